"""How much the sources of a language differ in their use of terms, exactly.

Counts are dealt by (language, source, term) once; terms in too few documents go. Terms whose counts over the sources, as
a sparse vector, are the same make equal contributions to every pair of sources, so the pairs of a vector's sources are
evaluated once for each distinct vector and multiplied by the number of its terms. What a term adds to a pair of which it
is in one source or in none depends on that source's count alone: it comes from the source's histogram of counts, once a
pair. So work grows with distinct vectors and counts instead of terms times pairs.

Nothing is rounded: shares are whole parts of 10^9, taken by decimal division. A vector has as many entries as a term has
sources, at most as many as the language has (the report has the square of that); long ones are paired in slices, in rows
of their own.

Defined results: null text, language and source count as ''; an empty table gives an empty report; a language without
kept terms gives pairs of value 0; repeated rows count each. A very long text is counted in parts; a task holds its
distinct terms at most.
Further columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: A term in lower-cased UTF-8 (no byte of a character beyond ASCII is below 0x80), and the parts that shares are counted in.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
PARTS = 1_000_000_000
SMOOTHING = 5
#: Vectors are paired in slices of so many sources.
SLICE = 64
#: Counts that a task holds before it hands them on, and terms that it handles at a time.
ENTRIES, TERMS = 600_000, 50_000


class _Counts:
    """Occurrences of terms, and texts with them, by group; handed on when there are many."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def add(self, group: tuple[str, str], text: bytes) -> None:
        n, docs = self.groups.setdefault(group, (Counter(), Counter()))
        terms, seen = (m[0] for m in _TERM.finditer(text)), set()
        while part := list(islice(terms, TERMS)):  # a long text in parts
            n.update(part)
            seen.update(part)
        docs.update(seen)

    def batch(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if sum(len(n) for n, _ in self.groups.values()) < least:
            return
        for (lang, source), (n, docs) in self.groups.items():
            terms = list(n)
            for at in range(0, len(terms), TERMS):
                part = terms[at : at + TERMS]
                columns = [[lang] * len(part), [source] * len(part), pa.array(part, pa.binary()).cast(pa.string()), [n[t] for t in part], [docs[t] for t in part]]
                yield pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "term", "n", "docs"), columns)))
        self.groups.clear()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Counts()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                held.add((lang, source), text.encode().lower())  # of bytes, A-Z alone
            yield from held.batch(ENTRIES)
    yield from held.batch()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term), summed in each task before they are dealt."""
    of = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = of.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """Parts of 10^9 of a smoothed count; null without terms."""
    above = F.lit(PARTS).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(19,0)")
    below = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def scored(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Kept counts with their share in the group (p), the share of a missing term there (z) and that in the language (q);
    and the groups: lang, source, terms (kept in the language) and z."""
    counts = materialize(term_counts(docs))
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"))
    rows = materialize(counts.drop("docs").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = every.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    filled = groups.na.fill(0, ["total", "terms", "lang_total"])
    groups = materialize(filled.withColumn("z", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    out = rows.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return materialize(out.select("lang", "source", "term", "n", p.alias("p"), "z", q.alias("q"))), groups.select("lang", "source", "terms", "z")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """lang, vector (sorted structs of source, n, p, z) and the number of terms with that vector."""
    entries = F.sort_array(F.collect_list(F.struct("source", "n", "p", "z"))).alias("vector")
    return rows.groupBy("lang", "term").agg(entries).groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("same"))


def shared_part(vectors: DataFrame) -> DataFrame:
    """For sources a < b that share terms: what these terms add beyond what the histograms of a and b count for them."""
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("vector") - 1) / SLICE)), lambda i: F.slice("vector", (i * SLICE + 1).cast("int"), SLICE))
    sliced = vectors.where(F.size("vector") > 1).select("lang", "same", slices.alias("slices"))
    twos = F.transform("slices", lambda s, i: F.transform(F.slice("slices", i + 1, F.size("slices")), lambda t: F.struct(s.alias("left"), t.alias("right"))))
    pairs = sliced.select("lang", "same", F.inline(F.flatten(twos))).hint("rebalance")

    def added(x: Column, y: Column) -> Column:
        value = F.abs(x["p"] - y["p"]) - F.abs(x["p"] - y["z"]) - F.abs(x["z"] - y["p"]) + F.abs(x["z"] - y["z"])
        return F.struct(x["source"].alias("a"), y["source"].alias("b"), (value * F.col("same")).alias("value"))

    of = F.flatten(F.transform("left", lambda x: F.transform(F.filter("right", lambda y: x["source"] < y["source"]), lambda y: added(x, y))))
    return pairs.select("lang", F.inline(of)).groupBy("lang", "a", "b").agg(F.sum("value").alias("shared"))


def pair_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value, the summed difference of shares over kept terms."""
    bars = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("same")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "same")).alias("bars"))
    whole = groups.join(bars, ["lang", "source"], "left")
    whole = whole.withColumn("bars", F.coalesce("bars", F.expr("cast(array() as array<struct<p: bigint, same: bigint>>)")))
    side = lambda s: whole.select("lang", *[F.col(c).alias(f"{s}_{c}") for c in ("source", "z", "bars")], *([F.col("terms")] if s == "a" else []))
    both = side("a").join(side("b"), "lang").where("a_source < b_source")
    far = F.abs(F.col("a_z") - F.col("b_z"))
    alone = lambda bars, z: F.aggregate(bars, F.lit(0).cast("long"), lambda sum_, x: sum_ + x["same"] * (F.abs(x["p"] - F.col(z)) - far))
    value = F.col("terms") * far + alone("a_bars", "b_z") + alone("b_bars", "a_z")
    closed = both.select("lang", F.col("a_source").alias("a"), F.col("b_source").alias("b"), F.coalesce(value, F.lit(0)).alias("value"))
    found = closed.join(shared_part(distinct_vectors(rows)), ["lang", "a", "b"], "left").select("lang", "a", "b", (F.col("value") + F.coalesce("shared", F.lit(0))).alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return found.select("lang", F.inline(ends), "value")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all other sources by difference, and the top terms by excess share."""
    rows, groups = scored(docs, min_docs)
    over = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), rank)
    return part(pair_values(rows, groups), "pair").unionByName(part(over, "term").where(F.col("rank") <= top))


SQL = rf"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (
  select d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as materialized (select lang, term, count(*) as n from words group by lang, term having count(distinct d) >= 30),
langs as (select l.lang, count(k.term) as v, coalesce(sum(k.n), 0) as total from (select distinct lang from docs) l left join kept k using (lang) group by l.lang),
groups as (select distinct lang, source from docs),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
totals as (select g.lang, g.source, coalesce(sum(c.n), 0) as total from groups g left join counts c using (lang, source) group by all),
cells as materialized (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + (cast({PARTS} as hugeint) * (coalesce(c.n, 0) + {SMOOTHING})) // cast(t.total + {SMOOTHING} * l.v as hugeint) as p,
         1 + (cast({PARTS} as hugeint) * (k.n + {SMOOTHING})) // cast(l.total + {SMOOTHING} * l.v as hugeint) as q
  from groups g join kept k using (lang) join totals t on t.lang = g.lang and t.source = g.source join langs l on l.lang = g.lang
  left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join cells x on x.lang = a.lang and x.source = a.source left join cells y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', term, p - q, row_number() over (partition by lang, source order by p - q desc, term) from cells where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 50"""
