"""Removal of lines that many documents share, by DataFrame functions alone.

Lines are exploded as 128-bit hashes of their normalised form, documents are counted per hash, and the text is
put together again from the stretches between dropped positions. Line texts are never shuffled: the exploded rows
carry hashes and positions, and the documents move once, for the join by doc_id and a hash of the text.

Defined results: a null or empty text is one empty line; an empty table gives an empty result; rows that repeat a
doc_id count as one document, and each keeps or loses its own lines; a null doc_id holds no line for others and loses
none. A line in any number of documents costs a row for each of them; the positions that a row loses are one array, so
at most as long as the row's own text. Further columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WS_CHARS, ascii_lower, materialize


#: Stands behind the last line of any text.
END = 2**31 - 1


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(WS_CHARS))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """Per line the two 64-bit hashes of its key, null where the key is too short."""

    def hashed(key: Column) -> Column:
        return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")))

    return F.transform(F.transform(_lines(text), line_key), hashed)


def _row_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; rows of one text lose the same lines."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, a hash of the text and the sorted positions of the lines it loses, END last; rows that lose none are absent."""
    keyed = docs.where("doc_id is not null").select("doc_id", _row_key(docs["text"]).alias("row"), F.posexplode(_hashes(F.col("text"), min_chars)).alias("pos", "h"))
    keyed = keyed.where("h is not null").select("doc_id", "row", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    common = (
        keyed.select("a", "b", "doc_id")
        .groupBy("a", "b")
        .agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("holder"))
        .where(F.col("n") >= min_docs)
        .select("a", "b", "holder")
    )
    # Written out, so that the join can broadcast a small table, or split the rows of a line that is everywhere.
    lost = keyed.join(materialize(common), ["a", "b"]).where("doc_id <> holder")
    return lost.groupBy("doc_id", "row").agg(F.concat(F.sort_array(F.collect_set("pos")), F.array(F.lit(END))).alias("drops"))


def _deduped(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, Column, Column, Column]:
    """Rows joined with what they lose, and as columns: the kept text, the number of lines, and that of dropped ones."""
    drops = dropped_positions(docs.select("doc_id", "text"), min_chars, min_docs).toDF("__tm_id", "__tm_row", "__tm_drops")
    same = (docs["doc_id"] == drops["__tm_id"]) & (_row_key(docs["text"]) == drops["__tm_row"])
    joined = docs.join(drops, same, "left").withColumn("__tm_lines", _lines(docs["text"]))

    # Kept lines are the slices between one dropped position and the next: linear in the number of lines.
    def kept(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("__tm_drops", k - 1) + 1)
        return F.slice("__tm_lines", start + 1, end - start)

    untouched = F.col("__tm_drops").isNull()
    text = F.when(untouched, F.coalesce(docs["text"], F.lit(""))).otherwise(F.array_join(F.flatten(F.transform("__tm_drops", kept)), "\n"))
    dropped = F.when(untouched, 0).otherwise(F.size("__tm_drops") - 1)
    return joined, text, F.size("__tm_lines").cast("long"), dropped.cast("long")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs, with the same columns, text replaced by its kept lines."""
    joined, text, _, _ = _deduped(docs, min_chars, min_docs)
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines before dropping, n_dropped, and the digest of the kept text of every row."""
    joined, text, lines, dropped = _deduped(docs.select("doc_id", "text"), min_chars, min_docs)
    return joined.select("doc_id", lines.alias("n_lines"), dropped.alias("n_dropped"), F.sha2(F.encode(text, "UTF-8"), 256).alias("kept_sha256"))


#: For unique doc_ids.
SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (
  select key, max(doc_id) as holder from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (
  select k.doc_id, k.line, k.pos, (c.key is not null and k.doc_id <> c.holder) as lost
  from keyed k left join common c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where lost))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from judged group by doc_id
"""
