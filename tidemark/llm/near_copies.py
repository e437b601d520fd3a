"""Near copies: components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one node. The method is that of operator 2, with 5-word shingles: each set has a SimHash fingerprint, its
BK-trees find the fingerprints within four bits, and their forests of links are candidates that are verified on the sets.
At 0.8 most fingerprints lie farther apart than that, and a link of a forest may fail the similarity, so that MinHash lists
follow for what these links leave apart. The hashes of a set give BANDS bands of ROWS MinHash values; nodes of an equal band are a list.
Two sets of similarity 0.8 share a list with a probability of 1 - (1 - 0.8**ROWS)**BANDS = 0.9997. Along with the links
of fingerprints each node is compared with the centre of most of its lists, one pair a node, which joins the families. Then all members of a list that
are in different components are compared by their signatures, a byte of each MinHash value, in blocks of CELL members
(a list of any size is dealt to as many tasks as it has pairs of blocks, and blocks of one component never meet). Members
with a partner whose signature allows the similarity (2e-5 of the pairs at 0.8 are lost) get their whole sets and are
verified within the same pair of blocks, by 40 bits of each hash: nothing below the similarity is linked, whatever
collides. Rows are members, never pairs; a task returns the links that join its components, fewer than it has members.

Words are split and lower-cased as in operator 2. Defined results: a text of fewer words than a shingle is one shingle;
texts without words, null ones too, are copies of each other; a null doc_id takes part but names no component unless it
is alone. Rows are judged by id and text, not by id alone: rows that share an id may be in different components, and one
row of each component stays whatever its id. An empty table gives an empty result; a very long text is one set of as many
hashes as it has words at most; further columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash_dedup
from tidemark.llm.common import materialize, partitions
from tidemark.llm.simhash_dedup import component_ids, components
from tidemark.llm.wordarrays import MUL, mixed, pack, rolling, runs, unpack

SHINGLE, SHARE = 5, 0.8
BANDS, ROWS = 20, 5
#: Cells of the filter of the nodes whose sets are sent (false positives only send more), and pairs of a node in a task.
CELLS, DEALT = 1 << 25, 64
#: Members and shingles of a list in a block, and equal signature bytes of a pair to verify.
CELL, CELL_SHINGLES, EQUAL = 4096, 4 << 20, 62
MEMBER = ["s", "i", "j", "block", "id", "root", "n", "keys", "sig"]
EPS = 1e-9


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(mixed(rolling(h, min(shingle, len(words)))))


def node_of(own: np.ndarray) -> int:
    """A signed hash of the whole set; 0 for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def bands(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The band values of a set and its signature; none for the empty one."""
    if not len(own):
        return np.zeros(0, np.uint64), b""
    factors = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * MUL) | np.uint64(1)  # each an order of all hashes
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        np.minimum(least, (own[at : at + 4096, None] * factors).min(axis=0), out=least)
    value = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        value = mixed(value * MUL + row)
    return value, mixed(least).astype(np.uint8).tobytes()


def _row(docs: DataFrame) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _records(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row (a hash of the text), fp (the node), n (the size of its set), print (its SimHash), keys (its bands) and sig (its signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [shingles(t, shingle) for t in part.column(2).to_pylist()]
                keys, sigs = zip(*map(bands, own))
                ends = np.cumsum([0, *map(len, keys)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
                columns = [part.column(0), part.column(1), pa.array([node_of(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([simhash_dedup.simhash(x) for x in own], pa.int64()), listed, pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fp", "n", "print", "keys", "sig"])

    return docs.select(F.col("doc_id").cast("long"), _row(docs), "text").mapInArrow(run, "doc_id long, row long, fp long, n long, print long, keys array<long>, sig binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, id, n), sorted by s and in runs of id, repeats included, to (s, id, n, c, cn): every other member of a list with its first one."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, i, n = (batch.column(k).to_numpy() for k in range(3))
        new = np.r_[not last or (s[0], i[0]) != last[:2], (s[1:] != s[:-1]) | (i[1:] != i[:-1])]
        begin = runs(s)
        sizes = np.diff(np.r_[begin, len(s)])
        c, cn = i[begin], n[begin]
        if last and last[0] == s[0]:
            c[0], cn[0] = last[2:]
        last = (s[-1], i[-1], c[-1], cn[-1])
        c, cn = np.repeat(c, sizes), np.repeat(cn, sizes)
        other = new & (i != c)
        yield pa.RecordBatch.from_arrays([pa.array(x[other]) for x in (s, i, n, c, cn)], names=["s", "id", "n", "c", "cn"])


def _fit(a: str, b: str, share: float) -> Column:
    """Whether the sizes allow the similarity."""
    return F.least(a, b) >= F.lit(share) * F.greatest(a, b) - F.lit(EPS)


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(fp, own) with the whole sets of at least the nodes in ids; a filter of constant size keeps back most others."""
    cell = F.pmod("id", F.lit(CELLS))
    words = ids.select(F.shiftright(cell, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(id, {CELLS}) & 31 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()
    bits = np.zeros(CELLS >> 5, np.uint32)
    bits[table.column("w").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                fp, own = [], []
                for text in batch.slice(at, 512).column(0).to_pylist():
                    x = shingles(text, shingle)
                    node = node_of(x)
                    if shared.value[node % CELLS >> 5] >> np.uint32(node % CELLS & 31) & 1:
                        fp.append(node)
                        own.append(pack(np.unique(x & np.uint64((1 << 40) - 1)), 5))
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(own, pa.binary())], names=["fp", "own"])

    return docs.select("text").mapInArrow(run, "fp long, own binary").groupBy("fp").agg(F.first("own").alias("own"))


def _alike(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (unpack(v.as_py(), 5) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= share * (len(x) + len(y) - both) - EPS)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(2)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, share: float = SHARE) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (fp, own) are alike; a node in many pairs is dealt out."""
    rows = pairs
    for node, other in ("a", "b"), ("b", "a"):
        parts = pairs.groupBy(node).agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("parts")).where("parts > 1")
        rows = rows.join(parts, node, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1)))).drop("parts")
        copies = sets.join(parts.withColumnRenamed(node, "fp"), "fp", "left").select(F.col("fp").alias(node), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"), F.col("own").alias(f"own_{node}"))
        rows = rows.join(copies, [node, "salt"]).drop("salt")
    return materialize(rows.select("a", "b", "own_a", "own_b").mapInArrow(_alike(share), "a long, b long"))


def _by_fingerprint(records: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of nodes to be verified, fewer than there are nodes: those of one fingerprint with the first of them,
    and these first ones where operator 2 links their fingerprints."""
    nodes = records.where("n > 0").groupBy(F.col("fp").alias("id")).agg(F.first("print").alias("print"), F.first("n").alias("n"))
    first = F.min(F.struct("id", "n")).alias("first")
    prints = materialize(nodes.groupBy("print").agg(first))
    same = nodes.join(prints, "print").select("id", "n", F.col("first.id").alias("other"), F.col("first.n").alias("other_n"))
    near = simhash_dedup.links(prints.select(F.col("print").alias("fp")))
    for end in "a", "b":
        near = near.join(prints.select(F.col("print").alias(end), F.col("first").alias(f"first_{end}")), end)
    near = near.select("first_a.id", "first_a.n", F.col("first_b.id").alias("other"), F.col("first_b.n").alias("other_n"))
    may = same.unionByName(near).where(F.col("id") != F.col("other")).where(_fit("n", "other_n", share))
    return may.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))


def _rooted(nodes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """nodes with the root of each id as a column; a node without a link is its own."""
    return nodes.join(roots.select(F.col("node").alias("id"), F.col("root").alias(name)), "id", "left").withColumn(name, F.coalesce(name, "id"))


def _blocks(members: DataFrame, records: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of lists (s, id, n) of several components, by pairs (i, j) of blocks; see MEMBER.

    The largest component of a list has blocks of its own, no two of which meet.
    """
    nodes = records.groupBy(F.col("fp").alias("id")).agg(*(F.first(c).alias(c) for c in ("n", "keys", "sig")))
    members = _rooted(members, roots, "root")
    sizes = members.groupBy("s", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    cells = F.ceil(F.greatest(F.col("m") / CELL, F.col("n") / CELL_SHINGLES))
    sizes = sizes.groupBy("s").agg(F.max_by(F.struct("root", "m", "n"), F.struct("m", "root")).alias("main"), F.sum("m").alias("m"), F.sum("n").alias("n")).where("main.m < m")
    rest = sizes.select("s", F.col("main.root").alias("main"), (F.col("m") - F.col("main.m")).alias("m"), (F.col("n") - F.col("main.n")).alias("n")).withColumn("rest", cells).drop("m", "n")
    sizes = rest.join(sizes.select("s", "main.m", "main.n").withColumn("own", cells).drop("m", "n"), "s")
    block = F.when(F.col("root") == F.col("main"), F.col("rest") + F.pmod(F.xxhash64("id"), "own")).otherwise(F.pmod(F.xxhash64("id"), "rest"))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("own") - 1), lambda t: F.least(t, "block") < F.col("rest"))
    rows = members.drop("n").join(sizes, "s").withColumn("block", block).withColumn("t", F.explode(met))
    rows = materialize(rows.select("s", F.least("t", "block").alias("i"), F.greatest("t", "block").alias("j"), "block", "id", "root"))
    return rows.join(nodes, "id").select(*MEMBER)


def _dealt(rows: DataFrame) -> DataFrame:
    by = ["s", "i", "j"]
    return rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by, "id")


def _by_block(solve):
    """Rows sorted by their first columns s, i, j: solve for each pair of blocks, of which a task holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not len(held):
                continue
            s, i, j = (held.column(k).to_numpy() for k in ("s", "i", "j"))
            begin = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for start, end in zip(begin[:-1], begin[1:]):
                yield from solve(held.slice(start, end - start))
            held = held.slice(begin[-1])  # the last one may go on
        if held is not None and len(held):
            yield from solve(held)

    return run


def _close(pair: pa.Table, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y), sorted by x, of the members of different roots whose sizes and signatures allow the similarity.

    A pair that shares several lists is compared in that of its first common band.
    """
    root, n, block = (pair.column(k).to_numpy() for k in ("root", "n", "block"))
    s, i, j = (pair.column(k)[0].as_py() for k in ("s", "i", "j"))
    sig = np.frombuffer(b"".join(pair.column("sig").to_pylist()), np.uint8).reshape(len(n), -1)
    keys = pair.column("keys").combine_chunks().flatten().to_numpy().reshape(len(n), -1)
    step = max(1, (1 << 24) // sig.size)
    for at in range(0, len(n), step):
        own = slice(at, at + step)
        may = (np.minimum(n[own, None], n) >= share * np.maximum(n[own, None], n) - EPS) & (root[own, None] != root)
        may &= np.arange(len(n)) > np.arange(len(n))[own, None]
        if i != j:
            may &= block[own, None] != block
        x, y = np.nonzero(may)
        x += at
        for part in range(0, len(x), 1 << 17):
            u, v = x[part : part + (1 << 17)], y[part : part + (1 << 17)]
            near = (sig[u] == sig[v]).sum(axis=1) >= EQUAL
            u, v = u[near], v[near]
            common = keys[u] == keys[v]
            here = keys[u, common.argmax(axis=1)] == s
            if here.any():
                yield u[here], v[here]


def _tied(share: float):
    """The rows of the members that have a partner to be verified in their pair of blocks."""

    def solve(pair: pa.Table) -> Iterator[pa.RecordBatch]:
        may = np.zeros(len(pair), bool)
        for x, y in _close(pair, share):
            may[x] = may[y] = True
        yield from pair.filter(pa.array(may)).to_batches()

    return _by_block(solve)


def _forest(share: float):
    """Rows with their whole sets to the links (a, b) that join the alike ones: fewer than there are rows."""

    def solve(pair: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = pair.column("id").to_numpy()
        label = np.unique(pair.column("root").to_numpy(), return_inverse=True)[1]
        sets = [unpack(raw, 5) for raw in pair.column("own").to_pylist()]
        size = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        sets = np.split(codes, np.cumsum(size)[:-1])
        mark, found = np.zeros(int(codes.max()) + 1, bool), []
        for x, y in _close(pair, share):
            begin = runs(x)
            for one, others in zip(x[begin].tolist(), np.split(y, begin[1:])):
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                mark[sets[one]] = True
                ends = np.cumsum(size[others])
                both = np.add.reduceat(mark[np.concatenate([sets[k] for k in others])], ends - size[others], dtype=np.int64)
                mark[sets[one]] = False
                for other in others[both >= share * (size[one] + size[others] - both) - EPS].tolist():
                    if label[other] != label[one]:
                        found.append((ids[one], ids[other]))
                        label[label == label[other]] = label[one]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return _by_block(solve)


def links(docs: DataFrame, records: DataFrame, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """Verified edges (a, b) that connect the nodes of records (fp, n, print, keys, sig) of at least that similarity."""
    spark = docs.sparkSession
    postings = records.select(F.explode("keys").alias("s"), F.col("fp").alias("id"), "n").withColumn("turn", F.xxhash64("id", "s"))
    dealt = postings.repartition(partitions(spark), "s").sortWithinPartitions("s", "turn", "id").select("s", "id", "n")
    lists = materialize(dealt.mapInArrow(_stars, "s long, id long, n long, c long, cn long"))
    stars = lists.where(_fit("n", "cn", share)).groupBy(F.col("id").alias("a"), F.col("c").alias("b")).agg(F.count(F.lit(1)).alias("lists"))
    starred = stars.groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))
    starred = starred.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tried = materialize(starred.unionByName(_by_fingerprint(records, share)).distinct())
    ids = tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).distinct()
    found = verified(tried, materialize(_sets(docs, ids, shingle)), share)
    members = lists.select("s", "id", "n").unionByName(lists.select("s", F.col("c").alias("id"), F.col("cn").alias("n")).distinct())
    blocks = _blocks(members, records, components(found))
    tied = materialize(_dealt(blocks).mapInArrow(_tied(share), blocks.schema))
    sets = _sets(docs, tied.select("id").distinct(), shingle).select(F.col("fp").alias("id"), "own")
    rows = _dealt(tied.join(sets, "id").select(*MEMBER, "own"))
    return found.unionByName(materialize(rows.mapInArrow(_forest(share), "a long, b long")))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """doc_id and component_id of every row."""
    records = materialize(_records(docs, shingle))
    nodes = materialize(records.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(docs, records, shingle, share))
    return records.select("doc_id", "fp").join(component_ids(nodes, roots), "fp").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (of several, of one text; without an id where no row has one)."""
    records = materialize(_records(docs, shingle))
    classes = records.groupBy("doc_id", "row").agg(F.first("fp").alias("id"), F.count(F.lit(1)).alias("rows"))
    roots = components(links(docs, records, shingle, share))
    classes = materialize(_rooted(classes, roots, "root").select("doc_id", "row", "root", "rows"))
    first = materialize(classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "rows")).alias("first")).select("root", "first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    gone = materialize(classes.join(first, "root").where(~same).select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row")))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (_row(docs) == gone["_gone_row"]), "left_anti")
    repeated = first.where("first.rows > 1").select(F.col("first.doc_id").alias("_many_id"), F.col("first.row").alias("_many_row"))
    if repeated.isEmpty():
        return left
    of_many = left["doc_id"].eqNullSafe(repeated["_many_id"]) & (_row(left) == repeated["_many_row"])
    once = left.join(repeated, of_many, "left_semi").withColumn("_row", _row(left)).dropDuplicates(["doc_id", "_row"]).drop("_row")
    return left.join(repeated, of_many, "left_anti").unionByName(once)
