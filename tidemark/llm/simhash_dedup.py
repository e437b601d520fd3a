"""SimHash near-deduplication with BK-trees.

Fingerprints are made per document in Arrow batches. Only distinct fingerprints are searched. Two fingerprints of 64
bits that differ in at most four bits agree in one of five blocks of bits, so each fingerprint goes to five buckets, one
for each block and value; a bucket of over BUCKET fingerprints is split again by five blocks of the bits in which its
members differ, as the same argument holds for these, and so on until no bucket is larger (members that differ in four
bits are 16 at most). A bucket that is too large a second time is first told apart by a few bits, other ones each time,
without that each member goes to five parts; where the links within these parts connect all of its members, the bucket is
settled and not split again, so that a dense cluster's rows stay in proportion to its members.
Each bucket is the shard of one BK-tree: children are keyed by the Hamming distance to their parent, and a search follows
only the edges within the radius; it ends once all members of a bucket are connected. Trees are shipped to the tasks by a
shuffle, not by a broadcast, since they grow with the data. A task passes on a spanning forest of the links of its
buckets, never all pairs, and large-star / small-star rounds join the forests to components.

Defined results: null, empty and white-space-only texts have fingerprint zero and are linked like any other; repeated
rows share a component; a null doc_id takes part but names no component unless it is alone (null then); a text of any
length is one value of one row, its shingles are hashed at once; an empty table gives an empty result; further columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, partitions, store
from tidemark.llm.wordarrays import MUL, mixed

SHINGLE, SEED, RADIUS, BUCKET = 4, 42, 4, 4096
#: Rows of whole buckets that are searched together, and node visits expected of a block of queries.
CHUNK_ROWS, CHUNK_VISITS = 100_000, 4_000_000


def simhash(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a text's 4-word shingles, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes.lower() and bytes.split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
        starts, ends = at[: len(words) - SHINGLE + 1].tolist(), (at[SHINGLE:] - 1).tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts))
    return simhash(hashes)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


class Forest:
    """BK-trees over fingerprints that are sorted by bucket and distinct within a bucket; one tree for each bucket."""

    def __init__(self, bucket: np.ndarray, prints: np.ndarray):
        n = len(prints)
        self.prints = prints
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[first, n])
        self.root = np.repeat(first, self.sizes)
        parent, edge, child = [], [], []
        live = np.setdiff1d(np.arange(n), first)
        at = self.root.copy()
        while len(live):  # a level of all trees at once: the first of each (node, distance) becomes its child
            distance = np.bitwise_count(prints[live] ^ prints[at[live]]).astype(np.int64)
            _, index, inverse = np.unique(at[live] * 65 + distance, return_index=True, return_inverse=True)
            new = live[index]
            parent.append(at[new])
            edge.append(distance[index])
            child.append(new)
            at[live] = new[inverse]
            live = live[at[live] != live]
        parents = np.concatenate(parent) if parent else np.zeros(0, np.int64)
        order = np.argsort(parents, kind="stable")
        self.edge = (np.concatenate(edge) if edge else np.zeros(0, np.int64))[order]
        self.child = (np.concatenate(child) if child else np.zeros(0, np.int64))[order]
        self.begin = np.searchsorted(parents[order], np.arange(n + 1))

    def links(self, radius: int, done: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions, smaller first, within the radius in their bucket; queries go in blocks of bounded work.

        done holds a flag for each position and is read anew for each block: such positions aren't queried.
        """
        load = np.cumsum(np.repeat(self.sizes, self.sizes))
        cuts = np.searchsorted(load, np.arange(CHUNK_VISITS, (load[-1] if len(load) else 0) + CHUNK_VISITS, CHUNK_VISITS), side="left")
        start = 0
        for cut in cuts:
            stop = min(int(cut) + 1, len(self.prints))
            query = start + np.flatnonzero(~done[start:stop])
            node = self.root[query]
            start = stop
            while len(query):
                distance = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
                hit = (distance <= radius) & (query < node)
                if hit.any():
                    yield query[hit], node[hit]
                count = self.begin[node + 1] - self.begin[node]
                ends = np.cumsum(count)
                way = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(self.begin[node], count)
                query, distance = np.repeat(query, count), np.repeat(distance, count)
                follow = np.abs(self.edge[way] - distance) <= radius
                query, node = query[follow], self.child[way[follow]]


def _labels(forest: Forest, radius: int) -> np.ndarray:
    """The smallest member of each position's component; each block of pairs is merged and let go."""
    label, done = np.arange(len(forest.prints)), np.zeros(len(forest.prints), bool)
    first = np.cumsum(forest.sizes) - forest.sizes
    for a, b in forest.links(radius, done):
        while True:
            a, b = label[a], label[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, hop := label[label]):
                label = hop
        done[:] = np.repeat(np.logical_and.reduceat(label == forest.root, first), forest.sizes)
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, fp), sorted by both, repeats dropped, to the spanning forests of the buckets' links."""

    def solve(bucket: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (prints[1:] != prints[:-1])]
        bucket, prints = bucket[new], prints[new]
        label = _labels(Forest(bucket, prints.view(np.uint64)), RADIUS)
        tied = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(prints[tied]), pa.array(prints[label[tied]])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            bucket, prints = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if cut:
                yield solve(bucket[:cut], prints[:cut])
            held, rows = [(bucket[cut:], prints[cut:])], len(bucket) - cut
    if rows:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (fp, mask) to five (bucket, fp): the bits outside mask are dealt into five blocks, each joined to mask in one row."""
    for batch in batches:
        prints, masks = (batch.column(k).to_numpy().view(np.uint64) for k in range(2))
        rows = []
        for mask in np.unique(masks):
            own = prints[masks == mask]
            free = [b for b in range(64) if not int(mask) >> b & 1]
            for block in np.array_split(free, RADIUS + 1):
                known = mask | np.uint64(sum(1 << int(b) for b in block))
                rows.append((mixed(mixed(own & known) * MUL + known), own))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*rows)], names=["bucket", "fp"])


def _thin(limit: int):
    """Each (bucket, fp, differ, rows) to a few (bucket, fp): parts of limit / 2 members if the bits were even.

    A part's members agree in all differing bits but a run of them; the runs of all turns together are all differing bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, prints, differ = (batch.column(k).to_numpy().view(np.uint64) for k in range(3))
            rows, out = batch.column(3).to_numpy(), []
            order = np.argsort(bucket, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if not len(at):
                    continue
                own, bits = prints[at], [b for b in range(64) if int(differ[at[0]]) >> b & 1]
                width = len(bits) - (int(np.ceil(np.log2(rows[at[0]] / limit))) + 1)
                for start in range(0, len(bits) if width > 0 else 0, max(width, 1)):
                    start = min(start, len(bits) - width)
                    apart = np.uint64(sum(1 << b for b in bits[:start] + bits[start + width :]))
                    out.append((mixed(mixed(own & apart) * MUL + mixed(bucket[at] + apart)), own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out)], names=["bucket", "fp"])

    return run


def _unsettled(members: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of (bucket, fp, differ, rows) the parts (bucket, fp) of up to limit members, and the buckets (bucket) that their links don't connect."""
    parts = materialize(members.select("bucket", "fp", "differ", "rows").mapInArrow(_thin(limit), "bucket long, fp long"))
    small = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") <= limit)
    parts = materialize(parts.join(small.select("bucket"), "bucket", "left_semi"))
    roots = components(_solved(parts))
    root = F.coalesce("root", "fp")
    ends = members.join(roots, F.col("fp") == F.col("node"), "left").groupBy("bucket").agg(F.min(root).alias("low"), F.max(root).alias("high"))
    return parts, materialize(ends.where("low <> high").select("bucket"))


def buckets(prints: DataFrame, limit: int = BUCKET) -> DataFrame:
    """(bucket, fp), some of them twice: every two fingerprints within RADIUS meet in a bucket, or in a larger one whose
    members are connected by the pairs of other buckets. mask holds the bits in which those to be split agree.
    """
    level, out = prints.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        dealt = level.mapInArrow(_split, "bucket long, fp long")
        dealt = materialize(dealt if out is None else dealt.distinct())  # two buckets may have the same part
        differ = F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))
        sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), differ.alias("differ"))
        crowded = materialize(sizes.where((F.col("rows") > limit) & (F.bit_count("differ") > RADIUS)))
        rest = dealt.join(crowded, "bucket", "left_anti")
        again, out = out is not None, rest if out is None else out.unionByName(rest)
        if crowded.isEmpty():
            return out
        members = dealt.join(crowded, "bucket")
        if again:
            parts, unsettled = _unsettled(members, limit)
            out, members = out.unionByName(parts), members.join(unsettled, "bucket", "left_semi")
        level = members.select("fp", F.bitwise_not("differ").alias("mask"))


def _solved(dealt: DataFrame) -> DataFrame:
    rows = dealt.repartition(partitions(dealt.sparkSession), "bucket").sortWithinPartitions("bucket", "fp")
    return rows.mapInArrow(_links, "a long, b long").distinct()


def links(prints: DataFrame, limit: int = BUCKET) -> DataFrame:
    """Edges (a, b), a > b in no given order, that connect all distinct fingerprints within RADIUS."""
    return _solved(buckets(prints, limit))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, by alternating large-star and small-star rounds until nothing changes.

    The least neighbours are written before they are joined: both sides of a join are then plain exchanges, so that the
    rows of a component's centre can be split among tasks. A round's tables are dropped once the next one is written.
    """
    edges, drop = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, drop_low = store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large, drop_large = store(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least, drop_least = store(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select("e.a", F.col("e.m").alias("b"))
        edges, drop_new = store(small.where("a <> b").distinct())
        for done in (drop, drop_low, drop_large, drop_least):
            done()
        drop = drop_new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def component_ids(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id) of every (fp, first_id); the least first_id of a component names it."""
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return materialize(named.join(lowest, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, limit: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = materialize(fingerprints(docs))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    classes = component_ids(distinct, components(links(distinct.select("fp"), limit)))
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
