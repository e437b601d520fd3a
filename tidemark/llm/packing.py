"""Lexical retrieval packing: documents that share words share a training window.

Every document is encoded once and written to the shared folder with a routing key, the smallest hash of its token
trigrams, so that copies and near copies meet. A range shuffle on (key, doc_id) deals the documents into partitions of
even size, however many share a key. Within a partition, runs of BLOCK documents form the shards of an inverted index
with BM25 weights whose document frequencies and mean length come from all documents. A seed document opens a window,
the index returns its unused neighbours, best first, and these fill the window greedily; the last one is cut where the
window ends and its rest stays in the index. Whole windows of long documents need no neighbours. What is left at the
end of a partition is cut to lengths that are powers of two, so nothing is padded.

Defined results: a null text counts as empty, and an empty text is the one end-of-document id; repeated rows are packed
like any other; a null doc_id stays null; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, shared_dir

WINDOW, END_ID, BLOCK = 2048, 1, 512
K1, B = 1.2, 0.75
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def _encoders(name: str):
    """(quick encoder, special strings, full encoder). The quick one holds the same vocabulary as ranks."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(name))
    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return quick, [t.content for t in full.get_added_tokens_decoder().values()], full


def ids_of(text: str | None, tokenizer: str = TOKENIZER) -> np.ndarray:
    """The ids of a text with END_ID behind them; equal to those of the tokenizer's file (tests compare them)."""
    quick, special, full = _encoders(tokenizer)
    text = text or ""
    if any(s in text for s in special):
        return np.array(full.encode(text, add_special_tokens=False).ids + [END_ID], np.uint32)
    return np.append(quick.encode_to_numpy(text), np.uint32(END_ID))


def encode(text: str | None, tokenizer: str = TOKENIZER) -> list[int]:
    return ids_of(text, tokenizer).tolist()


def _key(ids: np.ndarray) -> int:
    """The smallest hash of the token trigrams, mixed so that keys spread evenly."""
    i = ids.astype(np.uint64)
    while len(i) < 3:
        i = np.r_[i, i[-1:]]
    h = (i[:-2] * np.uint64(0x9E3779B97F4A7C15) + i[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + i[2:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    least = h.min(keepdims=True) ^ np.uint64(0x5851F42D4C957F2D)
    return int((least * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)[0])


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, key and ids (little-endian, 16 bits where the vocabulary allows it), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [ids_of(t, tokenizer) for t in part.column(1).to_pylist()]
                narrow = [int(i.max()) < 1 << 16 for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_key(i) for i in ids], pa.int64()), pa.array(narrow), pa.array([i.astype("<u2" if n else "<u4").tobytes() for i, n in zip(ids, narrow)])],
                    names=["doc_id", "key", "narrow", "ids"],
                )

    path = shared_dir(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, narrow boolean, ids binary")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _ids(row_ids: bytes, narrow: bool) -> np.ndarray:
    return np.frombuffer(row_ids, "<u2" if narrow else "<u4")  # 16-bit ids are sorted by radix


def statistics(tokens: DataFrame) -> tuple[int, float, dict[int, int]]:
    """Documents, mean length, and documents for each id; as many rows as the vocabulary has ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, total = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for narrow, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = _ids(raw, narrow)
                seen = np.unique(ids)
                if len(seen) and seen[-1] >= len(found):
                    found = np.r_[found, np.zeros(int(seen[-1]) + 1 - len(found), np.int64)]
                found[seen] += 1
                rows, total = rows + 1, total + len(ids)
        at = np.flatnonzero(found)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[rows, total, found[at]])], names=["id", "n"])

    out = {r["id"]: r["n"] for r in tokens.select("narrow", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    rows, total = out.pop(-2, 0), out.pop(-1, 0)
    return rows, total / max(1, rows), out


class Shard:
    """An inverted index over a block of pieces with BM25 weights."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float):
        term, doc, weight = [], [], []
        self.terms = []
        for d, ids in enumerate(pieces):
            t, tf = np.unique(ids, return_counts=True)
            self.terms.append(t)
            term.append(t)
            doc.append(np.full(len(t), d))
            weight.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        terms = np.concatenate(term)
        order = np.argsort(terms, kind="stable")
        self.doc, self.weight = np.concatenate(doc)[order], (np.concatenate(weight) * idf[terms])[order]
        self.begin = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.size = len(pieces)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece for the distinct ids of the seed."""
        a, b = self.begin[self.terms[seed]], self.begin[self.terms[seed].astype(np.int64) + 1]
        count = b - a
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(a, count)
        return np.bincount(self.doc[at], self.weight[at], minlength=self.size)


class Packer:
    """Fills windows in one partition; sequences are numbered from first."""

    def __init__(self, first: int, idf: np.ndarray, mean: float):
        self.next, self.idf, self.mean = first, idf, mean
        self.pool: list[list] = []  # [doc_id, doc_tokens, start, ids] of what has no window yet
        self.out: list[tuple] = []

    def emit(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, total, start, ids in window:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // WINDOW * WINDOW
        for at in range(0, whole, WINDOW):
            self.emit([(doc_id, len(ids), at, ids[at : at + WINDOW])])
        if whole < len(ids):
            self.pool.append([doc_id, len(ids), whole, ids[whole:]])
        if len(self.pool) >= BLOCK:
            self.fill()

    def fill(self) -> None:
        """Packs all full windows of the block; less than a window stays in the pool."""
        pool, left = self.pool, np.array([len(p[3]) for p in self.pool])
        if left.sum() < WINDOW:
            return
        index = Shard([p[3] for p in pool], self.idf, self.mean)
        seeds, waiting = np.argsort(-left, kind="stable"), int(left.sum())
        for seed in seeds:
            while left[seed] and waiting >= WINDOW:
                window, room = [], WINDOW
                score = index.scores(int(seed))
                score[seed] = np.inf
                for d in np.argsort(-score, kind="stable"):
                    if not left[d]:
                        continue
                    take = min(room, int(left[d]))
                    doc_id, total, start, ids = pool[d]
                    window.append((doc_id, total, start, ids[:take]))
                    pool[d] = [doc_id, total, start + take, ids[take:]]
                    left[d] -= take
                    room -= take
                    if not room:
                        break
                self.emit(window)
                waiting -= WINDOW
        self.pool = [p for p in pool if len(p[3])]

    def finish(self) -> None:
        """Full windows, then the rest in lengths that are powers of two, largest first."""
        self.fill()
        rest = sum(len(p[3]) for p in self.pool)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            window = []
            while room:
                doc_id, total, start, ids = self.pool[0]
                take = min(room, len(ids))
                window.append((doc_id, total, start, ids[:take]))
                room -= take
                if take == len(ids):
                    self.pool.pop(0)
                else:
                    self.pool[0] = [doc_id, total, start + take, ids[take:]]
            self.emit(window)

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each piece of a document in a sequence; see PIECES."""
    spark = docs.sparkSession
    tokens = tokenized(docs, tokenizer)
    rows, mean, found = statistics(tokens)
    idf = np.zeros(max(found, default=0) + 1)
    for i, n in found.items():
        idf[i] = np.log(1 + (rows - n + 0.5) / (n + 0.5))
    shared = spark.sparkContext.broadcast((idf, max(mean, 1.0)))  # one number for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, *shared.value)
        for batch in batches:
            for doc_id, narrow, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                packer.add(doc_id, _ids(raw, narrow))
            if packer.out:
                yield packer.batch()
        packer.finish()
        if packer.out:
            yield packer.batch()

    dealt = tokens.repartitionByRange(partitions(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return dealt.select("doc_id", "narrow", "ids").mapInArrow(run, PIECES)
