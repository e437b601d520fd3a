"""A quality classifier with supervised subword embeddings.

Each word and each run of three to five characters within a word (ends marked) is hashed to a learned vector; a
document is the mean of its vectors, and a softmax over two classes gives its score. Numpy stochastic gradient descent
trains on a bounded sample of the labelled rows, in one task. For scoring, each vector is folded with the output layer
into one number, so that a score is a mean of table look-ups; the folded table of 2**BITS numbers is broadcast.

Only text is used for a score. Rows with crc32(doc_id as text) mod 5 equal to 0 are never learned from. Defined
results: null and empty texts have no features and get the score of the bias alone; repeated labels of a document count
once, with the larger value; rows without a label are only scored; with no usable label every score is 0.5; an empty
table gives an empty result; further columns are left alone. A text of any length is scored, stretch by stretch; repeated
rows get one score each; a document of several texts is learned from by the smallest one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS, DIM, EPOCHS, RATE = 18, 8, 5, 0.5
#: Bound on the labelled rows that are learned from, the first by a hash of doc_id.
MAX_TRAIN_ROWS = 4000
#: Bounds on their characters: of all of them, in the same order, and of one (a longer text is only scored).
MAX_TRAIN_CHARS, MAX_TRAIN_TEXT = 1 << 26, 1 << 20
THRESHOLD = 0.3
SIZES = (3, 4, 5)
#: Characters that are hashed at once; longer texts go in stretches that end at white space.
STRETCH = 1 << 18
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * _MIX
    return (code >> np.uint64(64 - BITS)).astype(np.int64)


def _stretch_features(c: np.ndarray) -> np.ndarray:
    """Feature ids of an array of code points that begins and ends with white space."""
    space = np.where(c < 128, _SPACE[np.minimum(c, 127)], False)
    code = c.astype(np.uint64)
    code[space] = 32
    out = []
    blocked = np.cumsum(space)
    gram = np.zeros(len(c), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(c) < n:
            break
        gram = gram[: len(c) - n + 1] * _MUL + code[n - 1 :] + np.uint64(n)
        if n in SIZES:  # a gram may have white space at its ends only
            inner = blocked[n - 2 : len(c) - 1] - blocked[: len(c) - n + 1]
            out.append(_bucket(gram[inner == 0]))
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(begin):
        power = np.cumprod(np.full(len(c), _MUL, np.uint64))
        inverse = np.cumprod(np.full(len(c), np.uint64(pow(int(_MUL), -1, 1 << 64)), np.uint64))
        total = np.r_[np.uint64(0), np.cumsum((code + np.uint64(77)) * power)]
        words = (total[end] - total[begin]) * inverse[begin]
        out.append(_bucket(words))
        pairs = words[1:] * _MIX + words[:-1]
        pairs[words[1:] == words[:-1]] = 1  # a word said twice is one feature, whichever word it is
        out.append(_bucket(pairs * _MUL))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def features(text: str | None) -> Iterator[np.ndarray]:
    """The hashed features of a text, stretch by stretch."""
    c = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    at = 0
    while at < len(c):
        stop = min(at + STRETCH, len(c))
        if stop < len(c):
            gaps = np.flatnonzero(_SPACE[np.minimum(c[at:stop], 127)] & (c[at:stop] < 128))
            stop = at + int(gaps[-1]) + 1 if len(gaps) else stop
        yield _stretch_features(np.r_[np.uint32(32), c[at:stop], np.uint32(32)])
        at = stop


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """The folded table and bias after plain SGD with a falling rate."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        ids, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *features(t)]), return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, weight = rows[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = weight @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = error @ out
            out -= rate * np.outer(error, mean)
            bias -= rate * error
            if len(ids):  # a vector moves in proportion to its share of the document, scaled up to its size
                vectors[ids] -= (rate * np.float32(40)) * np.outer(weight, back)
    edge = out[1] - out[0]
    return vectors @ edge, float(bias[1] - bias[0])


def score(text: str | None, table: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for ids in features(text):
        total += float(table[ids].sum(dtype=np.float64))
        n += len(ids)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, bias + total / max(1, n)))))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Learns labels (doc_id, quality) on at most max_rows rows, in one task of bounded size."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = docs.where("doc_id is not null").select("doc_id", "text")
    chars = known.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("_chars"), F.first("_label").alias("_label"))
    running = F.sum("_chars").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # max_rows numbers at most
    marked = chars.where(F.col("_chars") <= MAX_TRAIN_TEXT).withColumn("_running", running).where(F.col("_running") <= MAX_TRAIN_CHARS).select("doc_id", "_label")
    texts = known.join(F.broadcast(marked), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))  # repeated ids count once

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, t, y) for b in batches for d, t, y in zip(*(b.column(i).to_pylist() for i in range(3)))]
        if got:
            got.sort(key=lambda r: (r[0], r[1] or ""))
            table, bias = train([r[1] for r in got], np.array([r[2] for r in got]))
            yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f4").tobytes()]), pa.array([bias])], names=["weights", "bias"])

    model = texts.select("doc_id", "text", F.col("_label").cast("int")).repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model[0]["weights"], "<f4"), model[0]["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            scores = [score(t, table, bias) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def quality_report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; the texts pass through the scoring task, so nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            good = [score(t, table, bias) >= THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
