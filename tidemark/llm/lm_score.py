"""Stupid-backoff scores of every document under a bigram model of all other documents.

Words are runs of anything but ASCII white space. With counts c over the whole table, a word w behind v in document d gets
(c(v w) - c_d(v w)) / c(v) if other documents hold the bigram, else ALPHA * c(w) / N; a first word gets c(w) / N. The
score of a document is the sum of the decimal logarithms.

The count tables are partitioned by hash and joined to the documents' own bigrams there: bigrams meet in the shard of
their first word, so that c(v w) and c(v) are sums over that shard; those without support elsewhere go on to the shard
of their second word, where the unigram table waits; sums per document come last. Words that make up more than 1 / HOT of
all words are HOT at most, at any size of the corpus. Their counts are broadcast, and their bigrams are dealt by the
whole bigram; bigrams of that share (HOT at most again, among those that have half of it in some part) are dealt by
document, too. So no group that meets in one place has more than 1 / HOT of the words. Rows are packed (see wordarrays):
a frequent word takes two bytes, another one eight of its XXH64. A shard holds about SHARD_WORDS words; beyond PARTS
shards a task works through several of them in sorted order, so that packed rows stay long and a task's memory doesn't
grow. Summands are whole numbers of 1e-9, so that a score is the same however the table is partitioned.

Defined results: a null or empty text has no words, score 0 and a null mean; repeated rows are documents of one doc_id
whose words and scores are added up, each row getting the sums; a null doc_id is counted, but not scored (score null); a
very long text is a part of its own and dealt like others; an empty table gives an empty result; further columns are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize
from tidemark.llm.wordarrays import MUL, mixed, parts, runs, shard_of

ALPHA, UNIT = 0.4, 1e9
SHARD_WORDS, SLICE, PARTS = 2_000_000, 250_000, 8192
#: Bound on frequent words; their codes fit in two bytes.
HOT = 65_000
#: Code behind a last word, so that the bigrams of a word are as many as the word; never scored.
END = np.uint64(0)
_RARE = np.uint64(1 << 63)
NOBODY = -(2**63)
#: Rows between the rounds. 0: bigrams, 1: second words without support, 2: sums, 3: first words, 4: unigram counts.
PACKED = "shard int, kind int, docs binary, ords binary, first binary, second binary, own binary"
_TYPES = (pa.int32(), pa.int32(), *[pa.binary()] * 5)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=[x.split()[0] for x in PACKED.split(", ")])


def _later(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word in its text, and the places of non-first words."""
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at, np.flatnonzero(at > 0)


def _pair_id(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) * MUL + second) >> np.uint64(1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 words; 1 bigrams of half a hot one's share of a part; 2 words of a document."""
    for ids, sizes, h in parts(batches):
        _, later = _later(sizes)
        key, n = np.unique(h, return_counts=True)
        pairs, m = np.unique(_pair_id(h[later - 1], h[later]), return_counts=True)
        often = m > max(1, len(h) / HOT / 2)
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(key), int(often.sum()), len(ids)])
        keys = np.r_[key.view(np.int64), pairs[often].view(np.int64), ids]
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(keys), pa.array(np.r_[n, m[often], sizes])], names=["kind", "key", "n"])


class Hot:
    """Counts of frequent words or bigrams, sorted by key."""

    def __init__(self, rows: list[tuple[int, int]]):
        key, n = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
        order = np.argsort(key.view(np.uint64))
        self.key, self.n = key.view(np.uint64)[order], n[order]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Where each key is, -1 if it isn't there."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def count(self, key: np.ndarray) -> np.ndarray:
        at = self.find(key)
        return np.where(at >= 0, self.n[at], 0) if len(self.n) else np.zeros(len(key), np.int64)


class Model:
    """What every task knows: the number of words and shards, and the counts of frequent words and bigrams."""

    def __init__(self, total: int, shard_words: int, least_shards: int, words: Hot):
        self.total, self.words, self.pairs = total, words, Hot([])
        self.shards = max(least_shards, total // shard_words)
        self.parts = min(self.shards, PARTS)
        self.runs = -(-self.shards // self.parts)  # shards of a task
        self.share = max(1.0, total / self.shards / 4)

    def coded(self, h: np.ndarray) -> np.ndarray:
        """Frequent words as 1, 2, ...; the others as their hash with the upper bit set."""
        at = self.words.find(h)
        return np.where(at >= 0, (at + 1).astype(np.uint64), h | _RARE)

    def frequent(self, code: np.ndarray) -> np.ndarray:
        """The counts of frequent words, 0 for others."""
        often = (code < _RARE) & (code != END)
        out = np.zeros(len(code), np.int64)
        out[often] = self.words.n[code[often].astype(np.int64) - 1]
        return out

    def of_word(self, code: np.ndarray) -> np.ndarray:
        return shard_of(mixed(code), self.shards)

    def of_pair(self, v: np.ndarray, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The shard of bigrams: of their first word, of the bigram if that is frequent, salted by document if the bigram is."""
        shard, often = self.of_word(v), np.flatnonzero(v < _RARE)
        pair = _pair_id(v[often], x[often])
        salts = np.maximum(1, np.ceil(self.pairs.count(pair) / self.share)).astype(np.uint64)
        salt = mixed(doc[often].view(np.uint64)) % salts
        shard[often] = (shard_of(mixed(pair), self.shards) + salt.astype(np.int64)) % self.shards
        return shard

    def logs(self, times: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.rint(times * np.log10(share) * UNIT).astype(np.int64)


def _count_pairs(shared, wanted: np.ndarray):
    """Counts of bigrams whose hash is wanted, by the codes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = shared.value, Hot([])
        held.key = wanted
        for _, sizes, h in parts(batches):
            _, later = _later(sizes)
            later = later[held.find(_pair_id(h[later - 1], h[later])) >= 0]
            key, n = np.unique(_pair_id(model.coded(h[later - 1]), model.coded(h[later])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _deal(shared):
    """Packs the distinct (document, bigram) of each part, with their counts, by task and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, sizes, h in parts(batches):
            w, (at, later), doc = model.coded(h), _later(sizes), np.repeat(np.arange(len(ids)), sizes)
            last = (np.cumsum(sizes) - 1)[sizes > 0]
            last = last[w[last] >= _RARE]  # the counts of frequent words are known
            v, x, d = w[np.r_[later - 1, last]], np.r_[w[later], np.full(len(last), END)], doc[np.r_[later, last]]
            rows = _packed(0, model.of_pair(v, x, ids[d]), d, v, x, ids, model.runs)
            x, d = w[at == 0], doc[at == 0]
            n = model.frequent(x)
            if (n > 0).any():
                names, sums = _sums(ids[d[n > 0]], model.logs(1, n[n > 0] / model.total))
                rows.append((0, 2, names.tobytes(), b"", b"", b"", sums.astype("<i8").tobytes()))
            x, d = x[n == 0], d[n == 0]
            rows += _packed(3, model.of_word(x), d, None, x, ids, model.runs)
            if rows:
                yield _batch(rows)

    return run


def _pack_codes(code: np.ndarray) -> bytes:
    """A bit for each code that tells whether it is frequent, then two or eight bytes of it."""
    rare = code >= _RARE
    return np.packbits(rare).tobytes() + code[~rare].astype("<u2").tobytes() + code[rare].astype("<u8").tobytes()


def _unpack_codes(raw: bytes, n: int) -> np.ndarray:
    head = -(-n // 8)
    rare = np.unpackbits(np.frombuffer(raw, np.uint8, head), count=n).astype(bool)
    often = n - int(rare.sum())
    out = np.zeros(n, np.uint64)
    out[~rare] = np.frombuffer(raw, "<u2", often, head)
    out[rare] = np.frombuffer(raw, "<u8", n - often, head + 2 * often)
    return out


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids as the first one and two bytes for each step, where these suffice; a byte in front tells."""
    steps = np.diff(ids)
    if len(steps) and 0 <= steps.min() and steps.max() < 1 << 16:
        return b"\1" + ids[:1].tobytes() + steps.astype("<u2").tobytes()
    return b"\0" + ids.tobytes()


def _unpack_ids(raw: bytes | pa.Buffer) -> np.ndarray:
    if not np.frombuffer(raw, np.uint8, 1)[0]:
        return np.frombuffer(raw, np.int64, -1, 1)
    return np.cumsum(np.r_[np.frombuffer(raw, np.int64, 1, 1), np.frombuffer(raw, "<u2", -1, 9)])


def _packed(kind: int, shard: np.ndarray, doc: np.ndarray, first: np.ndarray | None, second: np.ndarray, ids: np.ndarray, together: int, own: np.ndarray | None = None) -> list[tuple]:
    """A row for every so many shards together, numbered by them, with their entries, equal ones merged; doc holds ordinals in ids."""
    if not len(shard):
        return []
    shard = shard // together
    order = np.lexsort((doc, second, shard)) if first is None else np.lexsort((doc, second, first, shard))
    shard, doc, second = shard[order], doc[order], second[order]
    new = np.r_[True, (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1]) | (second[1:] != second[:-1])]
    if first is not None:
        first = first[order]
        new[1:] |= first[1:] != first[:-1]
    begin = np.flatnonzero(new)
    n = np.add.reduceat(np.ones(len(shard), np.int64) if own is None else own[order], begin)
    shard, doc, second = shard[begin], doc[begin], second[begin]
    first = first[begin] if first is not None else None
    out = []
    bounds = np.r_[runs(shard), len(shard)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        names, ordinal = np.unique(doc[a:b], return_inverse=True)
        kind_of = "<u2" if len(names) < 1 << 16 else "<u4"
        of_first = _pack_codes(first[a:b]) if first is not None else b""
        out.append((int(shard[a]), kind, _pack_ids(ids[names]), ordinal.astype(kind_of).tobytes(), of_first, _pack_codes(second[a:b]), n[a:b].astype("<u4").tobytes()))
    return out


def _entries(row: tuple) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(doc ids, first words, second words, own counts) of a packed row."""
    _, _, docs, ords, first, second, own = row
    ids, own = _unpack_ids(docs), np.frombuffer(own, "<u4")
    ordinal = np.frombuffer(ords, "<u2" if len(ids) < 1 << 16 else "<u4")
    return ids[ordinal], _unpack_codes(first, len(own)) if first else None, _unpack_codes(second, len(own)), own.astype(np.int64)


def _apart(shared):
    """Packed rows of several shards to rows of one shard each, for tasks that have more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if row[1] == 2:
                    yield _batch([row])
                elif row[1] == 4:
                    key, n = np.frombuffer(row[5], "<u8"), np.frombuffer(row[6], "<u8")
                    yield _batch(_unigram_rows(key, n, model.of_word(key)))
                else:
                    doc, first, second, own = _entries(row)
                    ids, ordinal = np.unique(doc, return_inverse=True)
                    shard = model.of_word(second) if first is None else model.of_pair(first, second, doc)
                    yield _batch(_packed(row[1], shard, ordinal, first, second, ids, 1, own))

    return run


def _sums(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, inverse = np.unique(doc, return_inverse=True)
    sums = np.zeros(len(names), np.int64)
    np.add.at(sums, inverse, value)
    return names, sums


def _score_pairs(shared):
    def cut_up(row: list[pa.Buffer], slices: int) -> tuple:
        """The columns of a packed row, sorted by slices of first words, and where each slice begins."""
        docs, ords, first, second, own = row
        ids, n = _unpack_ids(docs), own.size // 4
        first = _unpack_codes(first, n)
        part = ((mixed(first) >> np.uint64(8)) % np.uint64(slices)).astype(np.uint16)
        order = np.argsort(part, kind="stable")
        columns = (np.frombuffer(ords, "<u2" if len(ids) < 1 << 16 else "<u4"), first, _unpack_codes(second, n), np.frombuffer(own, "<u4"))
        return ids, *(c[order] for c in columns), np.searchsorted(part[order], np.arange(slices + 1))

    def solve(model: Model, shard: int, held: list[tuple], slices: int) -> Iterator[pa.RecordBatch]:
        """Scores a shard in slices of first words, into which each row has been cut once."""
        sums = []
        for k in range(slices):
            cut = [(ids[ords[c[k] : c[k + 1]]], *(x[c[k] : c[k + 1]] for x in (first, second, own))) for ids, ords, first, second, own, c in held]
            doc, first, second, own = (np.concatenate(x) for x in zip(*cut))
            if len(first):
                known, rest = solve_slice(model, doc, first, second, own.astype(np.int64))
                sums.append(known)
                if rest:
                    yield _batch(rest)
        if sums:  # of the whole shard: a document has few bigrams in a slice
            names, values = _sums(*(np.concatenate(x) for x in zip(*sums)))
            yield _batch([(shard // model.runs, 2, names.tobytes(), b"", b"", b"", values.astype("<i8").tobytes())])

    def solve_slice(model: Model, doc: np.ndarray, first: np.ndarray, second: np.ndarray, own: np.ndarray) -> tuple[tuple, list[tuple]]:
        """Documents with what their bigrams add, and rows of those that need the count of their second word."""
        order = np.lexsort((second, first))
        doc, second, own, first = doc[order], second[order], own[order], first[order]
        by_first = runs(first)
        begin = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])

        def counted(starts: np.ndarray, known: np.ndarray) -> np.ndarray:
            n = np.add.reduceat(own, starts)
            return np.repeat(np.where(known > 0, known, n), np.diff(np.r_[starts, len(own)]))

        elsewhere = counted(begin, model.pairs.count(_pair_id(first[begin], second[begin]))) - own
        context = counted(by_first, model.frequent(first[by_first]))
        held = (elsewhere > 0) & (second != END)
        value = np.zeros(len(own), np.int64)
        value[held] = model.logs(own[held], elsewhere[held] / context[held])
        unigram = np.where(held, 0, model.frequent(second))
        quick = unigram > 0
        value[quick] = model.logs(own[quick], ALPHA * unigram[quick] / model.total)
        done = held | quick
        known = _sums(doc[done], value[done])
        rest = ~done & (second != END)
        doc, second, own = doc[rest], second[rest], own[rest]
        ids, ordinal = np.unique(doc, return_inverse=True)
        return known, _packed(1, model.of_word(second), ordinal, None, second, ids, model.runs, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        slices = max(1, model.total // model.shards // SLICE)
        shard, held = -1, []
        for batch in batches:
            to, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in range(batch.num_rows):  # a row is read where it lies, and only its cut columns are held
                if held and (to[k] != shard or kinds[k] != 0):
                    yield from solve(model, shard, held, slices)
                    held = []
                if kinds[k] == 0:
                    shard = int(to[k])
                    held.append(cut_up([batch.column(c)[k].as_buffer() for c in range(2, 7)], slices))
                else:
                    together = model.runs if kinds[k] == 3 else 1
                    row = [batch.column(c)[k].as_py() for c in range(1, 7)]
                    yield _batch([(int(to[k]) // together, *row)])
            del batch, to, kinds
        if held:
            yield from solve(model, shard, held, slices)

    return run


def _unigram_rows(key: np.ndarray, n: np.ndarray, shard: np.ndarray) -> list[tuple]:
    order = np.lexsort((key, shard))
    shard, key, n = shard[order], key[order], n[order]
    bounds = np.r_[runs(shard), len(shard)]
    return [(int(shard[a]), 4, b"", b"", b"", key[a:b].astype("<u8").tobytes(), n[a:b].astype("<u8").tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]


def _unigrams(shared):
    """The counts of words that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            key, n = model.coded(batch.column(0).to_numpy().view(np.uint64)), batch.column(1).to_numpy()
            key, n = key[key >= _RARE], n[key >= _RARE]
            if len(key):
                yield _batch(_unigram_rows(key, n, model.of_word(key) // model.runs))

    return run


def _back_off(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard, unigram counts first, to parts of scores, packed by the task of their documents."""
        model = shared.value
        shard, table, key, n, held, load, limit = -1, [], None, None, [], 0, SLICE

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                names, sums = _sums(*(np.concatenate(x) for x in zip(*held)))
                to = shard_of(mixed(names.view(np.uint64)), model.parts)
                order = np.argsort(to, kind="stable")
                to, names, sums = to[order], names[order], sums[order]
                bounds = np.r_[runs(to), len(to)]
                cut = list(zip(bounds[:-1], bounds[1:]))
                home = pa.array(to[bounds[:-1]].astype(np.int32))
                docs = pa.array([names[a:b].tobytes() for a, b in cut], pa.binary())
                values = pa.array([sums[a:b].astype("<i8").tobytes() for a, b in cut], pa.binary())
                yield pa.RecordBatch.from_arrays([home, docs, values], names=["home", "docs", "parts"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(i)[k].as_py() for i in range(7)]
                if row[0] != shard:
                    shard, table, key = row[0], [], None
                if row[1] == 4:
                    table.append((np.frombuffer(row[5], "<u8"), np.frombuffer(row[6], "<u8").astype(np.int64)))
                    continue
                if row[1] == 2:
                    doc, value = np.frombuffer(row[2], np.int64), np.frombuffer(row[6], "<i8")
                else:
                    if key is None:
                        key, n = (np.concatenate(x) for x in zip(*table))
                        order = np.argsort(key)
                        key, n, table = key[order], n[order], []
                    doc, _, second, own = _entries(row)
                    value = model.logs(own, (ALPHA if row[1] == 1 else 1.0) * n[np.searchsorted(key, second)] / model.total)
                held.append((doc, value))
                load += len(doc)
                if load > limit:
                    held = [_sums(*(np.concatenate(x) for x in zip(*held)))]
                    load = len(held[0][0])
                    if load > 4 * SLICE:
                        yield from flush()
                        held, load = [], 0
                    limit = max(SLICE, 2 * load)
        yield from flush()

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of scores to sums of bounded runs of them, (scored_id, score)."""
    held, load = [], 0

    def flush() -> pa.RecordBatch:
        names, sums = _sums(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], names=["scored_id", "score"])

    for batch in batches:
        for docs, values in zip(*(batch.column(i).to_pylist() for i in range(2))):
            held.append((np.frombuffer(docs, np.int64), np.frombuffer(values, "<i8")))
            load += len(held[-1][0])
            if load > 8 * SLICE:
                yield flush()
                held, load = [], 0
    if held:
        yield flush()


def score(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, score and mean_score of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc_id"), "text")
    counts = materialize(texts.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = counts.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT words, and 2 * HOT bigrams, can have such counts.
    words = Hot([(r["key"], r["n"]) for r in counts.where((F.col("kind") == 0) & (F.col("n") > total / HOT)).select("key", "n").collect()])
    wanted = counts.where((F.col("kind") == 1) & (F.col("n") > total / HOT / 2)).select("key").collect()
    model = Model(total, shard_words, 2 * spark.sparkContext.defaultParallelism, words)
    if wanted:
        likely = np.sort(np.array([r["key"] for r in wanted], np.int64).view(np.uint64))
        found = texts.mapInArrow(_count_pairs(spark.sparkContext.broadcast(model), likely), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        model.pairs = Hot([(r["key"], r["n"]) for r in found.where(F.col("n") > total / HOT).collect()])
    shared = spark.sparkContext.broadcast(model)

    def meet(rows: DataFrame, *order) -> DataFrame:
        """Rows in the task of their shards; where that has several, rows of one shard each."""
        rows = rows.repartitionById(model.parts, "shard")
        return (rows if model.runs == 1 else rows.mapInArrow(_apart(shared), PACKED)).sortWithinPartitions(*order)

    scored = meet(texts.mapInArrow(_deal(shared), PACKED), "kind", "shard").mapInArrow(_score_pairs(shared), PACKED)
    unigrams = counts.where("kind = 0").select("key", "n").mapInArrow(_unigrams(shared), PACKED)
    backed = meet(scored.unionByName(unigrams), "shard", F.desc("kind")).mapInArrow(_back_off(shared), "home int, docs binary, parts binary")
    sums = backed.repartitionById(model.parts, "home").select("docs", "parts").mapInArrow(_add_up, "scored_id long, score long")
    sums = sums.groupBy("scored_id").agg(F.sum("score").alias("score"))
    sizes = counts.where("kind = 2").select(F.col("key").alias("sized_id"), F.col("n").alias("n_words"))
    out = texts.select("doc_id").join(sizes, F.col("doc_id") == F.col("sized_id")).join(sums, F.col("doc_id") == F.col("scored_id"), "left")
    named = F.col("doc_id") != F.lit(NOBODY)
    total_score = F.when(named, F.round(F.coalesce("score", F.lit(0)) / UNIT, 3))
    mean = F.when(F.col("n_words") > 0, F.round(total_score / F.col("n_words"), 6))
    return out.select(F.when(named, F.col("doc_id")).alias("doc_id"), "n_words", total_score.alias("score"), mean.alias("mean_score"))
