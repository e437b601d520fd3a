"""Removal of passages of WINDOW and more words that a document with a smaller doc_id holds, by fixed-block anchors.

Every document is cut into blocks of BLOCK words, which are indexed; every window of BLOCK words, at any position, is a
probe. A run of 2 * BLOCK - 1 words or more always contains a whole block of the document that holds it, so a repeat of
WINDOW words gives a hit. Index and probes meet in shards of their hashes. Each hit is then extended: the windows of
WINDOW words around it, on both sides of the match, are compared by two 64-bit hashes of all their words, in the order
of doc_id, so that a window is marked if a smaller document starts it, too. Adjoining marked windows are the maximal
repeats. No pairs are made: a block or passage of a million documents costs a probe or window for each of them. Both
rounds stream through a shard in sorted order and hold only its distinct blocks or windows; beyond PARTS shards a task
works through several of them, so that packed rows stay long and a task's memory doesn't grow. (Among n windows, two of
different words are taken for equal with a chance of n**2 / 2**129: 1e-11 for 1e14 windows.)

Defined results: a null text has no words; documents of fewer than WINDOW words lose none; a repeat within one document
or between rows of one doc_id is left; a null doc_id neither loses words nor takes any from others; a very long text is
a part of its own, held as arrays of its words' hashes; an empty table gives an empty result; further columns are left
alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordarrays import MUL, hashed, mixed, pack, parts, rolling, runs, shard_of, unpack, words

WINDOW, BLOCK = 50, 25
KEY = 5
_LOW = np.uint64((1 << 8 * KEY) - 1)
#: Entries of a shard that are compared at once, and text that a shard stands for. A task holds the distinct blocks or
#: windows of a shard; each document with repeats has a row for each shard they fall into.
CHUNK, SHARD_BYTES, PARTS = 500_000, 48 << 20, 8192
_ANCHORS = "shard int, kind int, docs binary, lens binary, keys binary"
_WINDOWS = "shard int, win_id long, hashes binary, positions binary"


def _spans(sizes: np.ndarray) -> np.ndarray:
    """The position of each word in its document."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _anchor_rows(kind: int, shard: np.ndarray, doc: np.ndarray, key: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """A row for each run of equal shards; doc holds ordinals in ids, in runs."""
    rows = []
    bounds = np.r_[runs(shard), len(shard)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        first = runs(doc[a:b])
        rows.append((int(shard[a]), kind, ids[doc[a:b][first]].tobytes(), np.diff(np.r_[first, b - a]).astype("<u4").tobytes(), pack(key[a:b], KEY)))
    return rows


def _among(key: np.ndarray, together: int) -> np.ndarray:
    """Which of the shards of a task a key belongs to."""
    return (mixed(key) % np.uint64(together)).astype(np.int64)


def _anchors_apart(together: int):
    """Packed rows of a task to rows of its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kind, docs, lens, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids, key = np.frombuffer(docs, np.int64), unpack(raw, KEY)
                doc, shard = np.repeat(np.arange(len(ids)), np.frombuffer(lens, "<u4")), part * together + _among(key, together)
                order = np.argsort(shard, kind="stable")
                yield _batch(_anchor_rows(kind, shard[order], doc[order], key[order], ids), _ANCHORS)

    return run


def _windows_apart(together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, doc_id, hashes, positions in zip(*(batch.column(i).to_pylist() for i in range(4))):
                full, at = np.frombuffer(hashes, np.uint64).reshape(2, -1), np.frombuffer(positions, "<u4")
                yield _batch(_window_rows(part * together + _among(full[0], together), doc_id, full, at), _WINDOWS)

    return run


def _window_rows(shard: np.ndarray, doc_id: int, full: np.ndarray, at: np.ndarray) -> list[tuple]:
    """A row for each shard of a document's windows: both hashes of each, and where they start."""
    order = np.argsort(shard, kind="stable")
    shard, full, at = shard[order], full[:, order], at[order].astype("<u4")
    bounds = np.r_[runs(shard), len(shard)]
    return [(int(shard[a]), doc_id, full[:, a:b].tobytes(), at[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]


def _anchors(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed rows (shard, kind, docs, lens, keys): 0 blocks, 1 probes, 2 blocks once more, to learn who probed them."""
        for ids, sizes, h in parts(batches):
            at, doc = _spans(sizes), np.repeat(np.arange(len(ids)), sizes)
            code = mixed(rolling(h, BLOCK))
            whole = np.flatnonzero((at + BLOCK <= np.repeat(sizes, sizes))[: len(code)])
            code, doc, at = code[whole], doc[whole], at[whole]
            shard = shard_of(code, shards)
            key = code & _LOW
            # Sorted by shard, document and hash, repeats within a document once.
            place = (shard.astype(np.uint64) << np.uint64(42)) | (doc.astype(np.uint64) << np.uint64(26)) | (key >> np.uint64(14))
            order = np.argsort(place, kind="stable")
            rows = []
            for kind, chosen in ((1, order), (0, order[at[order] % BLOCK == 0])):
                s, d, k = shard[chosen], doc[chosen], key[chosen]
                fresh = np.r_[True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | (k[1:] != k[:-1])] if len(s) else np.zeros(0, bool)
                packed = _anchor_rows(kind, s[fresh], d[fresh], k[fresh], ids)
                rows += packed + ([(r[0], 2, *r[2:]) for r in packed] if kind == 0 else [])
            if rows:
                yield _batch(rows, _ANCHORS)

    return run


def _hits(together: int):
    return lambda batches: _hits_of(batches, together)


def _hits_of(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """From packed rows sorted by shard and kind to (doc_id, keys with their shard) of probes that hit smaller documents and of blocks hit by larger ones."""
    shard, held, keys, low, high = -1, [], None, None, None
    for batch in batches:
        out_docs, out_keys = [], []
        for s, kind, docs, lens, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if s != shard:
                shard, held, keys = s, [], None
            ids, lens, key = np.frombuffer(docs, np.int64), np.frombuffer(lens, "<u4"), unpack(raw, KEY)
            doc = np.repeat(ids, lens)
            if kind == 0:
                held.append((key, doc))
                if sum(len(x[0]) for x in held[1:]) > CHUNK:
                    held = [_lowest(held)]
                continue
            if keys is None:
                keys, low = _lowest(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                high, held = low.copy(), []
            if not len(keys):
                continue
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[found] == key
            if kind == 1:
                np.maximum.at(high, found[known], doc[known])
                known &= low[found] < doc
            else:
                known &= high[found] > doc
            if known.any():
                hit_doc, hit_key = doc[known], (key[known] | (np.uint64(s // together) << np.uint64(8 * KEY)))
                bounds = np.r_[runs(hit_doc), len(hit_doc)]
                for a, b in zip(bounds[:-1], bounds[1:]):
                    out_docs.append(int(hit_doc[a]))
                    out_keys.append(hit_key[a:b].tobytes())
        if out_docs:
            yield pa.RecordBatch.from_arrays([pa.array(out_docs, pa.int64()), pa.array(out_keys, pa.binary())], names=["hit_id", "keys"])


def _lowest(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the smallest document of each."""
    key, doc = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = runs(key)
    return key[first], doc[first]


def _windows(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, win_id, hashes, positions) of the windows around the hits of (doc_id, text, list of keys)."""
        for batch in batches:
            for doc_id, text, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if doc_id is None or not lists:
                    continue
                h, _ = hashed([words(text.as_py())])
                if len(h) < WINDOW:
                    continue
                half = rolling(h, BLOCK)
                code = mixed(half)
                own = (code & _LOW) | (shard_of(code, shards).astype(np.uint64) << np.uint64(8 * KEY))
                hit = np.flatnonzero(np.isin(own, np.frombuffer(b"".join(lists), np.uint64)))
                near = np.zeros(len(h) + 1, np.int64)  # a window holds a hit if it starts at most WINDOW - BLOCK words before it
                np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
                np.add.at(near, hit + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: len(h) - WINDOW + 1])
                if not len(at):
                    continue
                power = np.uint64(pow(int(MUL), BLOCK, 1 << 64))
                again = rolling(hashed([words(text.as_py())], 1)[0], BLOCK)
                full = np.array([mixed(x[at] * power + x[at + BLOCK] + np.uint64(1)) for x in (half, again)])
                yield _batch(_window_rows(shard_of(full[0], shards), doc_id, full, at), _WINDOWS)

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From window rows sorted by shard and document to (lost_id, positions) of windows that a smaller document has."""

    def judge(rows: list[tuple], seen: np.ndarray) -> tuple[pa.RecordBatch | None, np.ndarray]:
        # Both hashes of a window as 16 bytes, which sort as one value.
        full = np.concatenate([np.frombuffer(r[1], np.uint64).reshape(2, -1).T for r in rows]).astype(">u8").reshape(-1).view("S16")
        at = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
        doc = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[2]) // 4 for r in rows])
        distinct, first, inverse = np.unique(full, return_index=True, return_inverse=True)  # the first holder is the smallest
        known = np.zeros(len(distinct), bool)
        if len(seen):
            known = seen[np.minimum(np.searchsorted(seen, distinct), len(seen) - 1)] == distinct
        lost = known[inverse] | (doc[first][inverse] < doc)
        out = None
        if lost.any():
            d, p = doc[lost], at[lost].astype("<u4")
            bounds = np.r_[runs(d), len(d)]
            lists = [p[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            out = pa.RecordBatch.from_arrays([pa.array(d[bounds[:-1]]), pa.array(lists, pa.binary())], names=["lost_id", "positions"])
        return out, np.union1d(seen, distinct[~known]) if not known.all() else seen

    shard, rows, load, seen = -1, [], 0, np.zeros(0, "S16")
    for batch in batches:
        for s, doc, full, at in zip(*(batch.column(i).to_pylist() for i in range(4))):
            # A chunk ends between documents: later rows of a document must not meet their own windows in seen.
            if rows and (s != shard or load >= CHUNK and doc != rows[-1][0]):
                out, seen = judge(rows, seen)
                if out:
                    yield out
                rows, load = [], 0
            if s != shard:
                shard, seen = s, np.zeros(0, "S16")
            rows.append((doc, full, at))
            load += len(at) // 4
    if rows:
        out, _ = judge(rows, seen)
        if out:
            yield out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, kept (the text that stays) of (doc_id, text, list of positions)."""
    for batch in batches:
        rows = []
        for doc_id, text, lists in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            own = words(text.as_py())
            gone = 0
            if lists:
                at = np.frombuffer(b"".join(lists), "<u4").astype(np.int64)
                at = np.unique(at[at + WINDOW <= len(own)])
                change = np.zeros(len(own) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                stays = np.cumsum(change)[:-1] == 0
                gone = int(len(own) - stays.sum())
                kept = b" ".join(compress(own, stays))
            else:
                kept = b" ".join(own)
            rows.append((doc_id, len(own), gone, kept))
            if len(rows) >= 256:
                yield _kept_batch(rows)
                rows = []
        if rows:
            yield _kept_batch(rows)


def _kept_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array([k.decode() for k in columns[3]], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        digests = [hashlib.sha256(k.encode()).hexdigest() for k in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _judged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, list of positions of marked windows or null) of every row."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // SHARD_BYTES)
    parts_ = min(shards, PARTS)
    together = -(-shards // parts_)

    def meet(rows: DataFrame, apart, schema: str, *order: str) -> DataFrame:
        """Rows in the task of their shards; where that has several, rows of one shard each."""
        rows = rows.repartitionById(parts_, "shard")
        return (rows if together == 1 else rows.mapInArrow(apart(together), schema)).sortWithinPartitions("shard", *order)

    packed = texts.where("doc_id is not null").mapInArrow(_anchors(parts_), _ANCHORS)
    hits = meet(packed, _anchors_apart, _ANCHORS, "kind").mapInArrow(_hits(together), "hit_id long, keys binary")
    hits = hits.groupBy("hit_id").agg(F.collect_list("keys").alias("lists"))
    # Both joins read the same exchange of the texts.
    near = texts.join(hits, texts["doc_id"] == hits["hit_id"], "left").select("doc_id", "text", "lists")
    windows = near.mapInArrow(_windows(parts_), _WINDOWS)
    lost = meet(windows, _windows_apart, _WINDOWS, "win_id").mapInArrow(_marked, "lost_id long, positions binary")
    lost = lost.groupBy("lost_id").agg(F.collect_list("positions").alias("lists"))
    return texts.join(lost, texts["doc_id"] == lost["lost_id"], "left").select("doc_id", "text", "lists")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay."""
    return _judged(docs).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def repeat_report(docs: DataFrame) -> DataFrame:
    return _judged(docs).mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: For unique doc_ids: the windows themselves, without anchors.
SQL = r"""
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, unnest(list_transform(generate_series(1, len(w) - 49), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) as h,
         unnest(generate_series(1, len(w) - 49)) as pos
  from words where len(w) >= 50),
holders as (select h, min(doc_id) as holder from windows group by h having count(distinct doc_id) > 1),
gone as (
  select doc_id, list_sort(list_distinct(flatten(list(generate_series(pos, pos + 49))))) as g
  from windows join holders using (h) where holder < doc_id group by doc_id),
marked as (
  select w.doc_id, w.w, coalesce(g.g, []) as g from words w left join gone g on w.doc_id = g.doc_id),
placed as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from marked),
lost as (select doc_id, unnest(g) as pos from marked),
kept as (
  select p.doc_id, string_agg(p.word, ' ' order by p.pos) as text
  from placed p where not exists (select 1 from lost l where l.doc_id = p.doc_id and l.pos = p.pos) group by p.doc_id)
select m.doc_id, len(m.w)::bigint as n_words, len(m.g)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from marked m left join kept k on m.doc_id = k.doc_id
"""
