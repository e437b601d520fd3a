"""Texts as arrays of word hashes, and the packed rows in which such arrays are shuffled.

A row per n-gram would make a shuffle several times the size of the text. Tasks therefore send one row for each part of
their input and shard, with the entries as bytes of a few columns; Spark partitions, shuffles and sorts these rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Bytes of text and documents that are turned into arrays at once; a longer text is a part of its own.
PART_BYTES, PART_DOCS = 4 << 20, 50_000
MUL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space; bytes.split() knows no other."""
    return (text or "").encode().split()


def hashed(lists: list[list[bytes]], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all words, and the number of words of each list."""
    import xxhash

    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lists), repeat(seed)), np.uint64, int(sizes.sum())), sizes


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, word hashes) of bounded parts of (doc_id, text) batches."""

    def joined(ids: list[int], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.array(ids, np.int64), np.fromiter(map(len, held), np.int64, len(held)), np.concatenate(held)
        ids.clear()
        held.clear()
        return out

    for batch in batches:
        ids, held, load = [], [], 0  # hashes are held, not words, which take several times as much
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.append(hashed([words(text.as_py())])[0])
            ids.append(doc_id)
            load += held[-1].nbytes
            if load >= PART_BYTES or len(ids) >= PART_DOCS:
                yield joined(ids, held)
                load = 0
        if ids:
            yield joined(ids, held)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """The polynomial of each width consecutive hashes; width - 1 fewer than h."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * MUL + h[k : n + k]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """A shard from the upper bits, so that the lower ones tell apart what meets in it."""
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes, width: int, chosen: np.ndarray | None = None) -> np.ndarray:
    """The numbers of pack(), or those at chosen places."""
    low = np.frombuffer(raw, np.uint8).reshape(-1, width)
    low = low if chosen is None else low[chosen]
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    return out.reshape(-1).view("<u8")


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
