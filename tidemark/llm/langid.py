"""Language identification with n-gram filters over bit masks of languages.

Each language has a Bloom filter of the character n-grams that are common in it. The filters are sliced by bit: a
table holds, for each position, a mask with one bit per language (several words of 64 bits if there are more languages),
so that the masks of a few positions, and-ed, give all languages that contain an n-gram. A text is decided by the number of its n-grams in each language (popcounts per bit),
corrected for the share of false positives that the filling of that language's filter implies.

Texts are lower-cased, everything but letters becomes a single space. Learned are texts with a non-null lang whose
crc32(doc_id as text) mod 5 is not 0, about MAX_TRAIN_ROWS for each language, chosen by a hash of doc_id. Defined
results: a null text or one without letters is und with score 0, as is every text if nothing could be learned; equal
counts go to the first language in alphabetical order; up to MAX_LANGUAGES values of lang are learned, each 64 taking
another 8 MB of masks that a task builds and every executor holds, and more raise a ValueError; a text of any length is hashed in stretches; repeated rows and null ids are predicted like any
other (a null doc_id isn't learned from); an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZES = (2, 3, 4)
#: Bounds: rows to learn from for each language, and the least share of its n-grams that an n-gram must have to enter a
#: language's filter (so that a filter holds at most 1 / MIN_RATE of them).
MAX_TRAIN_ROWS, MIN_RATE = 2000, 2e-5
#: Languages whose masks are broadcast: 64 slices of 8 MB.
MAX_LANGUAGES, SLICE = 4096, 64
#: An n-gram enters the filters of the languages in which it is at least this share as frequent as where it is most so.
NEAR_BEST = 0.5
BITS, PROBES = 20, 3
STRETCH = 1 << 18
#: N-grams that a task holds before it merges equal ones.
MERGE = 1 << 22
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of a text, stretch by stretch; nothing if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    for at in range(0, len(c), STRETCH):
        part = c[at : at + STRETCH]
        letter = _letters()[part]
        if not letter.any():
            continue
        part = np.r_[np.uint32(32), np.where(letter, part, 32), np.uint32(32)]
        keep = np.r_[True, (part[1:] != 32) | (part[:-1] != 32)]
        code = part[keep].astype(np.uint64)
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, max(SIZES) + 1):
            if len(code) < n:
                break
            gram = gram[: len(code) - n + 1] * _MUL + code[n - 1 :] + np.uint64(n)
            if n in SIZES:
                yield (gram ^ (gram >> np.uint64(31))) * _MIX


def positions(gram: np.ndarray, probe: int) -> np.ndarray:
    """The position of each n-gram in the table for one of the probes: another stretch of 20 bits of its hash."""
    return ((gram >> np.uint64(64 - BITS * (probe + 1))) & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Filters:
    """The sliced filters; built from arrays of n-gram hashes, one for each language, or from slices of up to 64 languages."""

    def __init__(self, languages: list[str], members: list[np.ndarray] | None = None, slices: list[np.ndarray] | None = None):
        self.languages = languages
        self.slices = slices if members is None else [self.sliced(members[i : i + SLICE]) for i in range(0, len(members), SLICE)]
        filled = [float(((m >> m.dtype.type(b)) & m.dtype.type(1)).mean()) for m, n in zip(self.slices, self._sizes()) for b in range(n)]
        self.false = np.array(filled) ** PROBES

    @staticmethod
    def sliced(members: list[np.ndarray]) -> np.ndarray:
        kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(members) <= n)
        masks = np.zeros(1 << BITS, kind)
        for bit, own in enumerate(members):
            for p in range(PROBES):
                np.bitwise_or.at(masks, positions(own, p), kind(1 << bit))
        return masks

    def _sizes(self) -> list[int]:
        return [min(SLICE, len(self.languages) - i) for i in range(0, len(self.languages), SLICE)]

    def languages_of(self, gram: np.ndarray) -> list[np.ndarray]:
        """For each slice the masks of the languages that contain each n-gram."""
        at = [positions(gram, p) for p in range(PROBES)]
        return [np.bitwise_and.reduce([masks[a] for a in at]) for masks in self.slices]

    def counts(self, gram: np.ndarray) -> np.ndarray:
        """For each language the number of n-grams whose mask has its bit."""
        out = []
        for mask, n in zip(self.languages_of(gram), self._sizes()):
            if mask.dtype == np.uint8:
                seen = np.bincount(mask, minlength=256)
                out += [seen[(np.arange(256) >> b) & 1 == 1].sum() for b in range(n)]
            else:
                out += [np.count_nonzero(mask & mask.dtype.type(1 << b)) for b in range(n)]
        return np.array(out)

    def decide(self, text: str | None) -> tuple[str, float]:
        counts, n = np.zeros(len(self.languages)), 0
        for gram in grams(text):
            n += len(gram)
            if self.languages:
                counts += self.counts(gram)
        if not n or not self.languages:
            return "und", 0.0
        share = np.clip((counts - n * self.false) / (1 - np.minimum(self.false, 0.999)) / n, 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best] / max(share.sum(), 1e-12)) if share[best] else 0.0


class _Counts:
    """Counts of n-grams by language; those not yet counted are sorted together, then merged with the counted ones."""

    def __init__(self):
        self.counted: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.new: dict[str, list[np.ndarray]] = {}
        self.load = 0

    def add(self, lang: str, gram: np.ndarray) -> None:
        self.new.setdefault(lang, []).append(gram)
        self.load += len(gram)
        if self.load > MERGE:
            self.merge()

    def merge(self) -> None:
        for lang, parts in self.new.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in self.counted:
                old, old_n = self.counted[lang]
                at = np.minimum(np.searchsorted(old, gram), len(old) - 1)
                known = old[at] == gram
                old_n[at[known]] += n[known]
                both, both_n = np.r_[old, gram[~known]], np.r_[old_n, n[~known]]
                order = np.argsort(both, kind="stable")
                gram, n = both[order], both_n[order]
            self.counted[lang] = gram, n
        self.new, self.load = {}, 0


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Filters:
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    names = sorted(r["lang"] for r in sizes.select("lang").limit(MAX_LANGUAGES + 1).collect())  # one row a language
    if not names:
        return Filters([], [])
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values to learn")
    drawn = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) * F.lit(2.0**-53)).cast("double")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for gram in grams(text):
                    counts.add(lang, gram)
        counts.merge()
        for lang, (gram, n) in counts.counted.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def build(part: pa.Table) -> pa.Table:
        at, gram = part.column("at").to_numpy(), part.column("gram").to_numpy().view(np.uint64)
        first = int(at[0]) // SLICE * SLICE
        masks = Filters.sliced([gram[at == x] for x in range(first, min(first + SLICE, len(names)))])
        return pa.table({"slice": pa.array([first // SLICE], pa.int32()), "masks": pa.array([masks.tobytes()], pa.binary())})

    sample = usable.join(F.broadcast(sizes), "lang").where(drawn * F.col("_rows") < max_rows).select("lang", "text")
    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counted.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * MIN_RATE).select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    most = F.max("rate").over(Window.partitionBy("gram"))  # a row a language at most
    common = rates.withColumn("most", most).where(F.col("rate") >= NEAR_BEST * F.col("most"))
    order = docs.sparkSession.createDataFrame(list(enumerate(names)), "at int, lang string")
    placed = common.join(F.broadcast(order), "lang").select("at", "gram")
    built = placed.groupBy(F.floor(F.col("at") / SLICE)).applyInArrow(build, "slice int, masks binary").toArrow()  # 8 MB a row
    empty = [Filters.sliced([np.zeros(0, np.uint64)] * min(SLICE, len(names) - i)) for i in range(0, len(names), SLICE)]
    made = dict(zip(built.column(0).to_pylist(), built.column(1).to_pylist()))
    return Filters(names, slices=[np.frombuffer(made[i], none.dtype) if i in made else none for i, none in enumerate(empty)])


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every row; only text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shared.value.decide(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
