"""Each operator against its SQL or a brute-force version, and the odd cases: nulls, empty and long texts, ties, repeats,
empty tables, further columns with clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tests.conftest import SMALL
from tidemark.llm import catalog, decontaminate, exact_dedup, langid, license_scan, line_dedup, lm_score, near_copies, packing, quality, simhash_dedup, substring_dedup
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, key string, label int"
WS = " \t\n\x0b\x0c\r"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    None, "", "   \t ", "one", "Two\twords\x0b", "three words here\n\nthree words here", "A line that is long enough to count\nunique tail one",
    "a LINE that is long enough to count  \nunique tail two", "  A line that is long enough to count\n", "A line that is long enough to count", "A line that is long enough to count",
    f"intro alpha {PASSAGE} outro", f"other start {PASSAGE} {PASSAGE}", f"x {PASSAGE}", "Und " * 300, LONG, LONG, LONG + " end", "émile zola  ünd <|endoftext|> \U0001f600",
    "Released under the MIT License.", "The work is RELEASED under the MIT\nlicense! Yes.", "12345 67890", "a b c d", "a b c d e", "a b c d e",
]


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), 1, "k", 0) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s", 3, 1, "k", 0), (None, f"null id {PASSAGE}", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]


def unique_ids(df):
    """odd without the row that repeats an id and the one that has none."""
    return df.where("doc_id is not null").dropDuplicates(["doc_id"])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, SMALL), duck, catalog.oracle_sql()[name])


# Exact and line deduplication


def keep_rule(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in WS), []).append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), keep == i, hashlib.sha256(norm.encode()).hexdigest())
    return out


def test_exact_dedup_odd_cases(spark, odd, nothing, tmp_path):
    rows = unique_ids(odd)
    rows.write.parquet(f"{tmp_path}/d.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in exact_dedup.dedup_path(spark, f"{tmp_path}/d.parquet").collect()}
    assert got == keep_rule([(r.doc_id, r.text) for r in rows.collect()])
    odd.write.parquet(f"{tmp_path}/o.parquet")
    assert exact_dedup.dedup_path(spark, f"{tmp_path}/o.parquet").count() == odd.count()
    nothing.write.parquet(f"{tmp_path}/n.parquet")
    assert exact_dedup.dedup_path(spark, f"{tmp_path}/n.parquet").count() == 0


def test_exact_dedup_takes_in_new_files_only(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    make((5, "same text"), (6, "lone")).write.parquet(f"{tmp_path}/d.parquet")
    base = f"file://{tmp_path}/base"
    first = {r.doc_id: r.keep_id for r in exact_dedup.dedup_path(spark, f"{tmp_path}/d.parquet", base).collect()}
    make((2, "sametext"), (7, "same  text")).write.mode("append").parquet(f"{tmp_path}/d.parquet")
    then = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.dedup_path(spark, f"{tmp_path}/d.parquet", base).collect()}
    assert first == {5: 5, 6: 6} and then == {5: (7, 3), 2: (7, 3), 7: (7, 3), 6: (6, 1)}


def test_exact_dedup_reads_no_sibling(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    make((1, "a b"), (2, "ab")).write.parquet(f"{tmp_path}/documents.parquet")
    make((0, "ab"), (9, "z")).write.parquet(f"{tmp_path}/documents.parquet.old")
    got = {r.doc_id: r.keep_id for r in exact_dedup.dedup_path(spark, f"{tmp_path}/documents.parquet").collect()}
    assert got == {1: 1, 2: 1}
    single = next((tmp_path / "documents.parquet").glob("*.parquet"))
    single.rename(tmp_path / "one.parquet")
    (tmp_path / "one.parquet2").write_bytes(b"no parquet")
    assert {r.doc_id: r.keep_id for r in exact_dedup.dedup_path(spark, f"{tmp_path}/one.parquet").collect()} == {1: 1, 2: 1}


def test_exact_dedup_keeps_one_row_of_rows_without_or_with_the_same_id(spark, tmp_path):
    rows = [(None, f"text {i % 150}") for i in range(300)] + [(4, "same"), (4, "sa me"), (4, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d.parquet")
    got = exact_dedup.dedup_path(spark, f"{tmp_path}/d.parquet").collect()
    assert len(got) == 303 and sum(r.kept for r in got if r.doc_id is None) == 150 and sum(r.kept for r in got if r.doc_id == 4) == 1


def test_exact_dedup_sends_few_texts_that_are_not_compared(spark):
    texts = spark.range(20_000).select(F.lit("f").alias("file"), F.col("id").alias("row"), F.lit("text").alias("text"))
    wanted = texts.where("row % 10 = 0").select("file", "row")
    near = exact_dedup._near(texts, wanted)
    assert near.columns == texts.columns
    assert near.join(wanted, ["file", "row"]).count() == 2_000
    assert near.count() < 2_020
    assert exact_dedup._near(texts, wanted.where("false")).count() == 0


def test_exact_dedup_compares_the_texts_of_a_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, _: F.lit("00"))  # any two texts of a length share a digest
    spark.createDataFrame([(1, "abc"), (2, "abd")], "doc_id long, text string").write.parquet(f"{tmp_path}/d.parquet")
    with pytest.raises(Exception, match="two texts share a SHA-256 digest"):
        exact_dedup.dedup_path(spark, f"{tmp_path}/d.parquet")


def line_rule(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(WS).translate(lower)
    holders = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_line_dedup_odd_cases(odd, nothing):
    rows = unique_ids(odd)
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.line_report(rows).collect()}
    assert got == line_rule([(r.doc_id, r.text) for r in rows.collect()])
    assert sum(v[1] for v in got.values()) > 0
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_rows_of_one_id_lose_their_own_lines(spark):
    line = "A line that four documents share"
    rows = [(5, f"{line}\nkeep me", 77), (5, "A first line of its own\nsecond unique", 78), (5, "x", 79), (5, None, 80), (6, f"q\n{line}", 81), (7, line, 82), (None, line, 83)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.n_lines: r.text for r in out.collect()} == {77: "keep me", 78: rows[1][1], 79: "x", 80: "", 81: "q", 82: line, 83: line}
    twice = docs.unionByName(docs)
    assert sorted(r.text for r in line_dedup.dedup_lines(twice).collect()) == sorted(2 * [r.text for r in out.collect()])


# Near duplicates


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    import xxhash

    w = [x for x in words((text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(small, small_rows, odd, nothing):
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(small).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    assert all(prints[i] == plain_fingerprint(t) for i, t in small_rows[:60])
    rows = unique_ids(odd)
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(rows).collect()}
    prints = {i: int(r.fingerprint, 16) for i, r in got.items()}
    assert all(prints[r.doc_id] == plain_fingerprint(r.text) for r in rows.collect())
    assert {i: r.component_id for i, r in got.items()} == brute_components(prints)
    assert simhash_dedup.near_duplicates(odd).count() == odd.count() and simhash_dedup.near_duplicates(nothing).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    rng = random.Random(5)
    centers = [rng.getrandbits(64) for _ in range(30)]
    prints = {c for c in centers} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 8))) for c in centers for _ in range(12)}
    prints = {p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute_components({p: p & (2**64 - 1) for p in prints})
    size = Counter(want.values())
    for limit in (4096, 8):
        got = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df, limit)).collect()}
        assert got == {p: c for p, c in want.items() if size[c] > 1 and p != c}


def test_tree_follows_only_edges_within_the_radius():
    rng = np.random.default_rng(2)
    prints = np.unique(rng.integers(0, 1 << 12, 400, dtype=np.uint64))
    forest = simhash_dedup.Forest(np.zeros(len(prints), np.int64), prints)
    found = {(int(a), int(b)) for x, y in forest.links(2, np.zeros(len(prints), bool)) for a, b in zip(x, y)}
    assert found == {(a, b) for a, b in combinations(range(len(prints)), 2) if int(prints[a] ^ prints[b]).bit_count() <= 2}


def test_dense_cluster_is_split_until_buckets_are_small(spark):
    rng = random.Random(3)
    prints = {0xABCDEF0123456789 ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 12))) for _ in range(600)} | {rng.getrandbits(64) for _ in range(50)}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    assert simhash_dedup.buckets(df, 40).distinct().groupBy("bucket").count().agg(F.max("count")).first()[0] <= 40
    want = brute_components({p: p & (2**64 - 1) for p in signed})
    size = Counter(want.values())
    got = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df, 40)).collect()}
    assert got == {p: c for p, c in want.items() if size[c] > 1 and p != c}


def test_a_dense_cube_makes_rows_in_proportion(spark):
    for bits in (10, 14):
        cube = spark.range(1 << bits).select(F.col("id").alias("fp"))
        assert simhash_dedup.buckets(cube, 64).count() < 32 << bits
    roots = simhash_dedup.components(simhash_dedup.links(cube, 64))
    assert roots.select("root").distinct().collect() == [(0,)] and roots.count() == (1 << bits) - 1


def test_dense_clusters_that_are_apart_stay_so(spark):
    """Cubes of 8 bits in two words of a code of distance 6, and a path between two of them: settled buckets lose no link."""
    cubes = [x | 0x3F << 20 for x in range(256)] + [x | 0x3F << 30 for x in range(256)] + [x | 0x3F << 40 for x in range(256)]
    prints = {*cubes, 0x3F << 30 | 0x07 << 40 | 1, 0x07 << 30 | 0x3F << 40 | 1}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    want = brute_components({p: p for p in prints})
    assert 1 < len(set(want.values())) < 4
    got = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.links(df, 16)).collect()}
    assert got == {p: c for p, c in want.items() if p != c}


def test_search_ends_once_a_bucket_is_connected():
    prints = np.unique(np.array([1 << a | 1 << b for a in range(40) for b in range(a)], np.uint64))
    forest = simhash_dedup.Forest(np.zeros(len(prints), np.int64), prints)
    old, simhash_dedup.CHUNK_VISITS = simhash_dedup.CHUNK_VISITS, 5000
    try:
        assert not simhash_dedup._labels(forest, 4).any()
        done = np.zeros(len(prints), bool)
        first = next(forest.links(4, done))
        done[:] = True
        assert len(first[0]) and not [x for x in forest.links(4, done)]
    finally:
        simhash_dedup.CHUNK_VISITS = old


def brute_copies(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    out = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and out[a] != out[b]:
            x, y = sorted((out[a], out[b]))
            out = {i: x if c == y else c for i, c in out.items()}
    return out


def test_pipeline_drops_near_copies_of_four_fifths(spark, small, small_rows, odd):
    import corpus_pipeline

    rng, rows = random.Random(7), []
    passage = [f"common{i}" for i in range(30)]
    for family in range(15):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(200)] + passage
        for changes in (0, 2, 4, 5, 6, 9, 12):
            own = list(base)
            for at in range(changes):
                own[at * 15 + 7] = f"new{family}x{changes}x{at}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, f"{passage[0]} {' '.join(passage)} own{i}") for i in range(50)]  # one large family
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_copies(rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()} == {i for i, c in want.items() if i == c}
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(small).collect()} == brute_copies(small_rows)
    rows = unique_ids(odd)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(rows).collect()} == brute_copies([(r.doc_id, r.text) for r in rows.collect()])


def test_near_copies_come_from_the_fingerprints_of_operator_2(spark):
    """Without any MinHash list, the sets whose fingerprints are within four bits are linked, where they are alike."""
    rng, rows = random.Random(5), [(1000, "a b c d e f"), (1001, "a b c d e g")]
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(600)]
        for k in range(12):
            own = list(base)
            own[rng.randrange(600)] = f"own{k}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    records = near_copies._records(docs, 5).withColumn("keys", F.array().cast("array<long>")).persist()
    nodes = {r.fp: r for r in records.collect()}
    root = {r.node: r.root for r in simhash_dedup.components(near_copies.links(docs, records)).collect()}
    records.unpersist()
    near = [(a, b) for a, b in combinations(nodes, 2) if bin((nodes[a].print ^ nodes[b].print) & (2**64 - 1)).count("1") <= 4]
    assert len(near) > 40
    assert all(root.get(a, a) == root.get(b, b) for a, b in near)
    assert not {a for a in nodes if nodes[a].doc_id >= 1000} & set(root)


@pytest.mark.parametrize(("cell", "cell_shingles"), [(4096, 4 << 20), (7, 4 << 20), (4096, 500)])
def test_near_copies_of_families_below_the_similarity(spark, monkeypatch, cell, cell_shingles):
    """Families whose members share lists, but of which few are alike: rows stay fewer than pairs, and no link is lost."""
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "CELL_SHINGLES", cell_shingles)
    rng, rows = random.Random(3), []
    for family in range(2):
        base = [f"f{family}w{k}" for k in range(120)]
        for _ in range(80):
            own = list(base)
            for at in rng.sample(range(120), rng.choice((1, 2, 3, 4))):
                own[at] = f"own{len(rows)}x{at}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    records = near_copies._records(docs, 5).persist()
    found = near_copies.links(docs, records)
    assert found.count() < 10 * len(rows)
    records.unpersist()
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == brute_copies(rows)


# Classifiers


def test_language_accuracy(spark, odd, nothing):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in langid.language_report(odd).collect()}
    assert all(got[i].lang_pred == "und" for i in (0, 1, 2, 21)) and got[4].lang_pred in ("en", "de")
    assert langid.language_report(nothing).count() == 0


def test_filters_return_all_languages_of_an_ngram():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(0, 2**63, 3000, dtype=np.uint64)
    f = langid.Filters(["x", "y"], [a, np.r_[b, a[:100]]])
    of = lambda g: f.languages_of(g)[0]
    assert (of(a) & 1).all() and (of(b) & 2).all() and (of(a[:100]) == 3).all()
    other = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (of(other) & 1).mean() < 0.01


@pytest.mark.parametrize("languages", [3, 13, 70, 130])
def test_decision_equals_brute_force(languages):
    """Membership from sets of the n-grams' positions in place of masks, counts one by one."""
    rng = random.Random(languages)
    texts = {f"l{k:03}": " ".join("".join(chr(97 + (7 * k + rng.randrange(9)) % 26) for _ in range(5)) for _ in range(60)) for k in range(languages)}
    members = [np.unique(np.concatenate(list(langid.grams(t)))) for t in texts.values()]
    f = langid.Filters(list(texts), members)
    held = [[set(langid.positions(m, p).tolist()) for p in range(langid.PROBES)] for m in members]
    for text in [*list(texts.values())[:: max(1, languages // 8)], "abc xyz", "q"]:
        own = np.concatenate(list(langid.grams(text)))
        at = list(zip(*(langid.positions(own, p).tolist() for p in range(langid.PROBES))))
        share = []
        for sets in held:
            n = sum(all(x in s for x, s in zip(places, sets)) for places in at)
            false = (len(set().union(*sets)) / (1 << langid.BITS)) ** langid.PROBES
            share.append(min(1, max(0, (n - len(at) * false) / (1 - false) / len(at))))
        best = max(range(languages), key=lambda k: (share[k], -k))
        assert f.decide(text) == (f"l{best:03}", pytest.approx(share[best] / sum(share) if share[best] else 0.0))


def test_learning_equals_brute_force(spark, monkeypatch):
    """The n-grams of each language counted one by one; a merge at every text, and a bound on languages."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("lang"))
    counts = {}
    for r in docs.where("lang is not null and text is not null").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            for gram in langid.grams(r.text):
                counts.setdefault(r.lang, Counter()).update(gram.tolist())
    rates = {x: {g: n / c.total() for g, n in c.items() if n >= c.total() * langid.MIN_RATE} for x, c in sorted(counts.items())}
    most = Counter()
    for own in rates.values():
        for g, rate in own.items():
            most[g] = max(most[g], rate)
    members = [np.array([g for g, rate in own.items() if rate >= langid.NEAR_BEST * most[g]], np.uint64) for own in rates.values()]
    want, got = langid.Filters(list(rates), members), langid.fit(docs)
    assert got.languages == want.languages and all(np.array_equal(a, b) for a, b in zip(got.slices, want.slices, strict=True))
    held = langid._Counts()
    monkeypatch.setattr(langid, "MERGE", 40)
    text = [np.array([5, 3, 5], np.uint64), np.array([9, 3] * 30, np.uint64), np.array([1, 9], np.uint64)]
    for part in text:
        held.add("x", part)
    held.merge()
    gram, n = held.counted["x"]
    assert dict(zip(gram.tolist(), n.tolist())) == {1: 1, 3: 31, 5: 2, 9: 31} and gram.tolist() == sorted(gram.tolist())
    monkeypatch.setattr(langid, "MAX_LANGUAGES", len(rates) - 1)
    with pytest.raises(ValueError, match="values to learn"):
        langid.fit(docs)


def test_more_than_64_languages_are_learned(spark):
    rows = [(i, f"{chr(97 + i % 70 // 3)}{chr(97 + i % 70 % 3)}{'xyz'[i % 70 % 3]} " * 9, f"l{i % 70:02}", None, 0, 0, "", 0) for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len({r.lang for r in got}) > 60 and all(r.lang == r.lang_pred for r in got)

def test_quality_accuracy(spark, odd, nothing):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = quality.quality_report(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) >= 0.98 and sum(r.predicted for r in bad) / len(bad) <= 0.2
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in quality.quality_report(spark, docs, labels).collect())
    some = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.quality_report(spark, odd, some).collect())
    assert quality.quality_report(spark, odd, some.where("false")).where("score <> 0.5").count() == 0
    assert quality.quality_report(spark, nothing, some).count() == 0


def test_the_folded_score_is_that_of_the_network():
    """Training step by step and scoring without the folded table: mean of vectors, softmax of two outputs."""
    texts, labels = [f"good {i} fine words" if i % 2 else f"bad junk{i}" for i in range(12)], np.arange(12) % 2
    rng, rows = np.random.default_rng(7), [Counter(np.concatenate(list(quality.features(t))).tolist()) for t in texts]
    vectors = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    out, bias, done = np.zeros((2, quality.DIM)), np.zeros(2), 0

    def forward(counts):
        n = sum(counts.values())
        mean = sum(c / n * vectors[f] for f, c in counts.items())
        p = np.exp(out @ mean + bias)
        return n, mean, p / p.sum()

    for _ in range(quality.EPOCHS):
        for i in rng.permutation(12):
            rate = quality.RATE * (1 - done / (quality.EPOCHS * 12))
            done += 1
            n, mean, p = forward(rows[i])
            error = p - np.eye(2)[labels[i]]
            back = error @ out
            out, bias = out - rate * np.outer(error, mean), bias - rate * error
            for f, c in rows[i].items():
                vectors[f] -= rate * 40 * c / n * back
    table, fitted = quality.train(texts, labels)
    for t, counts in zip(texts, rows):
        assert quality.score(t, table, fitted) == pytest.approx(forward(counts)[2][1], abs=1e-3)


def test_a_repeated_label_trains_once(spark):
    rows = [(i, f"good words number {i}" if i % 2 else f"bad junk {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    more = once.unionByName(spark.createDataFrame([(i, f"zz later {k}") for i in (2, 3) for k in range(50)], "doc_id long, text string"))
    (a, x), (b, y) = quality.fit(once, labels), quality.fit(more, labels)
    assert np.array_equal(a, b) and x == y


def test_learned_texts_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * (400 if i % 7 == 0 else 5)) for i in range(1, 60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    few = quality.fit(docs.where("doc_id % 7 <> 0"), labels)
    monkeypatch.setattr(quality, "MAX_TRAIN_TEXT", 100)
    bounded = quality.fit(docs, labels)
    assert (few[0] == bounded[0]).all() and few[1] == bounded[1] != 0
    monkeypatch.setattr(quality, "MAX_TRAIN_CHARS", 0)
    assert quality.fit(docs, labels)[1] == 0


def test_stretches_change_no_feature():
    text = " ".join(f"w{i % 50}é" for i in range(400))
    whole = Counter(np.concatenate(list(quality.features(text))).tolist())
    old, quality.STRETCH = quality.STRETCH, 300
    try:
        cut = Counter(np.concatenate(list(quality.features(text))).tolist())
    finally:
        quality.STRETCH = old
    assert sum((whole - cut).values()) <= 0.02 * sum(whole.values())


# Substrings, language model


def brute_repeats(rows):
    least, w = {}, {i: words(t) for i, t in rows}
    for i, x in w.items():
        for k in range(len(x) - 49):
            g = tuple(x[k : k + 50])
            least[g] = min(least.get(g, i), i)
    out = {}
    for i, x in w.items():
        gone = {j for k in range(len(x) - 49) if least[tuple(x[k : k + 50])] < i for j in range(k, k + 50)}
        out[i] = (len(x), len(gone), hashlib.sha256(b" ".join(v for j, v in enumerate(x) if j not in gone)).hexdigest())
    return out


def test_substring_dedup_equals_brute_force(small, small_rows, odd, nothing):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeat_report(small).collect()}
    want = brute_repeats(small_rows)
    assert got == want and sum(v[1] for v in want.values()) > 0
    rows = unique_ids(odd)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeat_report(rows).collect()}
    assert got == brute_repeats([(r.doc_id, r.text) for r in rows.collect()]) and got[12][1] == 120
    assert substring_dedup.repeat_report(odd).count() == odd.count() and substring_dedup.cut_repeats(nothing).count() == 0


def test_substring_dedup_at_every_offset(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        a, n = rng.randrange(0, 140), rng.choice([49, 50, 51, 60])
        rows.append((i, " ".join([f"x{i}_{j}" for j in range(rng.randrange(30))] + base[a : a + n] + [f"y{i}_{j}" for j in range(rng.randrange(30))])))
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("shard_bytes,parts", [(2000, 8192), (2000, 3), (500, 16)])
def test_substring_dedup_with_many_shards(small, small_rows, monkeypatch, shard_bytes, parts):
    """Hundreds of shards, also several to a task."""
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substring_dedup, "PARTS", parts)
    small = small.limit(150)
    rows = [(r.doc_id, r.text) for r in small.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeat_report(small).collect()}
    assert got == brute_repeats(rows)


def test_windows_that_share_a_hash_are_told_apart_by_the_other():
    import pyarrow as pa

    hashes = lambda *pairs: np.array(pairs, np.uint64).T.tobytes()
    rows = [(0, 1, hashes((7, 1), (8, 1)), np.array([0, 1], "<u4").tobytes()), (0, 2, hashes((7, 2), (8, 1), (0, 0)), np.array([5, 6, 7], "<u4").tobytes()), (0, 3, hashes((0, 256), (0, 0)), np.array([1, 2], "<u4").tobytes())]
    batch = substring_dedup._batch(rows, substring_dedup._WINDOWS)
    got = {i: np.frombuffer(p, "<u4").tolist() for b in substring_dedup._marked(iter([batch])) for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert got == {2: [6], 3: [2]} and isinstance(batch, pa.RecordBatch)


def test_substring_dedup_of_a_passage_in_every_document(spark):
    base = " ".join(f"h{i}" for i in range(70))
    rows = [(i, f"{base} own{i} " + ("Is onhe. " * 60 if i % 3 else "") + base) for i in range(150)]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    assert got == brute_repeats(rows)


def brute_scores(rows):
    w = {i: words(t) for i, t in rows}
    one, two = Counter(), Counter()
    for x in w.values():
        one.update(x)
        two.update(zip(x, x[1:]))
    n, out = sum(one.values()), {}
    for i, x in w.items():
        own = Counter(zip(x, x[1:]))
        s = math.log10(one[x[0]] / n) if x else 0.0
        for (a, b), m in own.items():
            e = two[a, b] - m
            s += m * math.log10(e / one[a] if e else 0.4 * one[b] / n)
        out[i] = (len(x), s)
    return out


def same_scores(got, rows):
    want = {i: (n, pytest.approx(s, abs=0.00051 + 1e-8 * n)) for i, (n, s) in brute_scores(rows).items()}
    assert {r.doc_id: (r.n_words, r.score) for r in got} == want


def test_lm_ids_take_two_bytes_each_where_steps_are_short():
    for ids in ([5], [7, 7, 8, 70_000], [-(2**63), 3], [9, 2], [2**62, 2**62 + 5], list(range(1000))):
        assert lm_score._unpack_ids(lm_score._pack_ids(np.array(ids, np.int64))).tolist() == ids
    assert len(lm_score._pack_ids(np.arange(1000))) == 1 + 8 + 2 * 999


def test_parts_hold_hashes_and_no_words():
    """The peak of a part of 400,000 words stays near the eight bytes that each takes."""
    import tracemalloc

    import pyarrow as pa

    from tidemark.llm.wordarrays import hashed, parts, words

    texts = [" ".join(f"w{(i * 31 + k) % 5003}" for k in range(1000)) for i in range(400)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(402), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    got = list(parts(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    h, sizes = hashed([words(t) for t in texts])
    assert [np.concatenate(c).tolist() for c in zip(*got)] == [list(range(402)), sizes.tolist(), h.tolist()]
    assert peak < 3 * h.nbytes


@pytest.mark.parametrize("shard_words,parts,hot", [(4_000_000, 8192, 65_000), (3000, 8192, 65_000), (3000, 3, 200), (300, 5, 20)])
def test_lm_scores_equal_brute_force(small, small_rows, monkeypatch, shard_words, parts, hot):
    """Also with several shards a task, and with few or many frequent words."""
    monkeypatch.setattr(lm_score, "PARTS", parts)
    monkeypatch.setattr(lm_score, "HOT", hot)
    same_scores(lm_score.score(small, shard_words).collect(), small_rows)


def test_lm_scores_with_hot_words_and_bigrams(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["hot pair", "hot pair", "hot", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    scores = []
    for parts, shard_words in ((1, 500), (7, 300), (30, 10_000)):
        got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), shard_words).collect()
        same_scores(got, rows)
        scores.append({r.doc_id: (r.score, r.mean_score) for r in got})
    assert scores[0] == scores[1] == scores[2]


def test_codes_survive_packing():
    rng = np.random.default_rng(4)
    code = np.where(rng.random(1003) < 0.6, rng.integers(0, 65_001, 1003, dtype=np.uint64), rng.integers(0, 2**63, 1003, dtype=np.uint64) | lm_score._RARE)
    for n in (0, 1, 8, 1003):
        assert np.array_equal(lm_score._unpack_codes(lm_score._pack_codes(code[:n]), n), code[:n])


def test_lm_scores_odd_cases(odd, nothing):
    rows = unique_ids(odd)
    got = {r.doc_id: (r.n_words, r.score) for r in lm_score.score(rows).collect()}
    want = brute_scores([(r.doc_id, r.text) for r in rows.collect()])
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], rel=1e-4, abs=0.01) for i in want)
    assert lm_score.score(odd).count() == odd.count() and lm_score.score(nothing).count() == 0
    assert lm_score.score(odd).where("doc_id is null and score is not null").count() == 0


# Scans


def test_masks_hit_every_overlap():
    for size in range(decontaminate.MIN_WORDS, decontaminate.WINDOW + 1):
        masks = decontaminate.LONG_MASKS if size == decontaminate.WINDOW else decontaminate.SHORT_MASKS
        for wrong in combinations(range(size), size - math.ceil(size * decontaminate.SHARE)):
            assert any(all(s + o not in wrong for o in m) for m in masks for s in range(size - m[-1]))
    assert decontaminate.LOOK <= 64 and max(m[-1] for m in decontaminate.LONG_MASKS) == 10


def brute_leaks(docs, items):
    import re

    split = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    out = {}
    for i, t in docs:
        d = split(t)
        for j, u in items:
            w = split(u)
            if not w:
                continue
            width = min(15, len(w))
            best = max((sum(d[a + k] == w[b + k] for k in range(width)) for a in range(len(d) - width + 1) for b in range(len(w) - width + 1) if d[a : a + width]), default=0)
            if best >= (width if width < 8 else math.ceil(width * 0.8)):
                out[i, j] = (best, width)
    return out


def test_decontamination_equals_brute_force_also_with_common_phrases(spark, monkeypatch):
    rng = random.Random(11)
    phrase = "which of the following statements best describes the main idea of".split()
    items = [(j, " ".join([f"i{j}x{rng.randrange(9)}" for _ in range(rng.randrange(0, 9))] + phrase[: 5 + j % 7] + [f"i{j}y{k}" for k in range(rng.randrange(2, 12))])) for j in range(40)]
    items += [(100, "eleven words of which all are to be found in here")]
    items += [(200 + n, " ".join(phrase[:n])) for n in range(1, 8)] + [(300, "of which zz are"), (301, ""), (302, "best MAIN"), (303, "words of which all are to")]
    docs = []
    for i in range(25):
        body = []
        for _ in range(12):
            own = (items[rng.choice([rng.randrange(41), 41 + rng.randrange(7)])][1] if rng.random() < 0.5 else " ".join(phrase)).split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "zz"
            body += own + [f"d{i}{k}" for k in range(rng.randrange(6))]
        docs.append((i, " ".join(body)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    for block, light in (1024, 16), (32, 16), (1024, 0), (32, 1):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        monkeypatch.setattr(decontaminate, "LIGHT", light)
        got = {(r.doc_id, r.item_id): (r.matched_words, r.window_words) for r in decontaminate.contaminated(df, bench).collect()}
        assert got == want and len(want) > 50


def test_a_phrase_of_items_and_documents_makes_no_pairs(spark, monkeypatch):
    phrase = "which of the following statements best describes the main idea of".split()
    texts = lambda n, own: [(i, " ".join([f"{own}{i}a{k}" for k in range(8)] + phrase + [f"{own}{i}b{k}" for k in range(8)])) for i in range(n)]
    made = []
    keep = decontaminate.materialize

    def counted(df):
        out = keep(df)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(decontaminate, "materialize", counted)
    for n in 100, 400:
        made.append(0)
        docs, items = texts(n, "d"), texts(n, "i")
        docs += [(n, "d " + " ".join(items[7][1].split()[7:20])), (n + 1, " ".join([*phrase, "i3b0"]))]
        docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert {(r.doc_id, r.item_id, r.matched_words) for r in decontaminate.contaminated(docs, items).collect()} == {(n, 7, 13), (n + 1, 3, 12)}
    assert made[1] < 4.2 * made[0]


def test_rows_without_or_with_the_same_id_are_judged_by_their_text(spark):
    item = " ".join(f"t{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, f"a {item} b", 1), (None, "clean", 2), (5, item, 3), (5, "clean, too", 4), (6, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    assert {r.item_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 4, 5}
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {None, 5}


def test_decontamination_tolerates_substitutions(spark, odd, nothing):
    rng = random.Random(4)
    item = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "too short to count"), (3, None), (None, "x " * 20), (4, " ".join(f"u{i}" for i in range(9)))], "item_id long, text string")
    docs = []
    for i in range(120):
        part = item[rng.randrange(16) :][:15]
        wrong = rng.sample(range(15), i % 6)
        docs.append((i, " ".join([f"q{i}"] * (i % 9) + [f"z{i}" if k in wrong else w for k, w in enumerate(part)]), i % 6 <= 3))
    docs.append((200, "U0, u1 u2 -- u3 u4 u5 U6 u7 wrong", True))
    df = spark.createDataFrame(docs, "doc_id long, text string, leak boolean")
    found = {r.doc_id for r in decontaminate.contaminated(df, bench).collect()}
    assert found == {d[0] for d in docs if d[2]}
    assert decontaminate.decontaminate(df, bench).count() == len(docs) - len(found)
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.where("false")).count() == 0
    old, decontaminate.BROADCAST_CHARS = decontaminate.BROADCAST_CHARS, -1
    try:
        assert {r.doc_id for r in decontaminate.contaminated(df, bench).collect()} == found
    finally:
        decontaminate.BROADCAST_CHARS = old


def test_license_scan_odd_cases(spark, odd, nothing):
    known = license_scan.templates(spark)
    got = {(r.doc_id, r.license_id) for r in license_scan.find_licenses(odd, known).collect()}
    assert got == {(19, "MIT-notice"), (20, "MIT-notice")}
    assert license_scan.find_licenses(nothing, known).count() == 0
    mit = license_scan.TEMPLATES["MIT"].split()
    rows = [(i, " ".join(["a"] * i + mit[: len(mit) - i] + ["b"] * 3)) for i in range(8)]
    got = {r.doc_id: r.containment for r in license_scan.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect() if r.license_id == "MIT"}
    total = len(mit) - 4
    assert got == {i: (total - i) / total for i in range(8) if (total - i) / total >= 0.8}
    rows = [(None, license_scan.TEMPLATES["ISC"]), (7, "nothing"), (7, license_scan.TEMPLATES["ISC"])]
    got = {(r.doc_id, r.license_id) for r in license_scan.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {(None, "ISC"), (7, "ISC")}


def brute_licenses(rows):
    import re

    def grams(t):
        w = [x for x in re.split(r"[^\w]|_", t.lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = {}
    for k, v in license_scan.TEMPLATES.items():
        t = grams(v)
        for i, text in rows:
            both = len(t & grams(text))
            if both >= 0.8 * len(t):
                out[i, k] = (both, len(t))
    return out


def test_license_scan_finds_every_edited_template(spark):
    rng, rows = random.Random(12), []
    for k, v in license_scan.TEMPLATES.items():
        for _ in range(25):
            w = v.split()
            for _ in range(rng.randrange(1 + len(w) // 18)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [f"new{at}"] * rng.randrange(2)
            rows.append((len(rows), " ".join([f"x{i}" for i in range(rng.randrange(9))] + w[rng.randrange(3) :] + [f"y{i}" for i in range(rng.randrange(9))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.license_id): (r.matched, r.total) for r in license_scan.find_licenses(df, license_scan.templates(spark)).collect()}
    want = brute_licenses(rows)
    assert got == want and len(want) > 200


def test_bands_collide_as_often_as_they_should(spark):
    rng = random.Random(13)
    width, trials = license_scan.WIDTH, 4000
    for shared in (8, 7, 6):
        rows = []
        for i in range(trials):
            both = [rng.getrandbits(64) - (1 << 63) for _ in range(shared)]
            rows += [(i, width, *both, *[rng.getrandbits(64) - (1 << 63) for _ in range(width - shared)]) for _ in range(2)]
        df = spark.createDataFrame(rows, "pair long, left int, " + ", ".join(f"s{k} long" for k in range(width)))
        seen = df.groupBy("pair").agg(*[(F.count_distinct(b) == 1).alias(f"b{k}") for k, b in enumerate(license_scan.bands())])
        hit = seen.where(" or ".join(f"b{k}" for k in range(license_scan.BANDS))).count() / trials
        j = shared / (2 * width - shared)
        assert hit >= 1 - (1 - j**license_scan.ROWS) ** license_scan.BANDS - 0.01


# Packing and the pipeline


def check_packing(rows, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_packing_round_trip(small, small_rows, odd, nothing):
    check_packing(packing.pack(small).collect(), small_rows)
    rows = unique_ids(odd)
    check_packing(packing.pack(rows).collect(), [(r.doc_id, r.text) for r in rows.collect()])
    assert packing.pack(odd).agg(F.countDistinct("doc_id")).first()[0] == len(TEXTS) and packing.pack(nothing).count() == 0


def test_scores_are_those_of_bm25():
    rng = np.random.default_rng(5)
    pieces = [rng.zipf(1.5, int(rng.integers(1, 80))).clip(max=50).astype(np.uint32) for _ in range(40)]
    idf, mean = rng.random(51) * 3, 30.0
    shard = packing.Shard(pieces, idf, mean)
    for seed in range(40):
        want = []
        for ids in pieces:
            tf, norm = Counter(ids.tolist()), packing.K1 * (1 - packing.B + packing.B * len(ids) / mean)
            want.append(sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in set(pieces[seed].tolist()) if t in tf))
        assert shard.scores(seed) == pytest.approx(want)


def test_neighbours_share_windows(spark):
    topics = [[f"topic{t}word{i}" for i in range(40)] for t in range(6)]
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(topics[i % 6]) for _ in range(90))) for i in range(120)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(1)).collect()
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append(r.doc_id % 6)
    same = sum(Counter(v).most_common(1)[0][1] for v in full.values() if len(v) > 1)
    assert same / sum(len(v) for v in full.values() if len(v) > 1) > 0.6


def test_encoder_equals_the_tokenizer_file():
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(9)
    alphabet = "ab Z'\t\n\r  12é́漢\U0001f600​　<|>!?.…_-\x00ÀßѢ٣"
    for t in [*[x or "" for x in TEXTS], *["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]]:
        assert packing.encode(t) == tok.encode(t, add_special_tokens=False).ids + [1]


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    d = SMALL
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    good = {r.doc_id for r in quality.quality_report(spark, docs, labels).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(WS).translate(lower)
    holders = {}
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            holders.setdefault(k, set()).add(i)
    rows = [(i, "\n".join(x for x in t.split("\n") if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i))) for i, t in rows]
    parts = brute_copies(rows)
    rows = [(i, t) for i, t in rows if parts[i] == i]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    leaks = {r.doc_id for r in decontaminate.contaminated(left, table(spark, d, "benchmark")).collect()}
    rows = [(i, t) for i, t in rows if i not in leaks]
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    check_packing(got, rows)


def test_pipeline_stages_keep_the_columns(spark, odd, nothing, tmp_path):
    import corpus_pipeline

    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5
    out = odd
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SMALL)
    assert out.count() > 0
