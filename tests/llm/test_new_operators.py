"""Clustering, chat formatting and the source audit: against their SQL, against plain versions, and in the odd cases."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import assert_same
from tests.conftest import SMALL
from tidemark.llm import catalog, chat_format, clustering, divergence, near_copies
from tidemark.llm.common import table


@pytest.mark.parametrize("name", ["op11_clustering", "op12_chat_format", "op13_source_audit"])
def test_query_equals_its_sql(spark, duck, name):
    assert_same(catalog.queries()[name](spark, SMALL), duck, catalog.oracle_sql()[name])


# Clustering


def plain_clusters(vectors, k, rounds):
    """vec_id, cluster, distance by comparing every vector with every centroid."""
    ok = [(i, [floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(ok, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in ok:
            of[near(v)[1]].append(v)
        centroids = [[sum(x) // len(of[i]) for x in zip(*of[i])] if of[i] else c for i, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in ok), key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label string, cluster int, q int")


def test_clusters_with_odd_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randint(-3, 3) / 64 for _ in range(64)]) for i in range(120)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[1][1]), (900, [0.0] * 64), (901, [0.0] * 64)]  # repeats, no id, ties
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [None] + [0.0] * 63), (1004, [float("nan")] + [0.0] * 63), (1005, [float("-inf")] * 64)]
    for k in (1, 5, 16):
        found, centroids = clustering.clusters(vectors_of(spark, rows), k=k, rounds=2)
        assert len(centroids) == k
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=str) == plain_clusters(rows, k, 2)


def test_clusters_of_copies_and_of_few_vectors(spark):
    one = [0.25] * 64
    report = clustering.cluster_report(vectors_of(spark, [(i, one) for i in range(300)])).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in report} == {(0, 0, 0)} and len(report) == 300
    assert clustering.cluster_report(vectors_of(spark, [(1, one), (2, [0.5] * 64)])).count() == 2
    assert clustering.cluster_report(vectors_of(spark, [])).count() == 0


def test_a_vector_that_would_overflow_is_refused(spark):
    with pytest.raises(Exception, match="component too large"):
        clustering.cluster_report(vectors_of(spark, [(1, [1e30] * 64)])).count()


def test_annuli_find_ties_at_their_border():
    centroids = np.array([[5, 0], [-5, 0], [0, 5], [3, 4], [0, 0]])
    x = np.array([[0, 0], [1, 1], [0, -5], [-1, 0], [40, 30]])
    cluster, distance = clustering.Annuli(centroids).nearest(x)
    every = ((x[:, None] - centroids) ** 2).sum(axis=2)
    assert cluster.tolist() == every.argmin(axis=1).tolist() and distance.tolist() == every.min(axis=1).tolist()


def test_an_annulus_holds_few_centroids():
    """Vectors near centroids of different norms are compared with those of like norm only."""
    rnd = np.random.default_rng(1)
    centroids = np.array([[i * 1000, 0, 0] for i in range(16)])
    x = centroids[rnd.integers(0, 16, 500)] + rnd.integers(-20, 20, (500, 3))
    annuli = clustering.Annuli(centroids)
    norms = np.sqrt((x * x).sum(axis=1))
    assert (np.abs(annuli.norms[None] - norms[:, None]) < 100).sum(axis=1).max() == 1
    assert annuli.nearest(x)[0].tolist() == ((x[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1).tolist()


# Chat formatting

PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]", "\\", "<", "/s>", "[", "]", "a", "\n", " ", "é", "\U0001f600", "INST]", "<SYS>>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)
SPOKEN = st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", "a\\[END]"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(SPOKEN, TEXT), max_size=6))
def test_turns_come_back_from_the_parser(turns):
    said = [chat_format.proven(*t) for t in turns]
    whole = "".join(text for text, _, _ in said)
    back = list(chat_format.parse(whole))
    assert [t[:2] for t in back] == turns
    at = 0
    for (text, start, stop), (_, _, a, b) in zip(said, back):
        assert (at + start, at + stop) == (a, b)
        at += len(text)
    for role, text in turns:
        assert chat_format.unescape(chat_format.escape(text)) == text


@pytest.mark.parametrize("wrong", ["text", "[INST]a", "[INST]a</s>", "a[INST]b[/INST]", "[ROLE]x[END]", "[/INST]", "<s></s>", "[INST][INST]a[/INST]"])
def test_what_is_not_of_the_grammar_is_refused(wrong):
    with pytest.raises(ValueError):
        list(chat_format.parse(wrong))


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, place int")


ODD_CHATS = [
    (1, 1, "assistant", "second"), (1, 0, "user", "first"), (1, 2, "user", None), (1, 3, "assistant", None), (2, 0, "assistant", ""), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"),
    (3, 5, "user", "a"), (3, None, "system", "none"), (3, 6, "user", "twice"), (3, 6, "user", "twice"), (4, 0, None, "no role"), (4, 1, "tool", "[END] \\[END]"), (None, 0, "user", "no id"),
    (None, 1, "assistant", "<\\s> <s>"), (5, 0, "user", "long " * 60_000), (5, 1, "assistant", "é\U0001f600 " * 60_000),
]


def plain_chats(rows):
    of = defaultdict(list)
    for c, t, role, text in rows:
        of[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    out = {}
    for c, turns in of.items():
        turns.sort()
        learnt = "".join(t[4] for t in turns if t[2] == "assistant")
        out[c] = len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[4]}\n" for t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()
    return out


@pytest.mark.parametrize("max_chars", [1, 40, 262_144])
def test_odd_conversations(spark, max_chars):
    report = chat_format.format_report(chats(spark, ODD_CHATS), max_chars)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in report.collect()}
    assert got == plain_chats(ODD_CHATS)
    assert chat_format.format_report(chats(spark, []), max_chars).count() == 0


def test_a_long_conversation_is_rendered_by_many_tasks(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i} </s>") for i in range(4000)] + [(2, 0, "user", "other")]
    pieces = chat_format.format_conversations(chats(spark, rows).repartition(8), 10_000)
    of = [r for r in pieces.orderBy("conv_id", "place").collect() if r.conv_id == 1]
    assert len(of) > 5 and [r.place for r in of] == list(range(len(of))) and [r.last for r in of] == [False] * (len(of) - 1) + [True]
    assert max(len(r.formatted) for r in of) <= 11_000 and of[0].formatted.startswith("<s>[INST]turn 0 <\\/s>[/INST]")
    assert chat_format.format_report(chats(spark, rows), 10_000).where("conv_id = 1").first().turns_sha256 == plain_chats(rows)[1][1]


def test_the_loss_mask_covers_assistants_alone(spark):
    row = chat_format.format_conversations(chats(spark, [(1, 0, "system", "s"), (1, 1, "user", "é"), (1, 2, "assistant", "yes"), (1, 3, "user", "u"), (1, 4, "assistant", "")])).first()
    assert row.formatted == "<s><<SYS>>s<</SYS>>[INST]é[/INST]yes</s>[INST]u[/INST]</s>"
    assert [row.formatted[s.start : s.stop] for s in row.loss] == ["yes", ""]


# Source audit


def plain_audit(rows, min_docs, top):
    letters = lambda t: "".join(ch if ch > "\x7f" or ch.isalpha() else " " for ch in t).split(" ")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, in_docs = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [w.translate(lower) for w in letters(text or "") if w]
        sources[lang].add(source)
        count[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + floor(Fraction(10**9 * (c[t] + 5), sum(c[x] for x in kept) + 5 * len(kept))) for t in kept}
        whole = share(sum((count[lang, s] for s in names), Counter()))
        of = {s: share(count[lang, s]) for s in names}
        for s in names:
            parts = {"pair": [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in names if o != s]}
            parts["term"] = [(of[s][t] - whole[t], t) for t in kept if count[lang, s][t] and of[s][t] > whole[t]]
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[: top if part == "term" else None])]
    return sorted(out)


def audited(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def documents(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, [2]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int, vector array<int>")


@pytest.mark.parametrize("slice_", [2, 64])
def test_audit_equals_a_plain_version(spark, monkeypatch, slice_):
    monkeypatch.setattr(divergence, "SLICE", slice_)
    rnd = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Über", "日本", "É", "zz"]
    rows = [(" ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(64)], k=rnd.randint(0, 40))), rnd.choice(["en", "de", None]), rnd.choice("abcdefg")) for _ in range(200)]
    rows += [(None, "en", None), ("", "xx", "alone"), ("few words", "yy", "p"), (None, "yy", "q"), ("A a-B_b c1D2é" * 50, "en", "a"), ("A b " * 30_000, "en", "hot")]
    rows += [("same text", "de", "b")] * 9
    for top in (3, 50):
        assert audited(divergence.audit(documents(spark, rows), 4, top)) == plain_audit(rows, 4, top)


def test_counts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 3)
    held, rows = divergence._Counts(), []
    for text in ("a b a c d b1e", "É a É", ""):
        held.add(("en", "s"), text.encode().lower())
        rows.append(sorted((r["term"], r["n"], r["docs"]) for b in held.batch(4) for r in b.to_pylist()))
    assert rows == [[("a", 2, 1), ("b", 2, 1), ("c", 1, 1), ("d", 1, 1), ("e", 1, 1)], [], []]
    assert sorted((r["term"], r["n"], r["docs"]) for b in held.batch() for r in b.to_pylist()) == [("a", 1, 1), ("É", 2, 1)] and not held.groups


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    assert audited(divergence.audit(documents(spark, [("a", "en", "s"), (None, None, "t"), (None, None, "u")]))) == [("", "t", "pair", "u", 0, 1), ("", "u", "pair", "t", 0, 1)]


def test_equal_vectors_are_paired_once(spark):
    rows = [(f"w{'abcdefghij'[i]}x " * 2, "en", s) for i in range(10) for s in "pqr"] + [("other", "en", "p")]
    kept, _ = divergence.scored(documents(spark, rows), 1)
    vectors = divergence.distinct_vectors(kept).collect()
    assert sorted(r.same for r in vectors) == [1, 10]


# Near copies: no text may be lost


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "ABCDE"}
    near = text["A"].replace("A30", "other")
    rows = [(3, text["B"]), (5, text["A"]), (5, text["B"]), (7, text["C"]), (None, text["D"]), (None, text["D"]), (9, near), (None, near), (11, None), (12, ""), (13, text["E"]), (13, text["E"]), (14, text["C"])]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, row string, root int, first int")
    kept = [(r.doc_id, r.text) for r in near_copies.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, text["B"]), (5, text["A"]), (7, text["C"]), (None, text["D"]), (11, None), (13, text["E"])], key=str)
    assert near_copies.keep_first(docs).columns == docs.columns
    assert near_copies.keep_first(docs.where("false")).count() == 0
