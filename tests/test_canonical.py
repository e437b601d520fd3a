import hashlib
import random
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import canonical as fn

WHITE = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000)]
ODD = ["  John\t", "Zoë", "a\U0001f600b", " ", " x", "x \u0085", " \u0085", "-", "John;+5:Smith", "", " ", None, "\x1fy\x1c"]


def expected(*fields):
    parts = []
    for f in fields:
        v = None if f is None else unicodedata.normalize("NFC", f).strip("".join(WHITE)) or None
        parts.append("-" if v is None else f"+{len(v.encode('utf-16-be')) // 2}:{v}")
    return hashlib.sha256(("v1;" + "".join(p + ";" for p in parts)).encode()).hexdigest()


def prints(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, external_id string, first_name string, last_name string, email string")
    return [r.fingerprint for r in fn.with_fingerprint(df).orderBy("i").collect()]


def test_fingerprint_equals_plain_python(spark):
    rng = random.Random(3)
    pool = ODD + ["".join(rng.choice("ab é́\U00010400;:+-\t ") for _ in range(rng.randrange(6))) for _ in range(80)]
    rows = [tuple(rng.choice(pool) for _ in range(4)) for _ in range(300)]
    assert prints(spark, rows) == [expected(*r) for r in rows]


def test_what_counts_as_equal(spark):
    a, b, c, d, e, f, g = prints(
        spark,
        [("1", "John", None, "x"), ("1", "  John\t", "", "x"), ("1", "john", None, "x"), ("1", "Zoë", None, "x"), ("1", "Zoë", " ", "x"), ("1", "Joh", "n", "x"), ("1", "John;-", None, "x")],
    )
    assert a == b and a != c and d == e and len({a, c, d, f, g}) == 5


def test_blank_and_strip(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ODD)], "i int, v string")
    rows = df.select("v", fn.is_blank(F.col("v")).alias("blank"), fn.strip(F.col("v")).alias("s")).collect()
    for r in rows:
        s = None if r.v is None else r.v.strip("".join(WHITE))
        assert r.s == s and r.blank == (s in (None, ""))


def test_small_functions(spark):
    row = spark.range(1).select(
        fn.truncate_error(F.lit("e" * 1500)).alias("e"), fn.partition_key(F.lit("t"), F.lit("c")).alias("k"), fn.padded_id(F.lit(7)).alias("p"),
        F.array(*[fn.backoff_ms(F.lit(n)) for n in range(1, 7)]).alias("b"),
    ).first()
    assert len(row.e) == 1000 and row.k == "t:c" and row.p == "candidate-00007" and row.b == [200, 400, 800, 1600, 2000, 2000]


def test_errors_are_cut_by_utf16_units(spark):
    from tidemark.functions.canonical import truncate_error

    texts = [None, "", "abc", "abcd", "abcde", "ab\U0001f600", "abc\U0001f600", "abc\U0001f600d", "\U0001f600\U0001f600\U0001f600", "é" * 9]

    def cut(t):
        units = t.encode("utf-16-be")[:8]
        return units.decode("utf-16-be", errors="ignore")

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.cut for r in rows.select("t", truncate_error(rows["t"], 4).alias("cut")).collect()}
    assert got == {t: t and cut(t) if t is not None else None for t in texts}
