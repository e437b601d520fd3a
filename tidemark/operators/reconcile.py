"""Comparison of a source and a target by fingerprints.

Fingerprints are projected before the join, so that a row of the shuffle is a key and 64 characters. One-sided results
have anti joins of their own, as the optimizer doesn't turn a full outer join with a null filter into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import is_blank, with_fingerprint
from tidemark.model import DIFFERENCES, RESULTS

KEY = ["tenant_id", "external_id"]


def side(df: DataFrame, *order: str) -> DataFrame:
    """tenant_id, external_id, fingerprint of the last write of each key: a page that was read again counts once.

    order: the columns of the scan order; of equal places the greatest fingerprint stands. Without an order, a key that was
    read in several versions fails the query: which of them is the last one isn't known.
    The aggregation is dealt by the key that the comparison joins on, so it adds no shuffle.
    """
    order = tuple(c for c in order if c in df.columns)
    rows = with_fingerprint(df).select(*KEY, "fingerprint", *order).groupBy(*KEY)
    if order:
        return rows.agg(F.max_by("fingerprint", F.struct(*order, "fingerprint")).alias("fingerprint"))
    found = rows.agg(F.max("fingerprint").alias("fingerprint"), F.min("fingerprint").alias("_other"))
    unclear = F.raise_error(F.lit("record read in several versions without an order of the scan"))
    return found.select(*KEY, F.when(F.col("fingerprint") == F.col("_other"), F.col("fingerprint")).otherwise(unclear).alias("fingerprint"))


def last_write(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that was scanned last; order must be total."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def checked(df: DataFrame, tenant: Column | None = None) -> DataFrame:
    """df, failing the query at a blank id, or at a row of another tenant than the given one."""
    wrong = is_blank(F.col("external_id"))
    error = F.when(wrong, F.raise_error(F.lit("record without an id")))
    if tenant is not None:
        error = error.when(~F.col("tenant_id").eqNullSafe(tenant), F.raise_error(F.lit("record of another tenant")))
    return df.withColumn("external_id", F.coalesce(error.cast("string"), F.col("external_id")))


def classify(source_seen: Column, target_seen: Column, same: Column) -> Column:
    """A null comparison is a mismatch; seen is a flag of its own, not a test of a payload column."""
    both = source_seen & target_seen
    return (
        F.when(both & F.coalesce(same, F.lit(False)), "MATCHED")
        .when(both, "MISMATCHED")
        .when(source_seen, "MISSING_IN_TARGET")
        .otherwise("UNEXPECTED_IN_TARGET")
    )


def items(source: DataFrame, target: DataFrame, *order: str) -> DataFrame:
    """One row a key: both fingerprints, both flags, the result. order: see side()."""
    s = side(source, *order).withColumn("s_seen", F.lit(True)).withColumnRenamed("fingerprint", "source_fingerprint")
    t = side(target, *order).withColumn("t_seen", F.lit(True)).withColumnRenamed("fingerprint", "target_fingerprint")
    seen = s.join(t, KEY, "full_outer").select(
        *KEY, F.coalesce("s_seen", F.lit(False)).alias("source_seen"), F.coalesce("t_seen", F.lit(False)).alias("target_seen"), "source_fingerprint", "target_fingerprint"
    )
    result = classify(F.col("source_seen"), F.col("target_seen"), F.col("source_fingerprint") == F.col("target_fingerprint"))
    return seen.withColumn("result", result)


def summary_columns() -> list[Column]:
    counted = {"source_count": "source_seen", "target_count": "target_seen"}
    counted |= {name: f"result = '{value}'" for name, value in (("matched_count", "MATCHED"), ("missing_count", "MISSING_IN_TARGET"), ("unexpected_count", "UNEXPECTED_IN_TARGET"), ("mismatched_count", "MISMATCHED"))}
    return [F.count_if(F.expr(v)).alias(k) for k, v in counted.items()]


def summarize(found: DataFrame, *by: str) -> DataFrame:
    """The six counts in one pass."""
    return found.groupBy(*by).agg(*summary_columns())


def missing_in_target(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select(*KEY).distinct().join(target.select(*KEY), KEY, "left_anti")


def unexpected_in_target(source: DataFrame, target: DataFrame) -> DataFrame:
    return missing_in_target(target, source)


def compared(source: DataFrame, target: DataFrame, equal: bool) -> DataFrame:
    """Keys on both sides whose fingerprints are equal, or aren't."""
    both = side(source).join(side(target).withColumnRenamed("fingerprint", "other"), KEY)
    same = F.coalesce(F.col("fingerprint") == F.col("other"), F.lit(False))
    return both.where(same if equal else ~same).select(*KEY)


def differences(found: DataFrame, result: str | None = None) -> DataFrame:
    """All rows but matched ones, or those of one result."""
    return found.where(F.col("result") == result if result else F.col("result").isin(*DIFFERENCES))


def items_index(rows: DataFrame) -> DataFrame:
    """Of files of items, each a range of ids in order: file, first and the number of rows of each result."""
    counts = [F.count_if(F.col("result") == r).alias(r) for r in RESULTS]
    return rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("external_id").alias("first"), *counts)


def files_of_page(index: DataFrame, page: int, size: int, result: str | None = None) -> list[tuple[str, int]]:
    """The files that hold a page of differences (or of one result) and the row behind it, in order, with the rows before each.

    The index has a row for each file; those of the page are as many as it has ranges, however deep it lies.
    """
    n = F.col(result) if result else sum((F.col(r) for r in DIFFERENCES[1:]), F.col(DIFFERENCES[0]))
    sized = index.select("file", "first", n.alias("n")).where("n > 0")
    before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sized.withColumn("before", before).where((F.col("before") < (page + 1) * size + 1) & (F.col("before") + F.col("n") > page * size))
    return [(r.file, r.before) for r in held.orderBy("first").collect()]


def differences_page(found: DataFrame, page: int, size: int) -> DataFrame:
    """A page of all differences with has_next in each row, without a second query: one row beyond the page is read."""
    more = differences(found).orderBy(*KEY).offset(page * size).limit(size + 1)
    numbered = more.withColumn("_n", F.row_number().over(Window.orderBy(*KEY))).withColumn("has_next", F.count(F.lit(1)).over(Window.partitionBy()) > size)
    return numbered.where(F.col("_n") <= size).select(*KEY, "result", "has_next")
