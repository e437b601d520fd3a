"""Pages of ordered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.operators.rules import check_page
from tidemark.sources.scratch import materialize


#: A tenant of up to so many rows is numbered by one task.
WINDOW_ROWS = 2_000_000


def with_row_numbers(df: DataFrame, partition: str, order: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """df with row_no, from 0, in the order of a column within each partition; order must be unique there.

    A window numbers partitions of moderate size. If one is larger, all rows are sorted by range and written; a row's
    number is then its place in its file plus the rows of its partition in the files before, so no task holds a partition.
    """
    largest = df.groupBy(partition).count().agg(F.max("count")).first()[0] or 0
    if largest <= window_rows:
        return df.withColumn("row_no", F.row_number().over(Window.partitionBy(partition).orderBy(order)).cast("long") - 1)
    placed = materialize(df.orderBy(partition, order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_file", F.shiftright("_place", 33))
    files = placed.groupBy(partition, "_file").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(partition).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("_before", F.coalesce(before, F.lit(0)))
    numbered = placed.join(files, [partition, "_file"]).withColumn("row_no", F.col("_place") - F.col("_first") + F.col("_before"))
    return numbered.select(*df.columns, "row_no")


def with_pages(df: DataFrame, size: int, partition: str = "tenant_id", order: str = "external_id", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """A page number, from 0, in the order of ids of each tenant."""
    check_page(0, size)
    numbered = with_row_numbers(df, partition, order, window_rows)
    return numbered.withColumn("page", F.floor(F.col("row_no") / size).cast("int")).drop("row_no")


def page_of(df: DataFrame, page: int, size: int, *order: str) -> DataFrame:
    """The rows of a page; none beyond the end."""
    check_page(page, size)
    return df.orderBy(*order).offset(page * size).limit(size)


def page_with_next(df: DataFrame, page: int, size: int, *order: str) -> tuple[list[Row], bool]:
    """The rows of a page and whether there are more: one row beyond the page tells."""
    check_page(page, size)
    rows = df.orderBy(*order).offset(page * size).limit(size + 1).collect()
    return rows[:size], len(rows) > size


def page_counts(df: DataFrame, size: int, partition: str = "tenant_id") -> DataFrame:
    """Rows and pages that a scan reads; an empty page counts for a tenant without rows."""
    return df.groupBy(partition).agg(F.count(F.lit(1)).alias("n_rows"), F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("long").alias("n_pages"))


def listing(df: DataFrame, tenant: str, order: str = "created_at") -> DataFrame:
    """All rows of a tenant in the order of a column."""
    return df.where(F.col("tenant_id") == tenant).orderBy(order)
