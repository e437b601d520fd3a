"""Generated source records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canonical import padded_id


def bulk_tenant(spark: SparkSession, rows: int = 1050, empty_every: int = 100) -> DataFrame:
    """A tenant of numbered records; the email of every so many is empty."""
    n = F.col("id")
    email = F.when(n % empty_every == 0, "").otherwise(F.concat(F.lit("candidate"), n.cast("string"), F.lit("@example.com")))
    return spark.range(1, rows + 1).select(
        padded_id(n).alias("external_id"), F.lit("tenant-bulk").alias("tenant_id"), F.concat(F.lit("First"), n.cast("string")).alias("first_name"), F.concat(F.lit("Last"), n.cast("string")).alias("last_name"), email.alias("email")
    )
