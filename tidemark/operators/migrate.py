"""Batch migration: writes, outcomes, page counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_KEY = ["tenant_id", "external_id"]
COUNTERS = ("processed", "succeeded", "skipped", "failed")


def create_if_absent(new: DataFrame, target: DataFrame) -> DataFrame:
    """The target with the new rows whose key it doesn't hold; rows that are there stay as they are. Of new rows with one key, the least is written."""
    rest = [c for c in new.columns if c not in TARGET_KEY]
    one = new.groupBy(*TARGET_KEY).agg(F.min(F.struct(*rest)).alias("_row")).select(*TARGET_KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return target.unionByName(one.join(target.select(*TARGET_KEY), TARGET_KEY, "left_anti"))


def upsert(new: DataFrame, target: DataFrame, now: Column) -> DataFrame:
    """The target after new rows (unique keys) replace the data of those with their key; id and created_at are kept."""
    data = [c for c in new.columns if c not in TARGET_KEY]
    joined = target.join(new.select(*TARGET_KEY, *[F.col(c).alias(f"_new_{c}") for c in data], F.lit(True).alias("_new")), TARGET_KEY, "full_outer")
    written = F.col("_new").isNotNull()
    out = [F.when(written, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in data]
    kept = [F.col(c) for c in target.columns if c not in (*TARGET_KEY, *data, "created_at", "updated_at")]
    times = [F.coalesce("created_at", now).alias("created_at"), F.when(written, now).otherwise(F.col("updated_at")).alias("updated_at")] if "created_at" in target.columns else []
    return joined.select(*TARGET_KEY, *kept, *out, *times)


def migration_outcome(claim: Column, valid: Column, written: Column, taken_over: Column) -> Column:
    """What became of one record: its claim, then validation and write, then the fence at the end."""
    return (
        F.when(claim == "ALREADY_MIGRATED", "ALREADY_MIGRATED")
        .when(claim == "CLAIMED_BY_OTHER_WORKER", "CLAIMED_BY_OTHER_WORKER")
        .when(taken_over, "LEASE_LOST")
        .when(valid & written, "MIGRATED")
        .otherwise("FAILED")
    )


def page_result(outcome: Column) -> Column:
    """MIGRATED and ALREADY_MIGRATED succeed; a record that another worker holds, or took, is skipped."""
    return F.when(outcome.isin("MIGRATED", "ALREADY_MIGRATED"), "SUCCEEDED").when(outcome.isin("CLAIMED_BY_OTHER_WORKER", "LEASE_LOST"), "SKIPPED").otherwise("FAILED")


def page_progress(results: DataFrame) -> DataFrame:
    """Counters of each page (tenant_id, page, result)."""
    is_ = lambda r: F.count_if(F.col("result") == r)
    return results.groupBy("tenant_id", "page").agg(F.count(F.lit(1)).alias("processed"), is_("SUCCEEDED").alias("succeeded"), is_("SKIPPED").alias("skipped"), is_("FAILED").alias("failed"))


def running_totals(progress: DataFrame) -> DataFrame:
    """A job's counters as they stand once a page is recorded, and the page it would go on with."""
    upto = Window.partitionBy("tenant_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return progress.select("tenant_id", (F.col("page") + 1).alias("next_page"), *[F.sum(c).over(upto).alias(c) for c in COUNTERS])


def final_status(failed: Column) -> Column:
    return F.when(failed > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")


def final_jobs(tenants: DataFrame, progress: DataFrame) -> DataFrame:
    """Each tenant's completed job; one without rows has read one empty page."""
    totals = progress.groupBy("tenant_id").agg((F.max("page") + 1).alias("next_page"), *[F.sum(c).alias(c) for c in COUNTERS])
    joined = tenants.select("tenant_id").distinct().join(totals, "tenant_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS]
    return joined.select("tenant_id", F.coalesce("next_page", F.lit(1)).alias("next_page"), *counts, final_status(F.coalesce("failed", F.lit(0))).alias("status"))
