"""Change events: inbox, outcome of each delivery, dead letters, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import is_blank, partition_key
from tidemark.operators.rules import event_complete, same_identity

PERMANENT = ("INCOMPLETE_EVENT", "REUSED_EVENT_ID", "SOURCE_NOT_FOUND", "SOURCE_IDENTITY", "INVALID_RECORD")


def with_identity(deliveries: DataFrame) -> DataFrame:
    """complete, rank (among the complete deliveries of an id) and whether the identity is that of the first of them.

    Incomplete deliveries, which may share a null id, are not ranked: no task holds them all.
    """
    ok = event_complete(F.col("event_id"), F.col("tenant_id"), F.col("candidate_id"), F.col("occurred_at"))
    marked = deliveries.withColumn("complete", F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy("event_id").orderBy("delivery_no")
    first = F.first(F.struct("tenant_id", "candidate_id")).over(w)
    whole = marked.where("complete").withColumn("rank", F.row_number().over(w)).withColumn("_first", first)
    whole = whole.withColumn("same_identity", same_identity(F.col("tenant_id"), F.col("candidate_id"), F.col("_first.tenant_id"), F.col("_first.candidate_id"))).drop("_first")
    broken = marked.where("not complete").withColumn("rank", F.lit(None).cast("int")).withColumn("same_identity", F.lit(False))
    return whole.unionByName(broken)


def lookup_source(events: DataFrame, source: DataFrame) -> DataFrame:
    """Events with the current state of their record; found is false where there is none.

    source may hold what was asked for (asked_tenant, asked_id) beside the ids of the record that came; own_identity tells
    whether these are the event's.
    """
    asked = [F.col(a if a in source.columns else c) for a, c in (("asked_tenant", "tenant_id"), ("asked_id", "external_id"))]
    own = [F.col("tenant_id").alias("own_tenant"), F.col("external_id").alias("own_id")]
    now = source.select(asked[0].alias("source_tenant"), asked[1].alias("source_id"), *own, "first_name", "last_name", "email", F.lit(True).alias("found"))
    on = (events["tenant_id"] == now["source_tenant"]) & (events["candidate_id"] == now["source_id"])
    same = same_identity(F.col("tenant_id"), F.col("candidate_id"), F.col("own_tenant"), F.col("own_id"))
    return events.join(now, on, "left").withColumn("found", F.coalesce("found", F.lit(False))).withColumn("own_identity", same).drop("own_tenant", "own_id")


def outcomes(deliveries: DataFrame, source: DataFrame) -> DataFrame:
    """outcome (PROCESSED, DUPLICATE or DLT) and reason of each delivery.

    A delivery that fails on its data fails again at a redelivery: it is no duplicate.
    """
    seen = lookup_source(with_identity(deliveries), source)
    reason = (
        F.when(~F.col("complete"), "INCOMPLETE_EVENT")
        .when(~F.col("same_identity"), "REUSED_EVENT_ID")
        .when(~F.col("found"), "SOURCE_NOT_FOUND")
        .when(~F.col("own_identity"), "SOURCE_IDENTITY")
        .when(is_blank(F.col("email")), "INVALID_RECORD")
    )
    judged = seen.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNotNull(), "DLT").when(F.col("rank") > 1, "DUPLICATE").otherwise("PROCESSED")
    return judged.withColumn("outcome", outcome)


def failure_kind(error: Column) -> Column:
    """Permanent errors go to the dead letters at once; everything else is tried again."""
    return F.when(error.isin(*PERMANENT) | (error == "PERMANENT"), "PERMANENT").otherwise("RETRYABLE")


def delivery_outcome(status: Column, same_identity: Column, claimed: Column, taken_over: Column, error: Column) -> Column:
    """One delivery against its inbox row: claim first, then the call, then the fence."""
    return (
        F.when(~same_identity, "PERMANENT")
        .when(~claimed & (status == "COMPLETED"), "DUPLICATE")
        .when(~claimed, "IN_PROGRESS")
        .when(taken_over, "LEASE_LOST")
        .when(error.isNull(), "PROCESSED")
        .otherwise(failure_kind(error))
    )


def dead_letters(judged: DataFrame) -> DataFrame:
    """The original event, its key, and why it was given up."""
    key = partition_key(F.col("tenant_id"), F.col("candidate_id"))
    return judged.where("outcome = 'DLT'").select("event_id", "delivery_no", key.alias("message_key"), "reason")


def attempts(judged: DataFrame) -> DataFrame:
    """Claims of each event id: one, and one more for each redelivery of an attempt that failed."""
    own = judged.where(F.col("complete") & F.col("same_identity"))
    failed = F.col("reason").isNotNull()
    return own.groupBy("event_id").agg(F.count_if(failed | (F.col("outcome") == "PROCESSED")).alias("attempts"))


def partition_order(deliveries: DataFrame) -> DataFrame:
    """Deliveries in the order in which a partition by record hands them out."""
    key = partition_key(F.col("tenant_id"), F.col("candidate_id"))
    w = Window.partitionBy("message_key").orderBy("occurred_at", "event_id", "delivery_no")
    return deliveries.where("candidate_id is not null").withColumn("message_key", key).withColumn("seq", F.row_number().over(w)).select("message_key", "event_id", "delivery_no", "seq")
