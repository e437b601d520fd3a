"""The change stream: an idempotent inbox in front of the target, dead letters beside it.

Messages are JSON with eventId, tenantId, candidateId and occurredAt, from any source with key and value columns (Kafka
in production, files in tests); partition and offset, where the source has them, give the order of deliveries. Each
micro-batch meets the inbox and the current source in DataFrame joins. A completed event is a duplicate; a failed one is
tried again at each redelivery, however often. A write that fails for a passing reason is tried again within its
delivery, up to max_attempts times, and then goes to the dead letters. Batches are idempotent: a repeated batch finds its
events completed, and only the buckets of the keys in a batch are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import is_blank, truncate_error
from tidemark.model import INBOX_STATE
from tidemark.operators.migrate import upsert
from tidemark.operators.rules import EMAIL_REQUIRED, event_complete
from tidemark.sources.scratch import materialize
from tidemark.sources.snapshots import SnapshotTable

MESSAGE = "eventId string, tenantId string, candidateId string, occurredAt timestamp"


def parsed(messages: DataFrame) -> DataFrame:
    """key, value, topic, partition, offset (null where the source has none) and the event's columns, null throughout for an unreadable value."""
    event = F.from_json(F.col("value").cast("string"), MESSAGE)
    place = [(F.col(c) if c in messages.columns else F.lit(None)).cast(t).alias(c) for c, t in (("topic", "string"), ("partition", "int"), ("offset", "long"))]
    return messages.select(
        "key", "value", *place, event["eventId"].alias("event_id"), event["tenantId"].alias("tenant_id"), event["candidateId"].alias("candidate_id"), event["occurredAt"].alias("occurred_at")
    )


def judge_batch(messages: DataFrame, inbox: DataFrame, source: DataFrame) -> DataFrame:
    """outcome (PROCESSED, DUPLICATE or DLT) and error of each message of a batch, with the source's current fields.

    Deliveries of an event are taken in the order of partition and offset, or of their own fields where there is none.
    Incomplete and unreadable ones are judged beforehand: they share no id to be grouped by. Only deliveries of the record
    that an event was first for can be its duplicates: one of another record takes no turn from them.

    source may hold what was asked for (asked_tenant, asked_id) and why a record couldn't be got (failure), as
    sources.rest.fetch_records gives them: then a record of another key, or none, goes to the dead letters.
    """
    complete = event_complete(F.col("event_id"), F.col("tenant_id"), F.col("candidate_id"), F.col("occurred_at"))
    events = parsed(messages).withColumn("complete", F.coalesce(complete, F.lit(False)))
    order = ["partition", "offset", "occurred_at", "tenant_id", "candidate_id"]
    w = Window.partitionBy("event_id").orderBy(*order)
    whole = events.where("complete").withColumn("_first", F.first(F.struct("tenant_id", "candidate_id")).over(w))
    known = inbox.select(F.col("event_id").alias("_e"), F.struct("tenant_id", "candidate_id").alias("_known"), F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    asked = [F.col(a if a in source.columns else c) for a, c in (("asked_tenant", "tenant_id"), ("asked_id", "external_id"))]
    failure = F.col("failure") if "failure" in source.columns else F.lit(None).cast("string")
    own = F.struct(F.col("tenant_id").alias("tenant_id"), F.col("external_id").alias("candidate_id")).eqNullSafe(F.struct(asked[0].alias("tenant_id"), asked[1].alias("candidate_id")))
    now = source.select(asked[0].alias("_t"), asked[1].alias("_c"), "first_name", "last_name", "email", failure.alias("_failure"), own.alias("_own"), F.lit(True).alias("_found"))
    joined = whole.join(known, whole["event_id"] == known["_e"], "left").join(now, (whole["tenant_id"] == now["_t"]) & (whole["candidate_id"] == now["_c"]), "left")
    same = F.struct("tenant_id", "candidate_id").eqNullSafe(F.coalesce("_known", "_first"))
    joined = joined.withColumn("_same", same).withColumn("rank", F.row_number().over(Window.partitionBy("event_id", "_same").orderBy(*order)))
    same = F.col("_same")
    unread = F.concat(F.lit("source read failed ("), "_failure", F.lit(")"))
    fault = F.when(F.col("_found").isNull(), "SOURCE_NOT_FOUND").when(F.col("_failure").isNotNull(), unread).when(~F.col("_own"), "SOURCE_IDENTITY").when(is_blank(F.col("email")), EMAIL_REQUIRED)
    done = F.coalesce(F.col("_status") == "COMPLETED", F.lit(False))
    outcome = F.when(~same, "DLT").when(done, "DUPLICATE").when(fault.isNotNull(), "DLT").when(F.col("rank") > 1, "DUPLICATE").otherwise("PROCESSED")
    error = F.when(~same, "REUSED_EVENT_ID").when(~done, fault)
    columns = ["key", "value", "topic", "partition", "offset", "event_id", "tenant_id", "candidate_id", "occurred_at", "_attempts", "first_name", "last_name", "email", "outcome", "error", "same_identity", "complete"]
    judged = joined.withColumn("outcome", outcome).withColumn("error", error).withColumn("same_identity", same).select(*columns)
    bad = F.when(F.col("event_id").isNull(), "UNREADABLE_MESSAGE").otherwise("INCOMPLETE_EVENT")
    broken = events.where(~F.col("complete")).withColumn("outcome", F.lit("DLT")).withColumn("error", bad).withColumn("same_identity", F.lit(False))
    return judged.unionByName(broken.select(*[c for c in columns if c in broken.columns]), allowMissingColumns=True)


def write_with_retries(rows: DataFrame, write: Callable[[DataFrame], DataFrame], max_attempts: int) -> DataFrame:
    """tenant_id, external_id, tries and failed (the class of the last failure, null once written) of each row.

    write returns (tenant_id, external_id, failure) of the rows that it couldn't write; those with a TRANSIENT failure are
    given to it again, max_attempts times in all.
    """
    done, left = [], rows
    for attempt in range(1, max_attempts + 1):
        failures = materialize(write(left).select("tenant_id", "external_id", F.col("failure").alias("failed")))
        last = attempt == max_attempts
        tried = left.select("tenant_id", "external_id").join(failures, ["tenant_id", "external_id"], "left").withColumn("tries", F.lit(attempt))
        again = F.coalesce(F.col("failed") == "TRANSIENT", F.lit(False)) & F.lit(not last)
        done.append(tried.where(~again))
        left = left.join(failures.where("failed = 'TRANSIENT'").select("tenant_id", "external_id"), ["tenant_id", "external_id"], "left_semi")
        if last or left.isEmpty():
            return materialize(reduce(DataFrame.unionByName, done))
    raise ValueError("max_attempts must be 1 or more")


def after_writes(judged: DataFrame, written: DataFrame) -> DataFrame:
    """Judged messages once their writes are done: those whose record couldn't be written go to the dead letters; tries counts claims."""
    of_write = written.select(F.col("tenant_id").alias("_wt"), F.col("external_id").alias("_wc"), "tries", "failed")
    joined = judged.join(of_write, (judged["outcome"] == "PROCESSED") & (judged["tenant_id"] == of_write["_wt"]) & (judged["candidate_id"] == of_write["_wc"]), "left")
    lost = F.col("failed").isNotNull()
    error = F.when(lost, F.concat(F.lit("target write failed ("), "failed", F.lit(")"))).otherwise(F.col("error"))
    return joined.withColumn("error", error).withColumn("outcome", F.when(lost, "DLT").otherwise(F.col("outcome"))).withColumn("tries", F.coalesce("tries", F.lit(1))).drop("_wt", "_wc", "failed")


def inbox_after(judged: DataFrame, inbox: DataFrame, now) -> DataFrame:
    """The inbox once a judged batch is in it; events of another identity and incomplete ones leave no row."""
    own = judged.where("complete and same_identity and outcome <> 'DUPLICATE'").groupBy("event_id").agg(
        F.first("tenant_id").alias("tenant_id"), F.first("candidate_id").alias("candidate_id"), F.min("occurred_at").alias("occurred_at"), F.max(F.coalesce("_attempts", F.lit(0))).alias("before"),
        F.sum("tries").alias("claims"), F.bool_or(F.col("outcome") == "PROCESSED").alias("done"), F.max("error").alias("error"),
    )
    new = own.select("event_id", "tenant_id", "candidate_id", F.when(F.col("done"), "COMPLETED").otherwise("FAILED").alias("status"), (F.col("before") + F.col("claims")).cast("int").alias("attempts"), "occurred_at", F.when(~F.col("done"), truncate_error(F.col("error"))).alias("last_error"), now.alias("updated_at"))
    return inbox.join(new.select("event_id"), "event_id", "left_anti").select(*INBOX_STATE.names).unionByName(new)


def start_inbox(
    spark: SparkSession,
    messages: DataFrame,
    read_source: Callable[[], DataFrame],
    inbox: SnapshotTable,
    target: SnapshotTable,
    dead_letters: str,
    checkpoint: str,
    max_attempts: int = 3,
    write: Callable[[DataFrame], DataFrame] | None = None,
):
    """A query over a stream of key, value. read_source is called for each batch, so that records are as they are then.

    write: see write_with_retries; the upsert into target, which fails as a whole or not at all, if there is none.
    """

    def upsert_target(rows: DataFrame) -> DataFrame:
        now = F.current_timestamp()
        target.merge(rows, lambda held: upsert(rows, held, now).withColumn("id", F.coalesce("id", F.concat_ws(":", "tenant_id", "external_id"))))
        return spark.createDataFrame([], "tenant_id string, external_id string, failure string")

    def batch(df: DataFrame, number: int) -> None:
        now = F.current_timestamp()
        judged = materialize(judge_batch(df, inbox.read(), read_source()))
        rows = judged.where("outcome = 'PROCESSED'").select("tenant_id", F.col("candidate_id").alias("external_id"), "first_name", "last_name", "email").dropDuplicates(["tenant_id", "external_id"])
        written = write_with_retries(materialize(rows), write or upsert_target, max_attempts)
        judged = materialize(after_writes(judged, written))
        judged.where("outcome = 'DLT'").select("key", "value", "topic", "partition", "offset", "error").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        seen = judged.where("complete and same_identity and outcome <> 'DUPLICATE'")
        inbox.merge(seen.select("event_id").distinct(), lambda held: inbox_after(judged, held, now))

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kafka_messages(spark: SparkSession, servers: str, topic: str = "candidate-changes") -> DataFrame:
    """The production source: from the earliest offset, keys, values and their places as they came. Needs the Kafka connector."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load().select(F.col("key").cast("string").alias("key"), "value", "topic", "partition", "offset")
