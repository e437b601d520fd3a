import json

from pyspark.sql import functions as F

from tidemark.model import INBOX_STATE, STORED_CANDIDATE
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import inbox

SOURCE = "tenant_id string, external_id string, first_name string, last_name string, email string"


def event(i, candidate="c1", tenant="t", at="2026-01-01T10:00:00Z"):
    return json.dumps({"eventId": i, "tenantId": tenant, "candidateId": candidate, "occurredAt": at})


def test_inbox_stream(spark, tmp_path):
    state = {"rows": [("t", "c1", "A", "L", "a@x"), ("t", "c2", "B", "L", "")]}
    boxes = SnapshotTable(spark, f"{tmp_path}/inbox", INBOX_STATE, ("event_id",), 4), SnapshotTable(spark, f"{tmp_path}/target", STORED_CANDIDATE, ("tenant_id", "external_id"), 4)

    def send(name, *values):
        spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "key string, value string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def run():
        messages = spark.readStream.schema("key string, value string").json(f"{tmp_path}/in")
        inbox.start_inbox(spark, messages, lambda: spark.createDataFrame(state["rows"], SOURCE), *boxes, f"{tmp_path}/dlt", f"{tmp_path}/log").awaitTermination()

    send("1", event("e1"), event("e1"), event("e2", "c2"), event("e3", "gone"), "{not json", event("e4", None))
    run()
    status = {r.event_id: (r.status, r.attempts) for r in boxes[0].read().collect()}
    assert status == {"e1": ("COMPLETED", 1), "e2": ("FAILED", 1), "e3": ("FAILED", 1)}
    letters = {r.error for r in spark.read.parquet(f"{tmp_path}/dlt").collect()}
    assert letters == {"Candidate email is required", "SOURCE_NOT_FOUND", "UNREADABLE_MESSAGE", "INCOMPLETE_EVENT"}
    assert spark.read.parquet(f"{tmp_path}/dlt").where(F.col("value") == "{not json").count() == 1
    before = boxes[1].read().first()
    # The record has changed, the failed event comes again and now succeeds; a used id for another record doesn't.
    state["rows"] = [("t", "c1", "A2", "L", "a@x"), ("t", "c2", "B", "L", "b@x")]
    send("2", event("e1"), event("e2", "c2"), event("e1", "c2"), event("e5"))
    run()
    status = {r.event_id: (r.status, r.attempts) for r in boxes[0].read().collect()}
    assert status["e1"] == ("COMPLETED", 1) and status["e2"] == ("COMPLETED", 2) and status["e5"] == ("COMPLETED", 1)
    rows = {r.external_id: r for r in boxes[1].read().collect()}
    assert rows["c1"].first_name == "A2" and rows["c1"].created_at == before.created_at and rows["c2"].email == "b@x"
    assert spark.read.parquet(f"{tmp_path}/dlt").where("error = 'REUSED_EVENT_ID'").count() == 1


EMPTY = "event_id string, tenant_id string, candidate_id string, status string, attempts int, occurred_at timestamp, last_error string, updated_at timestamp"


def test_first_delivery_by_offset_names_the_event(spark):
    rows = [("k", event("e", "c1", at="2026-01-02T00:00:00Z"), 0, 5), ("k", event("e", "c2", at="2026-01-01T00:00:00Z"), 0, 6), ("k", "{no", 0, 7), ("k", None, 0, 8)]
    messages = spark.createDataFrame(rows, "key string, value string, partition int, offset long")
    source = spark.createDataFrame([("t", "c1", "A", "L", "a@x"), ("t", "c2", "B", "L", "b@x")], SOURCE)
    got = {(r.candidate_id, r.error): r.outcome for r in inbox.judge_batch(messages, spark.createDataFrame([], INBOX_STATE), source).collect()}
    assert got == {("c1", None): "PROCESSED", ("c2", "REUSED_EVENT_ID"): "DLT", (None, "UNREADABLE_MESSAGE"): "DLT"}


def test_a_failed_event_may_come_again_however_often(spark):
    held = spark.createDataFrame([("e", "t", "c1", "FAILED", 3, None, "x", None)], EMPTY)
    source = spark.createDataFrame([("t", "c1", "A", "L", "a@x")], SOURCE)
    row = inbox.judge_batch(spark.createDataFrame([("k", event("e"))], "key string, value string"), held, source).first()
    assert (row.outcome, row.error) == ("PROCESSED", None)


def test_passing_failures_are_tried_again_up_to_the_bound(spark, tmp_path):
    tried = []

    def write(rows):
        ids = sorted(r.external_id for r in rows.collect())
        tried.append(ids)
        failing = [("t", i, "PERMANENT" if i == "c4" else "TRANSIENT") for i in ids if i in ("c3", "c4") or (i == "c2" and len(tried) == 1)]
        return spark.createDataFrame(failing, "tenant_id string, external_id string, failure string")

    boxes = SnapshotTable(spark, f"{tmp_path}/inbox", INBOX_STATE, ("event_id",), 4), SnapshotTable(spark, f"{tmp_path}/target", STORED_CANDIDATE)
    source = spark.createDataFrame([("t", f"c{i}", "A", "L", "a@x") for i in range(1, 5)], SOURCE)
    spark.createDataFrame([(f"k{i}", event(f"e{i}", f"c{i}")) for i in range(1, 5)], "key string, value string").coalesce(1).write.json(f"{tmp_path}/in")
    messages = spark.readStream.schema("key string, value string").json(f"{tmp_path}/in")
    inbox.start_inbox(spark, messages, lambda: source, *boxes, f"{tmp_path}/dlt", f"{tmp_path}/log", write=write).awaitTermination()
    assert tried == [["c1", "c2", "c3", "c4"], ["c2", "c3"], ["c3"]]
    got = {r.event_id: (r.status, r.attempts) for r in boxes[0].read().collect()}
    assert got == {"e1": ("COMPLETED", 1), "e2": ("COMPLETED", 2), "e3": ("FAILED", 3), "e4": ("FAILED", 1)}
    letters = {r.key: r.error for r in spark.read.parquet(f"{tmp_path}/dlt").collect()}
    assert letters == {"k3": "target write failed (TRANSIENT)", "k4": "target write failed (PERMANENT)"}


def test_an_event_is_not_lost_behind_a_reused_id(spark):
    """A failed event comes again in one batch with a delivery of its id for another record, which is first."""
    held = spark.createDataFrame([("e", "t", "c1", "FAILED", 1, None, "x", None)], EMPTY)
    source = spark.createDataFrame([("t", "c1", "A", "L", "a@x"), ("t", "c2", "B", "L", "b@x")], SOURCE)
    rows = [("k", event("e", "c2"), 0, 1), ("k", event("e", "c1"), 0, 2), ("k", event("e", "c1"), 0, 3)]
    judged = inbox.judge_batch(spark.createDataFrame(rows, "key string, value string, partition int, offset long"), held, source)
    got = sorted((r.offset, r.candidate_id, r.outcome, r.error) for r in judged.collect())
    assert got == [(1, "c2", "DLT", "REUSED_EVENT_ID"), (2, "c1", "PROCESSED", None), (3, "c1", "DUPLICATE", None)]
    after = inbox.inbox_after(judged.withColumn("tries", F.lit(1)), held, F.current_timestamp()).first()
    assert (after.candidate_id, after.status, after.attempts) == ("c1", "COMPLETED", 2)


def test_a_record_of_another_key_is_a_dead_letter(spark):
    source = spark.createDataFrame([("t", "c1", "t", "c1", "A", "L", "a@x", None), ("t", "c2", "t", "c9", "B", "L", "b@x", None), ("t", "c3", None, None, None, None, None, "PERMANENT")], "asked_tenant string, asked_id string, " + SOURCE + ", failure string")
    rows = [("k", event(f"e{i}", f"c{i}"), 0, i) for i in (1, 2, 3, 4)]
    judged = inbox.judge_batch(spark.createDataFrame(rows, "key string, value string, partition int, offset long"), spark.createDataFrame([], INBOX_STATE), source)
    assert {r.candidate_id: r.error for r in judged.collect()} == {"c1": None, "c2": "SOURCE_IDENTITY", "c3": "source read failed (PERMANENT)", "c4": "SOURCE_NOT_FOUND"}
