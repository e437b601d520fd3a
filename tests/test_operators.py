import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.model import RECORD_STATE
from tidemark.operators import migrate, paging, reconcile, resilience, rules, state
from tidemark.sources.generated import bulk_tenant

NOW = dt.datetime(2026, 1, 1, 12)
AGO = lambda **k: NOW - dt.timedelta(**k)

CANDIDATE = "tenant_id string, external_id string, first_name string, last_name string, email string"


@pytest.fixture(scope="module")
def clock(spark):
    return F.lit(NOW).cast("timestamp"), F.expr("INTERVAL '5' MINUTE")


def candidates(spark, *rows):
    return spark.createDataFrame([("t", i, f, "L", e) for i, f, e in rows], CANDIDATE)


def test_reconciliation_of_seven_and_five(spark):
    source = candidates(spark, *[(f"c{i}", "A", "e") for i in range(1, 8)])
    target = candidates(spark, *[(f"c{i}", "A" if i < 5 else "B", "e") for i in range(1, 6)])
    found = reconcile.items(source, target)
    row = reconcile.summarize(found).first()
    assert (row.source_count, row.target_count, row.matched_count, row.missing_count, row.mismatched_count, row.unexpected_count) == (7, 5, 4, 2, 1, 0)
    rows, more = paging.page_with_next(reconcile.differences(found).select("external_id"), 0, 2, "external_id")
    assert [r.external_id for r in rows] == ["c5", "c6"] and more
    rows, more = paging.page_with_next(reconcile.differences(found).select("external_id"), 1, 2, "external_id")
    assert [r.external_id for r in rows] == ["c7"] and not more


def test_null_comparison_is_a_mismatch(spark):
    row = spark.range(1).select(reconcile.classify(F.lit(True), F.lit(True), F.lit(None).cast("boolean")).alias("r")).first()
    assert row.r == "MISMATCHED"


def test_scan_checks_fail_the_run(spark):
    bad = candidates(spark, (" ", "A", "e"))
    with pytest.raises(Exception, match="without an id"):
        reconcile.checked(bad).collect()
    with pytest.raises(Exception, match="another tenant"):
        reconcile.checked(candidates(spark, ("c", "A", "e")), F.lit("other")).collect()
    assert reconcile.checked(candidates(spark, ("c", "A", "e")), F.lit("t")).count() == 1


def test_last_scanned_row_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in reconcile.last_write(df, ["k"], "seq").collect()} == {("a", "y"), ("b", "z")}


def test_claims(spark, clock):
    held = spark.createDataFrame(
        [("t", "failed", "FAILED", AGO(seconds=10), None), ("t", "fresh", "IN_PROGRESS", AGO(minutes=1), "w"), ("t", "stale", "IN_PROGRESS", AGO(minutes=10), "w"), ("t", "edge", "IN_PROGRESS", AGO(minutes=5), "w"), ("t", "done", "COMPLETED", AGO(days=1), None)],
        RECORD_STATE,
    )
    asked = spark.createDataFrame([("t", k, f"w{n}", n) for k in ("failed", "fresh", "stale", "edge", "done", "new") for n in range(50)], "tenant_id string, source_record_id string, lease_owner string, request_seq int")
    claims = state.claim_records(asked, held, *clock)
    got = {(r.source_record_id, r.outcome): r["count"] for r in claims.groupBy("source_record_id", "outcome").count().collect()}
    assert got == {
        ("failed", "CLAIMED"): 1, ("failed", "CLAIMED_BY_OTHER_WORKER"): 49, ("fresh", "CLAIMED_BY_OTHER_WORKER"): 50, ("stale", "CLAIMED"): 1, ("stale", "CLAIMED_BY_OTHER_WORKER"): 49,
        ("edge", "CLAIMED_BY_OTHER_WORKER"): 50, ("done", "ALREADY_MIGRATED"): 50, ("new", "CLAIMED"): 1, ("new", "CLAIMED_BY_OTHER_WORKER"): 49,
    }
    after = {r.source_record_id: (r.status, r.lease_owner) for r in state.state_after_claims(claims, held, clock[0]).collect()}
    assert after["new"] == ("IN_PROGRESS", "w0") and after["stale"] == ("IN_PROGRESS", "w0") and after["done"] == ("COMPLETED", None)


def test_finish_is_fenced(spark, clock):
    held = spark.createDataFrame([("t", "a", "IN_PROGRESS", NOW, "me"), ("t", "b", "IN_PROGRESS", NOW, "other"), ("t", "c", "COMPLETED", NOW, None)], RECORD_STATE)
    asked = spark.createDataFrame([("t", k, "me", "COMPLETED") for k in "abc"], "tenant_id string, source_record_id string, owner string, new_status string")
    got = {r.source_record_id: (r.status, r.applied, r.lease_owner) for r in state.finish_records(asked, held, clock[0]).collect()}
    assert got == {"a": ("COMPLETED", True, None), "b": ("IN_PROGRESS", False, "other"), "c": ("COMPLETED", False, None)}


def test_failed_jobs_block_and_failed_runs_do_not(spark):
    table = spark.createDataFrame([(1, "t", "FAILED")], "job_id int, tenant_id string, status string")
    asked = spark.createDataFrame([(5, "t"), (6, "t"), (7, "u")], "job_id int, tenant_id string")
    jobs = {r.tenant_id: (r.job_id, r.created) for r in state.create_or_get_job(asked, table).collect()}
    assert jobs == {"t": (1, False), "u": (7, True)}
    runs = state.create_or_get_run(asked.withColumnRenamed("job_id", "run_id"), table.withColumnRenamed("job_id", "run_id"))
    assert {r.tenant_id: (r.run_id, r.created) for r in runs.collect()} == {"t": (5, True), "u": (7, True)}


def test_event_claims_guard_identity_and_count_attempts(spark, clock):
    inbox = spark.createDataFrame([("e1", "t", "c", "FAILED", NOW, 1), ("e2", "t", "c", "COMPLETED", NOW, 1)], "event_id string, tenant_id string, candidate_id string, status string, updated_at timestamp, attempts int")
    asked = spark.createDataFrame([("e1", "t", "c", 1), ("e1", "t", "c", 2), ("e2", "t", "c", 1), ("e3", "t", "c", 1)], "event_id string, tenant_id string, candidate_id string, request_seq int")
    got = {(r.event_id, r.request_seq): (r.claimed, r.attempts) for r in state.claim_events(asked, inbox, *clock).collect()}
    assert got == {("e1", 1): (True, 2), ("e1", 2): (False, 1), ("e2", 1): (False, 1), ("e3", 1): (True, 1)}
    stolen = spark.createDataFrame([("e1", "x", "c", 1)], asked.schema)
    assert state.claim_events(stolen, inbox, *clock).first().claimed is False


def test_event_finish_truncates_errors(spark):
    inbox = spark.createDataFrame([("e", "IN_PROGRESS", "me")], "event_id string, status string, lease_owner string")
    asked = spark.createDataFrame([("e", "me", "FAILED", "x" * 3000)], "event_id string, owner string, new_status string, error string")
    row = state.finish_events(asked, inbox).first()
    assert row.applied and row.status == "FAILED" and len(row.last_error) == 1000


def test_writes(spark):
    target = spark.createDataFrame([("t", "a", "1", "A", "L", "e", NOW, NOW)], "tenant_id string, external_id string, id string, first_name string, last_name string, email string, created_at timestamp, updated_at timestamp")
    new = candidates(spark, ("a", "B", "f"), ("b", "C", "g"))
    later = NOW + dt.timedelta(hours=1)
    rows = {r.external_id: r for r in migrate.upsert(new, target, F.lit(later).cast("timestamp")).collect()}
    assert rows["a"].id == "1" and rows["a"].first_name == "B" and rows["a"].created_at == NOW and rows["a"].updated_at == later
    assert rows["b"].id is None and rows["b"].created_at == later
    kept = {r.external_id: r.first_name for r in migrate.create_if_absent(new, target.select(*new.columns)).collect()}
    assert kept == {"a": "A", "b": "C"}


def test_outcomes_and_counters(spark):
    rows = [("CLAIMED", True, True, False, "MIGRATED"), ("CLAIMED", False, True, False, "FAILED"), ("CLAIMED", True, False, False, "FAILED"), ("CLAIMED", True, True, True, "LEASE_LOST"), ("CLAIMED", True, False, True, "LEASE_LOST"), ("ALREADY_MIGRATED", True, True, False, "ALREADY_MIGRATED"), ("CLAIMED_BY_OTHER_WORKER", True, True, False, "CLAIMED_BY_OTHER_WORKER")]
    df = spark.createDataFrame(rows, "claim string, valid boolean, written boolean, taken boolean, want string")
    got = df.select("want", migrate.migration_outcome(*[F.col(c) for c in ("claim", "valid", "written", "taken")]).alias("got")).withColumn("page", migrate.page_result(F.col("got"))).collect()
    assert all(r.want == r.got for r in got)
    assert {r.got: r.page for r in got} == {"MIGRATED": "SUCCEEDED", "ALREADY_MIGRATED": "SUCCEEDED", "FAILED": "FAILED", "LEASE_LOST": "SKIPPED", "CLAIMED_BY_OTHER_WORKER": "SKIPPED"}
    progress = spark.createDataFrame([("t", 0, 100, 97, 1, 2), ("t", 1, 50, 50, 0, 0)], "tenant_id string, page int, processed long, succeeded long, skipped long, failed long")
    last = migrate.running_totals(progress).orderBy(F.desc("next_page")).first()
    assert tuple(last)[1:] == (2, 150, 147, 1, 2)
    empty = migrate.final_jobs(spark.createDataFrame([("u",)], "tenant_id string"), progress).first()
    assert (empty.next_page, empty.processed, empty.status) == (1, 0, "COMPLETED")


def test_bulk_tenant(spark):
    rows = bulk_tenant(spark)
    paged = paging.with_pages(rows, 100)
    assert paged.agg(F.max("page")).first()[0] == 10
    assert rows.where(rules.email_error(F.col("email")).isNotNull()).count() == 10
    assert paging.page_of(rows, 10, 100, "external_id").count() == 50 and paging.page_of(rows, 11, 100, "external_id").count() == 0
    with pytest.raises(ValueError):
        paging.page_of(rows, 0, 1001, "external_id")


def test_failure_types(spark):
    want = {s: "TRANSIENT" for s in (408, 429, 502, 503, 504)} | {s: "PERMANENT" for s in (400, 401, 403, 404, 409, 422, 500, 501)} | {None: "TRANSIENT", 200: None}
    df = spark.createDataFrame([(s,) for s in want], "s int")
    assert {r.s: r.t for r in df.select("s", resilience.failure_type(F.col("s")).alias("t")).collect()} == want


def test_messages_hold_nothing_foreign(spark):
    calls = spark.createDataFrame([(1, "source", 503, "secret@example.com")], "call_seq long, system_name string, http_status int, body string")
    row = resilience.call_failures(calls).first()
    assert row.message == "source call failed (TRANSIENT, HTTP 503)" and "secret" not in str(row)


def test_breaker():
    b = resilience.Breaker(least=4)
    assert [b.call(t, True)[0] for t in range(4)] == ["CLOSED"] * 4
    assert b.call(5, True) == ("OPEN", False) and b.call(32.9, False) == ("OPEN", False)
    assert b.call(33, False) == ("HALF_OPEN", True) and b.call(34, False) == ("HALF_OPEN", True)
    assert b.call(35, False) == ("CLOSED", True)
    b = resilience.Breaker(least=4)
    for t in range(4):
        b.call(t, True)
    assert [b.call(40, True)[0], b.call(41, True)[0], b.call(42, True)[0]] == ["HALF_OPEN", "HALF_OPEN", "OPEN"]
    permanent = resilience.Breaker(least=4)
    assert all(permanent.call(t, False) == ("CLOSED", True) for t in range(20))


def test_breakers_are_apart(spark):
    rows = [(i, "source" if i % 2 else "target", dt.datetime(2026, 1, 1, 0, 0, i), 503 if i % 2 else 200) for i in range(30)]
    calls = spark.createDataFrame(rows, "call_seq long, system_name string, called_at timestamp, http_status int")
    got = resilience.breaker_states(calls).collect()
    assert {r.state for r in got if r.system_name == "target"} == {"CLOSED"}
    assert [r.permitted for r in sorted(got, key=lambda r: r.call_seq) if r.system_name == "source"].count(False) == 10


def test_large_tenants_are_numbered_without_a_window(spark):
    rows = [("t" if i % 3 else "u", f"c{i:04d}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "tenant_id string, external_id string, v int").repartition(7)
    by_window = {(r.tenant_id, r.external_id): r.page for r in paging.with_pages(df, 9).collect()}
    by_range = paging.with_pages(df, 9, window_rows=10)
    assert {(r.tenant_id, r.external_id): r.page for r in by_range.collect()} == by_window and by_range.columns == [*df.columns, "page"]


def test_window_rates_do_not_depend_on_blocks(spark):
    rows = [(i, "source" if i % 5 else "target", [200, 503, None, 404][i * 7 % 4]) for i in range(200)]
    calls = spark.createDataFrame(rows, "call_seq long, system_name string, http_status int").repartition(5)
    whole = sorted(map(tuple, resilience.window_rate(calls).collect()))
    assert sorted(map(tuple, resilience.window_rate(calls, block=15).collect())) == whole and len(whole) == 200


def plain_breaker(calls, window=10, least=5, percent=50, wait=30, trials=2):
    """The rules of a breaker told from its whole past at each call: the time it last opened, and what was let through since."""
    out, past = [], []  # past: (at, failed, phase) of calls that were let through
    opened, closed_from, half_from = None, 0, None
    for at, failed in calls:
        if opened is not None and half_from is None and at - opened >= wait:
            half_from = len(past)
        phase = "HALF_OPEN" if half_from is not None else "OPEN" if opened is not None else "CLOSED"
        out.append((phase, phase != "OPEN"))
        if phase == "OPEN":
            continue
        past.append(failed)
        seen = past[half_from:] if phase == "HALF_OPEN" else past[closed_from:][-window:]
        if len(seen) < (trials if phase == "HALF_OPEN" else least):
            continue
        if 100 * sum(seen) >= percent * len(seen):
            opened, half_from = at, None
            closed_from = len(past)
        elif phase == "HALF_OPEN":
            opened, half_from, closed_from = None, None, len(past)
    return out


def test_breaker_equals_an_independent_version():
    import random

    from tidemark.operators.resilience import Breaker

    for seed in range(60):
        rng, at, calls = random.Random(seed), 0.0, []
        for _ in range(300):
            at += rng.choice([0.1, 1, 5, 31])
            calls.append((at, rng.random() < rng.choice([0.1, 0.5, 0.9])))
        machine = Breaker()
        assert [machine.call(*c) for c in calls] == plain_breaker(calls)


def test_pages_meet_in_any_order_and_count_once(spark, tmp_path):
    """Pages of two runs, repeated, out of order, and with a changed record: a side never touches the other's columns."""
    from tidemark.operators.converge import WorkingTable

    table = WorkingTable(spark, "test_converge", f"file://{tmp_path}/w", 4)
    page = lambda run, place, *rows: spark.createDataFrame([(run, k, f, place) for k, f in rows], "run_id string, external_id string, fingerprint string, place int")
    try:
        assert table.items().count() == 0
        table.record("target", page("r", 1, ("b", "2"), ("c", "3")))
        table.record("source", page("r", 2, ("c", "x"), ("d", "4")))
        table.record("source", page("r", 1, ("a", "1"), ("b", "2"), ("c", "3")))
        table.record("source", page("r", 1, ("a", "1"), ("b", "2"), ("c", "3")))
        table.record("target", page("r", 2, ("d", "4"), ("e", "5")))
        table.record("source", page("other", 1, ("a", "1")))
        got = {r.external_id: (r.source_seen, r.target_seen, r.result) for r in table.items().where("run_id = 'r'").collect()}
        assert got == {"a": (True, False, "MISSING_IN_TARGET"), "b": (True, True, "MATCHED"), "c": (True, True, "MISMATCHED"), "d": (True, True, "MATCHED"), "e": (False, True, "UNEXPECTED_IN_TARGET")}
        counts = {r.run_id: r for r in table.summary().collect()}
        row = counts["r"]
        assert (row.source_count, row.target_count, row.matched_count, row.missing_count, row.unexpected_count, row.mismatched_count) == (4, 4, 2, 1, 1, 1)
        assert counts["other"].missing_count == 1
        table.record("source", page("r", 3, ("c", "3")))
        assert table.items().where("run_id = 'r' and external_id = 'c'").first().result == "MATCHED"
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = table.items()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table.drop()
