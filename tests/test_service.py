import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.plans.service import NotFound, NotReady, Service
from tidemark.sources.generated import bulk_tenant

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture
def service(spark, tmp_path):
    clock = {"now": T0}
    out = Service(spark, f"file://{tmp_path}/s", lambda: bulk_tenant(spark), clock=lambda: clock["now"])
    out.test_clock = clock
    return out


def test_batch_then_reconciliation(service):
    job = service.start_batch("tenant-bulk")
    assert job["status"] == "PENDING" and "lease_owner" not in job and service.start_batch("tenant-bulk")["job_id"] == job["job_id"]
    done = service.run_job(job["job_id"])
    assert (done["status"], done["next_page"], done["processed"], done["succeeded"], done["failed"]) == ("COMPLETED_WITH_ERRORS", 11, 1050, 1040, 10)
    assert service.target.read().count() == 1040
    again = service.run_job(service.start_batch("tenant-bulk")["job_id"])
    assert (again["succeeded"], again["failed"]) == (1040, 10) and service.target.read().count() == 1040
    run = service.start_reconciliation("tenant-bulk")
    assert "page_size" not in run
    with pytest.raises(ValueError):
        service.get_items(run["run_id"], 0, 5000)
    with pytest.raises(NotFound):
        service.get_items("none")
    with pytest.raises(NotReady):
        service.get_items(run["run_id"])
    run = service.run_reconciliation(run["run_id"])
    assert (run["status"], run["source_count"], run["target_count"], run["matched_count"], run["missing_count"]) == ("COMPLETED", 1050, 1040, 1040, 10)
    page = service.get_items(run["run_id"], 1, 4)
    assert [i["external_id"] for i in page["items"]] == [f"candidate-00{n}" for n in (500, 600, 700, 800)] and page["has_next"]
    assert len(service.get_items(run["run_id"], 2, 4, "MISSING_IN_TARGET")["items"]) == 2
    assert service.get_items(run["run_id"], 0, 4, "MISMATCHED")["items"] == []


def test_single_records_and_missing_ones(service):
    assert service.migrate_candidate("tenant-bulk", "candidate-00001") == "MIGRATED"
    assert service.migrate_candidate("tenant-bulk", "candidate-00001") == "ALREADY_MIGRATED"
    assert service.migrate_candidate("tenant-bulk", "candidate-00100") == "FAILED"
    for call in (lambda: service.migrate_candidate("tenant-bulk", "gone"), lambda: service.get_job("none"), lambda: service.get_run("none")):
        with pytest.raises(NotFound):
            call()


def test_empty_tenant_has_read_one_page(service):
    done = service.run_job(service.start_batch("empty")["job_id"])
    assert (done["status"], done["next_page"], done["processed"]) == ("COMPLETED", 1, 0)


def test_recovery_and_stored_errors(service, spark):
    job, run = service.start_batch("tenant-bulk"), service.start_reconciliation("tenant-bulk")
    service._set(service.runs, "run_id", run["run_id"], status="RUNNING", lease_owner="dead")
    service._set(service.jobs, "job_id", job["job_id"], status="RUNNING", lease_owner="dead")
    assert service.recover() == {"jobs": [], "failed_runs": [], "runs": [], "errors": {}}
    service.test_clock["now"] = T0 + dt.timedelta(minutes=11)
    second = service.start_reconciliation("other")
    got = service.recover()
    assert got == {"jobs": [job["job_id"]], "failed_runs": [run["run_id"]], "runs": [second["run_id"]], "errors": {}}
    row = service._one(service.runs, "run_id", run["run_id"])
    assert row.last_error == "Abandoned: no progress within lease timeout" and row.updated_at == row.completed_at == service.test_clock["now"] and row.lease_owner is None
    assert service.get_run(run["run_id"])["status"] == "FAILED" and service.get_job(job["job_id"])["processed"] == 1050
    service.read_source = lambda: spark.createDataFrame([("t", " ", "secret", "s", "secret@example.com")], "tenant_id string, external_id string, first_name string, last_name string, email string")
    bad = service.start_reconciliation("t")
    with pytest.raises(Exception):
        service.run_reconciliation(bad["run_id"])
    row = service.get_run(bad["run_id"])
    assert row["status"] == "FAILED" and row["source_count"] == 0 and "secret" not in row["last_error"]


def test_a_taken_job_is_let_go(service, spark):
    service.pages_a_step = 2
    job = service.start_batch("tenant-bulk")["job_id"]
    steps, migrate_rows = [], service._migrate

    def stolen(rows):
        out = migrate_rows(rows)
        steps.append(rows)
        if len(steps) == 3:
            service._set(service.jobs, "job_id", job, lease_owner="thief")
        return out

    service._migrate = stolen
    row = service.run_job(job, "me")
    assert (row["status"], row["next_page"], row["processed"]) == ("RUNNING", 4, 400) and len(steps) == 3
    assert service._one(service.jobs, "job_id", job).lease_owner == "thief"


def test_a_job_goes_on_behind_its_last_recorded_step(service):
    service.pages_a_step = 4
    job = service.start_batch("tenant-bulk")["job_id"]
    calls, migrate_rows = [], service._migrate

    def failing(rows):
        calls.append(rows)
        if len(calls) == 2:
            raise OSError("secret")
        return migrate_rows(rows)

    service._migrate = failing
    with pytest.raises(OSError):
        service.run_job(job)
    row = service._one(service.jobs, "job_id", job)
    assert (row.status, row.next_page, row.processed, row.lease_owner, row.last_error) == ("FAILED", 4, 400, None, "migration failed (OSError)")
    service._migrate = migrate_rows
    done = service.run_job(job)
    assert (done["status"], done["next_page"], done["processed"], done["succeeded"], done["failed"]) == ("COMPLETED_WITH_ERRORS", 11, 1050, 1040, 10)


def test_a_taken_run_is_not_written(service):
    run = service.start_reconciliation("tenant-bulk")["run_id"]
    compare = service._compare

    def stolen(*args):
        service._set(service.runs, "run_id", run, lease_owner="thief")
        return compare(*args)

    service._compare = stolen
    assert service.run_reconciliation(run, "me")["status"] == "RUNNING"
    row = service._one(service.runs, "run_id", run)
    assert (row.lease_owner, row.source_count, row["items"]) == ("thief", 0, None)


def slow(spark, seconds, fields="external_id string, tenant_id string, first_name string, last_name string, email string"):
    """The bulk tenant from a source that takes its time."""

    def wait(batches):
        import time

        time.sleep(seconds)
        yield from batches

    return bulk_tenant(spark).coalesce(1).mapInPandas(wait, fields)


def test_a_run_longer_than_its_lease_completes(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/s", lambda: slow(spark, 14), lease="INTERVAL '7' SECOND", renew_s=1)
    run = service.start_reconciliation("tenant-bulk")["run_id"]
    with ThreadPoolExecutor(1) as pool:
        work = pool.submit(service.run_reconciliation, run)
        time.sleep(12)
        assert not work.done() and service.recover()["failed_runs"] == []
        assert work.result()["status"] == "COMPLETED" and service.get_run(run)["missing_count"] == 1050


def test_a_stolen_run_is_cancelled_and_writes_nothing(spark, tmp_path):
    service = Service(spark, f"file://{tmp_path}/s", lambda: slow(spark, 60), renew_s=0.5)
    run = service.start_reconciliation("tenant-bulk")["run_id"]
    began = time.time()
    with ThreadPoolExecutor(1) as pool:
        work = pool.submit(service.run_reconciliation, run, "me")
        while service._one(service.runs, "run_id", run).lease_owner != "me":
            time.sleep(0.2)
        service._set(service.runs, "run_id", run, lease_owner="thief")
        assert work.result()["status"] == "RUNNING" and time.time() - began < 50
    row = service._one(service.runs, "run_id", run)
    assert (row.lease_owner, row.last_error, row["items"]) == ("thief", None, None)
    assert spark.range(5).count() == 5  # jobs behind the lease aren't cancelled


def test_a_failing_job_stops_no_other(service, spark):
    fields = "tenant_id string, external_id string, first_name string, last_name string, email string"
    good = [("good", f"c{i}", "A", "L", "a@x") for i in range(5)]
    reads = []

    def read():
        reads.append(1)
        if len(reads) == 1:
            raise OSError("secret")
        return spark.createDataFrame(good, fields)

    service.read_source, service.at_once = read, 1
    first, second = service.start_batch("bad"), service.start_batch("good")
    run = service.start_reconciliation("good")
    got = service.recover()
    ((failed, error),) = got["errors"].items()
    assert error == "OSError" and set(got["jobs"]) == {first["job_id"], second["job_id"]} and got["runs"] == [run["run_id"]]
    assert {j: service.get_job(j)["status"] for j in got["jobs"]} == {j: "FAILED" if j == failed else "COMPLETED" for j in got["jobs"]}
    assert service.get_run(run["run_id"])["source_count"] == 5


def test_two_workers_see_each_others_claims(service, spark):
    """A second worker asks while the first one writes; then the first one's claims are taken over."""
    rows = bulk_tenant(spark).where("external_id <= 'candidate-00003'").withColumn("page", F.lit(0))
    written, other = service._written, {}

    def during(new, now):
        if not other:
            other["asked"] = None
            other["asked"] = {r.outcome for r in service._migrate(rows).collect()}
            service.records.update(lambda held: held.withColumn("lease_owner", F.when(F.col("source_record_id") == "candidate-00002", "thief").otherwise(F.col("lease_owner"))))
        return written(new, now)

    service._written = during
    got = {r.external_id: r.outcome for r in service._migrate(rows).collect()}
    assert other["asked"] == {"CLAIMED_BY_OTHER_WORKER"}
    assert got == {"candidate-00001": "MIGRATED", "candidate-00002": "LEASE_LOST", "candidate-00003": "MIGRATED"}
    held = {r.source_record_id: (r.status, r.lease_owner) for r in service.records.read().collect()}
    assert held["candidate-00002"] == ("IN_PROGRESS", "thief") and held["candidate-00001"] == ("COMPLETED", None)


def test_refused_writes_fail_and_are_tried_again(service, spark):
    down = {"candidate-00002"}

    def write(rows):
        return rows.where(F.col("external_id").isin(*down)).select("tenant_id", "external_id", F.lit("TRANSIENT").alias("failure"))

    service.write = write
    rows = bulk_tenant(spark).where("external_id <= 'candidate-00003'").withColumn("page", F.lit(0))
    assert {r.external_id: r.outcome for r in service._migrate(rows).collect()} == {"candidate-00001": "MIGRATED", "candidate-00002": "FAILED", "candidate-00003": "MIGRATED"}
    down = {"none"}
    assert {r.external_id: r.outcome for r in service._migrate(rows).collect()}["candidate-00002"] == "MIGRATED"


SCANNED = "tenant_id string, external_id string, first_name string, last_name string, email string, page int, position int"


def test_the_last_read_of_a_record_counts(service, spark):
    source = [("t", "a", "A", "L", "a@x", 0, 0), ("t", "b", "B", "L", "b@x", 0, 1), ("t", "a", "A2", "L", "a@x", 1, 0), ("t", "b", "B2", "L", "b@x", 1, 1)]
    for first in (("A2", "B2"), ("A", "B")):
        service.read_source = lambda: spark.createDataFrame(source[::-1], SCANNED)
        service.read_target = lambda: spark.createDataFrame([("t", k, n, "L", f"{k}@x") for k, n in zip("ab", first)], SCANNED.rsplit(",", 2)[0])
        run = service.run_reconciliation(service.start_reconciliation("t")["run_id"])
        assert (run["source_count"], run["matched_count"], run["mismatched_count"]) == (2, 2 if first[0] == "A2" else 0, 0 if first[0] == "A2" else 2)
        assert service.scanned[run["run_id"]] == {"source_rows": 4, "source_pages": 2, "target_rows": 2, "target_pages": None}
    service.read_source = lambda: spark.createDataFrame(source, SCANNED).drop("page", "position")
    with pytest.raises(Exception, match="without an order of the scan"):
        service.run_reconciliation(service.start_reconciliation("t")["run_id"])


def test_a_deep_page_reads_as_few_files_as_the_first(service, spark, monkeypatch):
    from tidemark.operators import reconcile

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        run = service.run_reconciliation(service.start_reconciliation("tenant-bulk")["run_id"])["run_id"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    read, files_of = [], reconcile.files_of_page
    monkeypatch.setattr(reconcile, "files_of_page", lambda *a: read.append(files_of(*a)) or read[-1])
    for page in (0, 100, 209):
        got = service.get_items(run, page, 5)
        assert [i["external_id"] for i in got["items"]] == [f"candidate-{n:05}" for n in range(page * 5 + 1, page * 5 + 6)] and got["has_next"] == (page < 209)
    assert max(map(len, read)) <= 2 and len({f for r in read for f, _ in r}) >= 3
    assert service.get_items(run, 210, 5) == {"items": [], "page": 210, "size": 5, "has_next": False} and read[-1] == []


def test_repeated_pages_count_once(spark):
    from tidemark.operators import reconcile

    schema = "tenant_id string, external_id string, first_name string, last_name string, email string, scan int"
    once = [("t", "a", "A", "L", "a@x", 1), ("t", "b", "B", "L", "b@x", 1)]
    source = spark.createDataFrame(once + [("t", "a", "A2", "L", "a@x", 2), ("t", "b", "B", "L", "b@x", 2)], schema)
    target = spark.createDataFrame([("t", "a", "A2", "L", "a@x", 1)], schema)
    row = reconcile.summarize(reconcile.items(source, target, "scan")).first()
    assert (row.source_count, row.target_count, row.matched_count, row.missing_count) == (2, 1, 1, 1)
