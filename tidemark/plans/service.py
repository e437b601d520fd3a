"""The calls a client makes, as methods: start and read migrations and reconciliations.

State lives in snapshot tables; a job or run is one set of DataFrame plans over all its pages. Each change of a job, run or
record is fenced by its owner and made again if another process was first. While Spark works for a job or run, a thread
renews its lease; if another owner has taken it, the work is cancelled and nothing of it is recorded. Errors that are
stored name an operation and a class only.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.model import JOB, RECORD_STATE, RESULTS, RUN, STORED_CANDIDATE
from tidemark.operators import migrate, paging, reconcile, rules, state
from tidemark.plans.lease import RenewedLease
from tidemark.sources.scratch import materialize
from tidemark.sources.snapshots import SnapshotTable

#: The order of a scan, where a source has it: a record that comes again counts as it came last.
SCAN = ("page", "position")


class NotFound(LookupError):
    """404"""


class NotReady(RuntimeError):
    """409"""


class Service:
    """write: where the target is another system, from rows to the (tenant_id, external_id, failure) of those not written;
    read_target then reads it. Without them the target is a table of this service's own.
    """

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        read_source: Callable[[], DataFrame],
        page_size: int = 100,
        lease: str = "INTERVAL '10' MINUTE",
        clock: Callable[[], dt.datetime] = dt.datetime.now,
        pages_a_step: int = 1000,
        buckets: int = 16,
        write: Callable[[DataFrame], DataFrame] | None = None,
        read_target: Callable[[], DataFrame] | None = None,
        renew_s: float = 200.0,
        at_once: int = 2,
    ):
        self.spark, self.base, self.read_source, self.page_size, self.lease, self.clock, self.pages_a_step = spark, base.rstrip("/"), read_source, page_size, lease, clock, pages_a_step
        self.target = SnapshotTable(spark, f"{self.base}/target", STORED_CANDIDATE, tuple(migrate.TARGET_KEY), buckets)
        self.records = SnapshotTable(spark, f"{self.base}/records", RECORD_STATE, tuple(state.RECORD_KEY), buckets)
        self.jobs, self.runs = SnapshotTable(spark, f"{self.base}/jobs", JOB), SnapshotTable(spark, f"{self.base}/runs", RUN)
        self.write, self.read_target, self.renew_s, self.at_once = write, read_target or self.target.read, renew_s, at_once
        #: Rows and pages that the sides of this process's runs had, repeated pages included, by run.
        self.scanned: dict[str, dict[str, int]] = {}

    def _now(self):
        return F.lit(self.clock()).cast("timestamp")

    def _one(self, table: SnapshotTable, key: str, value: str, shown: Callable[[DataFrame], DataFrame] = lambda df: df) -> Row:
        row = shown(table.read().where(F.col(key) == value)).first()
        if row is None:
            raise NotFound(f"no {key} {value}")
        return row

    def _set(self, table: SnapshotTable, key: str, value: str, **columns) -> None:
        mine = F.col(key) == value
        new = {c: v if not isinstance(v, (str, int, type(None))) else F.lit(v) for c, v in columns.items()}
        table.update(lambda held: held.withColumns({c: F.when(mine, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in new.items()}))

    def _fenced(self, table: SnapshotTable, value: str, change: Callable[[DataFrame], DataFrame]) -> bool:
        """Publishes the one row of a fenced operator, if the fence lets it through as the table is then."""
        key, names, done = table.schema.names[0], table.schema.names, False

        def apply(held: DataFrame) -> DataFrame | None:
            nonlocal done
            row = change(held.where(F.col(key) == value)).first()
            done = row is not None and row.applied
            if not done:
                return None
            return held.where(F.col(key) != value).unionByName(self.spark.createDataFrame([tuple(row[c] for c in names)], table.schema))

        table.update(apply)
        return done

    def _claim(self, claims: DataFrame, owner: str) -> DataFrame:
        """Claimed jobs or runs as their new owner's."""
        return claims.withColumn("status", F.col("new_status")).withColumns({"lease_owner": F.lit(owner), "updated_at": self._now()}).withColumn("applied", F.col("claimed"))

    def _renewed(self, table: SnapshotTable, value: str, owner: str) -> RenewedLease:
        beat = lambda: self._fenced(table, value, lambda mine: state.heartbeat(mine, F.lit(owner), self._now()).withColumn("applied", F.col("alive")))
        return RenewedLease(self.spark, beat, self.renew_s)

    # Migration

    def start_batch(self, tenant: str) -> dict:
        """The tenant's unfinished job, or a new one."""
        row = lambda id_: (id_, tenant, "PENDING", self.page_size, 0, 0, 0, 0, 0, None, None, self.clock(), self.clock())
        return self.get_job(self._started(self.jobs, tenant, state.create_or_get_job, row))

    def _started(self, table: SnapshotTable, tenant: str, create_or_get: Callable[[DataFrame, DataFrame], DataFrame], row: Callable[[str], tuple]) -> str:
        key, found = table.schema.names[0], ""
        new = self.spark.createDataFrame([(str(uuid.uuid4()), tenant)], f"{key} string, tenant_id string")

        def apply(held: DataFrame) -> DataFrame | None:
            nonlocal found
            got = create_or_get(new, held).first()
            found = got[key]
            return held.unionByName(self.spark.createDataFrame([row(found)], table.schema)) if got.created else None

        table.update(apply)
        return found

    def get_job(self, job_id: str) -> dict:
        return self._one(self.jobs, "job_id", job_id, rules.job_response).asDict()

    def run_job(self, job_id: str, owner: str | None = None) -> dict:
        """Claims a job and migrates all pages that it hasn't recorded; a job that can't be claimed is left alone.

        Pages are worked in steps of pages_a_step, each recorded under the fence before the next begins: after a crash or
        a failure the job goes on behind the last recorded step. A job whose lease another owner has taken is let go.
        """
        job, owner = self._one(self.jobs, "job_id", job_id), owner or str(uuid.uuid4())
        if not self._fenced(self.jobs, job_id, lambda mine: self._claim(state.claim_jobs(mine, self._now(), F.expr(self.lease)), owner)):
            return self.get_job(job_id)
        with self._renewed(self.jobs, job_id, owner) as lease:
            try:
                source = self.read_source().where(F.col("tenant_id") == job.tenant_id)
                rows = materialize(paging.with_pages(source, job.page_size))
                last = rows.agg(F.max("page")).first()[0]
                pages = 1 if last is None else last + 1  # an empty tenant has one empty page
                for page in range(job.next_page, pages, self.pages_a_step):
                    until = min(page + self.pages_a_step, pages)
                    results = self._migrate(rows.where(F.col("page").between(page, until - 1)))
                    if lease.lost or not self._record(job_id, owner, results, until):
                        return self.get_job(job_id)
            except Exception as error:
                if lease.lost:
                    return self.get_job(job_id)
                said = F.lit(f"migration failed ({type(error).__name__})")
                self._fenced(self.jobs, job_id, lambda mine: state.fail_job(mine, F.lit(owner), said, self._now()))
                raise
        self._fenced(self.jobs, job_id, lambda mine: state.complete_job(mine, F.lit(owner), self._now()))
        return self.get_job(job_id)

    def _record(self, job_id: str, owner: str, results: DataFrame, next_page: int) -> bool:
        """Adds a step's counters to the job; false if it is no longer the owner's."""
        progress = migrate.page_progress(results.withColumn("result", migrate.page_result(F.col("outcome"))))
        sums = progress.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in migrate.COUNTERS])
        step = materialize(sums.select(F.lit(job_id).alias("job_id"), F.lit(next_page).alias("next_page"), *migrate.COUNTERS))
        return self._fenced(self.jobs, job_id, lambda mine: state.record_page(mine, step, F.lit(owner), self._now()))

    def migrate_candidate(self, tenant: str, candidate: str) -> str:
        """One record; its outcome."""
        row = self.read_source().where((F.col("tenant_id") == tenant) & (F.col("external_id") == candidate)).withColumn("page", F.lit(0))
        got = self._migrate(row).first()
        if got is None:
            raise NotFound(f"no candidate {candidate}")
        return got.outcome

    def _migrate(self, rows: DataFrame) -> DataFrame:
        """Claims, validates, writes and finishes records; tenant_id, external_id, page and outcome of each.

        Claims are published before anything is written, under an owner of this call alone, and a record is finished only
        while it is that owner's: of two workers one writes, and one whose claim was taken over has LEASE_LOST. The rows
        are judged once and written out, so all commits are of the same records, however the source changes.
        """
        now, token, key = self._now(), str(uuid.uuid4()), state.RECORD_KEY
        keyed = materialize(rows.withColumn("source_record_id", F.col("external_id")))
        asked = keyed.select(*key).distinct().withColumn("lease_owner", F.lit(token)).withColumn("request_seq", F.lit(1))
        names = RECORD_STATE.names
        self.records.merge(asked, lambda held: state.state_after_claims(state.claim_records(asked, held, now, F.expr(self.lease)), held, now).select(*names))
        claim = F.when(F.col("status") == "COMPLETED", "ALREADY_MIGRATED").when(F.col("lease_owner") == token, "CLAIMED").otherwise("CLAIMED_BY_OTHER_WORKER")
        known = self.records.read().select(*key, claim.alias("claim"))
        valid = rules.email_error(F.col("email")).isNull()
        judged = materialize(keyed.join(known, key).withColumn("valid", valid))
        new = judged.where("claim = 'CLAIMED' and valid").select(*migrate.TARGET_KEY, "first_name", "last_name", "email").dropDuplicates(migrate.TARGET_KEY)
        refused = self._written(new, now)
        judged = judged.join(refused.select(*migrate.TARGET_KEY, F.lit(True).alias("refused")), migrate.TARGET_KEY, "left").withColumn("written", F.col("refused").isNull())
        outcome = migrate.migration_outcome(F.col("claim"), F.col("valid"), F.col("written"), F.lit(False))
        judged = materialize(judged.withColumn("outcome", outcome))
        status = F.when(F.col("outcome") == "MIGRATED", "COMPLETED").otherwise("FAILED")
        finishes = judged.where("claim = 'CLAIMED'").groupBy(*key).agg(F.min(status).alias("new_status")).withColumn("owner", F.lit(token))
        finished = [finishes.withColumn("applied", F.lit(True))]

        def finish(held: DataFrame) -> DataFrame:
            finished[0] = materialize(state.finish_records(finishes, held, now))
            known = finished[0].where("status is not null").select(*names)
            return held.join(known, key, "left_anti").select(*names).unionByName(known)

        self.records.merge(finishes, finish)
        taken = finished[0].where("not applied").select(*key, F.lit(True).alias("taken"))
        fenced = migrate.migration_outcome(F.col("claim"), F.col("valid"), F.col("written"), F.coalesce("taken", F.lit(False)))
        return materialize(judged.join(taken, key, "left").select("tenant_id", "external_id", "page", fenced.alias("outcome")))

    def _written(self, new: DataFrame, now) -> DataFrame:
        """Writes records with unique keys; tenant_id and external_id of those that the target refused."""
        if self.write:
            return materialize(self.write(new).select(*migrate.TARGET_KEY))
        rows = new.select(F.concat_ws(":", *migrate.TARGET_KEY).alias("id"), *new.columns, now.alias("created_at"), now.alias("updated_at"))
        self.target.merge(rows, lambda held: migrate.create_if_absent(rows, held))
        return self.spark.createDataFrame([], "tenant_id string, external_id string")

    # Reconciliation

    def start_reconciliation(self, tenant: str) -> dict:
        """The tenant's unfinished run, or a new one; a failed run is not gone on with."""
        row = lambda id_: (id_, tenant, "PENDING", self.page_size, 0, 0, 0, 0, 0, 0, None, None, self.clock(), self.clock(), None, None)
        return self.get_run(self._started(self.runs, tenant, state.create_or_get_run, row))

    def get_run(self, run_id: str) -> dict:
        return self._one(self.runs, "run_id", run_id, rules.run_response).asDict()

    def run_reconciliation(self, run_id: str, owner: str | None = None) -> dict:
        """Compares the tenant's records with its target; a run that isn't pending is left alone, one taken over isn't written.

        The counters come from the pass that writes the items. The items of each attempt have a folder of their own, which
        the completed run names.
        """
        run, owner = self._one(self.runs, "run_id", run_id), owner or str(uuid.uuid4())
        if not self._fenced(self.runs, run_id, lambda mine: self._claim(state.claim_runs(mine), owner)):
            return self.get_run(run_id)
        with self._renewed(self.runs, run_id, owner) as lease:
            try:
                path = f"{self.base}/items/{run_id}-{uuid.uuid4().hex}"
                counts = self._compare(run_id, run.tenant_id, path)
            except Exception as error:
                if lease.lost:
                    return self.get_run(run_id)
                said = F.lit(f"reconciliation failed ({type(error).__name__})")
                self._fenced(self.runs, run_id, lambda mine: state.fail_run(mine, F.lit(owner), said, self._now()))
                raise
        summary = self.spark.createDataFrame([{"run_id": run_id, **counts}])
        named = lambda done: done.withColumn("items", F.when(F.col("applied"), path).otherwise(F.col("items")))
        self._fenced(self.runs, run_id, lambda mine: named(state.finish_run(mine, summary, F.lit(owner), self._now())))
        return self.get_run(run_id)

    def _compare(self, run_id: str, tenant: str, path: str) -> dict[str, int]:
        """Writes a run's items below path, in the order of ids, and an index of their files; the six counters."""
        seen: dict[str, Observation] = {}

        def scanned(name: str, rows: DataFrame) -> DataFrame:
            seen[name] = Observation(name)
            pages = F.max(F.col("page") + 1 if "page" in rows.columns else F.lit(None).cast("long"))
            checked = reconcile.checked(rows.where(F.col("tenant_id") == tenant), F.lit(tenant))
            return checked.observe(seen[name], F.count(F.lit(1)).alias("rows"), pages.alias("pages"))

        source, target, total = scanned("source", self.read_source()), scanned("target", self.read_target()), Observation("items")
        found = materialize(reconcile.items(source, target, *SCAN).observe(total, *reconcile.summary_columns()))
        self.scanned[run_id] = {f"{side}_{k}": v for side, o in seen.items() for k, v in o.get.items()}
        found.repartitionByRange("external_id").sortWithinPartitions("external_id").write.parquet(f"{path}/rows")
        reconcile.items_index(self.spark.read.schema(found.schema).parquet(f"{path}/rows")).write.parquet(f"{path}/index")
        return total.get

    def get_items(self, run_id: str, page: int = 0, size: int = 100, result: str | None = None) -> dict:
        """A page of differences, or of one result. Bounds are checked first, then the run, then whether it is completed.

        Only the files whose ranges the page meets are read, as many for a deep page as for the first.
        """
        rules.check_page(page, size)
        if result is not None and result not in RESULTS:
            raise ValueError(f"no result {result}")
        run = self._one(self.runs, "run_id", run_id)
        if run.status != "COMPLETED":
            raise NotReady(f"run {run_id} is not completed")
        files = reconcile.files_of_page(self.spark.read.parquet(f"{run['items']}/index"), page, size, result)
        if not files:
            return {"items": [], "page": page, "size": size, "has_next": False}
        schema = "external_id string, result string, source_fingerprint string, target_fingerprint string"
        found = reconcile.differences(self.spark.read.schema(schema).parquet(*[f"{run['items']}/rows/{f}" for f, _ in files]), result)
        rows = found.orderBy("external_id").offset(page * size - files[0][1]).limit(size + 1).collect()
        return {"items": [r.asDict() for r in rows[:size]], "page": page, "size": size, "has_next": len(rows) > size}

    # Recovery

    def _side_by_side(self, ids: list[str], run: Callable[[str], dict]) -> dict[str, str]:
        """Runs each, some at a time in threads of their own; the class of the error of those that failed."""

        def one(id_: str) -> str | None:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", "recovery")
            try:
                run(id_)
            except Exception as error:  # noqa: BLE001
                return type(error).__name__
            return None

        with ThreadPoolExecutor(self.at_once) as pool:
            said = list(pool.map(one, ids))
        return {id_: error for id_, error in zip(ids, said) if error}

    def recover(self, limit: int = 100) -> dict[str, list[str] | dict[str, str]]:
        """Resumes pending and abandoned jobs, fails abandoned runs, then starts pending ones; one that fails stops no other."""
        now, lease = self._now(), F.expr(self.lease)
        jobs = [r.job_id for r in state.resumable_jobs(self.jobs.read(), now, lease, limit).select("job_id").collect()]
        errors = self._side_by_side(jobs, self.run_job)
        failed: list[str] = []

        def abandon(held: DataFrame) -> DataFrame | None:
            runs = state.fail_abandoned(held, now, lease)
            failed[:] = [r.run_id for r in runs.where("failed_now").select("run_id").orderBy("run_id").collect()]  # runs in hand, not records
            return runs if failed else None

        self.runs.update(abandon)
        started = [r.run_id for r in state.pending_runs(self.runs.read(), limit).select("run_id").collect()]
        errors |= self._side_by_side(started, self.run_reconciliation)
        return {"jobs": jobs, "failed_runs": failed, "runs": started, "errors": errors}
