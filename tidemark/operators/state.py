"""Claims, leases and fences as set operations on tables of state.

Of several requests for a key, the first wins; the outcome is that of running them one after the other. Atomicity
between processes is up to a single writer (see sources.snapshots).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import truncate_error
from tidemark.model import UNFINISHED_JOB, UNFINISHED_RUN
from tidemark.operators.migrate import COUNTERS, final_status
from tidemark.operators.rules import is_stale

RECORD_KEY = ["tenant_id", "source_record_id"]


def claimable(status: Column, updated_at: Column, as_of: Column, timeout: Column) -> Column:
    """No row, a failed one, or one in progress whose lease has run out."""
    return status.isNull() | (status == "FAILED") | ((status == "IN_PROGRESS") & is_stale(updated_at, as_of, timeout))


def claim_records(requests: DataFrame, state: DataFrame, as_of: Column, timeout: Column) -> DataFrame:
    """Each request with its outcome: CLAIMED, ALREADY_MIGRATED or CLAIMED_BY_OTHER_WORKER."""
    rank = F.row_number().over(Window.partitionBy(*RECORD_KEY).orderBy("request_seq"))
    known = state.select(*RECORD_KEY, "status", "updated_at")
    joined = requests.withColumn("_rank", rank).join(known, RECORD_KEY, "left")
    free = claimable(F.col("status"), F.col("updated_at"), as_of, timeout)
    outcome = F.when(free & (F.col("_rank") == 1), "CLAIMED").when(F.col("status") == "COMPLETED", "ALREADY_MIGRATED").otherwise("CLAIMED_BY_OTHER_WORKER")
    return joined.select(*RECORD_KEY, "lease_owner", "request_seq", outcome.alias("outcome"))


def state_after_claims(claims: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """The table of state once the claims are in it."""
    won = claims.where("outcome = 'CLAIMED'").select(*RECORD_KEY, F.col("lease_owner").alias("new_owner"), F.lit(True).alias("won"))
    joined = state.join(won, RECORD_KEY, "full_outer")
    pick = lambda new, old: F.when(F.col("won"), new).otherwise(F.col(old))
    return joined.select(*RECORD_KEY, pick(F.lit("IN_PROGRESS"), "status").alias("status"), pick(as_of, "updated_at").alias("updated_at"), pick(F.col("new_owner"), "lease_owner").alias("lease_owner"))


def finish_records(finishes: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """State after fenced finishes (key, owner, new_status), with whether each was applied; a finished row loses its owner."""
    joined = finishes.join(state, RECORD_KEY, "left")
    applied = (F.col("status") == "IN_PROGRESS") & (F.col("lease_owner") == F.col("owner"))
    applied = F.coalesce(applied, F.lit(False))
    return joined.select(
        *RECORD_KEY,
        F.when(applied, F.col("new_status")).otherwise(F.col("status")).alias("status"),
        F.when(applied, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(~applied, F.col("lease_owner")).alias("lease_owner"),
        applied.alias("applied"),
    )


def claim_events(requests: DataFrame, inbox: DataFrame, as_of: Column, timeout: Column) -> DataFrame:
    """As claim_records for event ids, with an identity guard and attempts + 1 for each claim."""
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy("request_seq"))
    known = inbox.select("event_id", F.col("tenant_id").alias("_t"), F.col("candidate_id").alias("_c"), "status", "updated_at", "attempts")
    joined = requests.withColumn("_rank", rank).join(known, "event_id", "left")
    same = F.col("status").isNull() | (F.col("tenant_id").eqNullSafe(F.col("_t")) & F.col("candidate_id").eqNullSafe(F.col("_c")))
    won = same & claimable(F.col("status"), F.col("updated_at"), as_of, timeout) & (F.col("_rank") == 1)
    return joined.select("event_id", "request_seq", won.alias("claimed"), F.when(won, F.coalesce("attempts", F.lit(0)) + 1).otherwise(F.col("attempts")).alias("attempts"))


def finish_events(finishes: DataFrame, inbox: DataFrame) -> DataFrame:
    """Fenced finishes of events; errors are cut to the column's length."""
    joined = finishes.join(inbox.select("event_id", "status", "lease_owner"), "event_id", "left")
    applied = F.coalesce((F.col("status") == "IN_PROGRESS") & (F.col("lease_owner") == F.col("owner")), F.lit(False))
    return joined.select("event_id", F.when(applied, F.col("new_status")).otherwise(F.col("status")).alias("status"), F.when(applied, truncate_error(F.col("error"))).alias("last_error"), applied.alias("applied"))


def create_or_get(requests: DataFrame, table: DataFrame, id_col: str, unfinished: tuple[str, ...]) -> DataFrame:
    """One unfinished job or run for each tenant: the one there is, else the first request becomes one."""
    first = F.row_number().over(Window.partitionBy("tenant_id").orderBy(id_col))
    open_ = table.where(F.col("status").isin(*unfinished)).withColumn("_n", first).where("_n = 1").select("tenant_id", F.col(id_col).alias("_open"))
    wanted = requests.withColumn("_n", first).where("_n = 1").select("tenant_id", F.col(id_col).alias("_new"))
    joined = wanted.join(open_, "tenant_id", "left")
    return joined.select("tenant_id", F.coalesce("_open", "_new").alias(id_col), F.col("_open").isNull().alias("created"))


def create_or_get_job(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """A failed job blocks a new one: it is resumed."""
    return create_or_get(requests, jobs, "job_id", UNFINISHED_JOB)


def create_or_get_run(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """A failed run doesn't block a new one."""
    return create_or_get(requests, runs, "run_id", UNFINISHED_RUN)


def claim_jobs(jobs: DataFrame, as_of: Column, timeout: Column) -> DataFrame:
    """Pending, failed and abandoned jobs become running; a claim clears the last error."""
    free = F.col("status").isin("PENDING", "FAILED") | ((F.col("status") == "RUNNING") & is_stale(F.col("updated_at"), as_of, timeout))
    out = jobs.withColumn("claimed", free).withColumn("new_status", F.when(free, "RUNNING").otherwise(F.col("status")))
    return out.withColumn("last_error", F.when(~free, F.col("last_error"))) if "last_error" in jobs.columns else out


def claim_runs(runs: DataFrame) -> DataFrame:
    """Only pending runs can be claimed: a run isn't resumed."""
    free = F.col("status") == "PENDING"
    return runs.withColumn("claimed", free).withColumn("new_status", F.when(free, "RUNNING").otherwise(F.col("status")))


def heartbeat(runs: DataFrame, owner: Column, as_of: Column) -> DataFrame:
    """updated_at moves on while the owner holds a running run, or job; alive tells whether it does."""
    held = F.coalesce((F.col("status") == "RUNNING") & (F.col("lease_owner") == owner), F.lit(False))
    return runs.withColumn("updated_at", F.when(held, as_of).otherwise(F.col("updated_at"))).withColumn("alive", held)


def resumable_jobs(jobs: DataFrame, as_of: Column, timeout: Column, limit: int) -> DataFrame:
    """Pending and abandoned jobs, longest untouched first; failed ones wait for an explicit restart."""
    stale = (F.col("status") == "RUNNING") & is_stale(F.col("updated_at"), as_of, timeout)
    return jobs.where((F.col("status") == "PENDING") | stale).orderBy("updated_at", "job_id").limit(limit)


#: Fixed value: what is stored of a run that was left.
ABANDONED = "Abandoned: no progress within lease timeout"


def fail_abandoned(runs: DataFrame, as_of: Column, timeout: Column) -> DataFrame:
    """Runs with stale running ones failed, their lease ended and the times and error set; failed_now tells which."""
    marked = runs.withColumn("failed_now", (F.col("status") == "RUNNING") & is_stale(F.col("updated_at"), as_of, timeout))
    changes = {"status": F.lit("FAILED"), "last_error": F.lit(ABANDONED), "lease_owner": F.lit(None), "updated_at": as_of, "completed_at": as_of}
    kept = [F.when(F.col("failed_now"), changes[c]).otherwise(F.col(c)).cast(runs.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in runs.columns]
    return marked.select(*kept, "failed_now")


def pending_runs(runs: DataFrame, limit: int, order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    return runs.where("status = 'PENDING'").orderBy(*order).limit(limit)


def _held(owner: Column) -> Column:
    """Whether a running job or run is still the given owner's: the fence of every write to it."""
    return F.coalesce((F.col("status") == "RUNNING") & (F.col("lease_owner") == owner), F.lit(False))


def _fenced(table: DataFrame, owner: Column, **changes: Column) -> DataFrame:
    """The table with the changes in the rows that the owner holds, and applied, which tells them apart."""
    held = table.withColumn("applied", _held(owner))
    return held.select(*[F.when(F.col("applied"), changes[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns], "applied")


def record_page(jobs: DataFrame, progress: DataFrame, owner: Column, as_of: Column) -> DataFrame:
    """Jobs after progress (job_id, next_page, the four counters of newly read pages): counters grow, the next page moves on."""
    new = progress.select("job_id", F.col("next_page").alias("_next"), *[F.col(c).alias(f"_{c}") for c in COUNTERS])
    joined = jobs.join(new, "job_id", "left")
    mine = F.when(F.col("_next").isNotNull(), owner)
    grown = {c: F.col(c) + F.col(f"_{c}") for c in COUNTERS}
    return _fenced(joined, mine, next_page=F.col("_next"), updated_at=as_of, **grown).select(*jobs.columns, "applied")


def complete_job(jobs: DataFrame, owner: Column, as_of: Column) -> DataFrame:
    """Jobs whose owner has read all pages: the failed counter gives the status, the lease ends."""
    return _fenced(jobs, owner, status=final_status(F.col("failed")), lease_owner=F.lit(None), last_error=F.lit(None), updated_at=as_of)


def fail_job(jobs: DataFrame, owner: Column, error: Column, as_of: Column) -> DataFrame:
    """Jobs given up by their owner; counters and next page stay for the next claim."""
    return _fenced(jobs, owner, status=F.lit("FAILED"), lease_owner=F.lit(None), last_error=truncate_error(error), updated_at=as_of)


def fail_run(runs: DataFrame, owner: Column, error: Column, as_of: Column) -> DataFrame:
    """Runs given up by their owner; one that has a time of completion gets it."""
    ended = {"completed_at": as_of} if "completed_at" in runs.columns else {}
    return _fenced(runs, owner, status=F.lit("FAILED"), lease_owner=F.lit(None), last_error=truncate_error(error), updated_at=as_of, **ended)


def finish_run(runs: DataFrame, summary: DataFrame, owner: Column, as_of: Column) -> DataFrame:
    """Runs after the fenced completion of those in summary (run_id and the six counters)."""
    counts = [c for c in summary.columns if c != "run_id"]
    joined = runs.join(summary.select("run_id", F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in counts]), "run_id", "left")
    mine = F.when(F.col("_in"), owner)
    done = {c: F.col(f"_{c}") for c in counts}
    out = _fenced(joined, mine, status=F.lit("COMPLETED"), lease_owner=F.lit(None), updated_at=as_of, completed_at=as_of, **done)
    return out.select(*runs.columns, "applied")
