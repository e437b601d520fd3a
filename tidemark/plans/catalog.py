"""Every query of the record model, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import canonical as fn
from tidemark.model import DIFFERENCES, JOB_STATUSES, MAX_ID_CHARS
from tidemark.operators import converge, delta, migrate, paging, reconcile, resilience, rules, state
from tidemark.sources import generated
from tidemark.sources.adapters import view, with_views
from tidemark.sources.scratch import shared_dir
from tidemark.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]

AS_OF, TIMEOUT = "TIMESTAMP '1998-06-01 00:00:00'", "INTERVAL '90' DAY"
_SPARK_AS_OF = "TIMESTAMP_NTZ '1998-06-01 00:00:00'"
# The JVM's white space as a class of RE2.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
_STATUSES = ", ".join(f"'{s}'" for s in JOB_STATUSES)

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _as_of():
    return F.expr(_SPARK_AS_OF), F.expr(TIMEOUT)


def query(views: tuple[str, ...], sql: str | None = None):
    """Registers a function of the named views under its name, and its SQL behind a WITH clause of them."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _queries[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql is not None:
            clause = with_views(*views)
            body = sql.strip()
            _sql[f.__name__] = (f"{clause},\n{body[5:]}" if body.startswith("with ") else f"{clause}\n{body}") if clause != "with " else body
        return f

    return add


def _blank(c: str) -> str:
    return f"({c} is null or regexp_full_match({c}, '{WS}*'))"


def _norm(c: str) -> str:
    return f"nullif(regexp_replace(nfc_normalize({c}), '^{WS}+|{WS}+$', '', 'g'), '')"


def _fragment(v: str) -> str:
    units = rf"length({v}) + length(regexp_replace({v}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"
    return f"case when {v} is null then '-' else '+' || ({units}) || ':' || {v} end"


def _fingerprint(relation: str, keys: str = "tenant_id, external_id", fields=("external_id", "first_name", "last_name", "email")) -> str:
    norm = ", ".join(f"{_norm(f)} as n{i}" for i, f in enumerate(fields))
    text = " || ';' || ".join(_fragment(f"n{i}") for i in range(len(fields)))
    return f"select {keys}, sha256('v1;' || {text} || ';') as fingerprint from (select {keys}, {norm} from {relation})"


_BOTH = ("source_candidate", "target_candidate")
_ITEMS = f"""with s as ({_fingerprint("source_candidate")}), t as ({_fingerprint("target_candidate")}),
items as (
  select coalesce(s.tenant_id, t.tenant_id) as tenant_id, coalesce(s.external_id, t.external_id) as external_id,
         s.external_id is not null as source_seen, t.external_id is not null as target_seen,
         s.fingerprint as source_fingerprint, t.fingerprint as target_fingerprint,
         case when s.external_id is not null and t.external_id is not null and s.fingerprint = t.fingerprint then 'MATCHED'
              when s.external_id is not null and t.external_id is not null then 'MISMATCHED'
              when s.external_id is not null then 'MISSING_IN_TARGET' else 'UNEXPECTED_IN_TARGET' end as result
  from s full outer join t on s.tenant_id = t.tenant_id and s.external_id = t.external_id)
"""
_COUNTS = """count(*) filter (where source_seen) as source_count, count(*) filter (where target_seen) as target_count,
count(*) filter (where result = 'MATCHED') as matched_count, count(*) filter (where result = 'MISSING_IN_TARGET') as missing_count,
count(*) filter (where result = 'UNEXPECTED_IN_TARGET') as unexpected_count, count(*) filter (where result = 'MISMATCHED') as mismatched_count"""


# Mapping and validation


@query(("source_candidate",), "select tenant_id, external_id, first_name, last_name, email from source_candidate")
def map_source_to_target(source):
    return rules.to_request(rules.to_canonical(source))


@query(("source_candidate",), f"select external_id, not {_blank('email')} as valid from source_candidate")
def validate_email(source):
    return source.select("external_id", rules.email_error(F.col("email")).isNull().alias("valid"))


@query(("source_candidate",), f"select tenant_id, external_id, '{rules.EMAIL_REQUIRED}' as error from source_candidate where {_blank('email')}")
def invalid_records(source):
    return source.withColumn("error", rules.email_error(F.col("email"))).where("error is not null").select("tenant_id", "external_id", "error")


_ODD_IDS = "select k, case when k % 3 = 0 then '' when k % 5 = 0 then '  ' when k % 7 = 0 then repeat('x', 101) else external_id end as id from source_candidate"


def _odd_ids(source: DataFrame) -> DataFrame:
    k = F.col("k")
    return source.select("k", F.when(k % 3 == 0, "").when(k % 5 == 0, "  ").when(k % 7 == 0, F.repeat(F.lit("x"), 101)).otherwise(F.col("external_id")).alias("id"))


@query(
    ("source_candidate",),
    f"""
select k, case when {_blank('id')} then 'external id is blank' else 'external id is too long' end as error
from ({_ODD_IDS}) where {_blank('id')} or length(id) > {MAX_ID_CHARS}
""",
)
def reject_bad_ids(source):
    return _odd_ids(source).withColumn("error", rules.id_error(F.col("id"))).where("error is not null").select("k", "error")


@query(
    ("source_candidate",),
    f"""
select count(*) filter (where length(id) > {MAX_ID_CHARS}) as too_long, count(*) filter (where length(id) <= {MAX_ID_CHARS}) as fitting
from ({_ODD_IDS})
""",
)
def id_length_rejects(source):
    return _odd_ids(source).agg(F.count_if(F.length("id") > MAX_ID_CHARS).alias("too_long"), F.count_if(F.length("id") <= MAX_ID_CHARS).alias("fitting"))


@query(
    ("source_candidate",),
    f"""
select k, case when {_blank('id')} then 'external id is blank' when id <> external_id then 'path and body differ' end as error
from (select s.k, o.id, s.external_id
from source_candidate s
join ({_ODD_IDS}) o on s.k = o.k)
""",
)
def rejected_writes(source):
    return source.join(_odd_ids(source), "k").select("k", rules.path_error(F.col("external_id"), F.col("id")).alias("error"))


@query(("migration_job",), f"select status, count(*) as n, bool_and(status in ({_STATUSES})) as known from migration_job group by status")
def enum_status_check(jobs):
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status").isin(*JOB_STATUSES)).alias("known"))


# Fingerprints


@query(("source_candidate",), _fingerprint("source_candidate"))
def fingerprint_source(source):
    return reconcile.side(source)


@query(("target_candidate",), _fingerprint("target_candidate"))
def fingerprint_target(target):
    return reconcile.side(target)


_RUN_COUNTS = ("source_count", "target_count", "matched_count", "missing_count", "unexpected_count", "mismatched_count")
_DOCUMENT_RECORDS = """select doc_id, cast(doc_id as varchar(20)) as external_id,
  case doc_id % 4 when 0 then text when 1 then '  ' || text || chr(9)
       when 2 then 'Zoe' || chr(776) || text else chr(128512) || text || chr(8195) end as first_name,
  case when doc_id % 6 = 0 then chr(8195) when doc_id % 6 = 1 then null else lang end as last_name,
  case when doc_id % 5 = 0 then '' else source end as email
from documents"""


def _document_records(documents: DataFrame) -> DataFrame:
    d, text = F.col("doc_id"), F.col("text")
    return documents.select(
        "doc_id",
        d.cast("string").alias("external_id"),
        F.when(d % 4 == 0, text).when(d % 4 == 1, F.concat(F.lit("  "), text, F.lit("\t"))).when(d % 4 == 2, F.concat(F.lit("Zoe\u0308"), text)).otherwise(F.concat(F.lit("\U0001f600"), text, F.lit("\u2003"))).alias("first_name"),
        F.when(d % 6 == 0, " ").when(d % 6 != 1, F.col("lang")).alias("last_name"),
        F.when(d % 5 == 0, "").otherwise(F.col("source")).alias("email"),
    )


@query(("documents",), _fingerprint(f"({_DOCUMENT_RECORDS})", "doc_id"))
def fingerprint_documents(documents):
    return fn.with_fingerprint(_document_records(documents)).select("doc_id", "fingerprint")


# Reconciliation


@query(_BOTH, _ITEMS + "select * from items")
def reconcile_items(source, target):
    return reconcile.items(source, target)


@query(_BOTH, _ITEMS + f"select {_COUNTS} from items")
def reconcile_summary(source, target):
    return reconcile.summarize(reconcile.items(source, target))


@query(_BOTH, _ITEMS + f"select tenant_id, {_COUNTS} from items group by tenant_id")
def reconcile_summary_by_tenant(source, target):
    return reconcile.summarize(reconcile.items(source, target), "tenant_id")


def _keys_of(result: str) -> str:
    return _ITEMS + f"select tenant_id, external_id from items where result = '{result}'"


@query(_BOTH, _keys_of("MISSING_IN_TARGET"))
def missing_in_target(source, target):
    return reconcile.missing_in_target(source, target)


@query(_BOTH, _keys_of("UNEXPECTED_IN_TARGET"))
def unexpected_in_target(source, target):
    return reconcile.unexpected_in_target(source, target)


@query(_BOTH, _keys_of("MATCHED"))
def matched(source, target):
    return reconcile.compared(source, target, True)


@query(_BOTH, _keys_of("MISMATCHED"))
def mismatched(source, target):
    return reconcile.compared(source, target, False)


@query(
    _BOTH,
    _ITEMS
    + """, page as (select tenant_id, external_id, result from items where result <> 'MATCHED' order by tenant_id, external_id limit 11 offset 20)
select tenant_id, external_id, result, (select count(*) > 10 from page) as has_next from page order by tenant_id, external_id limit 10""",
)
def differences_page(source, target):
    return reconcile.differences_page(reconcile.items(source, target), 2, 10)


@query(_BOTH, _ITEMS + "select tenant_id, external_id, source_fingerprint, target_fingerprint from items where result = 'MISMATCHED'")
def differences_by_result(source, target):
    return reconcile.differences(reconcile.items(source, target), DIFFERENCES[2]).select("tenant_id", "external_id", "source_fingerprint", "target_fingerprint")


@query(
    _BOTH,
    _ITEMS
    + f""", sums as (select tenant_id as run_id, length(tenant_id) % 2 = 0 as live, {_COUNTS} from items group by tenant_id)
select run_id, case when live then 'COMPLETED' else 'FAILED' end as status, live as applied, cast(null as varchar) as lease_owner,
       {", ".join(f"case when live then {c} else 0 end as {c}" for c in _RUN_COUNTS)}
from sums""",
)
def run_complete(source, target):
    sums = reconcile.summarize(reconcile.items(source, target), "tenant_id").withColumnRenamed("tenant_id", "run_id")
    live = F.length("run_id") % 2 == 0
    at = F.lit(None).cast("timestamp_ntz")
    runs = sums.select("run_id", F.when(live, "RUNNING").otherwise("FAILED").alias("status"), F.when(live, "me").alias("lease_owner"), at.alias("updated_at"), at.alias("completed_at"), *[F.lit(0).cast("long").alias(c) for c in _RUN_COUNTS])
    return state.finish_run(runs, sums, F.lit("me"), _as_of()[0]).select("run_id", "status", "applied", "lease_owner", *_RUN_COUNTS)


# Pages are read again: the target's every row twice, the source's first as it was before its last change.

_TWICE = f"""with s0 as (select *, 1 as scan from target_candidate union all select tenant_id, external_id, first_name, last_name, email, 2 from source_candidate),
s1 as (select * from (select *, row_number() over (partition by tenant_id, external_id order by scan desc) as n from s0) where n = 1),
s as ({_fingerprint("s1")}), t as ({_fingerprint("target_candidate")}),
"""


@query(_BOTH, _TWICE + _ITEMS[_ITEMS.index("items as (") :] + f"select tenant_id, {_COUNTS} from items group by tenant_id")
def reconcile_repeated_pages(source, target):
    first = target.withColumn("scan", F.lit(1))
    scanned = first.unionByName(source.select(*target.columns, F.lit(2).alias("scan")))
    return reconcile.summarize(reconcile.items(scanned, first.unionByName(first), "scan"), "tenant_id")


# Scans and writes


@query(_BOTH, _ITEMS + f"select tenant_id as run_id, {_COUNTS} from items group by tenant_id")
def reconcile_converged_pages(source, target):
    """Both sides' pages of every tenant, each recorded twice; the first reading of a page, which comes last, has older data."""
    spark = source.sparkSession
    path = shared_dir(spark)
    table = converge.WorkingTable(spark, "converged_" + path.rsplit("-", 1)[1], path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for side, rows in (("target", target), ("source", source)):
        once = fn.with_fingerprint(rows).select(F.col("tenant_id").alias("run_id"), "external_id", "fingerprint", F.lit(2).alias("place"))
        table.record(side, once)
        table.record(side, once.withColumn("fingerprint", F.lit("older")).withColumn("place", F.lit(1)))
    return table.summary()


@query(
    ("source_candidate",),
    """
select tenant_id, external_id, cast(floor((row_number() over (partition by tenant_id
order by external_id) - 1) / 10) as int) as page
from source_candidate
""",
)
def source_pages(source):
    return paging.with_pages(source, 10).select("tenant_id", "external_id", "page")


@query(
    ("target_candidate",),
    """
select tenant_id, external_id, cast(floor((row_number() over (partition by tenant_id
order by external_id) - 1) / 10) as int) as page
from target_candidate
""",
)
def target_pages(target):
    return paging.with_pages(target, 10).select("tenant_id", "external_id", "page")


@query(
    ("source_candidate",),
    """
select tenant_id, count(*) as n_rows, greatest(cast(ceil(count(*) / 10.0) as bigint), 1) as n_pages
from source_candidate
group by tenant_id
""",
)
def page_counts(source):
    return paging.page_counts(source, 10)


@query(
    ("target_candidate",),
    """
select tenant_id, external_id, email
from target_candidate where tenant_id = 'tenant-3' order by external_id
limit 10 offset 10
""",
)
def target_page(target):
    return paging.page_of(target.where("tenant_id = 'tenant-3'").select("tenant_id", "external_id", "email"), 1, 10, "external_id")


@query(
    ("source_candidate",),
    """
select external_id, email
from source_candidate where tenant_id = 'tenant-7' and external_id = (select min(external_id)
from source_candidate where tenant_id = 'tenant-7')
""",
)
def point_lookup(source):
    own = source.where("tenant_id = 'tenant-7'")
    return own.join(own.agg(F.min("external_id").alias("external_id")), "external_id", "left_semi").select("external_id", "email")


@query(("migration_state",), "select source_record_id, status, updated_at from migration_state where tenant_id = 'tenant-3' order by updated_at")
def target_listing(records):
    return paging.listing(records, "tenant-3", "updated_at").select("source_record_id", "status", "updated_at")


@query(
    ("events",),
    """
select event_id, 'e' || event_id as external_id, case when event_id % 2 = 0 then 'F' end as first_name, cast(null as varchar) as email
from events
""",
)
def target_json(events):
    first = F.when(F.col("event_id") % 2 == 0, '"F"').otherwise("null")
    payload = F.concat(F.lit('{"externalId": "e'), F.col("event_id").cast("string"), F.lit('", "firstName": '), first, F.lit(', "more": '), F.col("props"), F.lit("}"))
    own = rules.owned_fields(payload)
    return events.select("event_id", own["externalId"].alias("external_id"), own["firstName"].alias("first_name"), own["email"].alias("email"))


@query(("migration_job",), "select job_id as run_id, tenant_id, status, updated_at from migration_job")
def run_response(jobs):
    return rules.run_response(jobs.withColumnRenamed("job_id", "run_id").withColumn("page_size", F.lit(100)).withColumn("lease_owner", F.lit("me")))


_NEW = "select tenant_id, external_id, first_name, last_name, email from source_candidate"


@query(
    _BOTH,
    f"""
with fresh as ({_NEW}) select tenant_id, external_id, first_name, last_name, email
from target_candidate
union all select f.*
from fresh f where not exists (select 1
from target_candidate t where t.tenant_id = f.tenant_id and t.external_id = f.external_id)
""",
)
def create_if_absent(source, target):
    new = source.select(*target.columns)
    return migrate.create_if_absent(new, target)


@query(
    _BOTH,
    f"""
with fresh as ({_NEW}) select coalesce(f.tenant_id, t.tenant_id) as tenant_id, coalesce(f.external_id, t.external_id) as external_id,
case when f.external_id is not null then f.first_name else t.first_name end as first_name,
case when f.external_id is not null then f.last_name else t.last_name end as last_name,
case when f.external_id is not null then f.email else t.email end as email
from fresh f
full outer join target_candidate t on f.tenant_id = t.tenant_id and f.external_id = t.external_id
""",
)
def upsert_target(source, target):
    new = source.select(*target.columns)
    return migrate.upsert(new, target, F.expr(_SPARK_AS_OF))


_LAST = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@query(
    ("lineitem",),
    f"""
select l_orderkey, l_linenumber, l_shipdate, l_partkey
from (select *, row_number() over (partition by l_orderkey, l_linenumber
order by {', '.join(c + ' desc' for c in _LAST.split(', '))}) as n
from lineitem) where n = 1
""",
)
def dedupe_last_write(lineitem):
    return reconcile.last_write(lineitem, ["l_orderkey", "l_linenumber"], *_LAST.split(", ")).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")


@query(("customer",), None)
def bulk_tenant(customer):
    return generated.bulk_tenant(customer.sparkSession)


_sql["bulk_tenant"] = "select 'candidate-' || lpad(cast(i as varchar), 5, '0') as external_id, 'tenant-bulk' as tenant_id, 'First' || i as first_name, 'Last' || i as last_name, case when i % 100 = 0 then '' else 'candidate' || i || '@example.com' end as email from range(1, 1051) t(i)"


# State

_FREE = f"(status is null or status = 'FAILED' or (status = 'IN_PROGRESS' and updated_at < {AS_OF} - {TIMEOUT}))"
_CLAIMS = f"""with claims as (
  select tenant_id, source_record_id, lease_owner, request_seq,
         case when {_FREE} and n = 1 then 'CLAIMED' when status = 'COMPLETED' then 'ALREADY_MIGRATED' else 'CLAIMED_BY_OTHER_WORKER' end as outcome
  from (select r.*, s.status, s.updated_at, row_number() over (partition by r.tenant_id, r.source_record_id order by r.request_seq) as n
        from claim_request r left join migration_state s on r.tenant_id = s.tenant_id and r.source_record_id = s.source_record_id))
"""
_STATE = ("claim_request", "migration_state")


@query(_STATE, _CLAIMS + "select * from claims")
def claim_records(requests, records):
    return state.claim_records(requests, records, *_as_of())


@query(_STATE, _CLAIMS + "select tenant_id, source_record_id, lease_owner from claims where outcome = 'CLAIMED'")
def claim_winner(requests, records):
    return state.claim_records(requests, records, *_as_of()).where("outcome = 'CLAIMED'").select("tenant_id", "source_record_id", "lease_owner")


@query(
    _STATE,
    _CLAIMS + f"""
select s.tenant_id, s.source_record_id, case when c.lease_owner is not null then 'IN_PROGRESS' else s.status end as status,
case when c.lease_owner is not null then {AS_OF} else s.updated_at end as updated_at,
case when c.lease_owner is not null then c.lease_owner else s.lease_owner end as lease_owner
from migration_state s
left join (select *
from claims where outcome = 'CLAIMED') c on s.tenant_id = c.tenant_id and s.source_record_id = c.source_record_id
""",
)
def state_after_claims(requests, records):
    as_of, timeout = _as_of()
    return state.state_after_claims(state.claim_records(requests, records, as_of, timeout), records, as_of)


@query(
    ("migration_state",),
    f"""
with asked as (select *, case when cast(source_record_id as bigint) % 2 = 0 then lease_owner else 'worker-x' end as owner
from migration_state) select tenant_id, source_record_id, case when coalesce(status = 'IN_PROGRESS' and lease_owner = owner, false) then 'COMPLETED' else status end as status, coalesce(status = 'IN_PROGRESS' and lease_owner = owner, false) as applied,
case when not coalesce(status = 'IN_PROGRESS' and lease_owner = owner, false) then lease_owner end as lease_owner
from asked
""",
)
def finish_fenced(records):
    owner = F.when(F.col("source_record_id").cast("long") % 2 == 0, F.col("lease_owner")).otherwise("worker-x")
    asked = records.select("tenant_id", "source_record_id", owner.alias("owner"), F.lit("COMPLETED").alias("new_status"))
    return state.finish_records(asked, records, _as_of()[0]).select("tenant_id", "source_record_id", "status", "applied", "lease_owner")


@query(
    ("migration_state",),
    f"""
select tenant_id, source_record_id, updated_at
from migration_state where status = 'IN_PROGRESS' and updated_at < {AS_OF} - {TIMEOUT}
""",
)
def stale_records(records):
    as_of, timeout = _as_of()
    return records.where((F.col("status") == "IN_PROGRESS") & rules.is_stale(F.col("updated_at"), as_of, timeout)).select("tenant_id", "source_record_id", "updated_at")


@query(
    _STATE,
    """
select r.tenant_id, r.source_record_id, r.request_seq, coalesce(s.status = 'COMPLETED', false) as completed
from claim_request r
left join migration_state s on r.tenant_id = s.tenant_id and r.source_record_id = s.source_record_id
""",
)
def status_lookup(requests, records):
    known = records.select("tenant_id", "source_record_id", "status")
    return requests.join(known, ["tenant_id", "source_record_id"], "left").select("tenant_id", "source_record_id", "request_seq", F.coalesce(F.col("status") == "COMPLETED", F.lit(False)).alias("completed"))


def _create_or_get(key: str, statuses: str) -> str:
    return f"select j.tenant_id, coalesce(o.job_id, j.job_id + 1000) as {key}, o.job_id is null as created from migration_job j left join (select * from migration_job where status in ({statuses})) o on j.tenant_id = o.tenant_id"


@query(("migration_job",), _create_or_get("job_id", "'PENDING', 'RUNNING', 'FAILED'"))
def job_create_or_get(jobs):
    return state.create_or_get_job(jobs.select("tenant_id", (F.col("job_id") + 1000).alias("job_id")), jobs)


@query(("migration_job",), _create_or_get("run_id", "'PENDING', 'RUNNING'"))
def run_create_or_get(jobs):
    runs = jobs.withColumnRenamed("job_id", "run_id")
    return state.create_or_get_run(runs.select("tenant_id", (F.col("run_id") + 1000).alias("run_id")), runs)


_JOB_AS_OF, _SPARK_JOB_AS_OF = "TIMESTAMP '2100-01-01 00:00:00'", "TIMESTAMP_NTZ '2100-01-01 00:00:00'"


def _job_as_of():
    return F.expr(_SPARK_JOB_AS_OF), F.expr(TIMEOUT)


_JOB_STALE = f"(status = 'RUNNING' and updated_at < {_JOB_AS_OF} - {TIMEOUT})"


@query(
    ("migration_job",),
    f"""
select job_id, {_JOB_STALE} or status in ('PENDING', 'FAILED') as claimed,
case when {_JOB_STALE} or status in ('PENDING', 'FAILED') then 'RUNNING' else status end as new_status
from migration_job
""",
)
def job_claim(jobs):
    return state.claim_jobs(jobs, *_job_as_of()).select("job_id", "claimed", "new_status")


@query(
    ("migration_job",),
    """
select job_id, status = 'PENDING' as claimed, case when status = 'PENDING' then 'RUNNING' else status end as new_status
from migration_job
""",
)
def run_claim(jobs):
    return state.claim_runs(jobs).select("job_id", "claimed", "new_status")


@query(
    ("migration_job",),
    f"""
select job_id, tenant_id, status
from migration_job where status = 'PENDING' or {_JOB_STALE} order by updated_at, job_id
limit 7
""",
)
def job_resumable(jobs):
    return state.resumable_jobs(jobs, *_job_as_of(), 7).select("job_id", "tenant_id", "status")


@query(
    ("migration_job", "migration_state"),
    """
select job_id, case when coalesce(n, 0) > 0 then 'COMPLETED_WITH_ERRORS' else 'COMPLETED' end as status
from migration_job left join (select tenant_id, count(*) as n from migration_state where status = 'FAILED' group by tenant_id) using (tenant_id)
where status = 'RUNNING'
""",
)
def job_complete_status(jobs, records):
    failed = records.where("status = 'FAILED'").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("failed"))
    done = jobs.where("status = 'RUNNING'").join(failed, "tenant_id", "left")
    return done.select("job_id", migrate.final_status(F.coalesce("failed", F.lit(0))).alias("status"))


@query(
    ("migration_job",),
    f"""
select case when {_JOB_STALE} then 'FAILED' else status end as status, count(*) as n, count(*) filter (where {_JOB_STALE}) as failed_now
from migration_job
group by 1
""",
)
def run_fail_abandoned(jobs):
    return state.fail_abandoned(jobs, *_job_as_of()).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed_now").alias("failed_now"))


@query(
    ("migration_job",),
    f"""
select job_id, case when {_JOB_STALE} then 'FAILED' else status end as status, case when {_JOB_STALE} then '{state.ABANDONED}' end as last_error,
       case when {_JOB_STALE} then {_JOB_AS_OF} else updated_at end as updated_at, case when {_JOB_STALE} then {_JOB_AS_OF} end as completed_at,
       case when status = 'RUNNING' and not {_JOB_STALE} then 'worker' end as lease_owner
from migration_job
""",
)
def run_fail_abandoned_fields(jobs):
    runs = jobs.withColumn("lease_owner", F.when(F.col("status") == "RUNNING", "worker")).withColumns({"last_error": F.lit(None).cast("string"), "completed_at": F.lit(None).cast("timestamp_ntz")})
    return state.fail_abandoned(runs, *_job_as_of()).select("job_id", "status", "last_error", "updated_at", "completed_at", "lease_owner")


@query(("migration_job",), "select job_id, tenant_id from migration_job where status = 'PENDING' order by updated_at, job_id limit 3")
def run_pending(jobs):
    return state.pending_runs(jobs, 3, ("updated_at", "job_id")).select("job_id", "tenant_id")


@query(
    ("migration_job",),
    f"""
select job_id, status = 'RUNNING' and job_id % 2 = 0 as alive,
case when status = 'RUNNING' and job_id % 2 = 0 then {AS_OF} else updated_at end as updated_at
from migration_job
""",
)
def run_heartbeat(jobs):
    owned = jobs.withColumn("lease_owner", F.when(F.col("job_id") % 2 == 0, "me").otherwise("other"))
    return state.heartbeat(owned, F.lit("me"), _as_of()[0]).select("job_id", "alive", "updated_at")


# Batch migration: a record's state is that of the customer's first order; every 31st write is refused, every 37th lease lost.

_RESULTS = f"""with first_state as (
  select o_custkey as k, min_by(o_orderstatus, o_orderkey) as st, min_by(o_orderdate, o_orderkey) as updated_at from orders group by o_custkey),
judged as (
  select s.tenant_id, s.external_id, s.k,
         case f.st when 'F' then 'FAILED' when 'O' then 'IN_PROGRESS' when 'P' then 'COMPLETED' end as status, f.updated_at, s.email
  from source_candidate s left join first_state f on s.k = f.k),
outcomes as (
  select tenant_id, external_id,
         case when status = 'COMPLETED' then 'ALREADY_MIGRATED'
              when not {_FREE} then 'CLAIMED_BY_OTHER_WORKER'
              when k % 37 = 0 then 'LEASE_LOST'
              when not {_blank("email")} and k % 31 <> 0 then 'MIGRATED' else 'FAILED' end as outcome
  from judged),
results as (
  select *, case when outcome in ('MIGRATED', 'ALREADY_MIGRATED') then 'SUCCEEDED' when outcome = 'FAILED' then 'FAILED' else 'SKIPPED' end as result,
         cast(floor((row_number() over (partition by tenant_id order by external_id) - 1) / 10) as int) as page from outcomes),
progress as (
  select tenant_id, page, count(*) as processed, count(*) filter (where result = 'SUCCEEDED') as succeeded,
         count(*) filter (where result = 'SKIPPED') as skipped, count(*) filter (where result = 'FAILED') as failed
  from results group by tenant_id, page)
"""
_MIGRATION = ("source_candidate", "orders")


def _results(source: DataFrame, orders: DataFrame) -> DataFrame:
    as_of, timeout = _as_of()
    first = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("st"), F.min_by("o_orderdate", "o_orderkey").alias("updated_at"))
    joined = source.join(first, "k", "left").withColumn("status", F.when(F.col("st") == "F", "FAILED").when(F.col("st") == "O", "IN_PROGRESS").when(F.col("st") == "P", "COMPLETED"))
    claim = F.when(F.col("status") == "COMPLETED", "ALREADY_MIGRATED").when(state.claimable(F.col("status"), F.col("updated_at"), as_of, timeout), "CLAIMED").otherwise("CLAIMED_BY_OTHER_WORKER")
    valid = rules.email_error(F.col("email")).isNull()
    outcome = migrate.migration_outcome(claim, valid, F.col("k") % 31 != 0, F.col("k") % 37 == 0)
    rows = joined.select("tenant_id", "external_id", outcome.alias("outcome")).withColumn("result", migrate.page_result(F.col("outcome")))
    return paging.with_pages(rows, 10)


@query(_MIGRATION, _RESULTS + "select tenant_id, external_id, outcome, result, page from results")
def migration_outcomes(source, orders):
    return _results(source, orders).select("tenant_id", "external_id", "outcome", "result", "page")


@query(_MIGRATION, _RESULTS + "select * from progress")
def page_progress(source, orders):
    return migrate.page_progress(_results(source, orders))


def _each(text: str) -> str:
    """text for each counter c."""
    return ", ".join(text.format(c=c) for c in migrate.COUNTERS)


@query(
    _MIGRATION,
    _RESULTS
    + f"""select tenant_id, page + 1 as next_page,
       {_each("cast(sum({c}) over (partition by tenant_id order by page) as bigint) as {c}")}
from progress""",
)
def job_running_totals(source, orders):
    return migrate.running_totals(migrate.page_progress(_results(source, orders)))


@query(
    (*_MIGRATION, "migration_job"),
    _RESULTS
    + f""", totals as (
  select tenant_id, max(page) + 1 as next_page, {_each("cast(sum({c}) as bigint) as {c}")} from progress group by tenant_id)
select j.tenant_id, coalesce(next_page, 1) as next_page, {_each("coalesce({c}, 0) as {c}")},
       case when coalesce(failed, 0) > 0 then 'COMPLETED_WITH_ERRORS' else 'COMPLETED' end as status
from migration_job j left join totals t on j.tenant_id = t.tenant_id""",
)
def job_final(source, orders, jobs):
    return migrate.final_jobs(jobs, migrate.page_progress(_results(source, orders)))


# Change events

# Fenced updates of jobs and runs that other workers may have taken: worker-1 acts on all of them.

_OWNED = """jobs as (select job_id, tenant_id, status, updated_at, 'worker-' || cast(job_id // 5 % 2 as varchar) as lease_owner from migration_job),
mine as (select *, status = 'RUNNING' and lease_owner = 'worker-1' as ok from jobs)"""
_SUMS = ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in migrate.COUNTERS)


def _owned(jobs: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Jobs as they stand once progress (tenant_id, the counters) is recorded, or unread."""
    owner = F.concat(F.lit("worker-"), F.floor(F.col("job_id") / 5) % 2)
    out = jobs.withColumn("lease_owner", owner).withColumn("next_page", F.lit(0)).withColumn("last_error", F.lit(None).cast("string"))
    if progress is None:
        return out.withColumns({c: F.lit(0).cast("long") for c in migrate.COUNTERS})
    sums = progress.groupBy("tenant_id").agg(*[F.sum(c).alias(c) for c in migrate.COUNTERS])
    return out.join(sums, "tenant_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in migrate.COUNTERS})


@query(
    (*_MIGRATION, "migration_job"),
    f"""{_RESULTS.rstrip()}, {_OWNED}
select j.job_id, j.ok and p.tenant_id is not null as applied, case when j.ok and p.tenant_id is not null then 1 else 0 end as next_page,
       {", ".join(f"case when j.ok then coalesce(p.{c}, 0) else 0 end as {c}" for c in migrate.COUNTERS)}
from mine j left join progress p on j.tenant_id = p.tenant_id and p.page = 0
""",
)
def job_record_page(source, orders, jobs):
    progress = migrate.page_progress(_results(source, orders)).where("page = 0")
    pages = progress.join(jobs.select("tenant_id", "job_id"), "tenant_id").withColumn("next_page", F.col("page") + 1)
    return state.record_page(_owned(jobs), pages, F.lit("worker-1"), _as_of()[0]).select("job_id", "applied", "next_page", *migrate.COUNTERS)


@query(
    (*_MIGRATION, "migration_job"),
    f"""{_RESULTS.rstrip()}, {_OWNED}, sums as (select tenant_id, {_SUMS} from progress group by tenant_id)
select j.job_id, j.ok as applied, case when not j.ok then j.status when coalesce(s.failed, 0) > 0 then 'COMPLETED_WITH_ERRORS' else 'COMPLETED' end as status,
       case when not j.ok then j.lease_owner end as lease_owner, coalesce(s.failed, 0) as failed
from mine j left join sums s on j.tenant_id = s.tenant_id
""",
)
def job_complete_fenced(source, orders, jobs):
    held = _owned(jobs, migrate.page_progress(_results(source, orders)))
    return state.complete_job(held, F.lit("worker-1"), _as_of()[0]).select("job_id", "applied", "status", "lease_owner", "failed")


_LONG_ERROR = "repeat('x', 1200)"


@query(
    (*_MIGRATION, "migration_job"),
    f"""{_RESULTS.rstrip()}, {_OWNED}, sums as (select tenant_id, {_SUMS} from progress group by tenant_id)
select j.job_id, j.ok as applied, case when j.ok then 'FAILED' else j.status end as status, case when j.ok then repeat('x', 1000) end as last_error,
       coalesce(s.processed, 0) as processed
from mine j left join sums s on j.tenant_id = s.tenant_id
""",
)
def job_fail_fenced(source, orders, jobs):
    held = _owned(jobs, migrate.page_progress(_results(source, orders)))
    return state.fail_job(held, F.lit("worker-1"), F.expr(_LONG_ERROR), _as_of()[0]).select("job_id", "applied", "status", "last_error", "processed")


@query(
    ("migration_job",),
    f"""with {_OWNED}
select job_id as run_id, ok as applied, case when ok then 'FAILED' else status end as status, case when ok then 'reconciliation failed' end as last_error,
       case when ok then {AS_OF} else updated_at end as updated_at from mine
""",
)
def run_fail_fenced(jobs):
    runs = _owned(jobs).withColumnRenamed("job_id", "run_id")
    return state.fail_run(runs, F.lit("worker-1"), F.lit("reconciliation failed"), _as_of()[0]).select("run_id", "applied", "status", "last_error", "updated_at")


_DELTA = f"""with complete as (
  select *, event_id is not null and occurred_at is not null and not {_blank("tenant_id")} and not {_blank("candidate_id")} as complete from change_event),
ranked as (
  select *, row_number() over w as rank, first_value(tenant_id) over w as t1, first_value(candidate_id) over w as c1
  from complete window w as (partition by event_id, complete order by delivery_no)),
judged as (
  select r.event_id, r.delivery_no, r.tenant_id, r.candidate_id, r.complete, r.rank,
         r.tenant_id is not distinct from r.t1 and r.candidate_id is not distinct from r.c1 as same_identity, s.email, s.external_id is not null as found, s.first_name, s.last_name
  from ranked r left join source_candidate s on r.tenant_id = s.tenant_id and r.candidate_id = s.external_id),
reasons as (
  select *, case when not complete then 'INCOMPLETE_EVENT' when not same_identity then 'REUSED_EVENT_ID'
                 when not found then 'SOURCE_NOT_FOUND' when {_blank("email")} then 'INVALID_RECORD' end as reason from judged),
outcomes as (select *, case when reason is not null then 'DLT' when rank > 1 then 'DUPLICATE' else 'PROCESSED' end as outcome from reasons)
"""
_EVENTS = ("change_event", "source_candidate")


@query(_EVENTS, _DELTA + "select event_id, delivery_no, outcome, reason from outcomes")
def delta_outcomes(events, source):
    return delta.outcomes(events, source).select("event_id", "delivery_no", "outcome", "reason")


@query(
    _EVENTS,
    _DELTA
    + """, answers as (select tenant_id, external_id, case when k % 211 = 0 then 'tenant-other' else tenant_id end as own_tenant from source_candidate)
select o.event_id, o.delivery_no, case when o.reason in ('INCOMPLETE_EVENT', 'REUSED_EVENT_ID', 'SOURCE_NOT_FOUND') then o.reason
       when a.own_tenant <> o.tenant_id then 'SOURCE_IDENTITY' else o.reason end as reason
from outcomes o left join answers a on o.tenant_id = a.tenant_id and o.candidate_id = a.external_id""",
)
def delta_source_identity(events, source):
    """Every 211th answer of the source is of another tenant than the one that was asked for."""
    answers = source.withColumn("asked_tenant", F.col("tenant_id")).withColumn("tenant_id", F.when(F.col("k") % 211 == 0, "tenant-other").otherwise(F.col("tenant_id")))
    return delta.outcomes(events, answers).select("event_id", "delivery_no", "reason")


@query(_EVENTS, _DELTA + "select event_id, delivery_no from outcomes where outcome = 'PROCESSED'")
def delta_dedupe_inbox(events, source):
    return delta.outcomes(events, source).where("outcome = 'PROCESSED'").select("event_id", "delivery_no")


@query(_EVENTS, _DELTA + "select event_id, delivery_no, tenant_id || ':' || candidate_id as message_key, reason from outcomes where outcome = 'DLT'")
def delta_dead_letters(events, source):
    return delta.dead_letters(delta.outcomes(events, source))


@query(
    _EVENTS,
    """
select e.event_id, e.delivery_no, s.external_id is not null as found, s.email
from change_event e
left join source_candidate s on e.tenant_id = s.tenant_id and e.candidate_id = s.external_id
""",
)
def delta_lookup_source(events, source):
    return delta.lookup_source(events, source).select("event_id", "delivery_no", "found", "email")


@query(
    (*_EVENTS, "target_candidate"),
    _DELTA
    + """, fresh as (
  select distinct tenant_id, candidate_id as external_id, first_name, last_name, email from outcomes where outcome = 'PROCESSED')
select coalesce(f.tenant_id, t.tenant_id) as tenant_id, coalesce(f.external_id, t.external_id) as external_id,
       case when f.external_id is not null then f.first_name else t.first_name end as first_name,
       case when f.external_id is not null then f.last_name else t.last_name end as last_name,
       case when f.external_id is not null then f.email else t.email end as email
from fresh f full outer join target_candidate t on f.tenant_id = t.tenant_id and f.external_id = t.external_id""",
)
def delta_upsert(events, source, target):
    done = delta.outcomes(events, source).where("outcome = 'PROCESSED'")
    new = done.select("tenant_id", F.col("candidate_id").alias("external_id"), "first_name", "last_name", "email").distinct()
    return migrate.upsert(new, target, F.expr(_SPARK_AS_OF))


@query(_EVENTS, _DELTA + "select event_id, delivery_no, tenant_id from outcomes where reason = 'REUSED_EVENT_ID'")
def delta_reused_ids(events, source):
    return delta.outcomes(events, source).where("reason = 'REUSED_EVENT_ID'").select("event_id", "delivery_no", "tenant_id")


@query(_EVENTS, _DELTA + "select event_id, delivery_no from complete where not complete")
def delta_incomplete(events, source):
    ok = rules.event_complete(F.col("event_id"), F.col("tenant_id"), F.col("candidate_id"), F.col("occurred_at"))
    return events.where(~ok).select("event_id", "delivery_no")


@query(
    _EVENTS,
    _DELTA + """
select event_id, count(*) filter (where reason is not null or outcome = 'PROCESSED') as attempts
from outcomes where complete and same_identity
group by event_id
""",
)
def delta_attempts(events, source):
    return delta.attempts(delta.outcomes(events, source))


# The inbox as it stands while its events are delivered: by the time of the event and the record's data.

_INBOX = ("change_event", "inbox_state", "source_candidate")
_INBOX_AS_OF, _LEASE = "TIMESTAMP '2024-01-31 00:00:00'", "INTERVAL '5' DAY"
_ASKED = f"""with asked as (
  select r.*, i.status, i.attempts, i.lease_owner,
         i.status is null or (r.tenant_id is not distinct from i.tenant_id and r.candidate_id is not distinct from i.candidate_id) as same_identity,
         i.status is null or i.status = 'FAILED' or (i.status = 'IN_PROGRESS' and i.updated_at < {_INBOX_AS_OF} - {_LEASE}) as free
  from (select *, row_number() over (partition by event_id order by delivery_no) as n, count(*) over (partition by event_id) as deliveries from change_event) r
  left join inbox_state i on r.event_id = i.event_id),
claims as (select *, same_identity and free and n = 1 as claimed from asked)
"""


def _claims(events: DataFrame, inbox: DataFrame) -> DataFrame:
    asked = events.withColumn("request_seq", F.col("delivery_no"))
    return state.claim_events(asked, inbox, F.expr(_INBOX_AS_OF.replace("TIMESTAMP", "TIMESTAMP_NTZ")), F.expr(_LEASE)).select("event_id", F.col("request_seq").alias("delivery_no"), "claimed", "attempts")


@query(_INBOX, _ASKED + "select event_id, delivery_no, claimed, case when claimed then coalesce(attempts, 0) + 1 else attempts end as attempts from claims")
def delta_claims(events, inbox, source):
    return _claims(events, inbox)


@query(
    _INBOX,
    """
with finishes as (
  select f.event_id, i.status, coalesce(i.status = 'IN_PROGRESS' and i.lease_owner = 'worker-' || f.tenant_id, false) as applied
  from change_event f left join inbox_state i on f.event_id = i.event_id)
select event_id, case when applied then 'FAILED' else status end as status, case when applied then repeat('x', 1000) end as last_error, applied from finishes
""",
)
def delta_finish(events, inbox, source):
    asked = events.select("event_id", F.concat(F.lit("worker-"), "tenant_id").alias("owner"), F.lit("FAILED").alias("new_status"), F.repeat(F.lit("x"), 1200).alias("error"))
    return state.finish_events(asked, inbox)


@query(
    _INBOX,
    _ASKED + f"""
select c.event_id, c.delivery_no,
       case when not c.same_identity then 'PERMANENT'
            when not c.claimed and c.status = 'COMPLETED' then 'DUPLICATE'
            when not c.claimed then 'IN_PROGRESS'
            when c.status = 'IN_PROGRESS' and c.deliveries > 1 then 'LEASE_LOST'
            when s.external_id is null or {_blank("s.email")} then 'PERMANENT' else 'PROCESSED' end as outcome
from claims c left join source_candidate s on c.tenant_id = s.tenant_id and c.candidate_id = s.external_id
""",
)
def delivery_outcomes(events, inbox, source):
    """A claim of an event that was in progress is lost to the delivery behind it, where there is one."""
    held = inbox.select("event_id", F.struct("tenant_id", "candidate_id").alias("_held"), F.col("status").alias("_status"))
    seen = delta.lookup_source(events, source).join(_claims(events, inbox).select("event_id", "delivery_no", "claimed"), ["event_id", "delivery_no"]).join(held, "event_id", "left")
    many = F.count(F.lit(1)).over(Window.partitionBy("event_id")) > 1
    same = F.col("_status").isNull() | F.struct("tenant_id", "candidate_id").eqNullSafe(F.col("_held"))
    error = F.when(~F.col("found"), "SOURCE_NOT_FOUND").when(fn.is_blank(F.col("email")), "INVALID_RECORD")
    taken = F.coalesce((F.col("_status") == "IN_PROGRESS") & many, F.lit(False))
    return seen.select("event_id", "delivery_no", delta.delivery_outcome(F.col("_status"), same, F.col("claimed"), taken, error).alias("outcome"))


@query(
    ("change_event",),
    f"""
with deliveries as (select *, cast(event_id as varchar) as e, event_id is not null and not {_blank("tenant_id")} and not {_blank("candidate_id")} and occurred_at is not null as complete from change_event),
firsts as (select *, row_number() over (partition by e order by delivery_no) as n from deliveries where complete)
select e as event_id, tenant_id, candidate_id, 'ATTEMPT' as outcome, e || '#1' as owner, cast(1 as integer) as attempts, cast(null as varchar) as error from firsts where n = 1
union all
select null, tenant_id, candidate_id, 'DLT', null, 0, 'INCOMPLETE_EVENT' from deliveries where not complete
""",
)
def inbox_attempts(events):
    """What the keyed inbox decides on its first batch: an attempt for the first delivery of each event; the others wait."""
    body = F.struct(F.col("event_id").cast("string").alias("eventId"), F.col("tenant_id").alias("tenantId"), F.col("candidate_id").alias("candidateId"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurredAt"))
    messages = events.select(fn.partition_key(F.col("tenant_id"), F.col("candidate_id")).alias("key"), F.to_json(body).alias("value"), F.lit(0).alias("partition"), F.col("delivery_no").cast("long").alias("offset"))
    none = events.sparkSession.createDataFrame([], stateful.RESULT)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    _ = events.sparkSession.streams.active  # starts the coordinator of state stores, which batches need, too
    return stateful.decisions(messages, none, stateful.Policy()).select("event_id", "tenant_id", "candidate_id", "outcome", "owner", "attempts", "error")


@query(
    ("change_event",),
    """
select tenant_id || ':' || candidate_id as message_key, event_id, delivery_no, cast(row_number() over (partition by tenant_id || ':' || candidate_id
order by occurred_at, event_id, delivery_no) as int) as seq
from change_event where candidate_id is not null
""",
)
def partition_order(events):
    return delta.partition_order(events)


# Resilience

_TYPE = "case when http_status is null or http_status in (408, 429, 502, 503, 504) then 'TRANSIENT' when http_status >= 400 then 'PERMANENT' end"


@query(("call_log",), f"select http_status, {_TYPE} as failure_type, count(*) as n from call_log group by 1, 2")
def classify_http_failures(calls):
    return calls.groupBy("http_status", resilience.failure_type(F.col("http_status")).alias("failure_type")).agg(F.count(F.lit(1)).alias("n"))


@query(
    ("call_log",),
    f"""
select call_seq, {_TYPE} as failure_type, case when http_status is null then 'TRANSPORT_ERROR' else 'HTTP_RESPONSE' end as failure_kind, system_name || ' call failed (' || {_TYPE} || ', ' ||
case when http_status is null then 'transport error' else 'HTTP ' || http_status end || ')' as message
from call_log where http_status is null or http_status >= 400
""",
)
def safe_error_messages(calls):
    return resilience.call_failures(calls)


@query(
    ("call_log",),
    """
select call_seq, case when call_seq % 13 = 0 then 'CIRCUIT_OPEN' when call_seq % 11 = 0 then 'INVALID_RESPONSE' when http_status >= 400 then 'HTTP_RESPONSE' when call_seq % 3 = 0 then 'TIMEOUT' when http_status is null then 'TRANSPORT_ERROR' end as kind
from call_log
""",
)
def failure_kinds(calls):
    n = F.col("call_seq")
    return calls.select("call_seq", resilience.failure_kind(F.col("http_status"), n % 3 == 0, n % 11 == 0, n % 13 == 0).alias("kind"))


@query(
    ("call_log",),
    f"""
select call_seq, attempt, case when attempt = 1 then 0 else least(200 * cast(pow(2, attempt - 2) as bigint), 2000) end as wait_ms
from call_log, (select 1 as attempt
union all select 2
union all select 3) where attempt = 1 or {_TYPE} = 'TRANSIENT'
""",
)
def retry_schedule(calls):
    return resilience.retry_schedule(calls)


@query(
    ("call_log",),
    f"""
select call_seq, system_name, n as calls, failed, case when n >= 5 then cast(floor(failed * 100 / n) as bigint) end as percent
from (select call_seq, system_name, count(*) over w as n, cast(sum(case when {_TYPE} = 'TRANSIENT' then 1 else 0 end) over w as bigint) as failed
from call_log
window w as (partition by system_name order by call_seq rows between 9 preceding and current row))
""",
)
def breaker_window_rate(calls):
    return resilience.window_rate(calls)


@query(
    ("call_log",),
    """
select call_seq, system_name, case when n <= 20 then 'UNAVAILABLE_AFTER_SAVE' else 'NONE' end as mode, n <= 20 as call_failed, true as saved
from (select *, row_number() over (partition by system_name order by call_seq) as n
from call_log)
""",
)
def failure_injection(calls):
    return resilience.injected(calls, "UNAVAILABLE_AFTER_SAVE", 20)


@query(("call_log",))
def breaker_states(calls):
    return resilience.breaker_states(calls)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
