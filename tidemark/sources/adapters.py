"""The record model's views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import read_table

#: name -> (relations that it reads, text); braces hold relations.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "source_candidate": (
        ("customer",),
        """
select 'tenant-' || cast(c_nationkey as varchar(20)) as tenant_id,
       'candidate-' || lpad(cast(c_custkey as varchar(20)), 8, '0') as external_id,
       c_name as first_name, c_mktsegment as last_name,
       case when c_custkey % 100 = 0 then ''
            else 'person' || lpad(cast(c_custkey as varchar(20)), 8, '0') || '@example.com' end as email,
       c_custkey as k
from {customer}""",
    ),
    "target_candidate": (
        ("source_candidate", "supplier"),
        """
select tenant_id, external_id,
       case when k % 41 = 0 then '  ' || first_name || ' ' else first_name end as first_name,
       case when k % 53 = 0 then last_name || '-X' else last_name end as last_name,
       case when k % 100 = 0 then null else email end as email
from {source_candidate} where k % 97 <> 0
union all
select 'tenant-' || cast(s_nationkey as varchar(20)),
       'ghost-' || lpad(cast(s_suppkey as varchar(20)), 8, '0'), s_name, 'Ghost', 'ghost@example.com'
from {supplier}""",
    ),
    "change_event": (
        ("events", "source_candidate"),
        """
select e.event_id, s.tenant_id,
       case when e.event_id % 250 = 0 then null else s.external_id end as candidate_id,
       e.ts as occurred_at, 1 as delivery_no
from {events} e join {source_candidate} s on e.user_id = s.k
union all
select e.event_id, s.tenant_id, s.external_id, e.ts, 2
from {events} e join {source_candidate} s on e.user_id = s.k where e.event_id % 20 = 1
union all
select e.event_id, 'tenant-reused', s.external_id, e.ts, 3
from {events} e join {source_candidate} s on e.user_id = s.k where e.event_id % 333 = 7""",
    ),
    "inbox_state": (
        ("change_event", "source_candidate"),
        """
select e.event_id, e.tenant_id, e.candidate_id, e.occurred_at, e.occurred_at as updated_at, cast(1 as int) as attempts,
       case when s.email = '' then 'FAILED' when cast(e.occurred_at as date) < date '2024-01-20' then 'COMPLETED' else 'IN_PROGRESS' end as status,
       case when s.email <> '' and cast(e.occurred_at as date) >= date '2024-01-20' then 'worker-' || e.tenant_id end as lease_owner
from {change_event} e join {source_candidate} s on e.tenant_id = s.tenant_id and e.candidate_id = s.external_id
where e.delivery_no = 1 and cast(e.occurred_at as date) < date '2024-01-28'""",
    ),
    "migration_state": (
        ("orders", "source_candidate"),
        """
select s.tenant_id, cast(o.o_orderkey as varchar(20)) as source_record_id,
       case o.o_orderstatus when 'F' then 'FAILED' when 'O' then 'IN_PROGRESS' else 'COMPLETED' end as status,
       o.o_orderdate as updated_at,
       case when o.o_orderstatus = 'O' then 'worker-' || cast(o.o_orderkey % 7 as varchar(20)) end as lease_owner
from {orders} o join {source_candidate} s on o.o_custkey = s.k""",
    ),
    "claim_request": (
        ("migration_state",),
        """
select tenant_id, source_record_id, 'new-' || cast(r.n as varchar(20)) as lease_owner, r.n as request_seq
from {migration_state} cross join (select 1 as n union all select 2 union all select 3) r""",
    ),
    "migration_job": (
        ("nation", "orders"),
        """
select n_nationkey as job_id, 'tenant-' || cast(n_nationkey as varchar(20)) as tenant_id,
       case n_nationkey % 5 when 0 then 'PENDING' when 1 then 'RUNNING' when 2 then 'COMPLETED'
            when 3 then 'COMPLETED_WITH_ERRORS' else 'FAILED' end as status,
       (select max(o_orderdate) from {orders}) as updated_at
from {nation}""",
    ),
    "call_log": (
        ("events",),
        """
select event_id as call_seq, case when event_id % 2 = 0 then 'source' else 'target' end as system_name, ts as called_at,
       case when k < 60 then 200 when k < 70 then 503 when k < 75 then 429 when k < 80 then 404
            when k < 85 then 500 when k < 90 then 400 else null end as http_status
from (select event_id, ts, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) e""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a driver table of that name."""
    if name not in VIEWS:
        return read_table(spark, sf_dir, name)
    uses, text = VIEWS[name]
    return spark.sql(text, **{u: view(spark, sf_dir, u) for u in uses})


def with_views(*names: str) -> str:
    """The WITH clause of the named views for DuckDB, what they read first."""

    def add(done: dict[str, str], name: str) -> dict[str, str]:
        if name not in VIEWS or name in done:
            return done
        uses, text = VIEWS[name]
        done = reduce(add, uses, done)
        return done | {name: text.format(**{u: u for u in uses})}

    return "with " + ",\n".join(f"{k} as ({v})" for k, v in reduce(add, names, {}).items())
