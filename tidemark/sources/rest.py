"""Spark data sources over an HTTP system of records: pages, records by key, and writes.

Reading (format paged_http). Options: url of a page, with {page}, {size} and perhaps {tenant}; record_url of one record,
with {id} and perhaps {tenant}; size; readers. An endpoint answers {"items": [...], "hasNext": bool}; unknown properties
are ignored, missing items are an empty page. How many pages there are need not be known: each of the readers is an input
partition that reads every readers-th page until one is empty or says that none follows, so that the first of them together
read all pages and each one page beyond the end at most. Rows carry page and position, the order of the scan, by which the
last read of a record counts (null for records got by key). An equality on tenantId goes into the address, and with an
equality or a list of ids the pages aren't read at all: the records are got one by one. A record that is missing, empty or
of another key than it was asked for fails the read.

Writing (format records_http, mode append). Options: url with {tenant}, and with {id} for an upsert (PUT) instead of a
creation (POST); in_flight, the calls that a task has open at a time. Columns: tenant_id, external_id, first_name,
last_name, email. Both writes are idempotent on tenant and id, so repeated tasks do no harm. What was written is counted by
the tasks' commit messages alone: an aborted write counts nothing.

fetch_records() and send_records() are the same calls as operators on rows, which give the failures as rows instead of
failing.
"""

from __future__ import annotations

import json
import secrets
import socket
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tidemark.operators.rules import check_page
from tidemark.sources.calls import CallError, address, call, fetch_page, fetch_record, in_flight, invalid

RECORD = "id string, tenantId string, firstName string, lastName string, email string, page int, position int"
REQUEST = ("tenant_id", "external_id", "first_name", "last_name", "email")
#: Bound of the calls that a task has open.
MAX_IN_FLIGHT = 64


@dataclass
class _Pages(InputPartition):
    """The pages first, first + step, ..."""

    first: int
    step: int


@dataclass
class _Keys(InputPartition):
    ids: list[str]


def _width(value: object) -> int:
    if not 1 <= int(value) <= MAX_IN_FLIGHT:
        raise ValueError(f"in_flight must be 1 to {MAX_IN_FLIGHT}")
    return int(value)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.url, self.record_url = options.get("url"), options.get("record_url")
        self.size, self.readers, self.width = int(options.get("size", 100)), int(options.get("readers", 8)), _width(options.get("in_flight", 8))
        self.tenant, self.ids = options.get("tenant"), None
        check_page(0, self.size)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities on tenantId and on id where the addresses have a place for them; the others are Spark's."""
        tenants = [f for f in filters if isinstance(f, EqualTo) and f.attribute == ("tenantId",)]
        ids = [f for f in filters if isinstance(f, (EqualTo, In)) and f.attribute == ("id",)]
        values = [set(f.value) if isinstance(f, In) else {f.value} for f in ids]
        taken: list[Filter] = []
        if len(tenants) == 1 and self.tenant in (None, tenants[0].value) and any("{tenant}" in (u or "") for u in (self.url, self.record_url)):
            self.tenant, taken = tenants[0].value, [*taken, *tenants]
        if ids and self.record_url and ("{tenant}" not in self.record_url or self.tenant is not None):
            self.ids, taken = sorted(v for v in set.intersection(*values) if v is not None), [*taken, *ids]
        return [f for f in filters if not any(f is t for t in taken)]

    def partitions(self) -> list[InputPartition]:
        if self.ids is not None:
            return [_Keys(self.ids[i :: self.readers]) for i in range(min(self.readers, max(1, len(self.ids))))]
        if "{tenant}" in self.url and self.tenant is None:
            raise ValueError("pages are of one tenant: filter by tenantId or set the option tenant")
        return [_Pages(i, self.readers) for i in range(self.readers)]

    def _row(self, item: dict, page: int | None = None, position: int | None = None) -> tuple:
        placed = item | {"page": page, "position": position}
        return tuple(placed.get(n) for n in self.names)

    def _record(self, key: str) -> dict:
        item = fetch_record(address(self.record_url, tenant=self.tenant, id=key))
        if item.get("id") != key or self.tenant is not None and item.get("tenantId") != self.tenant:
            raise invalid("record read", "record of another key")
        return item

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Keys):
            yield from map(self._row, in_flight(self._record, partition.ids, self.width))
            return
        number = partition.first
        while True:
            page = fetch_page(address(self.url, tenant=self.tenant, page=number, size=self.size))
            items = page.get("items") or []
            for position, item in enumerate(items):
                if self.tenant is not None and item.get("tenantId") != self.tenant:
                    raise invalid("page read", "record of another tenant")
                yield self._row(item, number, position)
            if not items or not page.get("hasNext"):
                return
            number += partition.step


class PagedHttpSource(DataSource):
    """register(spark); spark.read.format("paged_http").option(...).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def send(url: str, row: Row | dict, **settings) -> None:
    """Creates (POST) or, where the url names an id, upserts (PUT) one record; the answer's body is of no interest."""
    body = {"externalId": row["external_id"], "firstName": row["first_name"], "lastName": row["last_name"], "email": row["email"]}
    call("record write", address(url, tenant=row["tenant_id"], id=row["external_id"]), method="PUT" if "{id}" in url else "POST", body=body, **settings)


@dataclass
class Sent(WriterCommitMessage):
    """What one task has written."""

    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        if missing := set(REQUEST) - set(schema.names):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        self.url, self.width, self.report = options["url"], _width(options.get("in_flight", 8)), options.get("report")

    def write(self, iterator: Iterator[Row]) -> Sent:
        url = self.url
        return Sent(sum(1 for _ in in_flight(lambda row: send(url, row), iterator, self.width)))

    def commit(self, messages: list[Sent | None]) -> None:
        """Tells the count to who waits for it at the port of option report (see write_records)."""
        if self.report:
            port, token = self.report.split(":")
            with socket.create_connection(("127.0.0.1", int(port)), timeout=10) as line:
                line.sendall(json.dumps({"token": token, "rows": sum(m.rows for m in messages if m)}).encode())

    def abort(self, messages: list[Sent | None]) -> None:
        """Nothing is counted; what got through stays in the target and is written again to the same end."""


class RecordsHttpSink(DataSource):
    """register(spark); df.write.format("records_http").option("url", ...).mode("append").save()"""

    @classmethod
    def name(cls) -> str:
        return "records_http"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a system of records can't be overwritten as a whole: use mode append")
        return _Writer(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedHttpSource)
    spark.dataSource.register(RecordsHttpSink)


class Report:
    """Where the count of a write arrives: Spark commits a Python sink in another process on the driver's machine."""

    def __init__(self):
        self.token, self.line = secrets.token_hex(16), socket.create_server(("127.0.0.1", 0))
        self.line.settimeout(10)

    @property
    def option(self) -> str:
        return f"{self.line.getsockname()[1]}:{self.token}"

    def rows(self) -> int:
        while True:
            with self.line.accept()[0] as said:
                said.settimeout(10)
                got = json.loads(b"".join(iter(lambda: said.recv(4096), b"")) or b"{}")
            if got.get("token") == self.token:
                return got["rows"]


def write_records(df: DataFrame, url: str, in_flight: int = 8) -> int:
    """Writes all rows or fails; the number of rows by the tasks' commit messages."""
    report = Report()
    with report.line:
        df.select(*REQUEST).write.format("records_http").option("url", url).option("in_flight", in_flight).option("report", report.option).mode("append").save()
        return report.rows()


def _by_row(df: DataFrame, work, schema: str, width: int) -> DataFrame:
    """work, a function of one row as a dict that returns one, with a bounded number of rows at work in each task."""
    types = df.sparkSession.createDataFrame([], schema).schema
    names = types.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = list(in_flight(work, batch.to_pylist(), width))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in done], pa.string()) for n in names], names=names)

    return df.mapInArrow(run, schema)


def fetch_records(keys: DataFrame, url: str, in_flight: int = 8, **settings) -> DataFrame:
    """The records of keys (tenant_id, external_id), each got by a call of its own.

    asked_tenant, asked_id, then the record as it came (tenant_id, external_id, first_name, last_name, email, null where it
    couldn't be got), failure (TRANSIENT or PERMANENT) and detail.
    """

    def work(key: dict) -> dict:
        out = {"asked_tenant": key["tenant_id"], "asked_id": key["external_id"]}
        try:
            got = fetch_record(address(url, tenant=key["tenant_id"], id=key["external_id"]), **settings)
        except CallError as error:
            return out | {"failure": error.type, "detail": str(error)}
        return out | {"tenant_id": got.get("tenantId"), "external_id": got.get("id"), "first_name": got.get("firstName"), "last_name": got.get("lastName"), "email": got.get("email")}

    schema = "asked_tenant string, asked_id string, tenant_id string, external_id string, first_name string, last_name string, email string, failure string, detail string"
    return _by_row(keys.select("tenant_id", "external_id").distinct(), work, schema, _width(in_flight))


def send_records(rows: DataFrame, url: str, in_flight: int = 8, **settings) -> DataFrame:
    """tenant_id, external_id, failure and detail (null once written) of each row. Evaluated again, it writes again."""

    def work(row: dict) -> dict:
        out = {"tenant_id": row["tenant_id"], "external_id": row["external_id"]}
        try:
            send(url, row, **settings)
        except CallError as error:
            return out | {"failure": error.type, "detail": str(error)}
        return out

    return _by_row(rows.select(*REQUEST), work, "tenant_id string, external_id string, failure string, detail string", _width(in_flight))


def failed_writes(url: str, in_flight: int = 8, **settings):
    """A write for streaming.inbox and plans.service: rows to the (tenant_id, external_id, failure) of those not written."""
    return lambda rows: send_records(rows, url, in_flight, **settings).where(F.col("failure").isNotNull()).select("tenant_id", "external_id", "failure")
