"""Reads, writes and streams over HTTP against a server in this process."""

import json
import pickle
import re
import socket
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import SOURCE, event
from tidemark.model import INBOX_STATE, STORED_CANDIDATE
from tidemark.operators import rules
from tidemark.plans.service import Service
from tidemark.sources import calls, rest
from tidemark.sources.generated import bulk_tenant
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming import feed, inbox


class System:
    """Eleven pages of two records for each tenant, a store of written records, and a feed."""

    def __init__(self):
        self.calls, self.stored, self.open, self.most_open = [], {}, 0, 0
        self.feed, self.acknowledged, self.broken, self.lock = {"0": [], "1": []}, [], {}, threading.Lock()
        self.refused: set[str] = set()
        system = self

        class Handler(BaseHTTPRequestHandler):
            def handle_one(self, method):
                with system.lock:
                    system.open += 1
                    system.most_open = max(system.most_open, system.open)
                    system.calls.append((method, self.path))
                    status = system.status(self.path)
                length = int(self.headers.get("Content-Length") or 0)
                sent = json.loads(self.rfile.read(length)) if length else None
                body = system.answer(method, self.path, sent) if status == 200 else b"person@example.com"
                if method != "GET":
                    time.sleep(0.002)
                with system.lock:
                    system.open -= 1
                self.send_response(404 if body is None else status)
                self.end_headers()
                self.wfile.write(body or b"")

            do_GET = lambda self: self.handle_one("GET")
            do_PUT = lambda self: self.handle_one("PUT")
            do_POST = lambda self: self.handle_one("POST")
            log_message = lambda *_: None

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.http.daemon_threads = True
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.http.server_port}"

    def status(self, path):
        """broken: a pattern of paths to the statuses of its next calls; one before None stays for all of them."""
        for pattern, left in self.broken.items():
            if left and re.search(pattern, path):
                return left[0] if len(left) > 1 and left[1] is None else left.pop(0)
        return 200

    def answer(self, method, path, sent):
        if m := re.fullmatch(r"/feed/heads", path):
            return json.dumps({"partitions": {p: len(rows) for p, rows in self.feed.items()}}).encode()
        if m := re.fullmatch(r"/feed/(\d+)/(\d+)/(\d+)", path):
            p, at, size = m[1], int(m[2]), int(m[3])
            return json.dumps({"items": [{"offset": at + i, "key": k, "value": v} for i, (k, v) in enumerate(self.feed[p][at : at + size])]}).encode()
        if path == "/feed/ack":
            self.acknowledged.append(sent["partitions"])
            return b"{}"
        tenant, _, rest_ = re.fullmatch(r"/(\w[\w-]*)(/records)?/?(.*)", unquote(path)).groups()
        if method == "PUT" or method == "POST":
            key = tenant, sent["externalId"]
            if key[1] in self.refused:
                return None
            with self.lock:
                if method == "PUT" or key not in self.stored:
                    self.stored[key] = sent
            return b""
        if m := re.match(r"target\?page=(\d+)&size=(\d+)", rest_):
            page, size = int(m[1]), int(m[2])
            rows = [{"tenantId": t, "id": i, **{k: v for k, v in r.items() if k != "externalId"}} for (t, i), r in sorted(self.stored.items()) if t == tenant]
            return json.dumps({"items": rows[page * size : (page + 1) * size], "hasNext": len(rows) > (page + 1) * size}).encode()
        if m := re.match(r"\?page=(\d+)", rest_):
            page = int(m[1])
            items = [{"id": f"c{page}-{i}", "tenantId": tenant, "firstName": "A", "extra": 1} for i in range(2)] if page < 11 else None
            return json.dumps({"items": items, "hasNext": page < 10, "secret": "person@example.com"}).encode()
        if rest_ in ("empty", "null"):
            return {"empty": b"", "null": b"null"}[rest_]
        if rest_ == "gone":
            return None
        return json.dumps({"id": "c0-0" if rest_ == "other" else rest_, "tenantId": tenant, "firstName": "K", "lastName": "L", "email": f"{rest_}@x"}).encode()


@pytest.fixture
def system():
    out = System()
    yield out
    out.http.shutdown()


@pytest.fixture
def pages(spark, system):
    rest.register(spark)
    reader = spark.read.format("paged_http").option("size", 2).option("url", system.base + "/{tenant}?page={page}&size={size}")
    return reader.option("record_url", system.base + "/{tenant}/records/{id}")


@pytest.mark.parametrize("readers", [1, 3, 20])
def test_pages_are_read_to_the_last_one_without_a_count(system, pages, readers):
    system.broken["page=1&"] = [503]
    df = pages.option("readers", readers).option("tenant", "t").load()
    assert sorted(r.id for r in df.collect()) == sorted(f"c{p}-{i}" for p in range(11) for i in range(2))
    seen = [int(re.search(r"page=(\d+)", path)[1]) for _, path in system.calls]
    assert seen.count(1) == 2 and len(set(seen)) <= 11 + readers
    assert [(r.page, r.position) for r in df.where("id like '%4-1'").collect()] == [(4, 1)]


def test_an_equality_on_key_becomes_one_call(system, pages):
    df = pages.load()
    assert [tuple(r) for r in df.where("tenantId = 't' and id = 'c7' and firstName like 'K%'").collect()] == [("c7", "t", "K", "L", "c7@x", None, None)]
    assert system.calls == [("GET", "/t/records/c7")]
    system.calls.clear()
    assert sorted(r.id for r in df.where("tenantId = 't' and id in ('a b', 'c', 'd/e')").select("id").collect()) == ["a b", "c", "d/e"]
    assert sorted(p for _, p in system.calls) == ["/t/records/a%20b", "/t/records/c", "/t/records/d%2Fe"]
    assert df.where("tenantId = 't' and id = 'c' and id = 'd'").count() == 0 and len(system.calls) == 3


def test_an_equality_on_tenant_goes_into_the_address(system, pages):
    assert pages.load().where("tenantId = 'other'").where("id > 'c9'").count() == 2
    assert {p.split("?")[0] for _, p in system.calls} == {"/other"}
    with pytest.raises(Exception, match="pages are of one tenant"):
        pages.load().count()


@pytest.mark.parametrize(("key", "said"), [("gone", "HTTP 404"), ("empty", "invalid response"), ("null", "invalid response"), ("other", "record of another key")])
def test_a_keyed_read_without_its_record_fails(system, pages, key, said):
    with pytest.raises(Exception, match=f"record read failed .PERMANENT, {said}"):
        pages.load().where(f"tenantId = 't' and id = '{key}'").collect()


def test_keys_of_a_table_are_read_by_calls_of_their_own(spark, system):
    system.broken["records/late"] = [503, 503]
    system.broken["records/down"] = [503, None]
    keys = spark.createDataFrame([("t", k) for k in ("a", "a", "gone", "late", "down", "other")], "tenant_id string, external_id string")
    got = {r.asked_id: (r.external_id, r.email, r.failure) for r in rest.fetch_records(keys, system.base + "/{tenant}/records/{id}", initial_s=0.01).collect()}
    assert got == {"a": ("a", "a@x", None), "gone": (None, None, "PERMANENT"), "late": ("late", "late@x", None), "down": (None, None, "TRANSIENT"), "other": ("c0-0", "other@x", None)}


def requests_of(spark):
    return rules.to_request(rules.to_canonical(bulk_tenant(spark)))


@pytest.mark.parametrize("address", ["/{tenant}", "/{tenant}/records/{id}"])
def test_a_written_tenant_is_there_once(spark, system, address):
    rest.register(spark)
    rows = requests_of(spark).repartition(3)
    assert rest.write_records(rows, system.base + address, in_flight=4) == 1050
    first = dict(system.stored)
    assert rest.write_records(rows, system.base + address, in_flight=4) == 1050
    assert system.stored == first and len(first) == 1050 and len(system.calls) == 2100
    assert system.most_open <= 3 * 4 and system.most_open > 3
    assert system.stored["tenant-bulk", "candidate-00100"] == {"externalId": "candidate-00100", "firstName": "First100", "lastName": "Last100", "email": ""}


def test_an_aborted_write_counts_nothing(spark, system):
    rest.register(spark)
    system.broken["records/candidate-00777"] = [400, None]
    report = rest.Report()
    report.line.settimeout(1)
    rows = requests_of(spark).repartition(3).write.format("records_http").option("url", system.base + "/{tenant}/records/{id}").option("report", report.option)
    with pytest.raises(Exception, match="record write failed .PERMANENT, HTTP 400"):
        rows.mode("append").save()
    with pytest.raises(TimeoutError):
        report.rows()
    assert system.stored
    with pytest.raises(Exception, match="can't be overwritten"):
        rows.mode("overwrite").save()
    system.broken.clear()
    assert rest.write_records(requests_of(spark), system.base + "/{tenant}/records/{id}") == 1050 == len(system.stored)


def test_writes_as_rows_name_their_failures(spark, system):
    system.broken["00005"] = [503, 503, 503]
    system.broken["00006"] = [409, None]
    rows = requests_of(spark).where("external_id <= 'candidate-00009'")
    got = {r.external_id: r.failure for r in rest.send_records(rows, system.base + "/{tenant}/records/{id}", initial_s=0.01).collect() if r.failure}
    assert got == {"candidate-00005": "TRANSIENT", "candidate-00006": "PERMANENT"} and len(system.stored) == 7


def test_permanent_errors_are_not_tried_again(system):
    system.broken["page=99"] = [404, None]
    with pytest.raises(calls.CallError, match=r"page read failed \(PERMANENT, HTTP 404\)") as error:
        calls.fetch_page(f"{system.base}/t?page=99")
    assert len(system.calls) == 1 and "person" not in str(error.value) and pickle.loads(pickle.dumps(error.value)).kind == "HTTP_RESPONSE"


def test_a_call_with_its_retries_is_one_outcome_of_the_breaker(system):
    """Five failing calls open the breaker, each after its three attempts; then nothing is called until it has waited."""
    system.broken["page=77"] = [503, None]
    breaker, at = calls.SharedBreaker(), [0.0]
    read = lambda page: calls.fetch_page(f"{system.base}/t?page={page}", breaker, initial_s=0, clock=lambda: at[0])
    for _ in range(5):
        with pytest.raises(calls.CallError, match="HTTP 503"):
            read(77)
    with pytest.raises(calls.CallError, match="circuit breaker open") as error:
        read(77)
    assert len(system.calls) == 15 and error.value.kind == "CIRCUIT_OPEN"
    at[0] = 31
    assert read(3)["hasNext"] and breaker.state == "HALF_OPEN" and read(4)["hasNext"] and breaker.state == "CLOSED"


def test_a_call_that_succeeds_at_a_retry_is_a_success(system):
    breaker = calls.SharedBreaker()
    for _ in range(6):
        system.broken["page=1"] = [503, 503]
        assert calls.fetch_page(f"{system.base}/t?page=1", breaker, initial_s=0)
    assert breaker.state == "CLOSED" and sum(breaker.last) == 0


def test_permanent_failures_do_not_open_the_breaker(system):
    system.broken["page=1"] = [500, None]
    breaker = calls.SharedBreaker()
    for _ in range(8):
        with pytest.raises(calls.CallError, match="HTTP 500"):
            calls.fetch_page(f"{system.base}/t?page=1", breaker)
    assert breaker.state == "CLOSED" and len(system.calls) == 8


def test_a_half_open_breaker_has_as_many_trials_as_it_takes():
    breaker = calls.SharedBreaker()
    for _ in range(5):
        breaker.admit(0) and breaker.record(0, True)
    assert breaker.state == "OPEN" and not breaker.admit(29)
    assert [breaker.admit(31) for _ in range(4)] == [True, True, False, False]
    breaker.record(31, False)
    breaker.record(31, False)
    assert breaker.state == "CLOSED" and breaker.admit(31)


def test_one_breaker_a_system(system):
    assert calls.breaker_of(f"{system.base}/a?x") is calls.breaker_of(f"{system.base}/b") is not calls.breaker_of("http://other/a")


def test_timeouts_and_broken_connections_differ():
    with socket.socket() as silent:
        silent.bind(("127.0.0.1", 0))
        silent.listen()
        url = f"http://127.0.0.1:{silent.getsockname()[1]}/"
        with pytest.raises(calls.CallError, match=r"\(TRANSIENT, timeout\)") as error:
            calls.fetch_page(url, attempts=1, timeout_s=0.2)
        assert error.value.kind == "TIMEOUT"
    with pytest.raises(calls.CallError, match=r"\(TRANSIENT, transport error\)"):
        calls.fetch_page(url, attempts=1, timeout_s=0.2)


def test_calls_in_flight_keep_order_and_bound():
    now, most, lock = [0], [0], threading.Lock()

    def work(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.001 * (i % 3))
        with lock:
            now[0] -= 1
        return i

    assert list(calls.in_flight(work, iter(range(100)), 5)) == list(range(100)) and 1 < most[0] <= 5


def test_a_tenant_is_migrated_and_verified_over_http(spark, system, tmp_path):
    """Two writes are refused for good and one passes at a later job; the verification reads the target's own pages."""
    rest.register(spark)
    pages = spark.read.format("paged_http").option("size", 100).option("readers", 3).option("url", system.base + "/{tenant}/target?page={page}&size={size}").option("tenant", "tenant-bulk").load()
    target = pages.select(F.col("tenantId").alias("tenant_id"), F.col("id").alias("external_id"), F.col("firstName").alias("first_name"), F.col("lastName").alias("last_name"), "email", "page", "position")
    write = rest.failed_writes(system.base + "/{tenant}", initial_s=0.01)
    service = Service(spark, f"file://{tmp_path}/s", lambda: bulk_tenant(spark), write=write, read_target=lambda: target)
    system.refused = {"candidate-00005", "candidate-00006"}
    job = service.run_job(service.start_batch("tenant-bulk")["job_id"])
    assert (job["status"], job["processed"], job["succeeded"], job["failed"]) == ("COMPLETED_WITH_ERRORS", 1050, 1038, 12) and len(system.stored) == 1038
    system.refused = set()
    again = service.run_job(service.start_batch("tenant-bulk")["job_id"])
    assert (again["succeeded"], again["failed"]) == (1040, 10)
    assert sum(m == "POST" for m, _ in system.calls) == 1040 + 2  # what was migrated isn't written again
    system.stored["tenant-bulk", "candidate-00001"]["firstName"] = "changed"
    run = service.run_reconciliation(service.start_reconciliation("tenant-bulk")["run_id"])
    assert (run["source_count"], run["target_count"], run["matched_count"], run["missing_count"], run["mismatched_count"]) == (1050, 1040, 1039, 10, 1)
    assert service.scanned[run["run_id"]]["target_pages"] == 11
    assert service.get_items(run["run_id"], 0, 5, "MISMATCHED")["items"][0]["external_id"] == "candidate-00001"


# The change feed


@pytest.fixture
def follow(spark, system, tmp_path):
    boxes = SnapshotTable(spark, f"{tmp_path}/inbox", INBOX_STATE, ("event_id",), 4), SnapshotTable(spark, f"{tmp_path}/target", STORED_CANDIDATE, ("tenant_id", "external_id"), 4)
    source = spark.createDataFrame([("t", f"c{i}", "A", "L", "a@x") for i in range(20)], SOURCE)

    def run(**more):
        messages = feed.feed_messages(spark, system.base + "/feed/heads", system.base + "/feed/{partition}/{offset}/{size}", size=3, rows=5, acknowledge=system.base + "/feed/ack")
        inbox.start_inbox(spark, messages, lambda: source, *boxes, f"{tmp_path}/dlt", f"{tmp_path}/log", **more).awaitTermination()

    return run, boxes, tmp_path


def test_a_feed_is_read_once_over_restarts(system, follow, spark):
    run, (events, target), path = follow
    for i in range(17):
        system.feed[str(i % 2)].append((f"t:c{i}", event(f"e{i}", f"c{i}")))
    run()
    assert events.read().count() == 17 and target.read().count() == 17
    run()
    assert events.read().count() == 17
    system.feed["0"] += [("t:c17", event("e17", "c17")), ("t:c1", event("e1", "c1"))]
    system.feed["2"] = [("t:c18", event("e18", "c18"))]  # a partition that is new
    run()
    got = {r.event_id: (r.status, r.attempts) for r in events.read().collect()}
    assert got == {f"e{i}": ("COMPLETED", 1) for i in range(19)}
    assert system.acknowledged and {"0": 9, "1": 8} in system.acknowledged
    long = [p for _, p in system.calls if p.startswith("/feed/0/")]
    assert "/feed/0/0/3" in long and "/feed/0/5/3" in long  # a backlog of nine in two tasks


def test_a_batch_that_failed_is_read_again(system, follow):
    run, (events, target), _ = follow
    for i in range(6):
        system.feed["0"].append((f"t:c{i}", event(f"e{i}", f"c{i}")))

    def broken(rows):
        raise OSError("down")

    with pytest.raises(Exception, match="down"):
        run(write=broken)
    assert events.read().count() == 0
    for i in range(6, 9):
        system.feed["1"].append((f"t:c{i}", event(f"e{i}", f"c{i}")))
    run()  # the batch that failed
    assert {r.event_id: r.attempts for r in events.read().collect()} == {f"e{i}": 1 for i in range(6)}
    run()
    assert {r.event_id: r.attempts for r in events.read().collect()} == {f"e{i}": 1 for i in range(9)} and target.read().count() == 9


def test_a_feed_that_lost_offsets_fails_the_query(system, follow):
    run, _, _ = follow
    system.feed["0"] = [("k", event("e", "c1"))] * 3
    answer = system.answer
    system.answer = lambda m, p, s: b'{"items": []}' if p.startswith("/feed/0/") else answer(m, p, s)
    with pytest.raises(Exception, match="offsets are gone"):
        run()


def test_an_inbox_that_writes_over_http(system, follow, spark):
    run, (events, _), path = follow
    system.feed["0"] = [(f"t:c{i}", event(f"e{i}", f"c{i}")) for i in range(4)]
    system.broken["records/c2"] = [409, None]
    run(write=rest.failed_writes(system.base + "/{tenant}/records/{id}"))
    assert {k for k in system.stored} == {("t", "c0"), ("t", "c1"), ("t", "c3")}
    assert {r.event_id: r.status for r in events.read().collect()} == {"e0": "COMPLETED", "e1": "COMPLETED", "e2": "FAILED", "e3": "COMPLETED"}
    assert [r.error for r in spark.read.parquet(f"{path}/dlt").collect()] == ["target write failed (PERMANENT)"]
