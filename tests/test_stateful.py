"""The inbox as keyed state: its rules with a set clock, the processor on a state in memory, and the stream with a restart."""

import json
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from tidemark.streaming import stateful
from tidemark.streaming.stateful import BucketProcessor, InboxProcessor, Pages, Policy

POLICY = Policy(max_attempts=3, lease_ms=10_000)


class Store:
    """The parts of a state store that the processor uses, for one key."""

    def __init__(self):
        self.value, self.entries, self.timers, self.most = None, {}, set(), 0

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def getMapState(self, name, key, value):
        return SimpleNamespace(updateValue=self.entries.__setitem__, getValue=self.entries.__getitem__, removeKey=self.entries.__delitem__)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clocked:
    """A processor of event e, its clock and what it has decided."""

    def __init__(self, policy=POLICY):
        self.store, self.now, self.offset = Store(), 0, 0
        self.processor = InboxProcessor(policy)
        self.processor.init(self.store)

    def times(self):
        return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: self.now)

    def rows(self, *rows):
        return [(r.outcome, r.candidate_id, r.owner, r.error, r.offset) for r in self.processor.handleInputRows(("e",), iter(rows), self.times())]

    def delivery(self, candidate="c1", complete=True, offset=None):
        self.offset += 1
        return Row(event_id="e", tenant_id="t", candidate_id=candidate, occurred_at=None, complete=complete, key="k", value="v", topic="x", partition=0, offset=self.offset if offset is None else offset, owner=None, failure=None, error=None)

    def result(self, owner, failure=None, error=None):
        return Row(event_id="e", tenant_id=None, candidate_id=None, occurred_at=None, complete=True, key=None, value=None, topic=None, partition=None, offset=None, owner=owner, failure=failure, error=error)

    def tick(self, now):
        """What comes due until then."""
        out = []
        while due := sorted(t for t in self.store.timers if t <= now):
            self.now = due[0]
            self.store.timers.discard(due[0])
            info = SimpleNamespace(getExpiryTimeInMs=lambda: due[0])
            out += [(self.now, r.outcome, r.owner, r.error) for r in self.processor.handleExpiredTimer(("e",), self.times(), info)]
        self.now = now
        return out

    @property
    def held(self):
        return self.processor._load()


def test_an_event_is_processed_once():
    c = Clocked()
    assert c.rows(c.delivery(), c.delivery()) == [("ATTEMPT", "c1", "e#1", None, 1)]
    assert c.rows(c.delivery()) == []
    assert c.rows(c.result("e#1")) == [("PROCESSED", "c1", "e#1", None, 1), ("DUPLICATE", "c1", None, None, 2), ("DUPLICATE", "c1", None, None, 3)]
    assert c.rows(c.delivery()) == [("DUPLICATE", "c1", None, None, 4)]
    assert (c.held.status, c.held.attempts, c.held.owner, c.store.entries, c.store.timers) == ("COMPLETED", 1, None, {}, set())


def test_a_reused_id_is_refused_and_takes_no_turn():
    c = Clocked()
    assert c.rows(c.delivery("c2", offset=9), c.delivery("c1", offset=3)) == [("ATTEMPT", "c1", "e#1", None, 3)]
    assert c.rows(c.delivery("c2", offset=10)) == [("DLT", "c2", None, "REUSED_EVENT_ID", 10)]
    assert c.rows(c.result("e#1", "PERMANENT", "gone")) == [("DLT", "c1", None, "gone", 3), ("DLT", "c2", None, "REUSED_EVENT_ID", 9)]
    assert c.rows(c.delivery("c2", offset=11), c.delivery("c1", offset=12))[1:] == [("ATTEMPT", "c1", "e#2", None, 12)]


def test_a_permanent_failure_is_tried_again_at_the_next_delivery_alone():
    c = Clocked()
    c.rows(c.delivery())
    assert c.rows(c.result("e#1", "PERMANENT", "Candidate email is required")) == [("DLT", "c1", None, "Candidate email is required", 1)]
    assert (c.held.status, c.held.last_error) == ("FAILED", "Candidate email is required") and c.tick(10**9) == []
    assert c.rows(c.delivery()) == [("ATTEMPT", "c1", "e#2", None, 2)]
    assert c.rows(c.delivery()) == [] and c.rows(c.result("e#2", "PERMANENT", "x")) == [("DLT", "c1", None, "x", 2), ("ATTEMPT", "c1", "e#3", None, 3)]
    assert c.rows(c.result("e#3"))[0][0] == "PROCESSED" and c.held.attempts == 3


def test_waits_double_up_to_the_bound_and_end_in_a_dead_letter():
    policy = Policy(max_attempts=6)
    c = Clocked(policy)
    c.rows(c.delivery())
    waits = []
    for number in range(1, 6):
        start = c.now
        assert c.rows(c.result(f"e#{number}", "TRANSIENT", "down")) == []
        assert c.tick(start + policy.wait_ms(number) - 1) == []
        ((at, outcome, owner, _),) = c.tick(start + policy.wait_ms(number))
        assert (outcome, owner) == ("ATTEMPT", f"e#{number + 1}")
        waits.append(at - start)
    assert waits == [200, 400, 800, 1600, 2000]
    assert c.rows(c.result("e#6", "TRANSIENT", "down")) == [("DLT", "c1", None, "down", 1)]
    assert (c.held.status, c.held.attempts) == ("FAILED", 6) and c.tick(10**9) == []


def test_a_delivery_during_a_wait_does_not_shorten_it():
    c = Clocked()
    c.rows(c.delivery())
    c.rows(c.result("e#1", "TRANSIENT", "down"))
    c.now = 100
    assert c.rows(c.delivery()) == [] and c.tick(199) == []
    assert [x[1:3] for x in c.tick(200)] == [("ATTEMPT", "e#2")]


def test_a_lease_that_ends_is_taken_over_and_its_owner_is_fenced():
    c = Clocked()
    c.rows(c.delivery())
    assert c.tick(9_999) == []
    assert c.tick(10_000) == [(10_000, "ATTEMPT", "e#2", None)]
    assert c.rows(c.result("e#1")) == [("LEASE_LOST", "c1", "e#1", None, 1)]
    assert c.rows(c.result("e#1", "PERMANENT", "x")) == [("LEASE_LOST", "c1", "e#1", None, 1)] and c.held.status == "IN_PROGRESS"
    assert c.rows(c.result("e#2"))[0][0] == "PROCESSED"
    assert c.rows(c.result("e#2"))[0][0] == "LEASE_LOST"


def test_leases_that_end_again_and_again_are_bounded():
    c = Clocked()
    c.rows(c.delivery())
    assert [x[1:] for x in c.tick(10**6)] == [("ATTEMPT", "e#2", None), ("ATTEMPT", "e#3", None), ("DLT", None, "lease lost")]


def test_broken_messages_leave_no_state():
    c = Clocked()
    assert c.rows(c.delivery(None, complete=False)) == [("DLT", None, None, "INCOMPLETE_EVENT", 1)]
    assert c.held is None and c.rows(c.result("e#1")) == []


def test_many_deliveries_of_one_id_wait_in_the_store():
    c = Clocked()
    c.rows(*[c.delivery() for _ in range(500)])
    assert len(c.store.entries) == 499
    assert len(c.rows(c.result("e#1"))) == 500 and not c.store.entries


class BucketStore:
    """The parts of a state store that the processor of a bucket uses, for one bucket, and the number of calls."""

    def __init__(self):
        self.states, self.timers, self.calls = {}, set(), 0

    def _called(self, value=None):
        self.calls += 1
        return value

    def getValueState(self, name, schema):
        held = self.states.setdefault(name, {})
        return SimpleNamespace(get=lambda: self._called(held.get(0)), update=lambda v: self._called(held.update({0: v})))

    def getMapState(self, name, key, value):
        held = self.states.setdefault(name, {})
        return SimpleNamespace(updateValue=lambda k, v: self._called(held.update({k: v})), getValue=lambda k: self._called(held.get(k)), removeKey=lambda k: self._called(held.pop(k)))

    def registerTimer(self, at):
        assert at not in self.timers
        self._called(self.timers.add(at))

    def deleteTimer(self, at):
        self._called(self.timers.remove(at))


class Bucket:
    """A processor of a bucket, its clock, and one of each id on its own that gets the same rows."""

    def __init__(self):
        self.store, self.now, self.single, self.offset = BucketStore(), 0, {}, 0
        self.processor = BucketProcessor(POLICY)
        self.processor.init(self.store)

    def times(self):
        return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: self.now)

    def delivery(self, event_id, candidate="c1"):
        self.offset += 1
        return dict(event_id=event_id, tenant_id="t", candidate_id=candidate, occurred_at=0, complete=True, key="k", value="v", topic="x", partition=0, offset=self.offset, owner=None, failure=None, error=None)

    def result(self, event_id, owner, failure=None):
        return dict(event_id=event_id, tenant_id=None, candidate_id=None, occurred_at=None, complete=True, key=None, value=None, topic=None, partition=None, offset=None, owner=owner, failure=failure, error=failure)

    def rows(self, rows):
        made = list(self.processor.handleInputRows((0,), (Row(row=json.dumps({k: v for k, v in r.items() if v is not None})) for r in rows), self.times()))
        alone, by_id = [], {}
        for r in rows:
            by_id.setdefault(r["event_id"], []).append(Row(**r))
        for i, mine in by_id.items():
            one = self.single.setdefault(i, Clocked())
            one.now = self.now
            alone += one.processor.handleInputRows((i,), iter(mine), one.times())
        assert sorted(map(str, made)) == sorted(map(str, alone))
        return made

    def tick(self, now):
        made, alone = [], []
        while due := sorted(t for t in self.store.timers if t <= now):
            self.now = due[0]
            info = SimpleNamespace(getExpiryTimeInMs=lambda: due[0])
            made += self.processor.handleExpiredTimer((0,), self.times(), info)
            self.store.timers.remove(due[0])  # as Spark does, behind the processor
        for i, one in self.single.items():
            while due := sorted(t for t in one.store.timers if t <= now):
                one.now = due[0]
                one.store.timers.discard(due[0])
                info = SimpleNamespace(getExpiryTimeInMs=lambda: due[0])
                alone += one.processor.handleExpiredTimer((i,), one.times(), info)
        self.now = now
        assert sorted(map(str, made)) == sorted(map(str, alone))
        return made


def test_a_bucket_answers_each_id_as_a_key_of_its_own():
    rng, b = random.Random(5), Bucket()
    for _ in range(150):
        rows = [b.delivery(f"é{rng.randrange(400)}", rng.choice(["c1", "c1", "c1", "c2"])) for _ in range(rng.randrange(30))]
        for i, one in b.single.items():
            if one.held and one.held.status == "IN_PROGRESS" and rng.random() < 0.3:
                owner = rng.choice([one.held.owner, one.held.owner, "late"])
                rows.append(b.result(i, owner, rng.choice([None, "PERMANENT", "TRANSIENT"])))
        rng.shuffle(rows)
        b.rows(rows)
        b.tick(b.now + rng.choice([0, 50, 300, 3_000, 11_000]))
        assert b.store.timers == {t for one in b.single.values() for t in one.store.timers} == {k[0] for k in b.store.states["due"]}
        assert len(b.store.states["waiting"]) == sum(len(one.store.entries) for one in b.single.values())
    held = Pages(b.processor.size, b.processor.pages)
    assert {i: held.get(i) for i in b.single} == {i: one.held for i, one in b.single.items()} and held.ids == len(b.single) > 300


def test_calls_to_the_state_store_are_those_of_pages_and_not_of_ids():
    b = Bucket()
    assert len(b.rows([b.delivery(f"e{i}") for i in range(3_000)])) == 3_000
    assert b.store.calls < 3_000 / 10
    for n in range(20):
        b.rows([b.delivery(f"f{n}-{i}") for i in range(100)])
    b.now, b.store.calls = 1, 0
    assert len(b.rows([b.delivery("last")])) == 1 and b.store.calls < 9
    assert max(len(json.loads(v[0])) for v in b.store.states["pages"].values()) < 4 * stateful.PAGE


def test_a_batch_query_decides_alike_with_buckets_and_without(spark):
    values = [event(f"e{i % 150}", f"c{i % 7}") for i in range(400)] + ["{not json", event("x", None), event("é\u2028\"\\")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    _ = spark.streams.active
    messages = spark.createDataFrame([(f"k{i}", v, "x", i % 3, i) for i, v in enumerate(values)], stateful.MESSAGE)
    none = spark.createDataFrame([], stateful.RESULT)
    made = [sorted(map(str, stateful.decisions(messages, none, POLICY, n).drop("due").collect())) for n in (0, 1, 50)]
    assert made[0] == made[1] == made[2] and len(made[0]) == 153


SOURCE = "tenant_id string, external_id string, first_name string, last_name string, email string"


def event(i, candidate="c1", tenant="t"):
    return json.dumps({"eventId": i, "tenantId": tenant, "candidateId": candidate, "occurredAt": "2026-01-01T10:00:00Z"})


@pytest.fixture
def stream(spark, tmp_path):
    people = {"c1": "a@x", "c2": "", "c3": "c@x"}
    written, failing, queries = [], {"c3": 2}, []

    def source(keys):
        return spark.createDataFrame([("t", c, "A", "L", e) for c, e in people.items()], SOURCE)

    def write(rows):
        ids = sorted(r.external_id for r in rows.collect())
        down = [i for i in ids if failing.get(i, 0) > 0]
        for i in down:
            failing[i] -= 1
        written.extend(i for i in ids if i not in down)
        return spark.createDataFrame([("t", i, "TRANSIENT") for i in down], "tenant_id string, external_id string, failure string")

    def send(*values):
        spark.createDataFrame([(f"k{i}", v) for i, v in enumerate(values)], "key string, value string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    def decided():
        try:
            return [(r.outcome, r.event_id, r.error, r.attempts) for r in spark.read.schema(stateful.DECISION).parquet(f"{tmp_path}/s/decisions").collect()]
        except Exception:  # noqa: BLE001
            return []

    def start():
        messages = spark.readStream.schema("key string, value string").json(f"{tmp_path}/in")
        queries.append(stateful.start_stateful_inbox(spark, messages, source, write, f"file://{tmp_path}/s", Policy(max_attempts=3, first_ms=50)))
        return queries[-1]

    def until(*wanted):
        end = time.time() + 90
        while time.time() < end:
            if queries[-1].exception():
                raise queries[-1].exception()
            if set(wanted) <= set(decided()):
                return
            time.sleep(0.2)
        raise AssertionError(decided())

    yield SimpleNamespace(people=people, written=written, failing=failing, send=send, decided=decided, start=start, until=until, path=tmp_path)
    for q in queries:
        q.stop()


def test_the_stream_keeps_its_state_over_a_restart(spark, stream):
    stream.send(event("e1"), event("e1"), event("e2", "c2"), event("e3", "c3"), event("e4", "gone"), "{not json", event("e5", None))
    query = stream.start()
    stream.until(
        ("PROCESSED", "e1", None, 1), ("DUPLICATE", "e1", None, 1), ("DLT", "e2", "Candidate email is required", 1), ("PROCESSED", "e3", None, 3), ("DLT", "e4", "SOURCE_NOT_FOUND", 1),
        ("DLT", None, "UNREADABLE_MESSAGE", 0), ("DLT", None, "INCOMPLETE_EVENT", 0),
    )
    assert sorted(stream.written) == ["c1", "c3"]
    query.stop()
    stream.people["c2"] = "b@x"
    stream.send(event("e1"), event("e1", "c3"), event("e2", "c2"))
    stream.start()
    stream.until(("DUPLICATE", "e1", None, 1), ("DLT", "e1", "REUSED_EVENT_ID", 1), ("PROCESSED", "e2", None, 2))
    assert sorted(stream.written) == ["c1", "c2", "c3"]
    assert [d for d in stream.decided() if d[0] == "DUPLICATE"] == [("DUPLICATE", "e1", None, 1)] * 2
    letters = {r.error: r.value for r in spark.read.parquet(f"{stream.path}/s/dead_letters").collect()}
    assert set(letters) == {"Candidate email is required", "SOURCE_NOT_FOUND", "UNREADABLE_MESSAGE", "INCOMPLETE_EVENT", "REUSED_EVENT_ID"} and letters["UNREADABLE_MESSAGE"] == "{not json"
