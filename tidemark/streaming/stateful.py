"""The inbox as keyed state with timers: each event id holds its status, owner and attempts in the state store.

One stream of rows holds deliveries of messages, and results of attempts that come back. It is grouped by buckets of event
ids, as each group and each call to the state store has a cost of its own; within a bucket, pages hold the events, so that a
batch reads and writes the pages of its ids, however many ids there are. The rules answer each id's rows with decisions: ATTEMPT (make the call now, under this owner), PROCESSED, DUPLICATE, DLT, LEASE_LOST. Calls are made outside
of the state, by the batch that gets the attempts, with the bound on calls in flight that the sink has; their results are
rows of the next batch. So a slow call blocks no other key, and a result counts only under the owner that made the attempt:

    delivery -> ATTEMPT -> result: done      -> PROCESSED; deliveries that waited are DUPLICATE
                                   permanent -> DLT; the next delivery that waited is attempted
                                   transient -> wait (200 ms, doubled, 2 s at most) -> ATTEMPT ... -> DLT after max_attempts
                        lease ends without a result -> ATTEMPT under a new owner; the old one's result is LEASE_LOST

The rules are functions of state, row and time alone; an owner is the event's id and the number of the attempt, so a
repeated batch gives the same decisions. Deliveries that wait are numbered entries of the state store and not in memory,
however many an id has. State stays for ever, as a used id must stay known. RocksDB keeps it on disk: use spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.canonical import is_blank
from tidemark.model import MAX_ERROR_CHARS
from tidemark.operators.rules import EMAIL_REQUIRED, event_complete
from tidemark.sources.scratch import materialize
from tidemark.streaming.inbox import parsed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "key string, value string, topic string, partition int, offset long"
RESULT = "event_id string, owner string, failure string, error string"
_ROW = f"event_id string, tenant_id string, candidate_id string, occurred_at timestamp, complete boolean, {MESSAGE}, owner string, failure string, error string"
DECISION = f"event_id string, tenant_id string, candidate_id string, outcome string, owner string, attempts int, due long, error string, {MESSAGE}"
_EVENT = f"tenant_id string, candidate_id string, status string, owner string, attempts int, tries int, due long, last_error string, head long, tail long, {MESSAGE}"
_WAITING = f"tenant_id string, candidate_id string, {MESSAGE}"
_FIELDS = ("key", "value", "topic", "partition", "offset")

#: Keys of the state store. A checkpoint's number stays: another one would look for its ids elsewhere.
BUCKETS = 16_384
#: Ids of a page of a bucket's events once they are dealt anew.
PAGE = 32


@dataclass(frozen=True)
class Policy:
    """Claims of a delivery, the waits between them, and how long an owner may take, in milliseconds."""

    max_attempts: int = 3
    first_ms: int = 200
    factor: float = 2.0
    longest_ms: int = 2000
    lease_ms: int = 300_000

    def wait_ms(self, tries: int) -> int:
        return int(min(self.first_ms * self.factor ** (tries - 1), self.longest_ms))


@dataclass(frozen=True)
class Event:
    """What is known of an event id. due: when the lease or the wait ends; message: of the delivery that is worked on;
    head and tail: the numbers of the deliveries that wait, tail excluded."""

    tenant_id: str
    candidate_id: str
    status: str
    owner: str | None
    attempts: int
    tries: int
    due: int | None
    last_error: str | None
    message: tuple
    head: int = 0
    tail: int = 0

    def decision(self, event_id: str, outcome: str, error: str | None = None, message: tuple | None = None, owner: str | None = None) -> dict:
        said = dict(zip(_FIELDS, self.message if message is None else message))
        held = {"event_id": event_id, "tenant_id": self.tenant_id, "candidate_id": self.candidate_id, "outcome": outcome, "owner": owner or self.owner}
        return held | {"attempts": self.attempts, "due": self.due, "error": error} | said


Answer = tuple[Event, list[dict]]


def claimed(event_id: str, event: Event, tries: int, now: int, policy: Policy) -> Answer:
    """The next attempt, under an owner of its own."""
    number = event.attempts + 1
    event = replace(event, status="IN_PROGRESS", owner=f"{event_id}#{number}", attempts=number, tries=tries, due=now + policy.lease_ms)
    return event, [event.decision(event_id, "ATTEMPT")]


def given_up(event_id: str, event: Event, error: str) -> Answer:
    event = replace(event, status="FAILED", owner=None, due=None, last_error=error[:MAX_ERROR_CHARS])
    return event, [event.decision(event_id, "DLT", error)]


def after_failure(event_id: str, event: Event, error: str, now: int, policy: Policy) -> Answer:
    """A failure that may pass: wait for the next attempt of this delivery, or give up."""
    if event.tries >= policy.max_attempts:
        return given_up(event_id, event, error)
    return replace(event, status="FAILED", owner=None, due=now + policy.wait_ms(event.tries), last_error=error[:MAX_ERROR_CHARS]), []


def on_delivery(event_id: str, event: Event | None, tenant: str, candidate: str, message: tuple, now: int, policy: Policy) -> tuple[Event, list[dict], bool]:
    """The event, the decisions, and whether the delivery waits for the attempt at work."""
    if event is None:
        return *claimed(event_id, Event(tenant, candidate, "FAILED", None, 0, 0, None, None, message), 1, now, policy), False
    if (event.tenant_id, event.candidate_id) != (tenant, candidate):
        refused = event.decision(event_id, "DLT", "REUSED_EVENT_ID", message) | {"tenant_id": tenant, "candidate_id": candidate, "owner": None}
        return event, [refused], False
    if event.status == "COMPLETED":
        return event, [event.decision(event_id, "DUPLICATE", message=message)], False
    if event.due is None:  # it failed for good: a new delivery tries again
        return *claimed(event_id, replace(event, message=message), 1, now, policy), False
    return event, [], True


def on_result(event_id: str, event: Event | None, owner: str, failure: str | None, error: str | None, now: int, policy: Policy) -> Answer | None:
    """None where there is no such event: a result without a claim is of no event."""
    if event is None:
        return None
    if event.status != "IN_PROGRESS" or event.owner != owner:
        return event, [event.decision(event_id, "LEASE_LOST", owner=owner)]
    if failure is None:
        done = replace(event, status="COMPLETED", owner=None, due=None, last_error=None)
        return done, [done.decision(event_id, "PROCESSED", owner=owner)]
    if failure == "PERMANENT":
        return given_up(event_id, event, error or failure)
    return after_failure(event_id, event, error or failure, now, policy)


def on_due(event_id: str, event: Event | None, now: int, policy: Policy) -> Answer | None:
    """What is due: the next attempt after a wait, or, where a lease has ended, that of another owner. None if nothing is."""
    if event is None or event.due is None or now < event.due:
        return None
    if event.status == "IN_PROGRESS" and event.tries >= policy.max_attempts:
        return given_up(event_id, event, "lease lost")
    return claimed(event_id, event, event.tries + 1, now, policy)


class Turn:
    """One event id in one batch: its rows, then the deliveries that wait and are not held up any more.

    waiting: the map state of deliveries that wait; place: what stands before the number in its keys.
    """

    def __init__(self, event_id: str, event: Event | None, waiting, place: tuple, now: int, policy: Policy):
        self.event_id, self.before, self.event, self.waiting, self.place, self.now, self.policy = event_id, event, event, waiting, place, now, policy
        self.first, self.behind = None, 0

    def row(self, r: dict) -> list[dict]:
        if r.get("owner") is not None:
            self.event, out = on_result(self.event_id, self.event, r["owner"], r.get("failure"), r.get("error"), self.now, self.policy) or (self.event, [])
            return out
        message = tuple(map(r.get, _FIELDS))
        if self.event is None:  # of the first batch that has the id, the first place names it
            place = (r.get("partition") or 0, r.get("offset") or 0, r["occurred_at"], r["tenant_id"], r["candidate_id"])
            held = place, r["tenant_id"], r["candidate_id"], message
            if self.first is None:
                self.first = held
                return []
            self.first, held = (self.first, held) if self.first[0] <= place else (held, self.first)
            self._wait(self.behind, *held[1:])
            self.behind += 1
            return []
        self.event, out, waits = on_delivery(self.event_id, self.event, r["tenant_id"], r["candidate_id"], message, self.now, self.policy)
        if waits:
            self._wait(self.event.tail, r["tenant_id"], r["candidate_id"], message)
            self.event = replace(self.event, tail=self.event.tail + 1)
        return out

    def end(self) -> Iterator[dict]:
        if self.first is not None:
            event, out, _ = on_delivery(self.event_id, None, *self.first[1:], self.now, self.policy)
            self.event = replace(event, tail=self.behind) if self.behind else event
            yield from out
        yield from self._settled()

    def due(self, at: int) -> Iterator[dict]:
        """What the timer of that time brings."""
        found = on_due(self.event_id, self.event, max(self.now, at), self.policy)
        if found:
            self.event, out = found
            yield from out
            yield from self._settled()

    def _wait(self, number: int, tenant: str, candidate: str, message: tuple) -> None:
        self.waiting.updateValue((*self.place, number), (tenant, candidate, *message))

    def _settled(self) -> Iterator[dict]:
        """The deliveries that wait meet the event, one by one, until an attempt is at work or none waits."""
        while self.event is not None and self.event.due is None and self.event.head < self.event.tail:
            key = (*self.place, self.event.head)
            tenant, candidate, *message = self.waiting.getValue(key)
            self.waiting.removeKey(key)
            event = replace(self.event, head=self.event.head + 1)
            self.event, out, _ = on_delivery(self.event_id, event, tenant, candidate, tuple(message), self.now, self.policy)
            yield from out


def _held(value) -> Event | None:
    if value is None:
        return None
    *held, head, tail = value[:10]
    return Event(*held, tuple(value[10:]), head, tail)


def _value(e: Event) -> tuple:
    return (e.tenant_id, e.candidate_id, e.status, e.owner, e.attempts, e.tries, e.due, e.last_error, e.head, e.tail, *e.message)


def _letter(r: dict) -> dict:
    """The dead letter of a message without a whole event."""
    tenant, candidate = r.get("tenant_id"), r.get("candidate_id")
    nothing = tenant is None and r.get("occurred_at") is None and candidate is None
    letter = {"event_id": None, "tenant_id": tenant, "candidate_id": candidate, "outcome": "DLT", "owner": None, "attempts": 0, "due": None, "error": "UNREADABLE_MESSAGE" if nothing else "INCOMPLETE_EVENT"}
    return letter | {f: r.get(f) for f in _FIELDS}


class InboxProcessor(StatefulProcessor):
    """The rules on the rows of one event id."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", _EVENT)
        self.waiting = handle.getMapState("waiting", "number long", _WAITING)

    def _load(self) -> Event | None:
        return _held(self.event.get())

    def _store(self, before: Event | None, event: Event | None) -> None:
        if event is None or event == before:
            return
        self.event.update(_value(event))
        if event.due is not None and (before is None or before.due != event.due):
            self.handle.registerTimer(event.due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        turn = Turn(key[0], self._load(), self.waiting, (), timerValues.getCurrentProcessingTimeInMs(), self.policy)
        for r in map(Row.asDict, rows):
            yield from (Row(**d) for d in (turn.row(r) if r["complete"] else [_letter(r)]))
        yield from (Row(**d) for d in turn.end())
        before, event = turn.before, turn.event
        if before is not None and before.due is not None and event.due != before.due:
            self.handle.deleteTimer(before.due)
        self._store(before, event)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        turn = Turn(key[0], self._load(), self.waiting, (), timerValues.getCurrentProcessingTimeInMs(), self.policy)
        yield from (Row(**d) for d in turn.due(expiredTimerInfo.getExpiryTimeInMs()))
        self._store(turn.before, turn.event)

    def close(self) -> None:
        pass


class Pages:
    """A bucket's events as a hash table of pages: a batch reads and writes the pages of its ids, one call each.

    The number of pages grows with that of ids, so that a page holds twice PAGE ids on average at most, however long a stream lives.
    A page is a JSON text, as values are handed to the state store one by one.
    """

    def __init__(self, size, pages):
        self.size, self.pages = size, pages
        self.ids, self.count = size.get() or (0, 1)
        self.known, self.read = self.ids > 0, {}

    def _page(self, number: int) -> dict:
        if number not in self.read:
            text = self.pages.getValue((number,)) if self.known else None
            self.read[number] = json.loads(text[0]) if text else {}
        return self.read[number]

    def _number(self, event_id: str) -> int:
        return zlib.crc32(event_id.encode()) % self.count

    def get(self, event_id: str) -> Event | None:
        return _held(self._page(self._number(event_id)).get(event_id))

    def put(self, events: dict[str, Event]) -> None:
        before, changed = self.ids, set()
        for event_id, event in events.items():
            number = self._number(event_id)
            page = self._page(number)
            self.ids += event_id not in page
            page[event_id] = _value(event)
            changed.add(number)
        if self.ids > 2 * PAGE * self.count:
            changed |= self._grown()
        for number in sorted(changed):
            if self.read[number]:
                self.pages.updateValue((number,), (json.dumps(self.read[number], ensure_ascii=False),))
            elif self.known:
                self.pages.removeKey((number,))
        if self.ids != before:
            self.size.update((self.ids, self.count))

    def _grown(self) -> set[int]:
        """Deals all ids to more pages; returns those to be written."""
        held = [self._page(n) for n in range(self.count)]
        while self.ids > PAGE * self.count:
            self.count *= 2
        self.read = {n: {} for n in range(self.count)}
        for page in held:
            for event_id, value in page.items():
                self.read[self._number(event_id)][event_id] = value
        return set(self.read)


class BucketProcessor(StatefulProcessor):
    """The rules on the rows of a bucket of event ids. Each row is a JSON text: Spark hands rows over value by value.

    A timer is that of all the bucket's ids that are due at its time; due holds them.
    """

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.size = handle.getValueState("size", "ids long, pages int")
        self.pages = handle.getMapState("pages", "page int", "events string")
        self.waiting = handle.getMapState("waiting", "event_id string, number long", _WAITING)
        self.due = handle.getMapState("due", "at long", "event_ids array<string>")

    def _turn(self, event_id: str, pages: Pages, now: int) -> Turn:
        return Turn(event_id, pages.get(event_id), self.waiting, (event_id,), now, self.policy)

    def _store(self, turns: Iterable[Turn], pages: Pages, fired: int | None = None) -> None:
        """fired: the time of the timer that is at work; Spark deletes it."""
        changed, begun, ended = {}, defaultdict(list), defaultdict(set)
        for t in turns:
            if t.event is None or t.event == t.before:
                continue
            changed[t.event_id] = t.event
            was = t.before.due if t.before else None
            if was != t.event.due:
                if was is not None:
                    ended[was].add(t.event_id)
                if t.event.due is not None:
                    begun[t.event.due].append(t.event_id)
        for at in sorted(begun.keys() | ended.keys()):
            (held,) = (self.due.getValue((at,)) if pages.known else None) or ([],)
            ids = [i for i in held if i not in ended[at]] + begun[at]
            if ids:
                self.due.updateValue((at,), (ids,))
                if not held:
                    self.handle.registerTimer(at)
            elif held:
                self.due.removeKey((at,))
                if at != fired:
                    self.handle.deleteTimer(at)
        pages.put(changed)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, pages, turns = timerValues.getCurrentProcessingTimeInMs(), Pages(self.size, self.pages), {}
        for packed in rows:
            r = json.loads(packed.row)
            if not r["complete"]:
                yield Row(**_letter(r))
                continue
            event_id = r["event_id"]
            turn = turns.get(event_id)
            if turn is None:
                turn = turns[event_id] = self._turn(event_id, pages, now)
            yield from (Row(**d) for d in turn.row(r))
        for turn in turns.values():
            yield from (Row(**d) for d in turn.end())
        self._store(turns.values(), pages)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, at, pages = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs(), Pages(self.size, self.pages)
        (ids,) = self.due.getValue((at,)) or ([],)
        turns = [self._turn(i, pages, now) for i in ids]
        for turn in turns:
            yield from (Row(**d) for d in turn.due(at))
        self._store(turns, pages, at)

    def close(self) -> None:
        pass


def decisions(messages: DataFrame, results: DataFrame, policy: Policy, buckets: int = BUCKETS) -> DataFrame:
    """The stream of decisions on messages and on the results of attempts; columns: see DECISION.

    Messages without a whole event have no id to be grouped by: each gets one of its own and leaves no state.
    buckets: 0 makes each id a key of the state store, as in checkpoints from before there were buckets.
    """
    events = parsed(messages)
    complete = F.coalesce(event_complete(F.col("event_id"), F.col("tenant_id"), F.col("candidate_id"), F.col("occurred_at")), F.lit(False))
    place = F.concat_ws(":", F.lit("!"), "partition", "offset", F.xxhash64("value").cast("string"))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    deliveries = events.withColumn("complete", complete).withColumn("event_id", F.when(F.col("complete"), F.col("event_id")).otherwise(place))
    deliveries = deliveries.select("event_id", "tenant_id", "candidate_id", "occurred_at", "complete", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset", *none("owner", "failure", "error"))
    back = results.select(
        "event_id", *none("tenant_id", "candidate_id"), F.lit(None).cast("timestamp").alias("occurred_at"), F.lit(True).alias("complete"), *none("key", "value", "topic"),
        F.lit(None).cast("int").alias("partition"), F.lit(None).cast("long").alias("offset"), "owner", "failure", "error",
    )
    rows = deliveries.unionByName(back)
    if not buckets:
        return rows.groupBy("event_id").transformWithState(InboxProcessor(policy), DECISION, "append", "processingTime")
    bucket = F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int").alias("bucket")
    packed = F.to_json(F.struct(*rows.columns)).alias("row")
    return rows.withColumn("occurred_at", F.unix_micros("occurred_at")).select(bucket, packed).groupBy("bucket").transformWithState(BucketProcessor(policy), DECISION, "append", "processingTime")


def attempted(attempts: DataFrame, read_source: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """event_id, owner, failure and error of each attempt: the record is read, judged and written as it is now.

    read_source: from the keys (tenant_id, external_id) of a batch to their records; see inbox.judge_batch for the further
    columns that it may give. write: see inbox.write_with_retries; a record is written once for all its events.
    """
    keys = attempts.select("tenant_id", F.col("candidate_id").alias("external_id")).distinct()
    source = read_source(keys)
    asked = [F.col(a if a in source.columns else c) for a, c in (("asked_tenant", "tenant_id"), ("asked_id", "external_id"))]
    unread = F.col("failure") if "failure" in source.columns else F.lit(None).cast("string")
    other = ~(F.col("tenant_id").eqNullSafe(asked[0]) & F.col("external_id").eqNullSafe(asked[1]))
    fault = F.when(unread.isNotNull(), F.concat(F.lit("source read failed ("), unread, F.lit(")"))).when(other, "SOURCE_IDENTITY").when(is_blank(F.col("email")), EMAIL_REQUIRED)
    read = source.select(asked[0].alias("_t"), asked[1].alias("_c"), "first_name", "last_name", "email", fault.alias("_fault"), F.when(fault.isNotNull(), F.coalesce(unread, F.lit("PERMANENT"))).alias("_why"))
    rows = keys.join(read, (keys["tenant_id"] == read["_t"]) & (keys["external_id"] == read["_c"]), "left")
    rows = rows.withColumn("_why", F.when(F.col("_t").isNull(), "PERMANENT").otherwise(F.col("_why"))).withColumn("_fault", F.when(F.col("_t").isNull(), "SOURCE_NOT_FOUND").otherwise(F.col("_fault")))
    rows = materialize(rows.drop("_t", "_c"))
    failed = materialize(write(rows.where("_why is null").select("tenant_id", "external_id", "first_name", "last_name", "email")).select("tenant_id", "external_id", F.col("failure").alias("_write")))
    said = F.coalesce("_fault", F.when(F.col("_write").isNotNull(), F.concat(F.lit("target write failed ("), "_write", F.lit(")"))))
    judged = rows.join(failed, ["tenant_id", "external_id"], "left").select("tenant_id", F.col("external_id").alias("candidate_id"), F.coalesce("_why", "_write").alias("failure"), said.alias("error"))
    return attempts.select("event_id", "owner", "tenant_id", "candidate_id").join(judged, ["tenant_id", "candidate_id"]).select("event_id", "owner", "failure", "error")


def start_stateful_inbox(
    spark: SparkSession,
    messages: DataFrame,
    read_source: Callable[[DataFrame], DataFrame],
    write: Callable[[DataFrame], DataFrame],
    base: str,
    policy: Policy | None = None,
    interval: str = "200 milliseconds",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """A query that goes on until it is stopped. Below base: log (the checkpoint), results, decisions and dead_letters.

    buckets: see decisions.

    A batch's folders are written over when it is repeated; results that have been read are deleted by the source.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = base.rstrip("/")
    spark.createDataFrame([], RESULT).write.mode("append").parquet(f"{base}/results/batch=none")
    results = spark.readStream.schema(RESULT).option("cleanSource", "delete").option("recursiveFileLookup", "true").parquet(f"{base}/results")

    def batch(df: DataFrame, number: int) -> None:
        made = materialize(df)
        if made.isEmpty():
            return
        made.write.mode("overwrite").parquet(f"{base}/decisions/batch={number}")
        letters = made.where("outcome = 'DLT'")
        if not letters.isEmpty():
            letters.select("key", "value", "topic", "partition", "offset", "error").write.mode("overwrite").parquet(f"{base}/dead_letters/batch={number}")
        attempts = made.where("outcome = 'ATTEMPT'")
        if not attempts.isEmpty():
            attempted(attempts, read_source, write).write.mode("overwrite").parquet(f"{base}/results/batch={number}")

    stream = decisions(messages, results, policy or Policy(), buckets).writeStream.foreachBatch(batch)
    return stream.outputMode("append").option("checkpointLocation", f"{base}/log").trigger(processingTime=interval).start()
