"""Failures of remote calls: classes, safe messages, retries, breaker."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canonical import backoff_ms
from tidemark.model import TRANSIENT_STATUSES
from tidemark.operators.paging import WINDOW_ROWS, with_row_numbers


def is_failure(status: Column) -> Column:
    """No status is a failure of the transport."""
    return status.isNull() | (status >= 400)


def failure_type(status: Column) -> Column:
    """TRANSIENT for the listed statuses and for transport failures, PERMANENT for others (500 among them), null for success."""
    return F.when(status.isNull() | status.isin(*TRANSIENT_STATUSES), "TRANSIENT").when(status >= 400, "PERMANENT")


def failure_kind(status: Column, timed_out: Column, unreadable: Column, circuit_open: Column) -> Column:
    return (
        F.when(circuit_open, "CIRCUIT_OPEN")
        .when(unreadable, "INVALID_RESPONSE")
        .when(status.isNotNull() & (status >= 400), "HTTP_RESPONSE")
        .when(timed_out, "TIMEOUT")
        .when(status.isNull(), "TRANSPORT_ERROR")
    )


def failure_detail(kind: Column, status: Column) -> Column:
    """What a stored message says of a failure."""
    http = F.concat(F.lit("HTTP "), status.cast("string"))
    # The details of the failure kinds.
    return (
        F.when(kind == "HTTP_RESPONSE", http)
        .when(kind == "TIMEOUT", "timeout")
        .when(kind == "TRANSPORT_ERROR", "transport error")
        .when(kind == "INVALID_RESPONSE", F.when(status.isNull(), "invalid response").otherwise(F.concat(F.lit("invalid response, "), http)))
        .when(kind == "CIRCUIT_OPEN", "circuit breaker open")
    )


def safe_message(operation: Column, kind: Column, detail: Column) -> Column:
    """Names the operation, the class and a detail of ours; never a body or a foreign message."""
    return F.concat(operation, F.lit(" failed ("), kind, F.lit(", "), detail, F.lit(")"))


def call_failures(calls: DataFrame) -> DataFrame:
    """call_seq, failure_type, kind and message of the failed calls of a log."""
    no = F.lit(False)
    failed = calls.where(is_failure(F.col("http_status")))
    kind = failure_kind(F.col("http_status"), no, no, no)
    detail = failure_detail(kind, F.col("http_status"))
    typed = failure_type(F.col("http_status"))
    return failed.select("call_seq", typed.alias("failure_type"), kind.alias("failure_kind"), safe_message(F.concat("system_name", F.lit(" call")), typed, detail).alias("message"))


def retry_schedule(calls: DataFrame, attempts: int = 3) -> DataFrame:
    """A row for each attempt of a call, if every attempt ended as the first: only transient failures are tried again."""
    again = failure_type(F.col("http_status")) == "TRANSIENT"
    numbers = F.when(F.coalesce(again, F.lit(False)), F.sequence(F.lit(1), F.lit(attempts))).otherwise(F.array(F.lit(1)))
    rows = calls.select("call_seq", F.explode(numbers).alias("attempt"))
    return rows.withColumn("wait_ms", F.when(F.col("attempt") == 1, F.lit(0)).otherwise(backoff_ms(F.col("attempt") - 1)).cast("long"))


def window_rate(calls: DataFrame, size: int = 10, least: int = 5, block: int = WINDOW_ROWS) -> DataFrame:
    """Percent of transient failures among the last calls of each system; null until there are enough.

    A system's calls are cut into blocks, each with the size - 1 calls before it, so that no task holds all calls of a system.
    """
    bad = F.coalesce(failure_type(F.col("http_status")) == "TRANSIENT", F.lit(False)).cast("int")
    rows = with_row_numbers(calls.select("call_seq", "system_name", bad.alias("bad")), "system_name", "call_seq", block)
    own = F.floor(F.col("row_no") / block)
    ahead = F.when(F.col("row_no") % block > block - size, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("own", own).withColumn("block", F.explode(ahead))
    w = Window.partitionBy("system_name", "block").orderBy("row_no").rowsBetween(-(size - 1), 0)
    failed = F.sum("bad").over(w)
    rated = rows.withColumn("failed", failed.cast("long")).withColumn("calls", F.least(F.col("row_no") + 1, F.lit(size)).cast("long")).where("block = own")
    return rated.select("call_seq", "system_name", "calls", "failed", F.when(F.col("calls") >= least, F.floor(F.col("failed") * 100 / F.col("calls"))).cast("long").alias("percent"))


def injected(calls: DataFrame, mode: str, count: int) -> DataFrame:
    """The first calls of each system in a failure mode; modes AFTER_SAVE fail although the write took place.

    Only the first calls are ranked (a group limit ahead of the shuffle); the others are compared with the last of them.
    """
    ranked = calls.select("system_name", "call_seq").withColumn("n", F.row_number().over(Window.partitionBy("system_name").orderBy("call_seq")))
    last = ranked.where(F.col("n") <= count).groupBy("system_name").agg(F.max("call_seq").alias("last"))
    hit = F.coalesce(F.col("call_seq") <= F.col("last"), F.lit(False))
    failed, saved = F.lit("UNAVAILABLE" in mode), F.lit(mode.endswith("AFTER_SAVE") or mode == "DELAY")
    return calls.join(last, "system_name", "left").select("call_seq", "system_name", F.when(hit, mode).otherwise("NONE").alias("mode"), F.when(hit, failed).otherwise(F.lit(False)).alias("call_failed"), F.when(hit, saved).otherwise(F.lit(True)).alias("saved"))


class Breaker:
    """One system's circuit breaker over its calls in order. Only transient failures count as failures."""

    def __init__(self, window: int = 10, least: int = 5, percent: float = 50, wait_s: float = 30, trials: int = 2):
        self.least, self.percent, self.wait_s, self.trials = least, percent, wait_s, trials
        self.state, self.opened_at = "CLOSED", 0.0
        self.last: deque[bool] = deque(maxlen=window)
        self.trial: list[bool] = []
        self.slots = 0

    def admit(self, at_s: float) -> bool:
        """Whether a call may be made now; an open breaker that has waited lets through as many as it has trials."""
        if self.state == "OPEN" and at_s - self.opened_at >= self.wait_s:
            self.state, self.trial, self.slots = "HALF_OPEN", [], self.trials
        if self.state == "HALF_OPEN":
            self.slots -= 1
            return self.slots >= 0
        return self.state != "OPEN"

    def record(self, at_s: float, failed: bool) -> None:
        """The outcome of a call that was let through; one that ends after others have opened the breaker changes nothing."""
        if self.state == "OPEN":
            return
        outcomes = self.trial if self.state == "HALF_OPEN" else self.last
        outcomes.append(failed)
        enough = self.trials if self.state == "HALF_OPEN" else self.least
        if len(outcomes) >= enough:
            if 100 * sum(outcomes) / len(outcomes) >= self.percent:
                self.state, self.opened_at = "OPEN", at_s
                self.last.clear()
            elif self.state == "HALF_OPEN":
                self.state = "CLOSED"
                self.last.clear()

    def call(self, at_s: float, failed: bool) -> tuple[str, bool]:
        """The state in which a call is made, and whether it is let through."""
        admitted, state = self.admit(at_s), self.state
        if admitted:
            self.record(at_s, failed)
        return state, admitted


def breaker_states(calls: DataFrame, **settings: float) -> DataFrame:
    """State and admission of every call: one machine for each system, over its calls in order.

    The calls of a system stream through a task in sorted order; only the machine is held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines: dict[str, Breaker] = {}
        for pdf in batches:
            said = [machines.setdefault(s, Breaker(**settings)).call(t, f) for s, t, f in zip(pdf["system_name"], pdf["at_s"], pdf["failed"])]
            yield pd.DataFrame({"system_name": pdf["system_name"], "call_seq": pdf["call_seq"], "state": [x for x, _ in said], "permitted": [p for _, p in said]})

    bad = F.coalesce(failure_type(F.col("http_status")) == "TRANSIENT", F.lit(False))
    at = F.unix_micros(F.col("called_at").cast("timestamp")) / 1e6
    rows = calls.select("system_name", "call_seq", at.alias("at_s"), bad.alias("failed"))
    return rows.repartition("system_name").sortWithinPartitions("system_name", "call_seq").mapInPandas(run, "system_name string, call_seq long, state string, permitted boolean")
