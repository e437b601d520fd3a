"""Leases that are renewed while Spark jobs run under them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class RenewedLease:
    """With the block: beat() every so many seconds, in a thread beside it. Once beat() is false the lease is lost, and
    the Spark jobs that the block's thread has started, or starts, are cancelled until it ends.

    A beat that fails is tried again at the next turn: whether the lease has run out meanwhile is for its table to say.
    """

    def __init__(self, spark: SparkSession, beat: Callable[[], bool], every_s: float):
        self.context, self.beat, self.every_s = spark.sparkContext, beat, every_s
        self.group, self.lost, self._over = uuid.uuid4().hex, False, threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._over.wait(min(0.5, self.every_s) if self.lost else self.every_s):
            if not self.lost:
                try:
                    self.lost = not self.beat()
                except Exception:  # noqa: BLE001
                    continue
            if self.lost:
                self.context.cancelJobGroup(self.group)

    def __enter__(self) -> RenewedLease:
        self.context.setJobGroup(self.group, "work under a lease", interruptOnCancel=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            self.context.setLocalProperty(name, None)
