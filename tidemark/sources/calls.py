"""Single HTTP calls as tasks make them: transient failures tried again, behind one breaker for each system and process.

A call is one outcome for its breaker, however many attempts it took. Errors name the operation and the class, never a body.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TypeVar
from urllib.parse import quote, urlsplit

from tidemark.model import TRANSIENT_STATUSES
from tidemark.operators.resilience import Breaker

T, R = TypeVar("T"), TypeVar("R")


class CallError(RuntimeError):
    """type: TRANSIENT or PERMANENT; kind: see operators.resilience.failure_kind."""

    def __init__(self, operation: str, type_: str, kind: str, detail: str):
        super().__init__(operation, type_, kind, detail)  # all arguments, so that it can be pickled
        self.type, self.kind, self.message = type_, kind, f"{operation} failed ({type_}, {detail})"

    def __str__(self) -> str:
        return self.message


def invalid(operation: str, detail: str = "invalid response") -> CallError:
    return CallError(operation, "PERMANENT", "INVALID_RESPONSE", detail)


class SharedBreaker(Breaker):
    """A breaker that several threads ask."""

    def __init__(self, **settings: float):
        super().__init__(**settings)
        self._lock = threading.Lock()

    def admit(self, at_s: float) -> bool:
        with self._lock:
            return super().admit(at_s)

    def record(self, at_s: float, failed: bool) -> None:
        with self._lock:
            super().record(at_s, failed)


_breakers: dict[str, SharedBreaker] = {}
_guard = threading.Lock()


def breaker_of(url: str) -> SharedBreaker:
    """The breaker of the system that a url belongs to, in this process."""
    parts = urlsplit(url)
    with _guard:
        return _breakers.setdefault(f"{parts.scheme}://{parts.netloc}", SharedBreaker())


def _once(operation: str, request: urllib.request.Request, timeout_s: float) -> bytes:
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        raise CallError(operation, "TRANSIENT" if e.code in TRANSIENT_STATUSES else "PERMANENT", "HTTP_RESPONSE", f"HTTP {e.code}") from None
    except OSError as e:
        if isinstance(getattr(e, "reason", e), TimeoutError):
            raise CallError(operation, "TRANSIENT", "TIMEOUT", "timeout") from None
        raise CallError(operation, "TRANSIENT", "TRANSPORT_ERROR", "transport error") from None


def _tried(attempt: Callable[[], R], attempts: int, initial_s: float) -> R:
    """Only transient failures are tried again, with doubled waits of at most 2 s."""
    for number in range(1, attempts):
        try:
            return attempt()
        except CallError as error:
            if error.type == "PERMANENT":
                raise
        time.sleep(min(initial_s * 2 ** (number - 1), 2.0))
    return attempt()


def _guarded(operation: str, breaker: Breaker, whole: Callable[[], R], clock: Callable[[], float]) -> R:
    """A call with all its attempts as one outcome; one that the breaker refuses is not made and not tried again."""
    if not breaker.admit(clock()):
        raise CallError(operation, "TRANSIENT", "CIRCUIT_OPEN", "circuit breaker open")
    failed = False
    try:
        return whole()
    except CallError as error:
        failed = error.type == "TRANSIENT"
        raise
    finally:
        breaker.record(clock(), failed)


def call(
    operation: str,
    url: str,
    breaker: Breaker | None = None,
    method: str = "GET",
    body: dict | None = None,
    attempts: int = 3,
    initial_s: float = 0.2,
    timeout_s: float = 3.0,
    clock: Callable[[], float] = time.monotonic,
) -> bytes:
    """The answer's bytes. breaker: that of the url's system, if none is given."""
    if attempts < 1:
        raise ValueError("attempts must be 1 or more")
    data, headers = (None, {}) if body is None else (json.dumps(body).encode(), {"Content-Type": "application/json"})
    request = urllib.request.Request(url, data, headers, method=method)
    return _guarded(operation, breaker or breaker_of(url), lambda: _tried(lambda: _once(operation, request, timeout_s), attempts, initial_s), clock)


def fetch(operation: str, url: str, breaker: Breaker | None = None, **settings) -> dict:
    """The decoded answer; an empty or unreadable body is a permanent failure."""
    try:
        body = json.loads(call(operation, url, breaker, **settings))
    except ValueError:
        raise invalid(operation) from None
    if not isinstance(body, dict):  # null counts as an empty body
        raise invalid(operation)
    return body


def fetch_page(url: str, breaker: Breaker | None = None, **settings) -> dict:
    return fetch("page read", url, breaker, **settings)


def fetch_record(url: str, breaker: Breaker | None = None, **settings) -> dict:
    """One record by its address; an empty body is an error, as is a missing record."""
    return fetch("record read", url, breaker, **settings)


def address(template: str, **parts: object) -> str:
    """A url with its parts quoted."""
    return template.format(**{k: quote(str(v), safe="") for k, v in parts.items()})


def in_flight(work: Callable[[T], R], items: Iterable[T], width: int) -> Iterator[R]:
    """work of each item in order, with at most width at a time; the first error ends it."""
    with ThreadPoolExecutor(width) as pool:
        held: deque[Future[R]] = deque()
        try:
            for item in items:
                if len(held) == width:
                    yield held.popleft().result()
                held.append(pool.submit(work, item))
            while held:
                yield held.popleft().result()
        finally:
            for left in held:
                left.cancel()
