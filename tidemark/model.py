"""Schemas and value sets of the record model. Types are declared here and never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SOURCE_CANDIDATE = _strings("id", "tenant_id", "first_name", "last_name", "email")
TARGET_REQUEST = _strings("external_id", "first_name", "last_name", "email")
STORED_CANDIDATE = _strings("id", "tenant_id", "external_id", "first_name", "last_name", "email").add("created_at", T.TimestampType()).add("updated_at", T.TimestampType())
CHANGE_EVENT = _strings("event_id", "tenant_id", "candidate_id").add("occurred_at", T.TimestampType())
RECORD_STATE = _strings("tenant_id", "source_record_id", "status").add("updated_at", T.TimestampType()).add("lease_owner", T.StringType())
INBOX_STATE = (
    _strings("event_id", "tenant_id", "candidate_id", "status")
    .add("attempts", T.IntegerType())
    .add("occurred_at", T.TimestampType())
    .add("last_error", T.StringType())
    .add("updated_at", T.TimestampType())
)
_COUNTS = ("processed", "succeeded", "skipped", "failed")
_RUN_COUNTS = ("source_count", "target_count", "matched_count", "missing_count", "unexpected_count", "mismatched_count")


def _longs(to: T.StructType, *names: str) -> T.StructType:
    for n in names:
        to = to.add(n, T.LongType())
    return to


JOB = _longs(_strings("job_id", "tenant_id", "status").add("page_size", T.IntegerType()).add("next_page", T.IntegerType()), *_COUNTS)
JOB = JOB.add("lease_owner", T.StringType()).add("last_error", T.StringType()).add("created_at", T.TimestampType()).add("updated_at", T.TimestampType())
RUN = _longs(_strings("run_id", "tenant_id", "status").add("page_size", T.IntegerType()), *_RUN_COUNTS)
RUN = RUN.add("lease_owner", T.StringType()).add("last_error", T.StringType()).add("created_at", T.TimestampType()).add("updated_at", T.TimestampType()).add("completed_at", T.TimestampType())
RUN = RUN.add("items", T.StringType())  # where a completed run's items are
PAGE_PROGRESS = T.StructType([T.StructField(n, T.LongType()) for n in _COUNTS])

COMPARED_FIELDS = ("external_id", "first_name", "last_name", "email")
RECORD_STATUSES = ("IN_PROGRESS", "COMPLETED", "FAILED")
JOB_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "COMPLETED_WITH_ERRORS", "FAILED")
UNFINISHED_JOB = ("PENDING", "RUNNING", "FAILED")
RUN_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED")
UNFINISHED_RUN = ("PENDING", "RUNNING")
RESULTS = ("MATCHED", "MISSING_IN_TARGET", "UNEXPECTED_IN_TARGET", "MISMATCHED")
DIFFERENCES = RESULTS[1:]
MAX_ID_CHARS = 100
MAX_ERROR_CHARS = 1000
MAX_PAGE_SIZE = 1000
TRANSIENT_STATUSES = (408, 429, 502, 503, 504)
