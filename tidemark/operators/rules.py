"""Mapping, validation and rejects of single records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canonical import is_blank
from tidemark.model import MAX_ID_CHARS, MAX_PAGE_SIZE

EMAIL_REQUIRED = "Candidate email is required"


def to_canonical(source: DataFrame) -> DataFrame:
    return source.select(F.col("external_id").alias("id"), "tenant_id", "first_name", "last_name", "email")


def to_request(candidate: DataFrame) -> DataFrame:
    """The target's request; the tenant travels beside it, in the address."""
    return candidate.select("tenant_id", F.col("id").alias("external_id"), "first_name", "last_name", "email")


def owned_fields(payload: Column) -> Column:
    """The target's fields of a JSON text; properties that aren't ours are ignored, absent ones null."""
    return F.from_json(payload, "externalId string, firstName string, lastName string, email string")


def job_response(jobs: DataFrame) -> DataFrame:
    """What a client sees of a job: never the owner of its lease."""
    return jobs.drop("lease_owner")


def run_response(runs: DataFrame) -> DataFrame:
    """What a client sees of a run: neither owner nor page size nor where its items are."""
    return runs.drop("lease_owner", "page_size", "items")


def email_error(email: Column) -> Column:
    return F.when(is_blank(email), F.lit(EMAIL_REQUIRED))


def id_error(external_id: Column) -> Column:
    return F.when(is_blank(external_id), F.lit("external id is blank")).when(F.length(external_id) > MAX_ID_CHARS, F.lit("external id is too long"))


def path_error(path_id: Column, body_id: Column) -> Column:
    """Why a target would refuse a write at a path."""
    return F.when(is_blank(body_id), F.lit("external id is blank")).when(path_id != body_id, F.lit("path and body differ"))


def event_complete(event_id: Column, tenant: Column, candidate: Column, occurred_at: Column) -> Column:
    return event_id.isNotNull() & occurred_at.isNotNull() & ~is_blank(tenant) & ~is_blank(candidate)


def same_identity(tenant: Column, candidate: Column, other_tenant: Column, other_candidate: Column) -> Column:
    return tenant.eqNullSafe(other_tenant) & candidate.eqNullSafe(other_candidate)


def is_stale(updated_at: Column, as_of: Column, timeout: Column) -> Column:
    """Strictly older than the timeout."""
    return updated_at < as_of - timeout


def check_page(page: int, size: int) -> None:
    if page < 0 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be 0 or more and size 1 to {MAX_PAGE_SIZE}")
