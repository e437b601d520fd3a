"""Helpers that several operators share: tables, shared storage, words as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize, shared_dir, store  # noqa: F401

#: The white space of every contract here, as the body of a regex class and as characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas (the optimizer would inline it there)."""
    return F.get(F.transform(F.array(value), body), 0)


def alnum_words(c: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_hashes(text: Column) -> Column:
    return F.transform(alnum_words(text), lambda w: F.xxhash64(w))
