"""Scalar functions of the record model: white space, Unicode form, canonical text and fingerprint.

Blank and stripped follow the JVM's Character.isWhitespace (U+001C to U+001F are white space, U+00A0 isn't), anchored so
that a line terminator before the end changes nothing.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import COMPARED_FIELDS, MAX_ERROR_CHARS

_WS = r"\p{javaWhitespace}"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(c: Column) -> Column:
    """Unicode NFC; the one function here without a built-in counterpart."""
    return _nfc(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{_WS}+|{_WS}+\z", "")


def is_blank(c: Column) -> Column:
    """True for null, too."""
    return c.isNull() | c.rlike(rf"\A{_WS}*\z")


def normalized(c: Column) -> Column:
    """NFC, then stripped; blank becomes null."""
    v = strip(nfc(c))
    return F.when(v != "", v)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def fragment(value: Column) -> Column:
    """A normalised field as '-' or '+length:value'."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), utf16_length(value).cast("string"), F.lit(":"), value))


def canonical(*values: Column) -> Column:
    return F.concat(F.lit("v1;"), *[x for v in values for x in (fragment(v), F.lit(";"))])


def fingerprint(*values: Column) -> Column:
    """SHA-256, in lower-case hex, of the canonical text of normalised fields."""
    return F.sha2(F.encode(canonical(*values), "UTF-8"), 256)


def with_fingerprint(df, fields: tuple[str, ...] = COMPARED_FIELDS, name: str = "fingerprint"):
    """df with the fingerprint of its fields; each field is normalised once, before the text is built."""
    norm = {f"_n_{f}": normalized(F.col(f)) for f in fields}
    return df.withColumns(norm).withColumn(name, fingerprint(*[F.col(k) for k in norm])).drop(*norm)


def truncate_error(c: Column, most: int = MAX_ERROR_CHARS) -> Column:
    """The first UTF-16 units of a text; a pair of two units at the end is left out rather than split."""
    units = F.encode(c, "UTF-16BE")
    last = F.hex(F.substring(units, 2 * most - 1, 1))
    whole = F.when(last.between("D8", "DB"), 2 * most - 2).otherwise(2 * most)
    return F.when(utf16_length(c) <= most, c).otherwise(F.decode(F.substr(units, F.lit(1), whole), "UTF-16BE"))


def partition_key(tenant: Column, candidate: Column) -> Column:
    return F.concat(tenant, F.lit(":"), candidate)


def padded_id(number: Column, width: int = 5) -> Column:
    return F.concat(F.lit("candidate-"), F.lpad(number.cast("string"), width, "0"))


def backoff_ms(attempt: Column, initial: int = 200, multiplier: float = 2.0, longest: int = 2000) -> Column:
    """The wait behind the given attempt, counted from 1."""
    return F.least(F.lit(float(initial)) * F.pow(F.lit(multiplier), attempt - 1), F.lit(float(longest))).cast("long")
