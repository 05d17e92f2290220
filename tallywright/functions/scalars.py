"""Scalar formatting and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_inr(amount: Column) -> Column:
    """A whole amount with the rupee sign and Indian grouping: 12,34,567."""
    digits = F.abs(amount).cast("bigint").cast("string")
    grouped = F.regexp_replace(digits, r"(\d)(?=(\d\d)+\d$)", "$1,")
    return F.concat(F.lit("₹"), F.when(amount < 0, "-").otherwise(""), grouped)


def format_inr_crore(amount: Column) -> Column:
    """A whole, non-negative amount in crore, one decimal, halves up."""
    tenths = F.floor((2 * amount + 1_000_000) / 2_000_000).cast("bigint")
    return F.concat(F.lit("₹"), F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(" Cr"))


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    """Prefix and number, zero-padded to `width` but never cut."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def parse_ts(text: Column) -> Column:
    """ISO text with an offset as an instant; null if it is none."""
    return F.try_to_timestamp(text)


def utc_iso(ts: Column) -> Column:
    """An instant as UTC ISO text with milliseconds; the session's zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def trim_all(text: Column) -> Column:
    """Without white space at either end, line breaks and tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ilike(column: Column, pattern: str) -> Column:
    return column.ilike(pattern)
