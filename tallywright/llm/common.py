"""Helpers that the operators share: column picking, scratch tables, text cleaning."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import counted_broadcast, materialize, new_path, scratch_scope  # noqa: F401

#: A table may be broadcast when it was counted and has at most this many rows of fixed width.
BROADCAST_ROWS = 1_000_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name under new names, whatever else the table holds.

    Extra columns are dropped, so they cannot clash with an operator's own columns;
    of equal names, or names that differ in case only, the exact first one counts.
    """
    inner = [f"_{i}" for i in range(len(df.columns))]
    at = {out: inner[df.columns.index(name)] for out, name in columns.items()}
    return df.toDF(*inner).select(*[F.col(name).alias(out) for out, name in at.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use` as a bound variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Hint a broadcast when the (materialized) table has at most `limit` rows."""
    return counted_broadcast(df, limit)
