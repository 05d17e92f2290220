"""Runs a query and its DuckDB twin on the same tables and compares rows as multisets."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """(columns match, difference) where the difference shows rows of one side only."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want_rel = con.sql(sql)
    want = rows_of(want_rel.columns, want_rel.fetchall())
    types = {c: str(t) for c, t in zip(want_rel.columns, want_rel.types)}
    return sorted(df.columns) == sorted(want_rel.columns), got - want, want - got, dict(df.dtypes), types
