"""Row comparison of a Spark query with its DuckDB SQL, order left out."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return tuple(map(cell, x)) if isinstance(x, list | tuple) else x


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def difference(spark_df, con, sql: str) -> tuple[int, list, list]:
    """(rows of the query, rows only Spark has, rows only DuckDB has)."""
    rel = con.sql(sql)
    assert sorted(spark_df.columns) == sorted(rel.columns), (spark_df.columns, rel.columns)
    mine, theirs = rows(spark_df.columns, map(tuple, spark_df.collect())), rows(rel.columns, rel.fetchall())
    return mine.total(), list((mine - theirs).elements())[:3], list((theirs - mine).elements())[:3]
