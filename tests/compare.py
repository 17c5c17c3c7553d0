"""Comparison of a DataFrame with a DuckDB query."""

from __future__ import annotations

import os
from collections import Counter

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Values as both engines' results can be compared."""
    import datetime
    import math

    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def assert_same(df, con, sql: str) -> None:
    """Equal columns and equal rows, in any order."""
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    spark_rows, sql_rows = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    assert spark_rows == sql_rows, (list((spark_rows - sql_rows).items())[:3], list((sql_rows - spark_rows).items())[:3])
