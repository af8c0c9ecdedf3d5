"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def bag(rows, columns):
    return Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not (n[0] == "p" and n[1].isdigit()) or n[1] in "247"))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    want = sql.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert bag(df.collect(), df.columns) == bag(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
