"""Every catalogue query against its SQL in DuckDB, or for rows where SQL can't say it."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from hireloom.plans import registry
from tests.conftest import DATA

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime | datetime.date):
        return str(x)[:19].replace(" 00:00:00", "")
    return x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    if name not in SQL:
        assert rows
        return
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted(repr(tuple(map(plain, r))) for r in expected.project(quoted).fetchall())
