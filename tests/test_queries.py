"""Every query with SQL against DuckDB at the smallest scale, value by value."""

import math
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SF
from verdigris.plans import catalog

NAMES = sorted(catalog.queries())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if not sql:
        return
    out = duck.sql(sql)
    assert columns == sorted(out.columns)
    at = [out.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
