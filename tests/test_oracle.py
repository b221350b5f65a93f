"""Every registered query with SQL gives the SQL's rows in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 6) if isinstance(v, float) and not math.isinf(v) else v


def bag(frame, columns):
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    number = lambda s: s.replace(".0,", ",").replace(".0)", ")")  # noqa: E731  whole doubles and longs print alike
    assert [number(x) for x in bag(got, sorted(got.columns))] == [number(x) for x in bag(want, sorted(want.columns))]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
