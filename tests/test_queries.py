"""Every query of the core against its SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import pandas as pd
import pytest

import __spark_entry__ as entry
from quarrylight import queries as core

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def value(v):
    if v is pd.NA or v is None or v != v:
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 5) if math.isfinite(v) else v
    return v if isinstance(v, (str, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, tables, name):
    got = core.queries()[name](spark, DATA).toPandas()
    if name not in core.oracle_sql():
        assert len(got)
        return
    want = tables.execute(core.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: Counter(tuple(map(value, r)) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
