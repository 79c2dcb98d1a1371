"""Every registered query runs on the smallest data and equals its SQL oracle."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check import table

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
LONG_RUNS = {"c2_strategy_run", "c3_pair_strategy_run", "c8_single_strategy"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_flagship(spark):
    assert entry.entry(spark).count() == 6


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LONG_RUNS])
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    got, want = table(df.columns, rows), table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
