"""A token whose events of a day are all worth nothing has a mid of zero; queries divide by it."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check import table

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = (
    "a4_field_missingness j23_outer_pairing j10_quote_or_trade j14_unresolved_candidates a21_structural_ev_grid "
    "j30_momentum_frame w11_cross_section_z f12_time_buckets a36_regression a36_bucket_regression a36_momentum_summary"
).split()


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zeros"))
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        os.symlink(f, f"{path}/{os.path.basename(f)}")
    os.unlink(f"{path}/events.parquet")
    worth = "CASE WHEN user_id % 3 = 0 AND day(ts) IN (4, 9) THEN 0 ELSE value END"
    con.execute(f"COPY (SELECT * REPLACE ({worth} AS value) FROM '{DATA}/events.parquet') TO '{path}/events.parquet'")
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return path, con


@pytest.mark.parametrize("name", NAMES)
def test_zero_price(spark, zeros, name):
    path, con = zeros
    df = QUERIES[name](spark, path)
    cur = con.execute(ORACLES[name])
    got, want = table(df.columns, [tuple(r) for r in df.collect()]), table([d[0] for d in cur.description], cur.fetchall())
    assert got == want


def test_first_run(spark, zeros):
    assert QUERIES["c6_first_run"](spark, zeros[0]).count() > 0


def test_float_ratio(spark):
    from marketlab.functions.columns import float_ratio

    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    got = [r[0] for r in df.select(F.format_string("%s", float_ratio(F.col("a"), F.col("b")))).collect()]
    assert got == ["Infinity", "-Infinity", "NaN", "null", "null", "0.25"]
