"""Distributed ranks and quantiles against pandas, with hot values and keys."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlab.operators import ranking as R


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n)), "v": np.where(rng.random(n) < 0.35, 1.5, np.round(rng.normal(size=n), 3))})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_rank_rows_in_groups(hot):
    pdf, df = hot
    got = R.rank_rows(df, [F.col("v").asc(), F.col("id").asc()], ["k"]).toPandas().sort_values("id")
    want = pdf.sort_values(["v", "id"]).assign(rn=lambda d: d.groupby("k").cumcount() + 1).sort_values("id")
    assert (got["rn"].to_numpy() == want["rn"].to_numpy()).all()
    assert (got["n_rows"].to_numpy() == pdf.groupby("k")["k"].transform("size").to_numpy()).all()


def test_rank_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = {(r["k"], r["v"]): r["rn"] for r in R.rank_rows(df, [F.col("v").asc()], ["k"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


@pytest.mark.parametrize("q", [0.0, 0.1, 0.33, 0.5, 0.95, 1.0])
def test_quantiles_match_linear_interpolation(hot, q):
    pdf, df = hot
    got = {r["k"]: r["value"] for r in R.quantiles(df, {"v": [q]}, ["k"]).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(g["v"].quantile(q), abs=1e-12)


def test_average_rank(hot):
    pdf, df = hot
    got = R.average_rank(df, "v", "r").toPandas().sort_values("id")["r"].to_numpy()
    assert np.allclose(got, pdf["v"].rank(method="average").to_numpy())


def test_average_rank_of_values_that_differ_when_taken_again(spark):
    # as sums of doubles do that are shuffled again in another order
    again = F.udf(lambda i: i + random.random(), "double").asNondeterministic()
    df = spark.range(200).select("id", again("id").alias("v"))
    got = R.average_rank(df, "v", "r").orderBy("id").collect()
    assert [(r["id"], r["r"]) for r in got] == [(i, i + 1.0) for i in range(200)]


def test_prefix_sums_with_keys(hot):
    pdf, df = hot
    got = R.prefix_sums(df, [F.col("id").asc()], {"s": F.col("v")}, ["k"]).toPandas().sort_values("id")["s"].to_numpy()
    assert np.allclose(got, pdf.groupby("k")["v"].cumsum().to_numpy())


@pytest.mark.parametrize("n", [2, 3, 7, 10, 11, 57])
@pytest.mark.parametrize("bins", [2, 5, 10])
def test_equal_count_bins(spark, n, bins):
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"), F.lit(n).cast("long").alias("t"))
    got = [r["b"] for r in df.select("rn", R.equal_count_bin(F.col("rn"), F.col("t"), bins).alias("b")).orderBy("rn").collect()]
    # exact integer form of quantile cuts of the ranks
    want = [max(0, -(-(r - 1) * bins // (n - 1)) - 1) for r in range(1, n + 1)]
    assert got == want
