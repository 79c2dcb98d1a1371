"""Tables and scores that many rows meet are made once."""

from pyspark.sql import functions as F

from marketlab.functions.text import ambiguity_score
from marketlab.operators import signals as S, studies as E
from marketlab.sources.driver_tables import Lake
from tests.conftest import DATA


def test_base_tables(spark):
    lake = Lake(spark, DATA)
    for name in ("snapshots", "outcomes", "markets", "resolutions"):
        assert not any("events" in f for f in getattr(lake, name).inputFiles())


def test_trades_meet_large_wallets_without_a_shuffle(spark):
    lake = Lake(spark, DATA)
    whales = E.whale_wallets(lake.trades, 0.9).select("trader")
    j = lake.trades.join(whales, "trader", "left_semi")
    j.collect()
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_rule_signal_of_scored_markets(spark):
    rows = [(i, 0.1 + 0.08 * i, float(i), 100.0, "may " * (i * 30), "or" if i % 2 else None) for i in range(10)]
    p = spark.createDataFrame(rows, "token_id long, mid double, liquidity_log double, spread_bps double, question string, description string")
    scored = p.withColumn("ambiguity_score", ambiguity_score(S.rule_text())).drop("question", "description")
    cols = ["token_id", "ambiguity_score", "signal", "confidence", "raw_signal"]
    got = [S.rule_ambiguity(x).select(cols).orderBy("token_id").collect() for x in (p, scored)]
    assert got[0] == got[1] and got[0]


def test_one_pass_over_trades_writes_none(spark):
    from marketlab.catalog import load_all, registry

    queries, key = load_all(), (spark.sparkContext.applicationId, DATA + "/")
    for name in ("p43_report_costs", "m11_portfolio_series"):
        assert queries[name].run(spark, DATA + "/").count() > 0
    assert "trades" not in registry._LAKES[key]._memo
