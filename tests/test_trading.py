"""Prices, returns and grids against numbers worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketlab.functions import direction as D
from marketlab.functions.columns import correlation, lit
from marketlab.operators import costing as C, diagnostics as G, pairs as X
from marketlab.operators.config import CostConfig, PairCostConfig

START = dt.datetime(2023, 5, 2, 9)


@pytest.mark.parametrize(
    "side, entry, exit_, gross, fees",
    [
        # bought at 0.30 + 0.01 + 0.004 + 0.006, sold at 0.42 - 0.02 - 0.002 - 0.008
        ("LONG_YES", 0.30, 0.42, 40 * (0.39 - 0.32), 0.0025 * 40 * (0.39 + 0.32)),
        # the other outcome: bought at 0.70 + 0.02, sold at 0.58 - 0.03
        ("LONG_NO", 0.30, 0.42, 40 * (0.55 - 0.72), 0.0025 * 40 * (0.55 + 0.72)),
    ],
)
def test_one_trade_in_closed_form(spark, side, entry, exit_, gross, fees):
    t = C.trade_return(lit(entry), lit(exit_), F.col("side"), lit(0.0025), lit(40), (lit(0.01), lit(0.02)), (lit(0.004), lit(0.002)), (lit(0.006), lit(0.008)), extra=lit(0.05))
    r = spark.createDataFrame([(side,)], "side string").select(*[c.alias(n) for n, c in t.items()]).first()
    paid = 40 * (0.32 if side == "LONG_YES" else 0.72)
    assert r["notional"] == pytest.approx(paid)
    assert r["gross_pnl"] == pytest.approx(gross) and r["fees"] == pytest.approx(fees)
    assert r["net_pnl"] == pytest.approx(gross - fees - 0.05)
    assert r["trade_return"] == pytest.approx((gross - fees - 0.05) / paid)
    assert r["spread_component"] == pytest.approx(1.2) and r["impact_component"] == pytest.approx(0.24) and r["vol_slippage_component"] == pytest.approx(0.56)


def test_missing_and_negative_costs_count_as_none(spark):
    t = C.trade_return(lit(0.5), lit(0.6), F.col("side"), lit(0), F.col("q"), (lit(-1), F.lit(None).cast("double")), (lit(0), lit(0)), (lit(0), lit(0)))
    r = spark.createDataFrame([("LONG_YES", None)], "side string, q double").select(*[c.alias(n) for n, c in t.items()]).first()
    assert r["qty"] == 1.0 and r["gross_return"] == pytest.approx(0.2)


@pytest.mark.parametrize("value, cut, want", [(0.31, 0.3, "LONG_YES"), (-0.7, 0.3, "LONG_NO"), (0.3, 0.3, "FLAT"), (0.0, 0.0, "FLAT")])
def test_labels(spark, value, cut, want):
    assert spark.createDataFrame([(value,)], "s double").select(D.label("s", cut)).first()[0] == want


def quotes(spark, rows):
    """Signals with a forecast that comes true and no trading costs."""
    cols = "token_id string, signal double, mid double, future_mid_2 double"
    d = spark.createDataFrame(rows, cols)
    fixed = {"market_id": F.col("token_id"), "category": F.lit("k"), "confidence": lit(1), "spread": lit(0), "spread_bps": lit(0), "future_spread_2": lit(0), "depth_total": lit(5000), "trade_notional_h": lit(1e7), "prob_vol_6": lit(0), "book_tradable": lit(1), "model_horizon": lit(2), "model_target_type": F.lit("FUTURE_MID"), "model_pred_future_mid": F.col("future_mid_2")}
    return d.withColumns(fixed).withColumn("ts", F.lit(START).cast("timestamp"))


def test_grid_cells_hold_the_signals_beyond_them(spark):
    frame = quotes(spark, [("a", 0.35, 0.50, 0.60), ("b", 0.80, 0.25, 0.30), ("c", -0.90, 0.40, 0.30), ("d", 0.10, 0.50, 0.90)])
    cfg = CostConfig(holding_periods=(2,), fee_bps=0.0, impact_coeff=0.0, max_impact=0.0, base_trade_notional=10.0, max_participation=1.0, vol_slippage_coeff=0.0, fill_alpha=40.0, fill_beta=0.0, fill_gamma=0.0)
    t = C.run_grid(frame, cfg, (0.2, 0.5))
    by = {}
    for r in t.collect():
        by.setdefault(r["threshold"], {})[r["token_id"]] = r["trade_return"]
    assert {k: sorted(v) for k, v in by.items()} == {0.2: ["a", "b", "c"], 0.5: ["b", "c"]}
    # price gains over the price paid; the third buys the other outcome at 0.60 and sells at 0.70
    assert by[0.2] == pytest.approx({"a": 0.2, "b": 0.2, "c": 1 / 6}, abs=1e-6)


def test_expected_value_mirrors_at_even_odds(spark):
    """At a mid of one half, a forecast above it is worth as much as its mirror image below it."""
    rows = [(0.6, 0.5, 0.58), (-0.6, 0.5, 0.42), (0.6, 0.5, 0.42)]
    d = spark.createDataFrame(rows, "signal double, mid double, model_pred_future_mid double")
    d = d.withColumns({"spread": lit(0.02), "depth_total": lit(400), "prob_vol_6": lit(0.02), "confidence": lit(0.7), "model_target_type": F.lit("FUTURE_MID"), "model_horizon": lit(1)})
    up, down, wrong = [r["expected_gross_return"] for r in C.expected_value(d, CostConfig()).collect()]
    assert up == pytest.approx(down) and up > 0 > wrong


def test_parity_trade_needs_an_edge_beyond_its_threshold(spark):
    book = {"confidence": 0.8, "spread_yes": 0.02, "spread_no": 0.02, "depth_yes": 900.0, "depth_no": 700.0, "pair_volatility": 0.0}
    rich = {"market_id": "rich", "signal": 0.06, "edge_raw": 0.06, "ask_yes": 0.31, "ask_no": 0.63, "bid_yes": 0.29, "bid_no": 0.61, "future_bid_yes_2": 0.36, "future_ask_yes_2": 0.38, "future_bid_no_2": 0.62, "future_ask_no_2": 0.64}
    poor = {"market_id": "poor", "signal": 0.02, "edge_raw": 0.02, "ask_yes": 0.50, "ask_no": 0.48, "bid_yes": 0.48, "bid_no": 0.46, "future_bid_yes_2": 0.48, "future_ask_yes_2": 0.50, "future_bid_no_2": 0.46, "future_ask_no_2": 0.48}
    over = {"market_id": "over", "signal": -0.07, "edge_raw": -0.07, "ask_yes": 0.60, "ask_no": 0.51, "bid_yes": 0.58, "bid_no": 0.49, "future_bid_yes_2": 0.52, "future_ask_yes_2": 0.53, "future_bid_no_2": 0.44, "future_ask_no_2": 0.45}
    names = ["market_id", *[c for c in rich if c != "market_id"], *book]
    d = spark.createDataFrame([tuple({**x, **book}[c] for c in names) for x in (rich, poor, over)], names).withColumn("ts", F.lit(START).cast("timestamp"))
    cfg = PairCostConfig(holding_periods=(2,), fee_bps=0.0, impact_coeff=0.0, max_impact=0.0, vol_slippage_coeff=0.0, fill_buffer_bps=0.0, fill_alpha=30.0, fill_beta=0.0, fill_gamma=0.0, base_trade_notional=40.0, max_participation=1.0)
    got = {r["market_id"]: r for r in X.run_pair_grid(d, cfg, (0.05,)).collect()}
    assert sorted(got) == ["over", "rich"]
    assert got["rich"]["pair_direction"] == "LONG_SET" and got["over"]["pair_direction"] != "LONG_SET"
    assert got["rich"]["trade_return"] > 0 and got["over"]["trade_return"] > 0


def test_diagnostics_tell_good_forecasts_from_bad(spark):
    rows = [(START + dt.timedelta(minutes=10 * i), "t", 1.0 if i > 75 else -1.0, 0.4, (i - 75) / 5000, (i - 75) / 4000) for i in range(150)]
    d = spark.createDataFrame(rows, "ts timestamp, token_id string, signal double, mid double, expected_net_return double, good double")
    good = G.ev_diagnostics(d.withColumn("trade_return", F.col("good"))).first()
    bad = G.ev_diagnostics(d.withColumn("trade_return", -F.col("good"))).first()
    assert good["ev_spearman"] == pytest.approx(1.0) and good["ev_monotonic_pass"] == 1
    assert bad["ev_spearman"] == pytest.approx(-1.0) and bad["ev_monotonic_pass"] == 0


def test_units_of_one_scale_are_comparable(spark):
    d = spark.createDataFrame([(x / 100, x / 110) for x in range(1, 30)], "expected_return double, trade_return double")
    assert G.units_comparable(d).first()["comparable"]


def test_constant_side_has_no_correlation_but_no_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(correlation("a", "b")).first()[0] is None
