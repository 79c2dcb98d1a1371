"""Composite runs: strategies and research."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from marketlab.catalog.base import UNIT
from marketlab.catalog.pairing import PCFG, books
from marketlab.catalog.registry import query
from marketlab.catalog.trading import signal_of
from marketlab.operators import validate as V
from marketlab.operators.config import StrategyConfig
from marketlab.plans import strategy as ST
from marketlab.plans.research import MinData, Tables, first_run, full_run

WALK = V.WalkConfig(n_folds=2, min_train_periods=4, min_train_samples=20, test_periods=6, min_test_trades=5)


def momentum(model: str = "heuristic") -> ST.Strategy:
    return ST.Strategy("momentum", lambda x: x["signal"], StrategyConfig(thresholds=(0.1, 0.2), holding_periods=(1, 3), model_type=model, model_candidates=("logistic", "bayesian"), cv_splits=2, label_mode="future_price_move"), ["velocity_1", "prob_vol_6", "liquidity_log", "spread_bps"])


def tables_of(lake) -> Tables:
    t = lake.texts.select("market_id", "question", "description")
    return Tables(lake.snapshots, lake.markets.join(t, "market_id", "left"), lake.outcomes, lake.resolutions, lake.trades)


@query("c2_strategy_run")
def c2(lake):
    return ST.run_strategy(momentum(), {"signal": signal_of(lake)}, WALK)["deployment_readiness"]


@query("m7_model_run")
def m7(lake):
    frame = V.time_split(signal_of(lake), 0.7)
    out = ST.apply_models(frame, momentum("ensemble").config, ["velocity_1", "prob_vol_6", "liquidity_log", "spread_bps"], trees=5)
    f = out["frame"]
    # a guard may have kept the heuristic signal
    for c, t in (("model_proba", "double"), ("model_target_type", "string"), ("model_pred_future_mid", "double")):
        if c not in f.columns:
            f = f.withColumn(c, F.lit(None).cast(t))
    return f.select("ts", "token_id", "split", "signal", "confidence", "model_proba", "model_target_type", "model_pred_future_mid")


@query("c3_pair_strategy_run")
def c3(lake):
    s = replace(ST.strategy_by_name("consistency_arb"), config=replace(PCFG, thresholds=(0.004, 0.01), holding_periods=(1, 3), min_train_trades=5, min_history_rows=1))
    from marketlab.operators.pairs import pair_signals

    s = replace(s, build=lambda x: pair_signals(x["pair_books"], s.config))
    return ST.run_pair_strategy(s, {"pair_books": books(lake)}, WALK)["deployment_readiness"]


@query("c8_single_strategy")
def c8(lake):
    b = ST.run_strategy(momentum(), {"signal": signal_of(lake)}, WALK)
    return ST.report_row("momentum", b)


@query("c6_first_run")
def c6(lake):
    return first_run(tables_of(lake))["edge_scores"]


@query("c7_gated_full_run")
def c7(lake):
    # the driver data is too thin for the gates: the run stops with its report
    return full_run(tables_of(lake), UNIT, limits=MinData())["insufficient_data_report"]
