"""YES/NO pairs: books side by side, parity signals, two-leg costing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marketlab.functions import direction as D
from marketlab.functions.columns import clip, flag, has, hours_between, lit, logistic, number, optional
from marketlab.operators.config import PairCostConfig, PairStrategyConfig, regime_costs
from marketlab.operators.costing import explode_grid
from marketlab.operators.panel import NEVER_H, rolling_std
from marketlab.operators.series import series_window, split_series, whole_series

LEG = ("token_id", "best_bid", "best_ask", "mid", "spread", "spread_bps", "bid_depth", "ask_depth")


def outcome_books(snapshots: DataFrame, outcomes: DataFrame, recent_hours: float | None = None) -> DataFrame:
    """Books with their normalised outcome label, optionally the latest hours only."""
    s = snapshots.where(F.col("market_id").isNotNull())
    if recent_hours:
        newest = snapshots.agg(F.max("snapshot_ts")).scalar()
        s = s.where(F.col("snapshot_ts") >= newest - F.make_dt_interval(secs=lit(recent_hours * 3600).cast("decimal(18,6)")))
    o = outcomes.select("market_id", "token_id", F.lower(F.trim(F.coalesce("outcome_label", F.lit("")))).alias("outcome_label"))
    joined = s.select(F.col("snapshot_ts").alias("ts"), "market_id", *LEG).join(o, ["market_id", "token_id"], "left")
    return joined.withColumn("outcome_label", F.coalesce("outcome_label", F.lit("")))


def latest_books(snapshots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """All quoted books of the newest timestamp, labelled."""
    newest = snapshots.agg(F.max("snapshot_ts")).scalar()
    s = snapshots.where((F.col("snapshot_ts") == newest) & F.col("mid").isNotNull())
    o = outcomes.select("market_id", "token_id", "outcome_label", "outcome_index")
    return s.select(F.col("snapshot_ts").alias("ts"), "market_id", *LEG).join(o, ["market_id", "token_id"], "left")


def side_by_side(books: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per (ts, market) with both legs, missing legs null.

    A conditional aggregate keyed by (ts, market) replaces the self join: one
    shuffle, and of repeated quotes the one with the largest token wins.
    """
    leg = lambda lab: F.max_by(F.when(F.col("outcome_label") == lab, F.struct(*LEG)), F.when(F.col("outcome_label") == lab, F.col("token_id")))
    g = books.where(F.col("outcome_label").isin("yes", "no")).groupBy("ts", "market_id").agg(leg("yes").alias("y"), leg("no").alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in carried])
    return g.select("ts", "market_id", *carried, *[F.col(f"y.{c}").alias(f"{c}_yes") for c in LEG], *[F.col(f"n.{c}").alias(f"{c}_no") for c in LEG])


def pair_presence(pair: DataFrame) -> DataFrame:
    """Presence flags and depth of an outer pairing."""
    total = lambda s: F.coalesce(f"bid_depth_{s}", lit(0)) + F.coalesce(f"ask_depth_{s}", lit(0))
    out = pair.withColumns(
        {
            "has_yes": F.col("token_id_yes").isNotNull(),
            "has_no": F.col("token_id_no").isNotNull(),
            "yes_two_sided": F.col("best_bid_yes").isNotNull() & F.col("best_ask_yes").isNotNull(),
            "no_two_sided": F.col("best_bid_no").isNotNull() & F.col("best_ask_no").isNotNull(),
            "depth_yes": total("yes"),
            "depth_no": total("no"),
        }
    )
    return out.withColumns(
        {
            "both_legs_present": F.col("has_yes") & F.col("has_no"),
            "both_legs_two_sided": F.col("yes_two_sided") & F.col("no_two_sided"),
            "min_pair_depth": F.least("depth_yes", "depth_no"),
        }
    )


def pair_books(snapshots: DataFrame, outcomes: DataFrame, markets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Labelled YES and NO books with market attributes."""
    o = outcomes.select("market_id", "token_id", F.lower(F.trim(F.coalesce("outcome_label", F.lit("")))).alias("outcome_label")).where(F.col("outcome_label").isin("yes", "no"))
    m = markets.select("market_id", "event_id", "category", "created_ts", F.coalesce("close_ts", "end_ts").alias("close_ts"))
    s = snapshots.select(F.col("snapshot_ts").alias("ts"), "market_id", *LEG).where(F.col("ts").isNotNull())
    return s.join(o, ["market_id", "token_id"]).join(m, "market_id", "left").join(resolutions.select("market_id", "resolved_ts"), "market_id", "left")


ATTRS = ("event_id", "category", "created_ts", "close_ts", "resolved_ts")


def complete_pairs(books: DataFrame) -> DataFrame:
    """Pairs with both legs, keyed by (ts, market) so null attributes cannot lose rows."""
    p = side_by_side(books, ATTRS).where(F.col("token_id_yes").isNotNull() & F.col("token_id_no").isNotNull())
    two = lambda s: F.col(f"best_bid_{s}").isNotNull() & F.col(f"best_ask_{s}").isNotNull()
    return p.withColumns({"pair_staleness_ms": lit(0), "has_both_legs": lit(1), "yes_two_sided": flag(two("yes")), "no_two_sided": flag(two("no")), "book_tradable": flag(two("yes") & two("no"))})


def pair_features(pair: DataFrame, cfg: PairStrategyConfig, flow: DataFrame | None = None) -> DataFrame:
    """Parity edges, signal, confidence, fill chance and expected net value.

    ``flow`` may give ``trade_frequency_pair_h`` per (ts, market).
    """
    pos = lambda c: clip(F.coalesce(c, lit(0)), 0.0)
    total = lambda s: F.coalesce(f"bid_depth_{s}", lit(0)) + F.coalesce(f"ask_depth_{s}", lit(0))
    p = pair.withColumns(
        {
            **{f"{q}_{s}": F.col(f"best_{q}_{s}") for q in ("ask", "bid") for s in ("yes", "no")},
            **{f"spread_{s}": pos(f"spread_{s}") for s in ("yes", "no")},
            **{f"spread_{s}_bps": pos(f"spread_bps_{s}") for s in ("yes", "no")},
            **{f"depth_{s}": total(s) for s in ("yes", "no")},
        }
    )
    p = p.withColumns({"min_pair_depth": F.least("depth_yes", "depth_no"), "sum_ask": F.col("ask_yes") + F.col("ask_no"), "sum_bid": F.col("bid_yes") + F.col("bid_no")})
    p = p.withColumns({"long_set_edge_raw": 1.0 - F.col("sum_ask"), "short_set_edge_raw": F.col("sum_bid") - 1.0})
    p = p.withColumns(
        {
            "edge_raw": F.when(F.col("sum_ask").isNotNull() & F.col("sum_bid").isNotNull(), F.greatest("long_set_edge_raw", "short_set_edge_raw", lit(0))),
            "pair_direction": F.when(F.col("long_set_edge_raw") >= F.col("short_set_edge_raw"), "LONG_SET").otherwise("SHORT_SET"),
            "time_to_resolution_h": F.coalesce(hours_between(F.coalesce("resolved_ts", "close_ts"), F.col("ts")), lit(NEVER_H)),
            "market_age_h": F.coalesce(hours_between(F.col("ts"), F.col("created_ts")), lit(0)),
            "pair_mid": clip((F.col("sum_bid") + F.col("sum_ask")) / 2.0, 1e-6, 0.999999),
            "category": F.coalesce("category", F.lit("unknown")),
        }
    )
    w = series_window(p, "market_id", "ts")
    p = p.withColumn("_ret", F.try_divide(F.col("pair_mid"), F.lag("pair_mid").over(w)) - 1)
    p = p.withColumns(
        {
            "signal": F.when(F.col("pair_direction") == "LONG_SET", F.col("edge_raw")).otherwise(-F.col("edge_raw")),
            "pair_volatility": F.abs(F.coalesce(rolling_std("_ret", 6, 3, w), lit(0))),
        }
    ).drop("_ret")
    if flow is not None:
        p = p.join(flow.select("ts", "market_id", "trade_frequency_pair_h"), ["ts", "market_id"], "left").withColumn("trade_frequency_pair_h", F.coalesce("trade_frequency_pair_h", lit(0)))
    else:
        p = p.withColumn("trade_frequency_pair_h", lit(0))
    bps = F.col("spread_yes_bps") + F.col("spread_no_bps")
    load = clip(cfg.base_trade_notional / clip("min_pair_depth", 1.0), 0.0)
    fill = clip(logistic(clip(1.5 - 2.0 * load - bps / 250.0, -20.0, 20.0)), 0.0, 1.0)
    conf = clip(F.col("edge_raw") / 0.02, None, 1.0) * (1.0 / (1.0 + bps / 400.0)) * (F.log1p(clip("min_pair_depth", 0.0)) / F.log1p(lit(500)))
    p = p.withColumns({"prob_vol_pair": F.col("pair_volatility"), "confidence": F.coalesce(clip(conf, 0.05, 1.0), F.lit(None).cast("double")), "_load": load, "_fill": fill})
    both = F.col("_fill") * F.col("_fill")
    slip = 0.10 * F.col("pair_volatility") * (1.0 + F.col("_load"))
    p = p.withColumns(
        {
            "fill_prob_yes": F.col("_fill"),
            "fill_prob_no": F.col("_fill"),
            "min_fill_prob_pair": F.col("_fill"),
            "expected_pair_fill": both,
            "expected_gross_return": F.col("edge_raw") * both,
            "expected_fee_return": 2.0 * (cfg.fee_bps / 1e4) * both,
            "expected_spread_cost_return": (1.0 - F.col("_fill")) * cfg.pair_fill_buffer,
            "expected_impact_return": F.least(lit(cfg.max_impact), cfg.impact_coeff * F.col("_load")) * both,
            "expected_vol_slippage_return": slip * both,
        }
    )
    cost = F.col("expected_fee_return") + F.col("expected_spread_cost_return") + F.col("expected_impact_return") + F.col("expected_vol_slippage_return")
    p = p.withColumn("expected_cost_return", cost).withColumn("expected_net_ev", F.col("expected_gross_return") - F.col("expected_cost_return"))
    same = {c: F.col("expected_net_ev") for c in ("expected_net_edge", "expected_return", "expected_ev")}
    return p.withColumns({**same, "required_notional": lit(cfg.base_trade_notional), "capacity_estimate": cfg.max_participation * F.col("min_pair_depth")}).drop("_load", "_fill")


AHEAD = ("bid_yes", "ask_yes", "bid_no", "ask_no", "spread_yes", "spread_no", "edge_raw", "long_set_edge_raw", "short_set_edge_raw")


def forward_quotes(pair: DataFrame, horizons: Sequence[int]) -> DataFrame:
    w = series_window(pair, "market_id", "ts")
    out = pair.withColumns({f"future_{c}_{h}": F.lead(c, h).over(w) for h in sorted(set(horizons) | {1}) for c in AHEAD})
    return out.withColumn("forward_ret_1", F.coalesce(F.col("future_edge_raw_1") - F.col("edge_raw"), lit(0)))


def pair_signals(books: DataFrame, cfg: PairStrategyConfig, flow: DataFrame | None = None) -> DataFrame:
    """Tradable pairs with enough depth and fill chance, labelled for costing."""
    p = split_series(complete_pairs(books), "market_id", "ts", 8, max(cfg.holding_periods))
    p = whole_series(forward_quotes(pair_features(p, cfg, flow), cfg.holding_periods))
    p = p.where((F.col("book_tradable") > 0) & (F.col("min_pair_depth") >= cfg.pair_min_depth) & (F.col("min_fill_prob_pair") >= cfg.min_pair_fill))
    return p.withColumns(
        {
            "direction": F.when(F.col("signal") >= 0, D.LONG_YES).otherwise(D.LONG_NO),
            "traded_side": F.lit("BASKET"),
            "position_type": F.lower("pair_direction"),
            "prediction_space": F.lit("RETURN_NEXT_H"),
            "model_target_type": F.lit("RETURN_NEXT_H"),
            "model_horizon": lit(1),
        }
    )


# ----------------------------------------------------------- two-leg costing

_FUT = ("future_bid_yes", "future_ask_yes", "future_bid_no", "future_ask_no")


def pair_grid(cfg: PairCostConfig, thresholds: Sequence[float], regimes: Sequence[str] = ("base",), impacts: Sequence[float] | None = None) -> list[dict]:
    from dataclasses import replace

    cells = []
    for reg in regimes:
        for imp in impacts if impacts is not None else (cfg.impact_coeff,):
            p = regime_costs(replace(cfg, impact_coeff=float(imp)), reg)
            cells += [{"threshold": float(t), "holding_period": int(h), "execution_regime": reg, "impact_coeff_input": float(imp), **p} for t in thresholds for h in cfg.holding_periods]
    return cells


def run_pair_grid(signals: DataFrame, cfg: PairCostConfig, thresholds: Sequence[float], regimes: Sequence[str] = ("base",), impacts: Sequence[float] | None = None) -> DataFrame:
    """Two-leg trades of every grid cell in one plan."""
    s = signals.where(optional(signals, "pair_staleness_ms", 0.0) <= cfg.staleness_ms)
    t = explode_grid(s, pair_grid(cfg, thresholds, regimes, impacts), _FUT, _FUT, strict=False)
    return pair_layout(pair_costs(t, cfg))


def pair_costs(df: DataFrame, cfg: PairCostConfig) -> DataFrame:
    """Leg fills, hedged and open quantity, locked edge, unwind, fees, impact, expected value."""
    px = lambda c: clip(number(c), 1e-6, 0.999)
    pos = lambda c: clip(F.coalesce(number(c), lit(0)), 0.0)
    long_set = number("signal", 0.0) > 0
    either = lambda a, b: F.when(F.col("_long"), a).otherwise(b)
    out = df.withColumns(
        {
            "_long": long_set,
            "_sign": F.signum(number("signal", 0.0)),
            "_conf": clip(number("confidence", 0.5), 0.05, 1.0),
            **{f"_{q}_{s}": px(f"{q}_{s}") for q in ("ask", "bid") for s in ("yes", "no")},
            **{f"_f{q[0]}{s[0]}": px(f"future_{q}_{s}") for q in ("ask", "bid") for s in ("yes", "no")},
            "_dy": pos("depth_yes"),
            "_dn": pos("depth_no"),
            "_wide": (pos("spread_yes") + pos("spread_no")) * 1e4,
            "_flow": F.coalesce(optional(df, "trade_frequency_pair_h", 0.0), lit(0)),
            "_vol": F.abs(F.coalesce(optional(df, "pair_volatility" if has(df, "pair_volatility") else "prob_vol_pair", 0.0), lit(0))),
        }
    )
    out = out.withColumn("_depth", clip(F.least("_dy", "_dn"), 1.0))
    out = out.withColumn("_target", clip(F.least(cfg.base_trade_notional * F.col("_conf"), cfg.max_participation * F.col("_depth")), 1.0))
    out = out.withColumn("_load", F.col("_target") / F.col("_depth"))
    logit = lambda d: F.col("fill_alpha") - 2.0 * (F.col("_target") / clip(d, 1.0)) - F.col("fill_beta") * (F.col("_wide") / 200.0) + F.col("fill_gamma") * F.log1p("_flow")
    out = out.withColumns({"fill_prob_yes": logistic(clip(logit("_dy"), -20.0, 20.0)), "fill_prob_no": logistic(clip(logit("_dn"), -20.0, 20.0)), "_queue": (1.0 - F.col("_conf")) * (0.25 + F.col("_load"))})
    real = lambda s: clip(F.col(f"fill_prob_{s}") * (1.0 - 0.5 * F.col("_queue")), 0.0, 1.0)
    out = out.withColumns({"leg_fill_pct_yes": real("yes"), "leg_fill_pct_no": real("no"), "expected_pair_fill": F.col("fill_prob_yes") * F.col("fill_prob_no"), "min_fill_prob_pair": F.least("fill_prob_yes", "fill_prob_no")})
    out = out.withColumns({"qty_yes_filled": F.col("_target") * F.col("leg_fill_pct_yes"), "qty_no_filled": F.col("_target") * F.col("leg_fill_pct_no")})
    out = out.withColumn("qty_pair_hedged", F.least("qty_yes_filled", "qty_no_filled"))
    out = out.withColumns(
        {
            "qty_unhedged_yes": F.col("qty_yes_filled") - F.col("qty_pair_hedged"),
            "qty_unhedged_no": F.col("qty_no_filled") - F.col("qty_pair_hedged"),
            "realized_pair_fill_pct": clip(F.col("qty_pair_hedged") / F.col("_target"), 0.0, 1.0),
            "realized_fill_pct": clip(0.5 * (F.col("leg_fill_pct_yes") + F.col("leg_fill_pct_no")), 0.0, 1.0),
            "actual_fill_proxy": F.least("leg_fill_pct_yes", "leg_fill_pct_no"),
            "_edge": either(1.0 - (F.col("_ask_yes") + F.col("_ask_no")), F.col("_bid_yes") + F.col("_bid_no") - 1.0),
            "_in_y": either(F.col("_ask_yes"), F.col("_bid_yes")),
            "_in_n": either(F.col("_ask_no"), F.col("_bid_no")),
            "_out_y": either(F.col("_fby"), F.col("_fay")),
            "_out_n": either(F.col("_fbn"), F.col("_fan")),
        }
    )
    swing = lambda s, k: either(F.col(f"_out_{k}") - F.col(f"_in_{k}"), F.col(f"_in_{k}") - F.col(f"_out_{k}")) * F.col(f"qty_unhedged_{s}")
    turn = F.col("_in_y") * F.col("qty_yes_filled") + F.col("_in_n") * F.col("qty_no_filled") + F.col("_out_y") * F.col("qty_unhedged_yes") + F.col("_out_n") * F.col("qty_unhedged_no")
    fee = cfg.fee_bps / 1e4
    out = out.withColumns(
        {
            "_turn": turn,
            "_imp": F.least(F.col("max_impact"), F.col("impact_coeff") * F.col("_load")),
            "_slip": F.col("vol_slippage_coeff") * F.col("_vol") * (1.0 + F.col("_load")),
            "gross_pnl": F.col("qty_pair_hedged") * F.col("_edge") + swing("yes", "y") + swing("no", "n"),
            "spread_component": 0.5 * clip(F.col("_fay") - F.col("_fby"), 0.0) * F.col("qty_unhedged_yes") + 0.5 * clip(F.col("_fan") - F.col("_fbn"), 0.0) * F.col("qty_unhedged_no"),
            "unwind_penalty_component": F.col("fill_buffer_bps") / 1e4 * (F.col("qty_unhedged_yes") + F.col("qty_unhedged_no")),
        }
    )
    out = out.withColumns({"fees": fee * F.col("_turn"), "impact_component": F.col("_turn") * F.col("_imp"), "vol_slippage_component": F.col("_turn") * F.col("_slip")})
    out = out.withColumn("net_pnl", F.col("gross_pnl") - F.col("fees") - F.col("spread_component") - F.col("impact_component") - F.col("vol_slippage_component") - F.col("unwind_penalty_component"))
    fill, least = F.col("expected_pair_fill"), F.col("min_fill_prob_pair")
    out = out.withColumns(
        {
            "trade_return": F.col("net_pnl") / F.col("_target"),
            "gross_return": F.col("gross_pnl") / F.col("_target"),
            "expected_fee_return": fee * (F.col("_in_y") + F.col("_in_n")) * fill,
            "expected_spread_cost_return": F.col("fill_buffer_bps") / 1e4 * (1.0 - fill),
            "expected_impact_return": F.col("_imp") * least,
            "expected_vol_slippage_return": F.col("_slip") * least,
            "expected_gross_return": F.col("_edge") * fill,
        }
    )
    cost = F.col("expected_fee_return") + F.col("expected_spread_cost_return") + F.col("expected_impact_return") + F.col("expected_vol_slippage_return")
    out = out.withColumn("expected_cost_return", cost).withColumn("expected_ev", F.col("expected_gross_return") - F.col("expected_cost_return"))
    return out.withColumn("ev_gap", F.col("trade_return") - F.col("expected_ev"))


def pair_layout(df: DataFrame) -> DataFrame:
    """Two-leg trade columns with an id per (ts, market, holding period)."""
    hp = F.col("holding_period")
    mid = clip((F.col("_ask_yes") + F.col("_ask_no") + F.col("_bid_yes") + F.col("_bid_no")) / 2.0, 1e-6, 0.999999)
    nxt = clip((F.col("_fby") + F.col("_fbn") + F.col("_fay") + F.col("_fan")) / 2.0, 1e-6, 0.999999)
    stale = optional(df, "pair_staleness_ms", 0.0)
    hedged = flag(F.col("realized_pair_fill_pct") >= 0.95)
    out = df.withColumns(
        {
            "paired_trade_id": F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("market_id").cast("string"), F.concat(F.lit("hp="), hp.cast("string"))),
            "direction": F.when(F.col("_long"), D.LONG_YES).otherwise(D.LONG_NO),
            "pair_direction": F.when(F.col("_long"), "LONG_SET").otherwise("SHORT_SET"),
            "direction_sign": F.col("_sign"),
            "traded_side": F.lit("BASKET"),
            "position_type": F.when(F.col("_long"), "long_complement_set").otherwise("short_complement_set"),
            "prediction_space": F.lit("RETURN_NEXT_H"),
            "model_target_type": F.lit("RETURN_NEXT_H"),
            "model_horizon": hp.cast("double"),
            "horizon": hp.cast("double"),
            "mid": mid,
            "future_mid_1": nxt,
            "forward_ret_1": F.coalesce(nxt - mid, lit(0)),
            "book_tradable": lit(1),
            "depth_total": F.col("_depth"),
            "notional": F.col("_target"),
            "target_notional": F.col("_target"),
            "required_notional": F.col("_target"),
            "qty_target_pair": F.col("_target"),
            "expected_fill_pct": F.col("expected_pair_fill"),
            "actual_pair_fill_proxy": F.col("actual_fill_proxy"),
            "fully_hedged": hedged,
            "fully_hedged_pair": hedged,
            "time_to_fill_h": clip(1.0 - F.col("expected_pair_fill"), 0.0, 1.0) * hp,
            "hedging_delay_proxy": clip(1.0 - F.col("realized_pair_fill_pct"), 0.0, 1.0) * hp,
            "pair_staleness_ms": stale,
            "pair_staleness_penalty_return": stale / 1000.0 * 1e-4,
            "expected_gross": F.col("expected_gross_return"),
            "expected_cost": F.col("expected_cost_return"),
            "expected_net_ev": F.col("expected_ev"),
            "expected_return": F.col("expected_ev"),
        }
    )
    params = ["impact_coeff", "max_impact", "vol_slippage_coeff", "fill_alpha", "fill_beta", "fill_gamma", "fill_buffer_bps", *_FUT]
    return D.attach_contract(out.drop(*[c for c in out.columns if c.startswith("_")], *params))


def structural_funnel(frame: DataFrame, cfg: PairStrategyConfig, ev_floor: float, split: str) -> DataFrame:
    """Row counts and forward proxies after each structural filter, one pass."""
    ok = {
        "raw": F.lit(True),
        "book_tradable": optional(frame, "book_tradable", 0.0) > 0,
        "min_depth": optional(frame, "min_pair_depth", 0.0) >= cfg.pair_min_depth,
        "min_fill_prob": optional(frame, "min_fill_prob_pair", 0.0) >= cfg.min_pair_fill,
        f"min_expected_net_ev_{ev_floor:.6f}": F.coalesce(number("expected_net_ev") >= ev_floor, F.lit(False)),
    }
    passed, steps = F.lit(True), []
    for i, (name, cond) in enumerate(ok.items()):
        passed = passed & F.coalesce(cond, F.lit(False))
        steps.append(F.when(passed, F.struct(F.lit(i).alias("step"), F.lit(name).alias("filter"))))
    t = frame.select(F.explode(F.array_compact(F.array(*steps))).alias("s"), F.abs(number("signal", 0.0)).alias("sig"), number("expected_net_ev").alias("ev"), optional(frame, "forward_ret_1", 0.0).alias("x"))
    agg = t.groupBy("s.step", "s.filter").agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.avg("sig").alias("avg_signal"),
        F.avg("ev").alias("avg_expected_ev"),
        F.avg("x").alias("proxy_expectancy"),
        F.when(F.count("x") > 1, F.avg("x") / F.greatest(F.stddev_pop("x"), lit(1e-9))).otherwise(lit(0)).alias("proxy_sharpe"),
    )
    base = frame.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter")) for i, n in enumerate(ok)])))
    return base.join(agg, ["step", "filter"], "left").select(
        F.lit(split).alias("split"), "step", "filter", *[F.coalesce(c, lit(0)).alias(c) for c in ("rows", "avg_signal", "avg_expected_ev", "proxy_expectancy", "proxy_sharpe")]
    )


# ------------------------------------------------------------ parity scans


def complement_parity(latest: DataFrame, buffer_bps: float = 35.0, min_violation: float = 0.005) -> DataFrame:
    """Pairs whose mids do not sum to one, net of both spreads and a buffer."""
    norm = latest.withColumn("outcome_label", F.lower(F.trim("outcome_label")))
    p = side_by_side(norm).where(F.col("token_id_yes").isNotNull() & F.col("token_id_no").isNotNull())
    total = F.col("mid_yes") + F.col("mid_no")
    p = p.withColumns(
        {
            "sum_prob": total,
            "violation_prob": F.abs(total - 1.0),
            "cost_buffer_return": F.coalesce("spread_yes", lit(0)) + F.coalesce("spread_no", lit(0)) + lit(2.0 * buffer_bps / 1e4),
        }
    ).where(F.col("violation_prob") >= min_violation)
    return p.select(
        "ts",
        "market_id",
        "mid_yes",
        "mid_no",
        "sum_prob",
        "violation_prob",
        "cost_buffer_return",
        F.col("violation_prob").alias("expected_gross_return"),
        (F.col("violation_prob") - F.col("cost_buffer_return")).alias("expected_net_return"),
        F.when(F.col("sum_prob") > 1, "BUY_CHEAPER_LEG").otherwise("SELL_RICHER_LEG").alias("trade_side"),
        (F.col("sum_prob") > 1).alias("sum_gt_one"),
        F.lit(1).alias("hedged"),
    )


def outcome_sums(latest: DataFrame, buffer_bps: float = 35.0, min_violation: float = 0.005) -> DataFrame:
    """Sum-to-one check over all outcomes of a market."""
    g = latest.groupBy("ts", "market_id").agg(
        F.count("token_id").alias("n_outcomes"), F.sum("mid").alias("sum_prob"), F.avg("spread").alias("avg_spread"), F.max("mid").alias("max_prob"), F.min("mid").alias("min_prob")
    )
    g = g.withColumn("violation_prob", F.when(F.col("n_outcomes") >= 2, F.abs(F.col("sum_prob") - 1.0)).otherwise(lit(0)))
    g = g.withColumns({"expected_gross_return": F.col("violation_prob"), "cost_buffer_return": F.coalesce("avg_spread", lit(0)) + buffer_bps / 1e4})
    return g.withColumn("expected_net_return", F.col("expected_gross_return") - F.col("cost_buffer_return")).where(F.col("violation_prob") >= min_violation)


def window_consistency(links: DataFrame, latest: DataFrame, markets: DataFrame, buffer_bps: float = 35.0, min_violation: float = 0.005, min_confidence: float = 0.65) -> DataFrame:
    """Linked markets where the earlier close is priced above the later one."""
    use = links.where(F.lower("relation_type").contains("time_window") & (F.coalesce(number("link_confidence"), lit(0)) >= min_confidence))
    yes = latest.where(F.lower("outcome_label") == "yes").groupBy("market_id").agg(F.avg("mid").alias("p"))
    m = markets.select("market_id", "close_ts").where(F.col("close_ts").isNotNull()).join(yes, "market_id")
    side = lambda s: m.select(F.col("market_id").alias(f"market_id_{s}"), F.col("close_ts").alias(f"close_{s}"), F.col("p").alias(f"p_{s}"))
    j = use.join(side("a"), "market_id_a").join(side("b"), "market_id_b").where(F.col("close_a") != F.col("close_b"))
    first = F.col("close_a") < F.col("close_b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    j = j.select(
        pick("market_id_a", "market_id_b").alias("market_id_earlier"), pick("market_id_b", "market_id_a").alias("market_id_later"), pick("p_a", "p_b").alias("prob_earlier"), pick("p_b", "p_a").alias("prob_later"), "link_confidence", "relation_type"
    )
    j = j.withColumn("violation_prob", F.greatest(lit(0), F.col("prob_earlier") - F.col("prob_later"))).where(F.col("violation_prob") >= min_violation)
    return j.withColumns({"expected_gross_return": F.col("violation_prob"), "expected_net_return": F.col("violation_prob") - buffer_bps / 1e4, "hedged": F.lit(1)})


def parity_summary(complement: DataFrame, multi: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Candidate counts per scan and their mean net return."""
    parts = [complement.select(F.lit("c").alias("k"), "expected_net_return"), multi.select(F.lit("m").alias("k"), "expected_net_return")]
    if windows is not None:
        parts.append(windows.select(F.lit("w").alias("k"), "expected_net_return"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    n = lambda k: F.count_if(F.col("k") == k).cast("double")
    return rows.agg(
        F.lit("consistency_arb").alias("module"), n("c").alias("n_complement_candidates"), n("m").alias("n_multioutcome_candidates"), n("w").alias("n_timewindow_candidates"), F.coalesce(F.avg("expected_net_return"), lit(0)).alias("avg_expected_net_return")
    )
