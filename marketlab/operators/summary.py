"""Equity curves, trade summaries, calibration, capacity and cost reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlab.functions.columns import clip, flag, has, lit, number, sharpe
from marketlab.operators.costing import forward_proxy
from marketlab.operators.ranking import quantile_groups, quantiles, rank_rows
from marketlab.session import materialise

CAPITAL = 100_000.0
CELL = ("threshold", "holding_period", "execution_regime", "impact_coeff_input")


def equity_curve(pnl: DataFrame, value: str = "net_pnl", keys: Sequence[str] = (), start: float = CAPITAL) -> DataFrame:
    """Cumulative pnl, equity, running peak, drawdown and below-peak runs.

    The input is summed to one row per (keys, ts) first. Running values are
    built in two levels, days and then instants of a day, so a long history
    never lands in one task.
    """
    ts = pnl.groupBy(*keys, "ts").agg(F.sum(value).alias("pnl")).withColumn("_day", F.date_trunc("day", "ts"))
    inside = W.partitionBy(*keys, "_day").orderBy("ts")
    ts = ts.withColumns({"_in": F.sum("pnl").over(inside.rowsBetween(W.unboundedPreceding, 0)), "_nth": F.row_number().over(inside)})
    # one row per day: what came before it and the peak reached before it
    earlier = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = ts.groupBy(*keys, "_day").agg(F.sum("pnl").alias("_dp"), F.max("_in").alias("_top"))
    days = days.withColumns({"_before": F.coalesce(F.sum("_dp").over(earlier), lit(0)), "_nday": F.row_number().over(W.partitionBy(*keys).orderBy("_day"))})
    days = days.select(*keys, "_day", "_before", "_nday", F.max(F.col("_before") + F.col("_top")).over(earlier).alias("_peak0"))
    cum = ts.join(days, [*keys, "_day"]).withColumn("cum_pnl", F.col("_before") + F.col("_in")).withColumn("equity", F.col("cum_pnl") + start)
    top = F.max("equity").over(inside.rowsBetween(W.unboundedPreceding, 0))
    out = cum.withColumn("peak", F.greatest(top, F.coalesce(F.col("_peak0") + start, top)))
    out = out.withColumns({"drawdown": F.col("equity") / F.col("peak") - 1, "below": F.col("equity") < F.col("peak"), "first": (F.col("_nth") == 1) & (F.col("_nday") == 1)})
    return out.drop("_before", "_peak0", "_in", "_nth", "_nday")


def below_peak_runs(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Longest run of instants below the peak, by gaps and islands."""
    up = F.when(~F.col("below"), 1).otherwise(0)
    inside = W.partitionBy(*keys, "_day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    days = curve.groupBy(*keys, "_day").agg(F.sum(up).alias("_u")).select(*keys, "_day", F.coalesce(F.sum("_u").over(earlier), F.lit(0)).alias("_u0"))
    isle = curve.join(days, [*keys, "_day"]).withColumn("_isle", F.col("_u0") + F.sum(up).over(inside))
    runs = isle.groupBy(*keys, "_isle").agg(F.sum(F.when(F.col("below"), 1).otherwise(0)).alias("_len"))
    return runs.groupBy(*keys).agg(F.max("_len").cast("double").alias("drawdown_duration"))


def equity_metrics(pnl: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sharpe of the step returns, worst drawdown and its longest run."""
    curve = materialise(equity_curve(pnl, keys=keys))
    step = F.when(F.col("first"), lit(0)).otherwise(F.col("pnl") / CAPITAL)
    m = curve.groupBy(*keys).agg(sharpe(step).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))
    runs = below_peak_runs(curve, keys)
    if keys:
        return m.join(runs, list(keys))
    return m.withColumn("drawdown_duration", runs.scalar())


def trade_summary(trades: DataFrame, keys: Sequence[str] = CELL, paired: bool = False) -> DataFrame:
    """All summary metrics, one row per grid cell that has trades."""
    avg = lambda c: F.avg(c)
    slip = F.avg(F.col("spread_component") / clip("notional", 1.0)) * 1e4 if paired else F.avg(F.abs("realized_slippage") * 1e4)
    wins = F.col("trade_return") > 0
    good = F.col("expected_ev") > 0
    metrics: dict[str, Column] = {
        "trade_count": F.count(F.lit(1)).cast("double"),
        "win_rate": F.avg(flag(wins)),
        "expectancy": avg("trade_return"),
        "total_pnl": F.sum("net_pnl"),
        "avg_expected_fill_pct": avg("expected_fill_pct"),
        "avg_realized_fill_pct": avg("realized_fill_pct"),
        "avg_actual_fill_proxy": avg("actual_fill_proxy"),
        "avg_fill_calibration_error": F.avg(F.col("expected_fill_pct") - F.col("actual_fill_proxy")),
        "avg_time_to_fill_h": avg("time_to_fill_h"),
        "avg_realized_slippage_bps": slip,
        "avg_gross_return": avg("gross_return"),
        "avg_expected_ev": avg("expected_ev"),
        "avg_ev_gap": avg("ev_gap"),
        "ev_hit_rate": F.coalesce(F.avg(F.when(good, flag(wins))), lit(0)),
        "gross_pnl_total": F.sum("gross_pnl"),
        "fees_total": F.sum("fees"),
        "spread_cost_total": F.sum("spread_component"),
        "impact_cost_total": F.sum("impact_component"),
        "vol_slippage_cost_total": F.sum("vol_slippage_component"),
        "observed_cost_bps": F.avg(F.col("gross_return") - F.col("trade_return")) * 1e4,
        "breakeven_cost_bps": F.greatest(lit(0), F.avg("gross_return")) * 1e4,
    }
    if not paired and has(trades, "mid_return"):
        metrics["mid_cost_bps"] = F.avg(F.col("mid_return") - F.col("trade_return")) * 1e4
    if paired:
        metrics |= {
            "hedged_fill_rate": avg("fully_hedged"),
            "fully_hedged_trade_count": F.sum("fully_hedged"),
            "avg_pair_fill_pct": avg("realized_pair_fill_pct"),
            "avg_expected_pair_fill": avg("expected_pair_fill"),
        }
    base = trades.groupBy(*keys).agg(*[v.alias(k) for k, v in metrics.items()]).withColumn("expectancy_per_trade", F.col("expectancy"))
    # days and markets of a cell side by side in one aggregate
    kinds = F.explode(F.array(F.struct(F.lit("d").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("id")), F.struct(F.lit("m").alias("kind"), F.col("market_id").cast("string").alias("id")))).alias("_g")
    per = trades.select(*keys, "net_pnl", kinds).groupBy(*keys, "_g.kind", "_g.id").agg((F.sum("net_pnl") / CAPITAL).alias("r"))
    only = lambda k, fn: fn(F.when(F.col("kind") == k, F.col("r")))
    day = per.groupBy(*keys).agg(only("d", F.avg).alias("return_per_day"), only("d", F.count).cast("double").alias("n_days"), only("m", F.avg).alias("return_per_event"), only("m", F.count).cast("double").alias("n_events"))
    q = quantile_groups(trades.select(*keys, "trade_return"), keys, {"ret_p10": ("trade_return", 0.1), "ret_p50": ("trade_return", 0.5), "ret_p90": ("trade_return", 0.9)})
    out = base
    for part in (day, q, equity_metrics(trades, keys)):
        out = out.join(part, list(keys))
    return out


def full_grid(summary: DataFrame, cells: Sequence[dict], keys: Sequence[str] = CELL) -> DataFrame:
    """Add the empty cells of the grid, all metrics zero."""
    num = lambda v: F.lit(v) if isinstance(v, (str, int)) else lit(v)
    uniq = {tuple(c[k] for k in keys): c for c in cells}
    grid = summary.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[num(c[k]).alias(k) for k in keys]) for c in uniq.values()])))
    rest = [c for c in summary.columns if c not in keys]
    return grid.join(summary, list(keys), "left").select(*keys, *[F.coalesce(c, lit(0)).alias(c) for c in rest])


def sensitivity(summary: DataFrame, kind: str) -> DataFrame:
    """Regime or impact sensitivity with the cost headroom."""
    return summary.withColumns({"analysis_type": F.lit(kind), "cost_headroom_bps": F.col("breakeven_cost_bps") - F.col("observed_cost_bps")})


def fill_calibration(trades: DataFrame, expected: str = "expected_fill_pct", actual: str = "actual_fill_proxy", bins: int = 10, keys: Sequence[str] = (), tie: Sequence[str] = ("ts", "token_id")) -> DataFrame:
    """Expected against realised fill in equal-count bins."""
    t = trades.withColumns({"_e": F.round(number(expected, 0.0, 0.0, 1.0), 9)})
    ranked = rank_rows(t, [F.col("_e").asc(), *[F.col(c).asc() for c in tie]], keys, "_rn", "_n")
    if keys:
        distinct = t.groupBy(*keys).agg(F.least(F.lit(bins), F.countDistinct("_e")).alias("_q"))
        ranked = ranked.join(distinct, list(keys))
    else:
        ranked = ranked.withColumn("_q", t.agg(F.least(F.lit(bins), F.countDistinct("_e"))).scalar())
    b = F.when(F.col("_q") <= 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((F.col("_rn") - 1) * F.col("_q") / F.greatest(F.col("_n") - 1, F.lit(1))).cast("long") - 1))
    e, a = number(expected, 0.0), number(actual, 0.0)
    return ranked.groupBy(*keys, b.cast("double").alias("fill_bin")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(e).alias("avg_expected_fill_pct"), F.avg(a).alias("avg_actual_fill_proxy"), F.avg(e - a).alias("fill_gap")
    )


def stability(trades: DataFrame, by: str) -> DataFrame:
    """Trades, mean return, win rate and Sharpe per day or category."""
    key = F.date_trunc("day", "ts").alias("bucket") if by == "day" else F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("bucket")
    return trades.groupBy(key).agg(F.count(F.lit(1)).alias("trade_count"), F.avg("trade_return").alias("avg_return"), F.avg(flag(F.col("trade_return") > 0)).alias("win_rate"), sharpe(F.col("trade_return")).alias("sharpe"))


def cost_decomposition(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    names = {"gross_pnl": "gross_pnl", "fees": "fees", "spread_cost": "spread_component", "vol_slippage": "vol_slippage_component", "impact_cost": "impact_component", "unwind_cost": "unwind_penalty_component", "net_pnl": "net_pnl"}
    total = lambda c: F.coalesce(F.sum(number(c, 0.0)), lit(0)) if has(trades, c) else lit(0)
    aggs = [total(src).alias(out) for out, src in names.items()] + [F.count(F.lit(1)).cast("double").alias("trade_count")]
    return trades.groupBy(*keys).agg(*aggs) if keys else trades.agg(*aggs)


def capacity(trades: DataFrame, max_participation: float = 0.15, impact_coeff: float = 0.10) -> DataFrame:
    """Daily traded notional, per-trade capacity, markets and impact."""
    depth = clip(number("depth_total", 0.0), 1.0) * clip(number("mid", 0.0), 1e-4)
    t = trades.select("ts", "market_id", "notional", (max_participation * depth).alias("cap"), (impact_coeff * clip("notional", 0.0) / depth * 1e4).alias("bps"))
    per_day = t.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.sum("notional").alias("v"))
    pooled = t.select(F.lit("cap").alias("kind"), F.col("cap").alias("v")).unionByName(per_day.select(F.lit("day").alias("kind"), "v"))
    med = quantiles(pooled, {"v": [0.5]}, ["kind"]).agg(
        F.max(F.when(F.col("kind") == "day", F.col("value"))).alias("d"), F.max(F.when(F.col("kind") == "cap", F.col("value"))).alias("c")
    )
    return t.agg(F.countDistinct("market_id").cast("double").alias("active_markets"), F.avg("bps").alias("avg_impact_bps")).select(
        F.coalesce(med.select("d").scalar(), lit(0)).alias("estimated_daily_capacity_usd"), F.coalesce(med.select("c").scalar(), lit(0)).alias("median_trade_capacity_usd"), "active_markets", F.coalesce("avg_impact_bps", lit(0)).alias("avg_impact_bps")
    )


def ev_threshold_grid(valued: DataFrame, grid: Sequence[float], split: str, proxy: Column | None = None, structural: bool = False) -> DataFrame:
    """Rows, expected value and forward proxy above each expected-value floor.

    One pass: every floor is a set of conditional aggregates.
    """
    cells = sorted({float(g) for g in grid})
    x = proxy if proxy is not None else forward_proxy(valued)
    t = valued.select(number("expected_net_ev").alias("ev"), x.alias("x"))
    floors = F.explode(F.filter(F.array(*[lit(g) for g in cells]), lambda g: F.col("ev") >= g)).alias("ev_threshold")
    ratio = F.when(F.count("x") > 1, F.avg("x") / F.greatest(F.stddev_pop("x"), lit(1e-9))).otherwise(lit(0)) if structural else sharpe(F.col("x"))
    agg = t.select("ev", "x", floors).groupBy("ev_threshold").agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg("ev").alias("avg_expected_net_ev"), F.coalesce(F.avg("x"), lit(0)).alias("proxy_expectancy"), ratio.alias("proxy_sharpe")
    )
    base = valued.sparkSession.range(1).select(F.explode(F.array(*[lit(g) for g in cells])).alias("ev_threshold"))
    return base.join(agg, "ev_threshold", "left").select(F.lit(split).alias("split"), "ev_threshold", *[F.coalesce(c, lit(0)).alias(c) for c in ("rows", "avg_expected_net_ev", "proxy_expectancy", "proxy_sharpe")])


def best_row(summary: DataFrame, min_count: float, value: str = "expectancy", count: str = "trade_count", keys: Sequence[str] = (), tie: Sequence[str] = ("threshold", "holding_period")) -> DataFrame:
    """Row with the best value x sqrt(count): enough trades first, then any, then all."""
    tier = F.when(F.col(count) >= min_count, 0).when(F.col(count) > 0, 1).otherwise(2)
    score = F.round(F.coalesce(value, lit(0)) * F.sqrt(clip(count, 0.0)), 12)
    s = summary.withColumns({"_tier": tier, "_score": score})
    rest = [c for c in summary.columns if c not in keys]
    order = F.struct(F.col("_tier"), (-F.col("_score")).alias("_neg"), *[F.col(c) for c in tie])
    picked = s.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b")) if keys else s.agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return picked.select(*keys, "_b.*")
