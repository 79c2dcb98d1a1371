"""Feature panel: order-book sanity, clocks, dynamics, trade flow, context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlab.functions.columns import clip, correlation, flag, hours_between, lit, number, ratio
from marketlab.operators.ranking import average_rank, quantile_row, rank_rows
from marketlab.operators.series import series_window, split_series, whole_series
from marketlab.session import materialise

# fixed limits of the order-book sanity rule
EXTREME_MID = 0.99
EXTREME_DEPTH = 50.0
MAX_SPREAD_BPS = 2500.0
HORIZONS = (1, 3, 6, 12)
NEVER_H = 9999.0
HISTORY = 220  # rows the longest token window looks back


def by_token(df: DataFrame) -> W:
    return series_window(df, "token_id", "ts")


def scan_snapshots(snapshots: DataFrame) -> DataFrame:
    """Quoted snapshots only, under the panel's column names."""
    return snapshots.where(F.col("mid").isNotNull()).select(
        F.col("snapshot_ts").alias("ts"), "market_id", "token_id", "best_bid", "best_ask", "mid", "spread", "spread_bps", "bid_depth", "ask_depth", "liquidity_score"
    )


def market_base(markets: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Markets with their (possibly missing) resolution time."""
    keep = [c for c in ("market_id", "event_id", "question", "description", "category") if c in markets.columns]
    m = markets.select(*keep, F.coalesce("close_ts", "end_ts").alias("target_close_ts"), "created_ts")
    return m.join(resolutions.select("market_id", "resolved_ts"), "market_id", "left")


def winner_map(outcomes: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Three-valued winner per outcome: missing, 1 or 0."""
    r = resolutions.select("market_id", "winner_token_id")
    win = F.when(F.col("winner_token_id").isNull(), None).when(F.col("token_id").cast("string") == F.col("winner_token_id").cast("string"), 1).otherwise(0)
    return outcomes.join(r, "market_id", "left").select(
        "market_id", "token_id", win.cast("double").alias("winner"), flag(F.col("winner_token_id").isNotNull()).alias("resolution_known")
    )


def yes_tokens(outcomes: DataFrame) -> DataFrame:
    """The YES token per market: label first, then outcome index."""
    order = F.struct(F.when(F.lower(F.coalesce("outcome_label", F.lit(""))) == "yes", 0).otherwise(1), F.col("outcome_index"), F.col("token_id"))
    return outcomes.groupBy("market_id").agg(F.min_by("token_id", order).alias("token_id"))


def book_sanity(panel: DataFrame) -> DataFrame:
    """Presence flags, canonical two-sided quote and the tradable flag."""
    two = F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()
    out = panel.withColumns(
        {
            "best_bid_present": flag(F.col("best_bid").isNotNull()),
            "best_ask_present": flag(F.col("best_ask").isNotNull()),
            "book_two_sided": flag(two),
            "book_reliable": flag(two),
            "mid": F.when(two, lit(0.5) * (F.col("best_bid") + F.col("best_ask"))),
            "spread": F.when(two, F.col("best_ask") - F.col("best_bid")),
            "depth_total_raw": F.coalesce("bid_depth", lit(0)) + F.coalesce("ask_depth", lit(0)),
        }
    ).withColumn("spread_bps", F.when(F.col("mid") > 0, F.col("spread") / F.col("mid") * lit(10000)))
    extreme = (F.col("mid") >= EXTREME_MID) | (F.col("mid") <= 1.0 - EXTREME_MID)
    fair = F.coalesce(F.col("spread_bps") <= MAX_SPREAD_BPS, F.lit(False))
    deep = F.col("depth_total_raw") >= EXTREME_DEPTH
    return out.withColumns(
        {
            "spread_reasonable": flag(fair),
            "mid_extreme": flag(extreme),
            "extreme_depth_ok": flag(deep),
            "book_tradable": flag(two & fair & (~F.coalesce(extreme, F.lit(False)) | deep)),
        }
    )


def clock_features(frame: DataFrame) -> DataFrame:
    end = F.coalesce("resolved_ts", "target_close_ts")
    return frame.withColumns({"time_to_resolution_h": hours_between(end, F.col("ts")), "market_age_h": hours_between(F.col("ts"), F.col("created_ts"))})


def percent_change(value: str, k: int, w: W) -> Column:
    return ratio(F.col(value), F.lag(value, k).over(w)) - 1


def rolling_std(value: str, rows: int, at_least: int, series: W) -> Column:
    w = series.rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(w) >= at_least, F.stddev_samp(value).over(w))


def dynamic_features(frame: DataFrame) -> DataFrame:
    """Velocity, acceleration, rolling volatility and book imbalance per token."""
    w = by_token(frame)
    depth = F.coalesce("bid_depth", lit(0)) + F.coalesce("ask_depth", lit(0))
    tilt = F.coalesce("bid_depth", lit(0)) - F.coalesce("ask_depth", lit(0))
    out = frame.withColumns({"velocity_1": percent_change("mid", 1, w), "velocity_3": percent_change("mid", 3, w), "depth_total": depth})
    out = out.withColumns(
        {
            "acceleration": F.col("velocity_1") - F.lag("velocity_1").over(w),
            "prob_vol_6": rolling_std("velocity_1", 6, 3, w),
            "prob_vol_24": rolling_std("velocity_1", 24, 6, w),
            "book_imbalance": F.coalesce(ratio(tilt, F.col("depth_total")), lit(0)),
        }
    )
    return out.withColumn("spread_to_vol_6", F.coalesce("spread_bps", lit(0)) / (F.abs("prob_vol_6") * 10000.0 + 1.0))


def trade_flow(trades: DataFrame, unit: str = "hour") -> DataFrame:
    """Traded notional per token and time unit, split by side."""
    t = trades.where(F.col("trade_ts").isNotNull() & F.col("token_id").isNotNull())
    side = lambda s: F.sum(F.when(F.upper("side") == s, F.col("notional")).otherwise(lit(0)))
    return t.groupBy(F.date_trunc(unit, "trade_ts").alias("hr"), "token_id").agg(
        F.sum("notional").alias("trade_notional"), F.count(F.lit(1)).alias("trade_count"), side("BUY").alias("buy_notional"), side("SELL").alias("sell_notional")
    )


def join_trade_flow(frame: DataFrame, flow: DataFrame, unit: str = "hour") -> DataFrame:
    out = frame.withColumn("hr", F.date_trunc(unit, "ts")).join(flow, ["hr", "token_id"], "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), lit(0))
    return out.withColumns(
        {
            "trade_notional_h": zero("trade_notional"),
            "trade_count_h": zero("trade_count"),
            "trade_buy_sell_imbalance_h": F.coalesce(ratio(zero("buy_notional") - zero("sell_notional"), zero("trade_notional")), lit(0)),
        }
    ).drop("hr", "trade_notional", "trade_count", "buy_notional", "sell_notional")


def category_codes(frame: DataFrame) -> DataFrame:
    """Code per category in order of first appearance (token, then time)."""
    first = frame.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.min(F.struct("token_id", "ts")).alias("seen"))
    ranked = rank_rows(first, [F.col("seen.token_id").asc(), F.col("seen.ts").asc()], (), "rn", "n")
    return ranked.select("category", (F.col("rn") - 1).cast("double").alias("category_code"))


def encode_category(frame: DataFrame, codes: DataFrame, dummies: Sequence[str] = ()) -> DataFrame:
    """Fill, code and (for the named categories) one 0/1 column each."""
    out = frame.withColumn("category", F.coalesce("category", F.lit("unknown"))).join(codes, "category", "left")
    return out.withColumns({f"cat_{c}": flag(F.col("category") == c) for c in dummies}) if dummies else out


def forward_targets(frame: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    w = by_token(frame)
    cols: dict[str, Column] = {}
    for h in horizons:
        cols[f"future_mid_{h}"] = F.lead("mid", h).over(w)
        cols[f"future_spread_{h}"] = F.lead("spread", h).over(w)
    out = frame.withColumns(cols)
    return out.withColumns({f"forward_ret_{h}": ratio(F.col(f"future_mid_{h}"), F.col("mid")) - 1 for h in horizons})


def log_transforms(frame: DataFrame) -> DataFrame:
    fill = lambda c, v=0.0: F.coalesce(F.col(c), lit(v))
    return frame.withColumns(
        {
            "liquidity_log": F.log1p(fill("liquidity_score")),
            "depth_log": F.log1p(fill("depth_total")),
            **{c: fill(c) for c in ("spread_bps", "prob_vol_6", "prob_vol_24", "velocity_1", "velocity_3", "acceleration", "market_age_h")},
            "time_to_resolution_h": fill("time_to_resolution_h", NEVER_H),
        }
    )


def regime_flags(frame: DataFrame) -> DataFrame:
    """Volatility terciles and the low-liquidity flag by whole-table quantiles."""
    cuts = quantile_row(
        frame.select(F.round(F.abs("prob_vol_6"), 12).alias("vol"), F.round("liquidity_log", 12).alias("liq")),
        {"v1": ("vol", 0.33), "v2": ("vol", 0.66), "l1": ("liq", 0.33)},
    )
    at = lambda name: cuts.select(name).scalar()
    vol = F.round(F.abs("prob_vol_6"), 12)
    out = frame.withColumns(
        {
            "order_flow_imbalance_h": F.coalesce("trade_buy_sell_imbalance_h", lit(0)),
            "trade_frequency_h": F.coalesce("trade_count_h", lit(0)),
            "vol_regime": F.when(vol <= at("v1"), lit(0)).when(vol <= at("v2"), lit(1)).otherwise(lit(2)),
            "is_low_liq_regime": flag(F.round("liquidity_log", 12) <= at("l1")),
        }
    )
    return out.withColumn("is_high_vol_regime", flag(F.col("vol_regime") >= 2))


def resolution_clock(frame: DataFrame) -> DataFrame:
    ttr = clip(F.coalesce("time_to_resolution_h", lit(NEVER_H)), 0.0)
    month = F.least(ttr, lit(720))
    return frame.withColumns({"ttr_log": F.log1p(ttr), "ttr_sq": month * month, "near_resolution_24h": flag(ttr <= 24), "near_resolution_72h": flag(ttr <= 72)})


def weighted_mean(history: Column, span: int, at_least: int) -> Column:
    """Adjusted exponential mean of an oldest-first array of bounded length."""
    keep = 1.0 - 2.0 / (span + 1)
    zero = F.struct(lit(0).alias("num"), lit(0).alias("den"))
    step = lambda acc, x: F.struct((acc["num"] * keep + x).alias("num"), (acc["den"] * keep + 1.0).alias("den"))
    folded = F.aggregate(history, zero, step, lambda acc: acc["num"] / acc["den"])
    return F.when(F.size(history) >= at_least, folded)


def momentum_decay(frame: DataFrame) -> DataFrame:
    """Fast minus slow exponential mean of velocity, and its rate.

    The history ends where the slow weight falls below 1e-15, so each row
    carries a bounded array.
    """
    past = F.collect_list(F.coalesce("velocity_1", lit(0))).over(by_token(frame).rowsBetween(1 - HISTORY, 0))
    out = frame.withColumn("_hist", past).withColumns({"_fast": weighted_mean(F.col("_hist"), 3, 2), "_slow": weighted_mean(F.col("_hist"), 12, 4)})
    out = out.withColumn("momentum_decay", F.coalesce(F.col("_fast") - F.col("_slow"), lit(0)))
    return out.withColumns(
        {
            "momentum_decay_rate": clip(F.col("momentum_decay") / (F.abs("_slow") + 1e-6), -5.0, 5.0),
            "velocity_abs": F.abs(F.coalesce("velocity_1", lit(0))),
        }
    ).drop("_hist", "_fast", "_slow")


def group_context(frame: DataFrame) -> DataFrame:
    """Event and category means and dispersion at each timestamp.

    Aggregated first and joined back: map-side combine keeps a hot event from
    becoming one window task.
    """
    out = frame.withColumns({"event_id": F.coalesce("event_id", F.lit("unknown_event")), "category": F.coalesce("category", F.lit("unknown"))})
    if "ret_1" not in out.columns:
        out = out.withColumn("ret_1", F.coalesce(percent_change("mid", 1, by_token(out)), lit(0)))
    ev = out.groupBy("event_id", "ts").agg(F.avg("mid").alias("event_mean_mid"), (F.max("mid") - F.min("mid")).alias("event_prob_dispersion"))
    ca = out.groupBy("category", "ts").agg(F.avg("mid").alias("category_mean_mid"), F.avg("ret_1").alias("category_ret_1"))
    out = out.join(ev, ["event_id", "ts"], "left").join(ca, ["category", "ts"], "left")
    zero = lambda c: F.coalesce(c, lit(0))
    return out.withColumns(
        {
            "related_prob_spread": zero(F.col("mid") - F.col("event_mean_mid")),
            "event_prob_dispersion": zero(F.col("event_prob_dispersion")),
            "category_prob_spread": zero(F.col("mid") - F.col("category_mean_mid")),
            "category_ret_1": zero(F.col("category_ret_1")),
        }
    )


def token_correlation(frame: DataFrame, at_least: int = 12) -> DataFrame:
    """Correlation of a token's returns with its category, and the quartile cluster."""
    corr = frame.groupBy("token_id").agg(
        F.when((F.count(F.lit(1)) >= at_least) & (F.stddev_pop("ret_1") > 1e-12) & (F.stddev_pop("category_ret_1") > 1e-12), correlation("ret_1", "category_ret_1")).alias("c")
    )
    corr = corr.select("token_id", F.round(F.coalesce("c", lit(0)), 12).alias("token_corr_category"))
    ranked = average_rank(corr, "token_corr_category", "_r")
    n = corr.agg(F.count(F.lit(1)).cast("double")).scalar()
    return ranked.select("token_id", "token_corr_category", clip(F.floor(F.round(F.col("_r") / n * 4.0, 9)).cast("double"), 0.0, 3.0).alias("corr_cluster"))


def cross_market_context(frame: DataFrame) -> DataFrame:
    ctx = group_context(frame)
    return ctx.join(token_correlation(ctx), "token_id", "left").drop("ret_1")


def build_panel(
    snapshots: DataFrame,
    markets: DataFrame,
    outcomes: DataFrame,
    resolutions: DataFrame,
    trades: DataFrame,
    unit: str = "hour",
    horizons: Sequence[int] = HORIZONS,
    dummies: Sequence[str] = (),
) -> DataFrame:
    """The whole feature panel, one row per tradable (ts, token)."""
    base = scan_snapshots(snapshots).join(market_base(markets, resolutions), "market_id", "left")
    p = book_sanity(base).where(F.col("book_tradable") > 0)
    p = p.join(winner_map(outcomes, resolutions), ["market_id", "token_id"], "left")
    p = p.withColumn("resolution_known", F.coalesce("resolution_known", lit(0)))
    # all token windows run side by side on one sort, then halo rows go
    p = split_series(p, "token_id", "ts", HISTORY + 4, max(horizons))
    p = forward_targets(momentum_decay(dynamic_features(p)), horizons)
    p = p.withColumn("ret_1", F.coalesce(percent_change("mid", 1, by_token(p)), lit(0)))
    p = clock_features(whole_series(p))
    # written once: ranks, quantiles and group means below all read it
    p = materialise(log_transforms(join_trade_flow(p, trade_flow(trades, unit), unit)))
    p = encode_category(p, category_codes(p), dummies)
    return cross_market_context(resolution_clock(regime_flags(p)))


def yes_panel(panel: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Panel rows of the YES tokens."""
    return panel.join(yes_tokens(outcomes), ["market_id", "token_id"], "left_semi")
