"""Signal builders: panel in, panel with signal and confidence out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions.columns import clip, flag, lit, logistic, number
from marketlab.functions.text import ambiguity_score
from marketlab.operators.ranking import quantile_row


def stat(df: DataFrame, expr: Column) -> Column:
    """A whole-table aggregate as a scalar subquery."""
    return df.agg(expr.alias("v")).scalar()


def z_score(df: DataFrame, name: str) -> Column:
    m = df.agg(F.struct(F.avg(name).alias("a"), F.stddev_pop(name).alias("s")).alias("v")).scalar()
    return (F.col(name) - m["a"]) / (m["s"] + 1e-9)


def _inverse_spread(scale: float) -> Column:
    return lit(1) / (1.0 + clip("spread_bps", 0.0) / scale)


def cross_market(panel: DataFrame, min_event_size: int = 2) -> DataFrame:
    """Fade the distance from the event mean, in event deviations."""
    stats = panel.groupBy("event_id", "ts").agg(F.countDistinct("market_id").alias("event_n"), F.avg("mid").alias("event_mean_prob"), F.stddev_samp("mid").alias("_sd"))
    stats = stats.where(F.col("event_n") >= min_event_size).withColumn("event_std_prob", F.when(F.col("_sd") != 0, F.col("_sd")).otherwise(lit(0.01))).drop("_sd")
    df = panel.join(stats, ["event_id", "ts"]).withColumn("dispersion_z", (F.col("mid") - F.col("event_mean_prob")) / F.col("event_std_prob"))
    df = df.withColumn("raw_signal", -F.col("dispersion_z") * F.log1p("event_n"))
    conf = F.abs("dispersion_z") / 3.0 * _inverse_spread(250.0) * (1.0 + F.col("depth_log") / 6.0)
    return df.withColumns({"signal": F.tanh(F.col("raw_signal") / 2.0), "confidence": clip(conf, 0.05, 1.0)})


def liquidity_premium(panel: DataFrame, low_quantile: float = 0.35) -> DataFrame:
    """Contrarian level signal in thin books."""
    cut = quantile_row(panel.select("liquidity_log"), {"c": ("liquidity_log", low_quantile)}).scalar()
    df = panel.withColumn("_low", F.greatest(cut - F.col("liquidity_log"), lit(0)))
    df = df.withColumn("low_liq_score", F.col("_low") / (stat(df, F.stddev_pop("_low")) + 1e-9)).drop("_low")
    boost = 1.0 + clip(F.abs("prob_vol_6") * 40.0, 0.0, 2.0)
    pen = _inverse_spread(300.0)
    score = F.col("low_liq_score")
    df = df.withColumn("raw_signal", -(F.col("mid") - 0.5) * score * boost * pen)
    conf = score / (1.0 + score) * (0.5 + 0.5 * pen) * (0.5 + 0.5 * F.least(lit(1), boost / 2.0))
    return df.withColumns({"signal": F.tanh("raw_signal"), "confidence": clip(conf, 0.05, 1.0)})


def momentum(panel: DataFrame, momentum_hours: float = 72.0) -> DataFrame:
    """Follow velocity close to resolution, fade it far away."""
    df = panel.withColumns({"_vz": z_score(panel, "velocity_1"), "_az": z_score(panel, "acceleration")})
    df = df.withColumns({"_base": 0.7 * F.col("_vz") + 0.3 * F.col("_az"), "regime_signal": F.when(F.col("time_to_resolution_h") <= momentum_hours, lit(1)).otherwise(lit(-1))})
    still = stat(df, F.stddev_pop("_base")) < 1e-12
    base = F.when(still, F.col("mid") - 0.5).otherwise(F.col("_base"))
    calm = lit(1) / (1.0 + F.abs("prob_vol_24") * 30.0)
    conf = 0.5 * F.least(lit(1), F.abs("_vz") / 3.0) + 0.5 * calm
    df = df.withColumns({"raw_signal": F.col("regime_signal") * base, "confidence": clip(conf, 0.05, 1.0)})
    return df.withColumn("signal", F.tanh(F.col("raw_signal") / 2.0)).drop("_vz", "_az", "_base")


def rule_text() -> Column:
    """Question and description of a market as one text."""
    return F.concat(F.coalesce("question", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))


def rule_ambiguity(panel: DataFrame, floor: float = 0.15) -> DataFrame:
    """Fade extreme prices of markets with ambiguous rules.

    A panel may bring ``ambiguity_score``, taken once per market (see
    :func:`rule_text`); else it needs the texts beside every price.
    """
    df = panel if "ambiguity_score" in panel.columns else panel.withColumn("ambiguity_score", ambiguity_score(rule_text()))
    med = quantile_row(df.select("ambiguity_score"), {"m": ("ambiguity_score", 0.5)}).scalar()
    df = df.withColumn("ambiguity_z", (F.col("ambiguity_score") - med) / (stat(df, F.stddev_pop("ambiguity_score")) + 1e-9)).where(F.col("ambiguity_score") >= floor)
    liq = quantile_row(df.select("liquidity_log"), {"m": ("liquidity_log", 0.5)}).scalar()
    unsure = F.greatest(lit(0), F.col("ambiguity_z"))
    pen = _inverse_spread(250.0)
    thin = lit(1) / (1.0 + F.exp(F.col("liquidity_log") - liq))
    df = df.withColumn("raw_signal", -(F.col("mid") - 0.5) * (1.0 + unsure) * pen)
    return df.withColumns({"signal": F.tanh(F.col("raw_signal") * (1.0 + thin)), "confidence": clip(unsure * pen * (0.5 + thin), 0.05, 1.0)})


def whale_flow_signal(panel: DataFrame, flow: DataFrame, unit: str = "hour") -> DataFrame:
    """Follow large wallets, weighted by their past alpha."""
    df = panel.withColumn("hr", F.date_trunc(unit, "ts")).join(flow, ["hr", "token_id"], "left").drop("hr")
    df = df.withColumns({c: F.coalesce(c, lit(0)) for c in ("whale_flow", "whale_flow_raw", "whale_alpha")})
    df = df.withColumns({"whale_flow_z": z_score(df, "whale_flow"), "whale_alpha_z": z_score(df, "whale_alpha"), "_rz": z_score(df, "whale_flow_raw")})
    raw = 0.6 * F.col("_rz") + 0.4 * (F.col("whale_flow_z") * (1.0 + clip("whale_alpha_z", -1.0, 2.0)))
    conf = F.least(lit(1), F.abs("whale_flow_z") / 3.0) * F.least(lit(1), 0.5 + F.greatest(lit(0), F.col("whale_alpha_z")) / 2.0)
    df = df.withColumns({"raw_signal": raw, "confidence": clip(conf, 0.05, 1.0)})
    return df.withColumn("signal", F.tanh(F.col("raw_signal") / 2.0)).drop("_rz")


def cross_section_z(prices: DataFrame, value: str = "ret_lb", at_least: int = 3, sign: float | Column = 1.0) -> DataFrame:
    """Score per timestamp across names, within [-1, 1].

    Timestamps with few names use the whole-table score instead.
    """
    m = prices.agg(F.struct(F.avg(value).alias("a"), F.stddev_pop(value).alias("s")).alias("v")).scalar()
    per = prices.groupBy("ts").agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    overall = F.when(m["s"] > 1e-12, (F.col(value) - m["a"]) / m["s"]).otherwise(lit(0))
    local = F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(lit(0))
    z = F.when(F.col("_n") < at_least, overall).otherwise(local)
    return prices.join(per, "ts").withColumn("signal", clip(z * sign, -2.0, 2.0) / 2.0).drop("_n", "_m", "_s")


def fill_probability(depth: Column, spread_bps: Column, flow: Column, liquidity: float = 0.9, spread: float = 1.2, queue: float = 0.5) -> Column:
    """Chance that a passive quote fills."""
    x = liquidity * F.log1p(clip(depth, 0.0) / 100.0) - spread * (clip(spread_bps, 0.0) / 200.0) + 0.4 * F.log1p(clip(flow, 0.0)) - queue
    return logistic(clip(x, -20.0, 20.0))


def quote_scores(
    panel: DataFrame,
    min_depth: float = 200.0,
    max_vol: float = 0.06,
    mid_band: tuple[float, float] = (0.10, 0.90),
    base_notional: float = 100.0,
    adverse: float = 0.02,
    fee_bps: float = 20.0,
    max_return: float = 0.05,
) -> DataFrame:
    """Passive two-sided quotes with their expected net return."""
    vol = F.abs(number("prob_vol_6", 0.0))
    df = panel.withColumns({"prob_vol_6": vol, "velocity_1": number("velocity_1", 0.0), "depth_total": number("depth_total", 0.0), "spread_bps": number("spread_bps", 0.0)})
    ok = (F.coalesce("book_tradable", lit(1)) > 0) & (F.col("depth_total") >= min_depth) & (F.col("prob_vol_6") <= max_vol) & F.col("mid").between(*mid_band) & (F.abs("velocity_1") < adverse)
    df = df.where(ok)
    med = quantile_row(df.select("prob_vol_6"), {"m": ("prob_vol_6", 0.5)}).scalar()
    near = flag(F.col("time_to_resolution_h") <= 24)
    fair = clip(F.col("mid") - 0.25 * clip("velocity_1", -0.05, 0.05), 0.001, 0.999)
    half = clip(number("spread", 0.0) / 2.0, 0.001, 0.05) * (1.0 + 1.5 * (F.col("prob_vol_6") / (med + 1e-6))) * (1.0 + 0.5 * near)
    half = F.least(clip(half, 0.001, 0.10), 0.25 * F.col("mid"))
    df = df.withColumns({"_half": half, "_fair": fair, "_near": near})
    df = df.withColumns({"quote_bid": clip(F.col("_fair") - F.col("_half"), 0.001, 0.999), "quote_ask": clip(F.col("_fair") + F.col("_half"), 0.001, 0.999)})
    fill = fill_probability(F.col("depth_total"), F.col("spread_bps"), number("trade_notional_h", 0.0))
    nxt = F.coalesce("future_mid_1", "mid")
    floor_mid = clip("mid", 1e-3)
    df = df.withColumns(
        {
            "quote_width": F.col("quote_ask") - F.col("quote_bid"),
            "expected_fill_probability": fill,
            "quoted_notional": clip(base_notional * (1.0 - 0.4 * F.col("_near")) * (1.0 - 0.2 * clip("prob_vol_6", 0.0, 1.0)), 10.0, base_notional),
            "_bid_gain": (F.col("_half") - clip(F.col("quote_bid") - nxt, 0.0)) / floor_mid,
            "_ask_gain": (F.col("_half") - clip(nxt - F.col("quote_ask"), 0.0)) / floor_mid,
        }
    )
    gross = clip(0.5 * (F.col("expected_fill_probability") * F.col("_bid_gain") + F.col("expected_fill_probability") * F.col("_ask_gain")), -max_return, max_return)
    df = df.withColumns({"expected_gross_return": gross, "expected_cost_return": 2.0 * (fee_bps / 1e4) * F.col("expected_fill_probability")})
    return df.withColumn("expected_net_return", F.col("expected_gross_return") - F.col("expected_cost_return")).drop("_half", "_fair", "_near", "_bid_gain", "_ask_gain")
