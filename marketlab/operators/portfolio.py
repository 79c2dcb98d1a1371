"""Portfolios over strategy return series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions.columns import correlation, lit, number, sharpe
from marketlab.operators.ranking import prefix_sums
from marketlab.operators.series import series_window, split_series, whole_series
from marketlab.operators.studies import resolution_bucket
from marketlab.operators.summary import CAPITAL, equity_curve


@dataclass(frozen=True)
class PortfolioConfig:
    risk_free: float = 0.0
    max_weight: float = 0.50
    ridge: float = 1e-6
    kelly_cap: float = 0.30
    turnover_penalty: float = 0.01
    risk_aversion: float = 6.0
    steps: int = 20  # weight grid of 1 / steps
    capital: float = CAPITAL


METHODS = ("risk_parity", "mean_variance", "max_sharpe", "kelly")


def strategy_returns(trades: DataFrame, name: Column) -> DataFrame:
    """Return per (strategy, ts): pnl over the starting capital."""
    return trades.groupBy(name.alias("strategy"), "ts").agg((F.sum("net_pnl") / CAPITAL).alias("ret"))


def aligned(returns: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per strategy over all instants, zero where it was idle."""
    return returns.groupBy("ts").pivot("strategy", list(names)).agg(F.sum("ret")).na.fill(0.0)


def covariance(wide: DataFrame, names: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """Correlation and population covariance of every pair, from one aggregate row."""
    pairs = [(a, b) for a in names for b in names]
    aggs = [F.struct(F.lit(a).alias("strategy_a"), F.lit(b).alias("strategy_b"), correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("correlation"), (F.covar_pop(F.col(f"`{a}`"), F.col(f"`{b}`")) + (ridge if a == b else 0.0)).alias("covariance")) for a, b in pairs]
    return wide.agg(F.array(*aggs).alias("p")).select(F.inline("p"))


def weight_grid(spark, k: int, steps: int, most: int) -> DataFrame:
    """All weight vectors on the simplex in steps of 1 / steps, none above ``most`` steps."""
    g = spark.range(1).select(F.array().cast("array<int>").alias("u"), F.lit(steps).alias("left"))
    for i in range(k - 1):
        rest = (k - 1 - i) * most
        low = F.greatest(F.lit(0), F.col("left") - rest)
        g = g.where(low <= F.least(F.lit(most), F.col("left"))).withColumn("x", F.explode(F.sequence(low, F.least(F.lit(most), F.col("left")))))
        g = g.select(F.array_append("u", F.col("x")).alias("u"), (F.col("left") - F.col("x")).alias("left"))
    g = g.where(F.col("left") <= most).select(F.array_append("u", F.col("left")).alias("u"))
    return g.select(F.transform("u", lambda x: x / float(steps)).alias("w"))


def choose_weights(wide: DataFrame, names: Sequence[str], cfg: PortfolioConfig = PortfolioConfig(), caps: dict[str, float] | None = None) -> DataFrame:
    """Best grid vector per method, with capacity caps and cash.

    Every vector is scored for all methods in one parallel pass.
    """
    k = len(names)
    cap = max(cfg.max_weight, 1.0 / k)
    most = max(1, int(round(cap * cfg.steps)), -(-cfg.steps // k))
    col = lambda n: F.col(f"`{n}`")
    stats = wide.agg(F.struct(F.array(*[F.avg(col(n)) for n in names]).alias("mu"), F.array(*[F.array(*[F.covar_pop(col(a), col(b)) + (cfg.ridge if a == b else 0.0) for b in names]) for a in names]).alias("cov")).alias("v")).scalar()
    g = weight_grid(wide.sparkSession, k, cfg.steps, most).withColumn("_s", stats)
    w, mu, cov = F.col("w"), F.col("_s.mu"), F.col("_s.cov")
    idx = range(k)
    add = lambda xs: sum(xs[1:], xs[0])
    mrc = [add([cov[i][j] * w[j] for j in idx]) for i in idx]
    g = g.withColumns({"_ret": add([mu[i] * w[i] for i in idx]), "_var": add([w[i] * mrc[i] for i in idx]), "_far": add([(w[i] - 1.0 / k) * (w[i] - 1.0 / k) for i in idx])})
    vol = F.sqrt(F.col("_var"))
    rc = [w[i] * mrc[i] / F.sqrt(F.col("_var") + 1e-12) for i in idx]
    even = add(rc) / float(k)
    gaps = add([(x - even) * (x - even) for x in rc])
    over = F.exists(w, lambda x: x > max(cfg.kelly_cap, 1.0 / k) + 1e-9)
    objective = {
        "risk_parity": gaps,
        "mean_variance": -(F.col("_ret") - 0.5 * cfg.risk_aversion * F.col("_var") - cfg.turnover_penalty * F.col("_far")),
        "max_sharpe": -((F.col("_ret") - cfg.risk_free) / (vol + 1e-12) - cfg.turnover_penalty * F.col("_far")),
        "kelly": F.when(over, F.lit(None)).otherwise(-(F.col("_ret") - 0.5 * F.col("_var"))),
    }
    best = g.agg(*[F.min_by("w", F.when(o.isNotNull(), F.struct(F.round(o, 15), F.col("w")))).alias(m) for m, o in objective.items()])
    rows = best.select(F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("w")) for m in METHODS])))
    limit = {n: min(max((caps or {}).get(n, float("inf")) / max(1.0, cfg.capital), 0.0), cap) for n in names}
    flat = rows.select("method", F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col("w")[i].alias("raw"), lit(limit[n]).alias("capacity_weight_cap")) for i, n in enumerate(names)])))
    flat = flat.withColumn("weight", F.least("raw", "capacity_weight_cap") if caps else F.col("raw")).withColumn("capacity_bound", F.when(F.col("weight") >= F.col("capacity_weight_cap") - 1e-10, 1).otherwise(0))
    cash = flat.groupBy("method").agg(F.greatest(lit(0), 1.0 - F.sum("weight")).alias("weight")).select("method", F.lit("cash").alias("strategy"), "weight")
    return flat.drop("raw").unionByName(cash, allowMissingColumns=True)


def portfolio_series(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Compounded equity and drawdown per method."""
    r = returns.join(F.broadcast(weights.where(F.col("strategy") != "cash").select("method", "strategy", "weight")), "strategy")
    p = r.groupBy("method", "ts").agg(F.sum(F.col("ret") * F.col("weight")).alias("portfolio_ret"))
    c = equity_curve(p.withColumn("_l", F.log1p("portfolio_ret")), "_l", ["method"], 0.0)
    c = c.select("method", "ts", F.expm1("pnl").alias("portfolio_ret"), (F.exp("equity") * CAPITAL).alias("portfolio_equity"), (F.exp(F.col("equity") - F.col("peak")) - 1.0).alias("portfolio_drawdown"))
    return c


def portfolio_summary(series: DataFrame, weights: DataFrame) -> DataFrame:
    s = series.groupBy("method").agg(
        sharpe(F.col("portfolio_ret")).alias("portfolio_sharpe"), F.min("portfolio_drawdown").alias("portfolio_max_drawdown"), (F.max_by("portfolio_equity", "ts") - CAPITAL).alias("portfolio_total_pnl"), F.avg("portfolio_ret").alias("portfolio_mean_return"), F.stddev_pop("portfolio_ret").alias("portfolio_vol"), F.count(F.lit(1)).cast("double").alias("n_periods")
    )
    w = weights.groupBy("method").agg(F.sum(F.when(F.col("strategy") == "cash", F.col("weight")).otherwise(lit(0))).alias("cash_weight"), F.sum(F.when(F.col("strategy") != "cash", F.col("weight")).otherwise(lit(0))).alias("gross_allocated_weight"), F.count_if(F.col("strategy") != "cash").cast("double").alias("n_strategies"))
    return s.join(w, "method").withColumn("warning", F.when(F.col("n_periods") < 30, "insufficient_sample_n_periods_lt_30").otherwise(""))


def risk_report(trades: DataFrame, weights: DataFrame) -> DataFrame:
    """Concentration of weights and weighted exposure by market, category and time left.

    ``trades`` carries ``strategy``; ``weights`` is one method's rows.
    """
    w = weights.where(F.col("strategy") != "cash")
    head = w.agg(F.sum(F.col("weight") * F.col("weight")).alias("h"), F.count_if(F.col("weight") > 1e-6).cast("double").alias("n"))
    head = head.select(F.inline(F.array(F.struct(F.lit("strategy_concentration").alias("risk_type"), F.lit("hhi_strategy_weights").alias("metric"), F.col("h").alias("value")), F.struct(F.lit("strategy_concentration").alias("risk_type"), F.lit("n_active_strategies").alias("metric"), F.col("n").alias("value")))))
    size = F.abs(F.coalesce(number("notional"), number("target_notional"), lit(0)))
    t = trades.join(F.broadcast(w.where(F.col("weight") > 0).select("strategy", "weight")), "strategy").withColumn("exposure", size * F.col("weight"))
    kind = lambda name, c: F.struct(F.lit(name).alias("risk_type"), c.cast("string").alias("metric"))
    t = t.select("exposure", F.explode(F.array(kind("market", F.col("market_id")), kind("category_exposure", F.col("category")), kind("time_to_resolution_exposure", resolution_bucket(F.coalesce(number("time_to_resolution_h"), lit(9999)))))).alias("k")).select("exposure", "k.*")
    g = t.groupBy("risk_type", "metric").agg(F.sum("exposure").alias("e"))
    total = g.groupBy("risk_type").agg(F.sum("e").alias("_t"))
    g = g.join(total, "risk_type").withColumn("value", F.try_divide(F.col("e"), F.col("_t"))).select("risk_type", "metric", "value")
    m = g.where(F.col("risk_type") == "market").agg(F.sum(F.col("value") * F.col("value")).alias("h"), F.max("value").alias("x"))
    m = m.select(F.inline(F.array(F.struct(F.lit("market_concentration").alias("risk_type"), F.lit("hhi_markets").alias("metric"), F.col("h").alias("value")), F.struct(F.lit("market_concentration").alias("risk_type"), F.lit("top_market_exposure_share").alias("metric"), F.col("x").alias("value")))))
    cat = g.where(F.col("risk_type") == "category_exposure").orderBy(F.col("value").desc(), "metric").limit(10)
    return head.unionByName(m).unionByName(cat).unionByName(g.where(F.col("risk_type") == "time_to_resolution_exposure"))


def mark_to_market(fills: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Position, price pnl and exposure of given fills, per (ts, token) and per category.

    Fills are (ts, token_id, qty); the position is the running sum inside a token.
    """
    f = fills.groupBy("token_id", "ts").agg(F.sum("qty").alias("qty"))
    x = prices.join(f, ["token_id", "ts"], "left")
    x = prefix_sums(x, [F.col("ts").asc()], {"position": F.coalesce("qty", lit(0))}, ["token_id"])
    x = split_series(x, "token_id", "ts", 1)
    x = whole_series(x.withColumn("step", F.col("mid") - F.lag("mid").over(series_window(x, "token_id", "ts"))))
    x = x.withColumn("price_pnl", F.col("position") * F.coalesce("step", lit(0)))
    ts = x.groupBy("ts").agg(F.sum("price_pnl").alias("price_pnl"), F.sum(F.abs(F.col("position") * F.col("mid"))).alias("gross_exposure"), F.sum(F.col("position") * F.col("mid")).alias("net_exposure"))
    cat = x.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.sum("price_pnl").alias("pnl"))
    return ts, cat
