"""Data-quality reports over snapshots, pairs and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions.columns import flag, has, lit, number
from marketlab.operators.panel import EXTREME_MID
from marketlab.operators.ranking import quantiles, rank_rows


def share(cond: Column) -> Column:
    return F.avg(flag(cond))


def book_missingness(snaps: DataFrame) -> DataFrame:
    """Missing sides, extremes and means per market."""
    bid, ask = F.col("best_bid").isNotNull(), F.col("best_ask").isNotNull()
    m = F.coalesce("mid", lit(0.5))
    return snaps.where(F.col("market_id").isNotNull()).groupBy("market_id").agg(
        F.count("token_id").alias("n_snapshots"),
        share(~bid).alias("bid_missing_rate"),
        share(~ask).alias("ask_missing_rate"),
        share(bid & ask).alias("two_sided_rate"),
        share(F.coalesce("spread", lit(0)) <= 0).alias("spread_zero_rate"),
        share((m >= EXTREME_MID) | (m <= 1.0 - EXTREME_MID)).alias("mid_extreme_rate"),
        F.avg("mid").alias("avg_mid"),
        F.avg("spread").alias("avg_spread"),
        F.avg(F.coalesce("bid_depth", lit(0)) + F.coalesce("ask_depth", lit(0))).alias("avg_depth_total"),
    )


# fixed values: histogram edges (right-closed bins, the first also left-closed)
MID_EDGES = (0.0, 0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99, 1.0)
SPREAD_EDGES = (-1e-9, 0.0, 0.001, 0.002, 0.005, 0.01, float("inf"))


def bin_names(edges: Sequence[float]) -> list[str]:
    show = lambda v: "inf" if v == float("inf") else repr(float(v))
    return [f"({show(a)}, {show(b)}]" for a, b in zip(edges, edges[1:])]


def histogram_bin(x: Column, edges: Sequence[float]) -> Column:
    names = bin_names(edges)
    out = F.when(x < edges[0], None)
    for hi, n in zip(edges[1:], names):
        out = out.when(x <= hi, n)
    return out


def book_distribution(snaps: DataFrame) -> DataFrame:
    """Histograms of mid and spread and the quote-presence classes, one pass.

    Empty bins stay in the report.
    """
    presence = F.concat(F.lit("bid="), F.initcap(F.col("best_bid").isNotNull().cast("string")), F.lit("_ask="), F.initcap(F.col("best_ask").isNotNull().cast("string")))
    cell = lambda kind, b, ok: F.when(ok, F.struct(F.lit(kind).alias("distribution_type"), b.alias("bucket")))
    rows = snaps.select(
        F.explode(
            F.array_compact(
                F.array(
                    cell("mid", histogram_bin(F.col("mid"), MID_EDGES), F.col("mid").isNotNull()),
                    cell("spread", histogram_bin(F.col("spread"), SPREAD_EDGES), F.col("spread").isNotNull()),
                    cell("quote_presence", presence, F.lit(True)),
                )
            )
        ).alias("c")
    ).select("c.*")
    counts = rows.groupBy("distribution_type", F.coalesce("bucket", F.lit("nan")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    bins = [("mid", b) for b in bin_names(MID_EDGES)] + [("spread", b) for b in bin_names(SPREAD_EDGES)]
    frame = snaps.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("distribution_type"), F.lit(b).alias("bucket")) for k, b in bins])))
    full = frame.join(counts, ["distribution_type", "bucket"], "full_outer").withColumn("count", F.coalesce("n", F.lit(0)).cast("double"))
    total = full.groupBy("distribution_type").agg(F.greatest(lit(1), F.sum("count")).alias("_t"))
    return full.join(total, "distribution_type").select("distribution_type", "bucket", "count", (F.col("count") / F.col("_t")).alias("pct"))


def _pinned(m: Column) -> Column:
    return F.coalesce((m <= 0.01) | (m >= 0.99), F.lit(False))


def audit_summary(panel: DataFrame) -> DataFrame:
    """Nine global panel metrics."""
    b, a, m = F.col("best_bid"), F.col("best_ask"), F.col("mid")
    return panel.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.countDistinct("ts").cast("double").alias("n_unique_ts"),
        F.countDistinct("market_id").cast("double").alias("n_unique_markets"),
        share(m.isNull()).alias("missing_mid_rate"),
        share(b.isNull()).alias("missing_bid_rate"),
        share(a.isNull()).alias("missing_ask_rate"),
        share(b > a).alias("bid_gt_ask_rate"),
        share((m < 0) | (m > 1)).alias("mid_out_of_bounds_rate"),
        share(_pinned(m)).alias("pinned_mid_rate"),
    )


FIELDS = ("best_bid", "best_ask", "mid", "spread", "spread_bps", "bid_depth", "ask_depth", "liquidity_score", "depth_total", "prob_vol_6")


def field_missingness(panel: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Missing share and count per field, from one aggregate row."""
    use = [f for f in fields if f in panel.columns]
    row = panel.agg(F.count(F.lit(1)).alias("_n"), *[F.count(number(f)).alias(f) for f in use])
    return row.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), (1.0 - F.col(f) / F.col("_n")).alias("missing_rate"), F.col(f).cast("double").alias("non_null_count")) for f in use])))


def pinned_markets(panel: DataFrame) -> DataFrame:
    """Markets stuck at a bound, with the default exclusion flag."""
    depth = F.coalesce(number("depth_total"), F.coalesce("bid_depth", lit(0)) + F.coalesce("ask_depth", lit(0)))
    g = panel.where(F.col("market_id").isNotNull()).groupBy("market_id").agg(
        F.count(F.lit(1)).alias("n"),
        share(_pinned(F.col("mid"))).alias("pinned_rate"),
        F.avg("mid").alias("avg_mid"),
        F.avg(depth).alias("avg_depth_total"),
        share(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()).alias("two_sided_rate"),
    )
    out = (F.col("pinned_rate") >= 0.8) & ((F.col("two_sided_rate") < 0.5) | (F.col("avg_depth_total") < 50))
    return g.withColumn("exclude_default", F.when(out, 1).otherwise(0))


def pair_quality(pair: DataFrame, min_coverage: float = 0.80) -> DataFrame:
    """Coverage gate, aggregate metrics and per-market rows in one report.

    Every pair counts once for its market and once for the whole, so one
    grouped aggregate serves both levels.
    """
    both = pair.withColumn("grp", F.explode(F.array(F.concat(F.lit("m"), F.col("market_id").cast("string")), F.lit("*"))))
    g = both.groupBy("grp").agg(
        F.first("market_id").alias("market_id"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("market_id").alias("mk"),
        share(F.col("both_legs_present")).alias("cov"),
        share(F.col("both_legs_two_sided")).alias("two"),
        *[share(F.col(f"best_{q}_{s}").isNull()).alias(f"{s}_missing_{q}_rate") for s in ("yes", "no") for q in ("bid", "ask")],
    )
    med_cols = ("spread_yes", "spread_no", "depth_yes", "depth_no", "min_pair_depth")
    med = quantiles(both, {c: [0.5] for c in med_cols}, ["grp"]).groupBy("grp").agg(*[F.max(F.when(F.col("field") == c, F.col("value"))).alias(f"{c}_median") for c in med_cols])
    g = g.join(med, "grp", "left")
    zero = lambda c: F.coalesce(c, lit(0))
    metrics = {
        "both_legs_coverage": F.col("cov"),
        "both_legs_two_sided_rate": F.col("two"),
        **{f"{s}_missing_{q}_rate": F.col(f"{s}_missing_{q}_rate") for s in ("yes", "no") for q in ("bid", "ask")},
        **{f"{c}_median": zero(F.col(f"{c}_median")) for c in med_cols},
        "snapshot_pairs": F.col("n").cast("double"),
        "markets_with_pairs": F.col("mk").cast("double"),
    }
    whole = F.array(*[F.struct(F.lit("aggregate").alias("level"), F.lit(k).alias("metric"), v.alias("value"), (lit(min_coverage) if k == "both_legs_coverage" else F.lit(None).cast("double")).alias("required_min")) for k, v in metrics.items()])
    single = F.array(F.struct(F.lit("market").alias("level"), F.lit("per_market").alias("metric"), F.col("cov").alias("value"), lit(min_coverage).alias("required_min")))
    rows = g.withColumn("_r", F.explode(F.when(F.col("grp") == "*", whole).otherwise(single)))
    is_market = F.col("grp") != "*"
    below = F.col("_r.required_min").isNotNull() & (F.col("_r.value") < F.col("_r.required_min"))
    only = lambda c: F.when(is_market, F.col(c))
    return rows.select(
        "_r.level",
        "_r.metric",
        only("market_id").alias("market_id"),
        "_r.value",
        "_r.required_min",
        F.when(below, 0).otherwise(1).alias("passed"),
        F.when(below & is_market, "low_both_legs_coverage").when(below, "both_legs_coverage_below_threshold").otherwise("").alias("reason"),
        only("n").alias("n_snapshot_pairs"),
        only("cov").alias("both_legs_coverage"),
        only("two").alias("both_legs_two_sided_rate"),
        *[only(f"{s}_missing_{q}_rate").alias(f"{s}_missing_{q}_rate") for s in ("yes", "no") for q in ("bid", "ask")],
        *[only(f"{c}_median").alias(f"{c}_median") for c in ("spread_yes", "spread_no", "min_pair_depth")],
    )


def legs_coverage(snapshots: DataFrame, outcomes: DataFrame, hours: float | None = 24) -> DataFrame:
    """Share of recent (ts, market) pairs that show both legs."""
    s = snapshots
    if hours:
        s = s.where(F.col("snapshot_ts") >= snapshots.agg(F.max("snapshot_ts")).scalar() - F.make_dt_interval(hours=F.lit(int(hours))))
    o = outcomes.select("market_id", "token_id", F.lower(F.trim(F.coalesce("outcome_label", F.lit("")))).alias("lab"))
    x = s.join(o, ["market_id", "token_id"], "left").groupBy("snapshot_ts", "market_id").agg(F.max(flag(F.col("lab") == "yes")).alias("y"), F.max(flag(F.col("lab") == "no")).alias("n"))
    return x.agg(F.coalesce(share((F.col("y") == 1) & (F.col("n") == 1)), lit(0)).alias("both_legs_coverage"))


def time_depth(snapshots: DataFrame) -> DataFrame:
    return snapshots.agg(F.countDistinct("snapshot_ts").alias("n_unique_ts"), F.min("snapshot_ts").alias("ts_min"), F.max("snapshot_ts").alias("ts_max"))


def thirds(frame: DataFrame, tie: Sequence[str], at_least: int = 1) -> DataFrame:
    """Rows of the first and the last third by time, marked early / late.

    Positions come from a distributed rank; very small frames overlap.
    """
    ranked = rank_rows(frame, [F.col("ts").asc(), *[F.col(c).asc() for c in tie]], (), "_rn", "_n")
    cut = F.greatest(F.lit(at_least), F.floor(F.col("_n") / 3))
    parts = F.array_compact(F.array(F.when(F.col("_rn") <= cut, "early"), F.when(F.col("_rn") > F.col("_n") - cut, "late")))
    return ranked.withColumn("part", F.explode(parts)).drop("_rn", "_n")


def stationarity(panel: DataFrame, tie: Sequence[str] = ("token_id",)) -> DataFrame:
    """Head against tail means of spread, liquidity and volatility."""
    liq = "liquidity_log" if has(panel, "liquidity_log") else "liquidity_score"
    cols = {"spread_bps": "spread_bps", "liquidity": liq, "volatility": "prob_vol_6"}
    t = thirds(panel.where(F.col("ts").isNotNull()).select("ts", *tie, *[F.col(c).alias(f"_{k}") for k, c in cols.items()]), tie)
    mean = lambda k, part: F.coalesce(F.avg(F.when(F.col("part") == part, number(f"_{k}"))), lit(0))
    row = t.agg(*[mean(k, p).alias(f"{k}_{p}") for k in cols for p in ("early", "late")])
    long = row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}_early").alias("early_mean"), F.col(f"{k}_late").alias("late_mean")) for k in cols])))
    long = long.withColumns({"check_group": F.lit("stationarity"), "drift_abs": F.col("late_mean") - F.col("early_mean")})
    long = long.withColumn("drift_ratio", F.abs("drift_abs") / (F.abs("early_mean") + 1e-9))
    return long.withColumn("status", F.when(F.col("drift_ratio") > 1, "warning_regime_drift").otherwise("ok"))


def integrity(panel: DataFrame, min_ts: int = 500, min_markets: int = 200, min_rows: int = 50_000, strategy_report: DataFrame | None = None, folds: DataFrame | None = None, min_test_trades: int = 300, min_fold_trades: int = 50, tie: Sequence[str] = ("token_id",)) -> DataFrame:
    """Depth and trade-count minimums with drift rows; a gate reads ``min(passed)``."""
    row = panel.agg(F.countDistinct("ts").alias("t"), F.countDistinct("market_id").alias("m"), F.count(F.lit(1)).alias("r"))

    def check(group: str, metric: str, value: Column, need: float, why: str) -> Column:
        ok = value >= need
        return F.struct(
            F.lit(group).alias("check_group"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), lit(need).alias("required_min"), F.when(ok, 1).otherwise(0).alias("passed"), F.greatest(lit(0), need - value.cast("double")).alias("missing_qty"), F.when(ok, "").otherwise(why).alias("reason")
        )

    out = row.select(
        F.inline(
            F.array(
                check("data_depth", "unique_timestamps", F.col("t"), min_ts, "need_more_time_slices"),
                check("data_depth", "unique_markets", F.col("m"), min_markets, "need_more_market_coverage"),
                check("data_depth", "total_snapshots", F.col("r"), min_rows, "need_more_snapshots"),
            )
        )
    )
    drift = stationarity(panel, tie).select("check_group", "metric", F.col("late_mean").alias("value"), F.lit(None).cast("double").alias("required_min"), F.lit(1).alias("passed"), lit(0).alias("missing_qty"), F.col("status").alias("reason"), "early_mean", "late_mean", "drift_abs", "drift_ratio")
    out = out.unionByName(drift, allowMissingColumns=True)
    if strategy_report is not None:
        m = strategy_report.agg(F.coalesce(F.max(number("test_trade_count")), lit(0)).alias("v"))
        out = out.unionByName(m.select(F.inline(F.array(check("trade_counts", "max_strategy_test_trades", F.col("v"), min_test_trades, "need_more_trades_or_looser_filters")))), allowMissingColumns=True)
    if folds is not None:
        ok = folds.where(F.col("status") == "ok") if has(folds, "status") else folds
        m = ok.agg(F.coalesce(F.min(number("trade_count")), lit(0)).alias("v"))
        out = out.unionByName(m.select(F.inline(F.array(check("trade_counts", "min_valid_fold_trades", F.col("v"), min_fold_trades, "walkforward_fold_too_sparse")))), allowMissingColumns=True)
    return out


def panel_sanity(panel: DataFrame, missingness: DataFrame) -> DataFrame:
    """Coverage row of the panel with the mean book missingness."""
    m = missingness.agg(F.struct(F.avg("bid_missing_rate").alias("b"), F.avg("ask_missing_rate").alias("a"), F.avg("two_sided_rate").alias("t"))).scalar()
    return panel.agg(
        F.countDistinct("ts").cast("double").alias("n_unique_ts"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.countDistinct("market_id").cast("double").alias("markets_covered"),
        F.countDistinct("token_id").cast("double").alias("tokens_covered"),
        F.count(F.lit(1)).cast("double").alias("rows"),
    ).withColumns({"missing_best_bid_rate": m["b"], "missing_best_ask_rate": m["a"], "two_sided_rate": m["t"]})
