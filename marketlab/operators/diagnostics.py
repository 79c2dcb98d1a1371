"""Signal diagnostics over trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlab.functions.columns import correlation, lit, number
from marketlab.operators.ranking import quantile_row


def units_comparable(df: DataFrame, expected: str = "expected_return", realized: str = "trade_return") -> DataFrame:
    """Do both columns look like return fractions? Ratio of their 95th percentiles."""
    q = quantile_row(df.select(F.abs(number(expected)).alias("e"), F.abs(number(realized)).alias("r")), {"e": ("e", 0.95), "r": ("r", 0.95)})
    ratio = F.col("e") / F.greatest(F.col("r"), lit(1e-9))
    return q.select(ratio.between(1e-3, 1e3).alias("comparable"), ratio.alias("p95_ratio"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with tie-averaged ranks."""
    from marketlab.operators.ranking import average_rank

    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_rank(average_rank(d, a, "_ra"), b, "_rb")
    return r.agg(F.count(F.lit(1)).alias("n"), correlation("_ra", "_rb").alias("spearman"))


# ---------------------------------------------------------------- per trade


def with_probabilities(trades: DataFrame) -> DataFrame:
    """Model and market probability of the traded side and the realised win."""
    from marketlab.functions import direction as D
    from marketlab.functions.columns import HIGH, LOW, clip, has, optional
    from marketlab.operators.costing import any_value, local_shift

    sig = optional(trades, "signal", 0.0)
    mid = clip(optional(trades, "mid", 0.5), LOW, HIGH)
    if not has(trades, "direction"):
        lab = D.label(sig)
    elif dict(trades.dtypes)["direction"] == "string":
        up = F.upper(F.trim("direction"))
        n = number("direction")
        lab = F.when(up.isin("LONG_YES", "LONGYES") | (n > 0), D.LONG_YES).when(up.isin("LONG_NO", "LONGNO") | (n < 0), D.LONG_NO).otherwise(D.FLAT)
    else:
        lab = D.label("direction")
    read = lambda c: F.coalesce(number(c), mid)
    up_prob = local_shift(mid, sig, clip(optional(trades, "confidence", 0.5), 0.05, 1.0))
    if has(trades, "model_pred_future_mid"):
        up_prob = F.when(any_value(trades, "model_pred_future_mid"), read("model_pred_future_mid")).otherwise(up_prob)
    if has(trades, "model_prob_up"):
        up_prob = read("model_prob_up")
    if has(trades, "model_pred_outcome_prob_yes"):
        up_prob = F.when(any_value(trades, "model_pred_outcome_prob_yes"), read("model_pred_outcome_prob_yes")).otherwise(up_prob)
    up_prob = clip(up_prob, LOW, HIGH)
    yes = lab == D.LONG_YES
    out = trades.withColumns(
        {
            "direction": lab,
            "market_prob_dir": F.when(yes, mid).otherwise(1.0 - mid),
            "model_prob_dir": F.when(yes, up_prob).otherwise(1.0 - up_prob),
            "realized_win": F.when(optional(trades, "trade_return", 0.0) > 0, lit(1)).otherwise(lit(0)),
            "signal_strength": F.abs(sig),
        }
    )
    return out.withColumns({"direction_sign": D.sign_of("direction"), "traded_side": D.side_of("direction"), "model_edge_prob": F.col("model_prob_dir") - F.col("market_prob_dir")})


def segment_metrics(t: DataFrame, segments: dict[str, object]) -> DataFrame:
    """Brier, log loss and returns per segment.

    Each trade lists the segments it belongs to; one grouped aggregate covers
    all of them.
    """
    from marketlab.functions.columns import HIGH, LOW, clip

    y = F.col("realized_win")

    def loss(p):
        q = clip(p, LOW, HIGH)
        return F.avg(-(y * F.log(q) + (1.0 - y) * F.log(1.0 - q)))

    sq = lambda p: F.avg((F.col(p) - y) * (F.col(p) - y))
    names = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) if k else F.lit("overall") for k, v in segments.items()]))
    g = t.withColumn("segment", F.explode(names)).groupBy("segment")
    out = g.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(number("trade_return", 0.0)).alias("avg_return"),
        F.avg("realized_win").alias("win_rate"),
        sq("model_prob_dir").alias("model_brier"),
        sq("market_prob_dir").alias("market_brier"),
        loss("model_prob_dir").alias("model_logloss"),
        loss("market_prob_dir").alias("market_logloss"),
        F.avg(number("model_edge_prob", 0.0)).alias("avg_model_edge_prob"),
    )
    return out.withColumn("brier_improvement", F.col("market_brier") - F.col("model_brier"))


def edge_attribution(trades: DataFrame) -> DataFrame:
    t = with_probabilities(trades)
    seg = {"": None, **{c: F.col(c) for c in ("category", "vol_regime", "is_low_liq_regime", "is_high_vol_regime") if c in t.columns}}
    return segment_metrics(t, seg)


TIE = ("ts", "token_id")


def model_vs_market(trades: DataFrame, tie: tuple[str, ...] = TIE) -> DataFrame:
    """Segment metrics by signal strength quintile and category."""
    from marketlab.operators.ranking import bin_rows

    t = bin_rows(with_probabilities(trades), "signal_strength", 5, tie, "strength_bin")
    seg = {"strength_bin": F.col("strength_bin")}
    if "category" in t.columns:
        seg["category"] = F.col("category")
    return segment_metrics(t, seg)


def calibration_curve(trades: DataFrame, bins: int = 10, tie: tuple[str, ...] = TIE) -> DataFrame:
    """Predicted against observed win rate in equal-count bins, model and market."""
    from marketlab.operators.ranking import bin_rows

    t = with_probabilities(trades)
    both = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(c).alias("pred")) for s, c in (("model", "model_prob_dir"), ("market", "market_prob_dir"))]))
    long = t.select(*tie, "realized_win", number("trade_return").alias("r"), both.alias("s")).select(*tie, "realized_win", "r", "s.*")
    b = bin_rows(long, "pred", bins, tie, "bin", ["source"])
    g = b.groupBy("source", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("pred").alias("avg_pred"), F.avg("realized_win").alias("observed_win_rate"), F.avg("r").alias("avg_return"))
    return g.withColumn("calibration_gap", F.col("avg_pred") - F.col("observed_win_rate"))


def signal_deciles(trades: DataFrame, bins: int = 10, tie: tuple[str, ...] = TIE) -> DataFrame:
    """Returns per equal-count bin of signal strength."""
    from marketlab.functions.columns import sharpe
    from marketlab.operators.ranking import bin_rows, quantile_groups

    ev = next((c for c in ("expected_net_return", "expected_return", "expected_ev") if c in trades.columns), None)
    t = bin_rows(with_probabilities(trades), "signal_strength", bins, tie, "signal_decile")
    t = t.select("signal_decile", number("trade_return", 0.0).alias("r"), (number(ev, 0.0) if ev else lit(0)).alias("ev"), number("model_edge_prob", 0.0).alias("e"))
    q = quantile_groups(t.select("signal_decile", "r"), ["signal_decile"], {"ret_p10": ("r", 0.1), "ret_p50": ("r", 0.5), "ret_p90": ("r", 0.9)})
    g = t.groupBy("signal_decile").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("r").alias("avg_return"), F.avg(F.when(F.col("r") > 0, lit(1)).otherwise(lit(0))).alias("win_rate"), sharpe(F.col("r")).alias("sharpe"), F.avg("ev").alias("avg_expected_ev"), F.avg("e").alias("avg_model_edge_prob")
    )
    return g.join(q, "signal_decile").withColumn("signal_decile", F.col("signal_decile").cast("double"))


def ev_diagnostics(trades: DataFrame, bins: int = 10, tie: tuple[str, ...] = TIE) -> DataFrame:
    """Deciles of expected value with monotonicity, correlation and validity."""
    from pyspark.sql import Window as W

    from marketlab.functions.columns import optional
    from marketlab.operators.ranking import bin_rows

    src = next((c for c in ("expected_net_return", "expected_return", "expected_ev") if c in trades.columns))
    t = trades.select(*tie, number(src, 0.0).alias("ev"), optional(trades, "trade_return", 0.0).alias("r"))
    b = bin_rows(t, "ev", bins, tie, "ev_bin")
    won = lambda c: F.avg(F.when(c > 0, lit(1)).otherwise(lit(0)))
    g = b.groupBy("ev_bin").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("ev").alias("avg_expected_ev"), F.avg("r").alias("avg_realized_return"), F.avg(F.col("r") - F.col("ev")).alias("ev_gap"), won(F.col("r")).alias("ev_hit_rate"))
    # at most ``bins`` rows from here on
    w = W.orderBy("avg_expected_ev", "ev_bin")
    rise = g.withColumn("_d", F.col("avg_realized_return") - F.lag("avg_realized_return").over(w))
    mono = rise.agg(F.struct(F.bool_and(F.coalesce(F.col("_d") >= -1e-12, F.lit(True))).alias("ok"), F.count(F.lit(1)).alias("k"), F.min("n").alias("low")).alias("v")).scalar()
    rho = spearman(t.select(F.round("ev", 12).alias("a"), F.round("r", 12).alias("b")), "a", "b").select("spearman").scalar()
    s = t.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.stddev_pop("ev").alias("se"), F.stddev_pop("r").alias("sr"), F.regr_slope("r", "ev").alias("beta"), correlation("ev", "r").alias("corr"), F.coalesce(F.avg(F.when(F.col("ev") > 0, F.when(F.col("r") > 0, lit(1)).otherwise(lit(0)))), lit(0)).alias("hit"), F.countDistinct(F.round("ev", 12)).alias("u")
        ).alias("v")
    ).scalar()
    usable = (s["n"] >= 5) & (s["se"] > 1e-12) & (s["sr"] > 1e-12)
    filled = (mono["k"] >= F.least(F.lit(5), F.greatest(F.lit(1), s["u"]))) & (mono["low"] > 0)
    num = lambda c: F.when(c, lit(1)).otherwise(lit(0))
    out = g.withColumns(
        {
            "ev_bin": F.col("ev_bin").cast("double"),
            "ev_calibration_beta": F.when(usable, s["beta"]).otherwise(lit(0)),
            "ev_realized_corr": F.when(usable, s["corr"]).otherwise(lit(0)),
            "ev_spearman": F.when(usable, rho).otherwise(lit(0)),
            "ev_monotonic_pass": num((mono["k"] >= 2) & mono["ok"]),
            "hit_rate_pos_ev": s["hit"],
            "n_trades": s["n"].cast("double"),
            "ev_expected_col": F.lit(src),
            "ev_bins_populated": mono["k"].cast("double"),
            "ev_min_bin_count": mono["low"],
            "ev_well_populated_bins": num(filled),
        }
    )
    valid = (F.col("ev_well_populated_bins") > 0) & ((F.col("n_trades") < 100) | (F.col("ev_spearman") >= 0))
    return out.withColumns({"ev_calibration_slope": F.col("ev_calibration_beta"), "ev_model_valid": num(valid)})


def feature_drift(frame: DataFrame, features: list[str], tie: tuple[str, ...] = ("token_id",), bins: int = 10) -> DataFrame:
    """First against last third: mean shift in deviations, stability index, flag."""
    from marketlab.operators.quality import thirds
    from marketlab.operators.ranking import quantiles

    use = [f for f in features if f in frame.columns]
    t = thirds(frame.select("ts", *tie, *use), tie, 10)
    long = t.select("part", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in use])).alias("s")).select("part", "s.*").where(F.col("value").isNotNull())
    early = long.where(F.col("part") == "early")
    m = long.groupBy("feature").agg(
        *[fn(F.when(F.col("part") == p, F.col("value"))).alias(n) for p, fn, n in (("early", F.avg, "mean_early"), ("late", F.avg, "mean_late"), ("early", F.stddev_pop, "_sd"), ("early", F.count, "_ne"), ("late", F.count, "_nl"))]
    ).where((F.col("_ne") >= 20) & (F.col("_nl") >= 20))
    probs = [i / bins for i in range(1, bins)]
    # bins - 1 inner edges per feature
    cuts = quantiles(early.select("feature", "value"), {"value": probs}, ["feature"]).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("cuts"))
    x = long.join(cuts, "feature")
    slot = F.size(F.filter("cuts", lambda c: F.round(F.col("value"), 12) >= F.round(c, 12)))
    h = x.groupBy("feature", slot.alias("slot")).agg(F.count_if(F.col("part") == "early").alias("e"), F.count_if(F.col("part") == "late").alias("l"))
    grid = m.select("feature", "_ne", "_nl", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("slot"))
    h = grid.join(h, ["feature", "slot"], "left")
    pe, pl = F.greatest(F.coalesce("e", F.lit(0)) / F.col("_ne"), lit(1e-6)), F.greatest(F.coalesce("l", F.lit(0)) / F.col("_nl"), lit(1e-6))
    psi = h.groupBy("feature").agg(F.sum((pl - pe) * F.log(pl / pe)).alias("psi"))
    out = m.join(psi, "feature").withColumn("mean_shift", F.col("mean_late") - F.col("mean_early"))
    out = out.withColumn("drift_z", F.col("mean_shift") / F.greatest(F.col("_sd"), lit(1e-6)))
    return out.withColumn("drift_flag", F.when((F.abs("drift_z") >= 0.5) | (F.col("psi") >= 0.2), lit(1)).otherwise(lit(0))).drop("_sd", "_ne", "_nl")


def condition_tables(trades: DataFrame, features: list[str]) -> DataFrame:
    """Returns in the top and bottom quartile of each feature."""
    from marketlab.operators.ranking import quantile_groups

    long = trades.select(number("trade_return").alias("r"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features])).alias("s")).select("r", "s.*").where(F.col("value").isNotNull())
    q = quantile_groups(long.select("feature", "value"), ["feature"], {"q25": ("value", 0.25), "q75": ("value", 0.75)})
    n = long.groupBy("feature").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 20)
    x = long.join(q.join(n, "feature"), "feature")
    v = F.round("value", 12)
    hit = F.array_compact(F.array(F.when(v >= F.round("q75", 12), F.struct(F.lit("strong").alias("side"), F.concat("feature", F.lit(">=Q75")).alias("condition"))), F.when(v <= F.round("q25", 12), F.struct(F.lit("weak").alias("side"), F.concat("feature", F.lit("<=Q25")).alias("condition")))))
    x = x.select("feature", "r", F.explode(hit).alias("h")).select("feature", "r", "h.*")
    return x.groupBy("side", "feature", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("avg_return"), F.avg(F.when(F.col("r") > 0, lit(1)).otherwise(lit(0))).alias("win_rate"))


def regime_splits(trades: DataFrame) -> DataFrame:
    """Performance in terciles of volatility, liquidity and time to resolution."""
    from marketlab.functions.columns import sharpe
    from marketlab.operators.ranking import quantile_groups

    groups = {"volatility": "prob_vol_6", "liquidity": "liquidity_log", "time_to_resolution": "time_to_resolution_h"}
    use = {g: c for g, c in groups.items() if c in trades.columns}
    long = trades.select(number("trade_return").alias("r"), F.explode(F.array(*[F.struct(F.lit(g).alias("regime_group"), F.round(number(c), 12).alias("x")) for g, c in use.items()])).alias("s")).select("r", "s.*").where(F.col("x").isNotNull() & F.col("r").isNotNull())
    size = long.groupBy("regime_group").agg(F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi")).where(F.col("_n") >= 10)
    q = quantile_groups(long.select("regime_group", "x"), ["regime_group"], {"q1": ("x", 0.33), "q2": ("x", 0.66)})
    x = long.join(size.join(q, "regime_group"), "regime_group")
    b = F.when(F.col("_lo") == F.col("_hi"), "all").when(F.col("x") <= F.col("q1"), "low").when(F.col("x") <= F.col("q2"), "mid").otherwise("high")
    return x.groupBy("regime_group", b.alias("regime_bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("avg_return"), F.avg(F.when(F.col("r") > 0, lit(1)).otherwise(lit(0))).alias("win_rate"), sharpe(F.col("r")).alias("sharpe"))


def bundle(signals: DataFrame, trades: DataFrame, features: list[str], tie: tuple[str, ...] = TIE) -> dict[str, DataFrame]:
    """All diagnostics of one strategy."""
    return {
        "edge_attribution": edge_attribution(trades),
        "calibration_curve": calibration_curve(trades, tie=tie),
        "signal_deciles": signal_deciles(trades, tie=tie),
        "feature_drift": feature_drift(signals, features, tuple(t for t in tie if t != "ts")),
        "model_vs_market": model_vs_market(trades, tie=tie),
        "ev_diagnostics": ev_diagnostics(trades, tie=tie),
    }
