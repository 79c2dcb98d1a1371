"""Time splits, labels, walk-forward folds and validation rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions.columns import clip, flag, lit, number, ratio
from marketlab.functions.tails import signed_rank_p, two_sided, upper_tail
from marketlab.operators import resample as B
from marketlab.operators.ranking import average_rank, quantile_row, rank_rows
from marketlab.operators.summary import best_row, equity_metrics, stability
from marketlab.session import materialise


@dataclass(frozen=True)
class WalkConfig:
    n_folds: int = 4
    min_train_periods: int = 4
    min_train_samples: int = 120
    test_periods: int = 12
    min_test_trades: int = 20
    embargo_periods: int = 1
    min_train_trades: int = 20


# ------------------------------------------------------------------ splits


def split_time(df: DataFrame, train_ratio: float) -> Column:
    """Cut-off instant (microseconds) at a quantile of the row times."""
    return quantile_row(df.select(F.unix_micros("ts").cast("double").alias("us")), {"c": ("us", train_ratio)}).scalar()


def time_split(df: DataFrame, train_ratio: float = 0.7) -> DataFrame:
    """Rows marked train (up to the cut-off) or test."""
    cut = split_time(df, train_ratio)
    return df.withColumn("split", F.when(F.unix_micros("ts") <= cut, "train").otherwise("test"))


# ------------------------------------------------------------------ labels


def move_labels(frame: DataFrame, horizon: int, quantile_list: Sequence[float], target: float = 0.35, low: float = 0.10, high: float = 0.90, tie: Sequence[str] = ("ts", "token_id")) -> tuple[DataFrame, DataFrame]:
    """Binary labels of future moves with the cut that best hits a target rate.

    Candidate cuts are quantiles of the move plus one percentile-rank cut;
    the best is inside the allowed band, closest to the target, and has two
    classes. Returns the labelled rows and a one-row diagnosis.
    """
    tgt = min(max(target, 0.01), 0.99)
    qs = [min(max(q, 0.0), 1.0) for q in quantile_list] + [1.0 - tgt]
    d = frame.withColumn("move", F.round(F.col(f"future_mid_{horizon}") - F.col("mid"), 12)).where(F.col("move").isNotNull())
    ranked = materialise(rank_rows(d, [F.col("move").asc(), *[F.col(c).asc() for c in tie]], (), "_rn", "_n"))
    cuts = quantile_row(ranked.select("move"), {f"q{i}": ("move", q) for i, q in enumerate(qs)})
    row = cuts.select(F.array(*[F.round(f"q{i}", 12) for i in range(len(qs))]).alias("v")).scalar()
    cut = 1.0 - tgt
    by_rank = F.round(F.col("_rn") / F.col("_n"), 12) >= round(cut, 12)
    r = ranked.withColumn("_cuts", row)
    rates = r.agg(F.count(F.lit(1)).alias("n"), *[F.avg(flag(F.col("move") > F.col("_cuts")[i])).alias(f"p{i}") for i in range(len(qs))], F.avg(flag(by_rank)).alias(f"p{len(qs)}"), F.first("_cuts").alias("_cuts"))

    def candidate(i: int) -> Column:
        p = F.col(f"p{i}")
        thr = F.col("_cuts")[i] if i < len(qs) else F.col("_cuts")[len(qs) - 1]
        uniq = F.when((p > 0) & (p < 1), 2).otherwise(1)
        out = F.when((p >= low) & (p <= high), 0).otherwise(1)
        return F.struct(out.alias("out"), F.round(F.abs(p - tgt), 12).alias("gap"), (-uniq).alias("neg"), F.lit(i).alias("no"), thr.alias("thr"), p.alias("rate"))

    best = rates.select("n", F.array_min(F.array(*[candidate(i) for i in range(len(qs) + 1)])).alias("b"))
    chosen = best.select("b").scalar()
    labelled = ranked.withColumn("_b", chosen).withColumn("label", F.when(F.col("_b.no") == len(qs), by_rank.cast("int")).otherwise((F.col("move") > F.col("_b.thr")).cast("int"))).drop("_b", "_rn", "_n")
    warn = F.when(F.col("b.neg") > -2, "degenerate_train_labels").when(F.col("b.out") == 1, "label_imbalance").otherwise("")
    diag = best.select(
        F.lit("future_price_move").alias("label_mode"), F.lit(f"future_mid_{horizon}").alias("label_source"), warn.alias("label_warning"), F.col("n").cast("double").alias("n_samples"), (-F.col("b.neg")).cast("double").alias("y_unique"), F.col("b.rate").alias("pos_rate"), F.col("b.thr").alias("move_threshold")
    )
    return labelled, diag


def outcome_labels(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels from resolved winners with their diagnosis."""
    y = frame.where(number("winner").isNotNull()).withColumn("label", number("winner").cast("int"))
    diag = y.agg(F.count(F.lit(1)).cast("double").alias("n_samples"), F.countDistinct("label").cast("double").alias("y_unique"), F.coalesce(F.avg("label"), lit(0)).alias("pos_rate"))
    return y, diag.select(F.lit("resolved_outcome").alias("label_mode"), F.lit("winner").alias("label_source"), F.when(F.col("y_unique") < 2, "degenerate_train_labels").otherwise("").alias("label_warning"), "n_samples", "y_unique", "pos_rate", lit(0).alias("move_threshold"))


def training_labels(frame: DataFrame, mode: str, horizon: int, quantile_list: Sequence[float], target: float, low: float, high: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """Labels by mode; auto prefers resolved outcomes when there are enough of both classes."""
    key = mode.lower().strip()
    if key == "resolved_outcome":
        return outcome_labels(frame)
    if key == "auto":
        y, diag = outcome_labels(frame)
        d = diag.first()  # one-row gate
        if d["y_unique"] >= 2 and d["n_samples"] >= min_samples:
            return y, diag
    return move_labels(frame, horizon, quantile_list, target, low, high)


def move_sizes(train: DataFrame, frame: DataFrame, target: str) -> DataFrame:
    """Expected absolute move per category from the training rows, with a global fallback."""
    m = F.abs(number(target) - number("mid"))
    overall = F.coalesce(clip(train.agg(F.avg(m)).scalar(), 1e-4, 0.25), lit(0.01))
    per = train.where(F.col("category").isNotNull()).groupBy("category").agg(F.avg(m).alias("_m"))
    return frame.join(per, "category", "left").withColumn("expected_move_size", clip(F.coalesce("_m", overall), 1e-4, 0.40)).drop("_m")


def fold_labels(train: DataFrame, keys: Sequence[str], horizon: int, quantile_list: Sequence[float], target: float = 0.35, low: float = 0.10, high: float = 0.90, min_samples: int = 200, tie: Sequence[str] = ("ts", "token_id")) -> DataFrame:
    """Label mode, positive rate and number of classes per key, in one pass.

    Resolved outcomes count when there are enough of both classes, else the
    best move cut of each key is judged as in :func:`move_labels`.
    """
    from marketlab.operators.ranking import quantile_groups

    tgt = min(max(target, 0.01), 0.99)
    qs = [min(max(q, 0.0), 1.0) for q in quantile_list] + [1.0 - tgt]
    d = train.withColumn("move", F.round(F.col(f"future_mid_{horizon}") - F.col("mid"), 12)).where(F.col("move").isNotNull()).select(*keys, *tie, "move")
    ranked = rank_rows(d, [F.col("move").asc(), *[F.col(c).asc() for c in tie]], keys, "_rn", "_n")
    cuts = quantile_groups(d.select(*keys, "move"), keys, {f"q{i}": ("move", q) for i, q in enumerate(qs)})
    by_rank = F.round(F.col("_rn") / F.col("_n"), 12) >= round(1.0 - tgt, 12)
    r = ranked.join(cuts, list(keys)).groupBy(*keys).agg(*[F.avg(flag(F.col("move") > F.round(f"q{i}", 12))).alias(f"p{i}") for i in range(len(qs))], F.avg(flag(by_rank)).alias(f"p{len(qs)}"))

    def candidate(i: int) -> Column:
        p = F.col(f"p{i}")
        return F.struct(F.when((p >= low) & (p <= high), 0).otherwise(1).alias("out"), F.round(F.abs(p - tgt), 12).alias("gap"), F.when((p > 0) & (p < 1), -2).otherwise(-1).alias("neg"), F.lit(i).alias("no"), p.alias("rate"))

    moves = r.select(*keys, F.array_min(F.array(*[candidate(i) for i in range(len(qs) + 1)])).alias("b"))
    won = number("winner") if "winner" in train.columns else F.lit(None).cast("double")
    res = train.groupBy(*keys).agg(F.count(won).alias("_n"), F.countDistinct(won).alias("_u"), F.avg(won).alias("_r"))
    known = (F.col("_u") >= 2) & (F.col("_n") >= min_samples)
    return res.join(moves, list(keys), "left").select(
        *keys,
        F.when(known, "resolved_outcome").otherwise("future_price_move").alias("label_mode_train"),
        F.when(known, F.col("_r")).otherwise(F.coalesce("b.rate", lit(0))).alias("label_pos_rate_train"),
        F.when(known, F.col("_u").cast("double")).otherwise(F.coalesce(-F.col("b.neg").cast("double"), lit(0))).alias("label_y_unique_train"),
    )


# ------------------------------------------------------------- walk forward


def time_index(df: DataFrame) -> DataFrame:
    """Distinct instants with their 0-based position."""
    ts = rank_rows(df.select("ts").where(F.col("ts").isNotNull()).distinct(), [F.col("ts").asc()], (), "_rn", "n_ts")
    return ts.select("ts", (F.col("_rn") - 1).alias("idx"), "n_ts")


def fold_plan(df: DataFrame, cfg: WalkConfig) -> DataFrame:
    """Train and test bounds per fold, by position on the time index."""
    t = time_index(df).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_folds - 1))))
    size = F.greatest(F.lit(cfg.min_train_periods), F.floor((F.col("n_ts") - cfg.embargo_periods - cfg.test_periods) / cfg.n_folds)).cast("long")
    t = t.withColumns({"size": size, "start": (F.col("fold") * max(1, cfg.test_periods)).cast("long")})
    gate = (F.col("n_ts") >= cfg.min_train_periods + cfg.test_periods + cfg.embargo_periods + 1) & (F.col("start") <= F.col("n_ts") - F.col("size") - cfg.embargo_periods - cfg.test_periods)
    test0 = F.col("start") + F.col("size") + cfg.embargo_periods
    train = (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + F.col("size"))
    test = (F.col("idx") >= test0) & (F.col("idx") < test0 + cfg.test_periods)
    edge = lambda fn, c: fn(F.when(c, F.col("ts")))
    return t.where(gate & (train | test)).groupBy("fold").agg(
        edge(F.min, train).alias("train_start"), edge(F.max, train).alias("train_end"), edge(F.min, test).alias("test_start"), edge(F.max, test).alias("test_end")
    )


def fold_rows(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with each fold and role they belong to.

    The plan has a handful of rows and is attached as an array scalar.
    """
    bounds = plan.agg(F.array_sort(F.collect_list(F.struct("fold", "train_start", "train_end", "test_start", "test_end")))).scalar()
    x = df.withColumn("_f", F.explode(bounds))
    train = F.col("ts").between(F.col("_f.train_start"), F.col("_f.train_end"))
    test = F.col("ts").between(F.col("_f.test_start"), F.col("_f.test_end"))
    return x.where(train | test).withColumns({"fold": F.col("_f.fold"), "role": F.when(train, "train").otherwise("test")}).drop("_f")


_CELL = ("fold", "threshold", "holding_period")


def fold_summaries(trades: DataFrame) -> DataFrame:
    """Trade count, expectancy and equity metrics per fold, role and cell."""
    k = ["role", *_CELL]
    base = trades.groupBy(*k).agg(F.count(F.lit(1)).cast("double").alias("trade_count"), F.avg("trade_return").alias("expectancy"), F.avg(flag(F.col("trade_return") > 0)).alias("win_rate"), F.sum("net_pnl").alias("total_pnl"))
    return base.join(equity_metrics(trades, k), k)


def walk_forward(signals: DataFrame, trades: DataFrame, cfg: WalkConfig, label_horizon: int | None = None, tie: Sequence[str] = ("ts", "token_id")) -> dict[str, DataFrame]:
    """All folds in one pass over the grid trades.

    Models are not refitted: each fold only chooses threshold and holding
    period on its train window and is judged on its test window.
    """
    plan = materialise(fold_plan(signals, cfg))
    members = fold_rows(signals, plan)
    rows = members.select("fold", "role").groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"))
    t = materialise(fold_rows(trades, plan))
    s = materialise(fold_summaries(t))
    train = s.where(F.col("role") == "train").drop("role")
    best = best_row(train.where(F.col("trade_count") > 0), cfg.min_train_trades, keys=["fold"]).select("fold", "threshold", "holding_period", F.col("trade_count").alias("n_trades_train"))
    test = s.where(F.col("role") == "test").drop("role")
    if label_horizon is not None and f"future_mid_{label_horizon}" in signals.columns:
        rows = rows.join(fold_labels(members.where(F.col("role") == "train"), ["fold"], label_horizon, (0.60, 0.50, 0.40, 0.30, 0.20, 0.10, 0.0), tie=tie), "fold", "left")
    f = plan.join(rows, "fold", "left").join(best, "fold", "left").join(test, list(_CELL), "left")
    few_rows = F.coalesce("n_train", F.lit(0)) < cfg.min_train_samples
    none = F.coalesce("n_train", F.lit(0)) == 0
    count = F.coalesce("trade_count", lit(0))
    status = (
        F.when(none | (F.coalesce("n_test", F.lit(0)) == 0), "insufficient_data").when(few_rows, "insufficient_train_samples").when(F.col("threshold").isNull(), "no_train_candidate").when(count < cfg.min_test_trades, "insufficient_test_trades").otherwise("ok")
    )
    f = f.withColumn("status", status).withColumns({"valid_fold": F.col("status") == "ok", "invalid_reason": F.when(F.col("status") == "ok", "").otherwise(F.col("status")), "embargo_periods": lit(cfg.embargo_periods)})
    judged = F.col("status").isin("ok", "insufficient_test_trades")
    zero = lambda c, ok=judged: F.when(ok, F.coalesce(c, lit(0))).otherwise(lit(0)).alias(c)
    n_train = F.when(judged, F.coalesce("n_trades_train", lit(0))).when(F.col("status") == "insufficient_train_samples", F.col("n_train").cast("double")).otherwise(lit(0))
    n_test = F.when(judged, count).when(F.col("status") == "insufficient_train_samples", F.col("n_test").cast("double")).otherwise(lit(0))
    folds = materialise(
        f.select("fold", "train_start", "train_end", "test_start", "test_end", zero("threshold"), F.when(judged, F.col("holding_period")).otherwise(F.lit(0)).cast("long").alias("holding_period"), n_train.alias("n_trades_train"), n_test.alias("n_trades_test"), zero("trade_count"), zero("expectancy"), zero("sharpe"), zero("max_drawdown"), zero("total_pnl"), "status", "valid_fold", "invalid_reason", "embargo_periods", *[c for c in ("label_mode_train", "label_pos_rate_train", "label_y_unique_train") if c in f.columns])
    )
    ok = folds.where("valid_fold").select("fold", "threshold", "holding_period")
    kept = t.where(F.col("role") == "test").join(ok, list(_CELL), "left_semi")
    return {
        "folds": folds,
        "aggregate": roll_up(folds, cfg.embargo_periods),
        "test_trades": kept,
        "stability_time": stability(kept, "day"),
        "stability_category": stability(kept, "category"),
        "parameter_sensitivity": train,
    }


def roll_up(folds: DataFrame, embargo: float = 1) -> DataFrame:
    """One row over the folds; the reasons as sorted ``status:count`` text."""
    v = lambda fn, c: F.coalesce(fn(F.when(F.col("valid_fold"), F.col(c))), lit(0))
    bad = folds.where(F.col("status") != "ok").groupBy("status").agg(F.count(F.lit(1)).alias("c"))
    text = bad.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("c").cast("string")))), ";")).scalar()
    return folds.agg(
        F.count(F.lit(1)).cast("double").alias("folds"),
        F.count_if("valid_fold").cast("double").alias("valid_folds"),
        v(F.avg, "expectancy").alias("mean_expectancy"),
        v(F.stddev_pop, "expectancy").alias("std_expectancy"),
        v(F.avg, "sharpe").alias("mean_sharpe"),
        v(F.avg, "max_drawdown").alias("mean_drawdown"),
        v(F.avg, "trade_count").alias("mean_trade_count"),
        v(F.avg, "trade_count").alias("mean_trades_test"),
        F.count_if(~F.col("valid_fold")).cast("double").alias("invalid_folds"),
    ).withColumns({"invalid_reason_counts": F.coalesce(text, F.lit("")), "embargo_periods": lit(embargo)})


def heatmap(train: DataFrame, holdings: Sequence[int]) -> DataFrame:
    """Mean train expectancy per threshold, one column per holding period."""
    return train.groupBy("threshold").pivot("holding_period", [int(h) for h in holdings]).agg(F.avg("expectancy"))


# --------------------------------------------------------------- statistics


def one_sample_tests(returns: DataFrame, value: str = "trade_return") -> DataFrame:
    """t test against zero and signed-rank statistic, without p-values."""
    x = returns.where(F.col(value).isNotNull()).select(number(value).alias("x"))
    s = x.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.stddev_pop("x").alias("sp")).alias("v")).scalar()
    nz = x.where(F.col("x") != 0).withColumn("a", F.round(F.abs("x"), 12))
    r = average_rank(nz, "a", "rk")
    ties = nz.groupBy("a").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t"))).scalar()
    w = r.agg(F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("rk"))), lit(0)).alias("up"), F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("rk"))), lit(0)).alias("down"), F.count(F.lit(1)).alias("n_nonzero"))
    still = (s["n"] < 3) | F.coalesce(s["sp"] < 1e-12, F.lit(True))
    t = F.when(still, lit(0)).otherwise(ratio(s["m"], s["s"] / F.sqrt(s["n"].cast("double"))))
    return w.select(s["n"].alias("n_obs"), t.alias("ttest_stat"), F.when(still, lit(0)).otherwise(F.least("up", "down")).alias("wilcoxon_stat"), "n_nonzero", F.coalesce(ties, lit(0)).alias("tie_term"), still.alias("degenerate"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """Tail probabilities of the one-sample tests."""
    dof = (F.col("n_obs") - 1).cast("double")
    one = lambda c: F.when(F.col("degenerate"), lit(1)).otherwise(c)
    return tests.withColumns(
        {
            "ttest_pvalue": one(two_sided(F.col("ttest_stat"), dof)),
            "ttest_pvalue_pos": F.when(F.col("n_obs") >= 2, upper_tail(F.col("ttest_stat"), dof)).otherwise(lit(1)),
            "wilcoxon_pvalue": one(signed_rank_p(F.col("wilcoxon_stat"), F.col("n_nonzero").cast("double"), F.col("tie_term"))),
        }
    )


def validation_row(train: DataFrame, test: DataFrame, tie: Sequence[str] = ("ts", "token_id"), reps: int = 1000, perms: int = 2000) -> DataFrame:
    """Means, resampled intervals (the wider of plain and day blocks), tests and overfit gap."""
    one = lambda df: df.agg(F.first(F.struct(*df.columns))).scalar()
    boot, block = B.bootstrap(test, tie, reps), B.block_bootstrap(test, reps)
    tests = one_sample_tests(test)
    flip = B.sign_flip(test, tie, perms)
    tr = F.coalesce(train.agg(F.avg("trade_return")).scalar(), lit(0))
    te = F.coalesce(test.agg(F.avg("trade_return")).scalar(), lit(0))
    out = boot.withColumns({"_b": one(block), "_t": one(tests), "_f": one(flip), "train_mean_return": tr, "test_mean_return": te})
    out = out.select("*", "_b.*", "_t.*", "_f.*").drop("_b", "_t", "_f")
    out = out.withColumns({"mean_return_ci_low_iid": F.col("mean_return_ci_low"), "mean_return_ci_high_iid": F.col("mean_return_ci_high")})
    out = out.withColumns(
        {
            "mean_return_ci_low": F.least("mean_return_ci_low_iid", "mean_return_block_ci_low"),
            "mean_return_ci_high": F.greatest("mean_return_ci_high_iid", "mean_return_block_ci_high"),
            "overfit_gap": F.col("train_mean_return") - F.col("test_mean_return"),
            "permutation_pvalue": F.col("perm_pvalue"),
            "n_obs": F.col("n_obs").cast("double"),
        }
    )
    return out.withColumn("stability_score", F.greatest(lit(0), 1.0 - F.abs("overfit_gap")))


def hedged_columns(test: DataFrame, tie: Sequence[str] = ("ts", "market_id"), reps: int = 1000) -> DataFrame:
    """Mean and interval of the fully hedged subset."""
    h = test.where(number("fully_hedged", 0.0) >= 0.5)
    b = B.bootstrap(h, tie, reps)
    m = h.agg(F.struct(F.coalesce(F.avg("trade_return"), lit(0)).alias("m"), F.count(F.lit(1)).cast("double").alias("n")).alias("v")).scalar()
    return b.select(m["m"].alias("hedged_mean_return"), F.col("mean_return_ci_low").alias("hedged_mean_return_ci_low"), F.col("mean_return_ci_high").alias("hedged_mean_return_ci_high"), m["n"].alias("hedged_n"))


def advanced_row(trades: DataFrame, threshold: float, holding: int, reps: int = 1000, perms: int = 2000) -> DataFrame:
    """Sign-flip, reality check and overfitting probability of a grid."""
    one = lambda df: df.agg(F.first(F.struct(*df.columns))).scalar()
    long = materialise(B.candidate_returns(trades))
    key = f"thr={threshold:.4f}|hp={int(holding)}"
    dense = B.dense_returns(long)
    chosen = F.coalesce(long.agg(F.max(F.when(F.col("candidate") == key, F.col("candidate")))).scalar(), long.agg(F.min("candidate")).scalar())
    mine = dense.withColumn("_k", chosen).where(F.col("candidate") == F.col("_k")).select("ts", F.col("ret").alias("trade_return"), "candidate")
    perm = B.sign_flip(mine, ["ts"], perms)
    out = B.reality_check(long, reps).withColumns({"_p": one(perm), "_o": one(B.overfit_probability(long)), "chosen_candidate": chosen})
    return out.select("*", "_p.*", "_o.*").drop("_p", "_o")


def classifier_metrics(df: DataFrame, label: str = "label", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """AUC from tie-averaged ranks, log loss and Brier score."""
    d = df.select(*keys, F.col(label).cast("double").alias("y"), clip(number(p), 1e-6, 1 - 1e-6).alias("q")).withColumn("_q", F.round("q", 12))
    r = average_rank(d, "_q", "rk", keys)
    pos, neg = F.sum("y"), F.sum(1.0 - F.col("y"))
    auc = F.when((pos > 0) & (neg > 0), (F.sum(F.col("rk") * F.col("y")) - pos * (pos + 1) / 2.0) / (pos * neg)).otherwise(lit(0.5))
    loss = F.avg(-(F.col("y") * F.log("q") + (1.0 - F.col("y")) * F.log(1.0 - F.col("q"))))
    aggs = [auc.alias("auc"), loss.alias("log_loss"), F.avg((F.col("q") - F.col("y")) * (F.col("q") - F.col("y"))).alias("brier")]
    return r.groupBy(*keys).agg(*aggs) if keys else r.agg(*aggs)
