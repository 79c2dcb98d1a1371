"""Strategy runs: signal, split, model, filters, grid, choice, validation, gate.

A run returns named frames. Values reach the driver only where a choice is
made: the split label, the expected-value floor, the chosen grid cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from marketlab.functions.columns import has, lit, number
from marketlab.operators import costing as C, diagnostics as G, models as M, pairs as X, resample as B, scoring as S, signals as SG, summary as R, validate as V
from marketlab.operators.config import PairStrategyConfig, StrategyConfig
from marketlab.session import materialise

# fixed values: model inputs, column names of the feature panel
FEATURES = [
    "time_to_resolution_h", "prob_vol_6", "prob_vol_24", "depth_total", "spread_bps", "book_imbalance", "category_code", "market_age_h", "velocity_1", "velocity_3", "acceleration", "liquidity_log",
    "order_flow_imbalance_h", "trade_frequency_h", "vol_regime", "ttr_log", "ttr_sq", "near_resolution_24h", "near_resolution_72h", "momentum_decay", "related_prob_spread", "event_prob_dispersion", "category_prob_spread", "corr_cluster", "token_corr_category",
]
PAIR_FEATURES = [
    "edge_raw", "long_set_edge_raw", "short_set_edge_raw", "expected_cost_return", "expected_net_ev", "spread_yes_bps", "spread_no_bps", "depth_yes", "depth_no", "min_pair_depth", "sum_ask", "sum_bid", "min_fill_prob_pair", "expected_pair_fill", "time_to_resolution_h", "market_age_h", "pair_volatility", "pair_staleness_ms",
]


@dataclass
class Strategy:
    """A registered strategy: builds its signal frame from the shared inputs."""

    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    config: StrategyConfig = field(default_factory=StrategyConfig)
    features: Sequence[str] = tuple(FEATURES)
    tie: tuple[str, ...] = ("ts", "token_id")


LOW_GRID = (0.005, 0.01, 0.02, 0.04, 0.08)


def registry() -> dict[str, Strategy]:
    """Strategies by name; inputs are ``panel`` (YES panel), ``whale_flow``, ``pair_books``."""
    cfg = lambda t: StrategyConfig(thresholds=t)
    items = [
        Strategy("cross_market_inefficiency_v2", lambda x: SG.cross_market(x["panel"]), cfg((0.01, 0.02, 0.04, 0.08))),
        Strategy("liquidity_premium_v2", lambda x: SG.liquidity_premium(x["panel"]), cfg(LOW_GRID), [*FEATURES, "low_liq_score"]),
        Strategy("momentum_vs_mean_reversion_v2", lambda x: SG.momentum(x["panel"]), cfg(LOW_GRID), [*FEATURES, "regime_signal"]),
        Strategy("resolution_rule_mispricing_v2", lambda x: SG.rule_ambiguity(x["panel"]), cfg(LOW_GRID), [*FEATURES, "ambiguity_score"]),
        Strategy("whale_behavior_v2", lambda x: SG.whale_flow_signal(x["panel"], x["whale_flow"]), cfg(LOW_GRID), [*FEATURES, "whale_flow_z", "whale_alpha_z"]),
        Strategy("consistency_arb_v2", lambda x: X.pair_signals(x["pair_books"], PairStrategyConfig()), PairStrategyConfig(), PAIR_FEATURES, ("ts", "market_id")),
    ]
    return {s.name: s for s in items}


ALIASES = {"consistency_arb": "consistency_arb_v2", "cross_market": "cross_market_inefficiency_v2", "liquidity_premium": "liquidity_premium_v2", "momentum": "momentum_vs_mean_reversion_v2", "resolution_rules": "resolution_rule_mispricing_v2", "whale": "whale_behavior_v2"}


def strategy_by_name(name: str) -> Strategy:
    reg = registry()
    key = ALIASES.get(name, name)
    if key not in reg:
        raise ValueError(f"unknown strategy {name}; known: {sorted(reg)}")
    return reg[key]


# ------------------------------------------------------------------ models


def unavailable(df: DataFrame, names: Sequence[str], reason: str) -> DataFrame:
    """Model comparison rows when no model was trained."""
    rows = [F.struct(F.lit(n).alias("model"), lit(0.5).alias("auc"), lit(0.693).alias("log_loss"), lit(0.25).alias("brier"), lit(0).alias("folds"), F.lit(False).alias("selected"), F.lit(False).alias("usable"), F.lit(reason).alias("reason")) for n in names]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def apply_models(frame: DataFrame, cfg: StrategyConfig, features: Sequence[str], trees: int = 250) -> dict[str, DataFrame]:
    """Replace the heuristic signal by model output; guards keep the heuristic.

    ``frame`` carries ``split``. Models learn on train rows only.
    """
    key = cfg.model_type.lower().strip()
    diag0 = frame.sparkSession.range(1).select(F.lit(cfg.label_mode).alias("label_mode"), F.lit("none").alias("label_source"), F.lit("model_type_heuristic").alias("label_warning"), *[lit(0).alias(c) for c in ("n_samples", "y_unique", "pos_rate", "move_threshold")])
    use = [c for c in features if has(frame, c)]
    target = f"future_mid_{cfg.model_horizon}"
    stop = lambda why, diag=diag0: {"frame": frame, "model_comparison": unavailable(frame, cfg.model_candidates, why), "label_diagnostics": diag}
    if key == "heuristic" or not has(frame, target) or not use:
        return stop("model_type_heuristic" if key == "heuristic" else "no_features" if not use else f"missing_target:{target}")
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    labelled, diag = V.training_labels(train, cfg.label_mode, cfg.model_horizon, cfg.label_quantiles, cfg.label_target_rate, cfg.label_min_rate, cfg.label_max_rate, cfg.label_min_samples)
    d = diag.first()
    if d["n_samples"] < cfg.label_min_samples:
        return stop(f"insufficient_label_samples:{int(d['n_samples'])}<{cfg.label_min_samples}", diag)
    if d["y_unique"] < 2:
        return stop("degenerate_train_labels", diag)
    labelled = materialise(labelled)
    metrics = materialise(M.compare_models(labelled, use, cfg.model_candidates, cfg.cv_splits, trees))
    if key == "auto":
        names = [r["model"] for r in M.rank_models(metrics, 1).collect()]
    elif key == "ensemble":
        names = [r["model"] for r in M.rank_models(metrics, 2).collect()]
    else:
        names = [M.ALIASES.get(key, key)]
    fitted = [M.fit_model(n, labelled, use, trees) for n in names]
    out = frame
    for i, m in enumerate(fitted):
        out = m.predict(out).withColumnRenamed("p", f"_p{i}")
    p = sum([F.col(f"_p{i}") for i in range(1, len(fitted))], F.col("_p0")) / float(len(fitted))
    out = M.blend(out.withColumn("p", p).drop(*[f"_p{i}" for i in range(len(fitted))]), cfg.ensemble_blend, key == "ensemble")
    resolved = d["label_mode"] == "resolved_outcome"
    space = "OUTCOME_PROB" if resolved else "UP_MOVE_PROB"
    out = out.withColumns({"signal_target_type": F.lit(space), "model_proba_target_type": F.lit(space), "model_horizon": lit(cfg.model_horizon)})
    importances = [(m.name, f, v) for m in fitted for f, v in m.importance()]
    if resolved:
        out = out.withColumn("model_pred_outcome_prob_yes", F.col("model_proba"))
    else:
        out = V.move_sizes(train, out, target)
        if d["n_samples"] >= max(50, cfg.label_min_samples // 2):
            frames, imp = M.future_mid_ensemble(train, {"all": out}, use, target, min(trees, 120))
            out, space = frames["all"], "FUTURE_MID"
            importances += imp
    out = materialise(out.withColumn("model_target_type", F.lit(space)))
    chosen = F.col("model").isin(*names)
    metrics = metrics.withColumns({"selected": chosen, "usable": F.lit(True), "reason": F.lit(""), "label_mode": F.lit(d["label_mode"]), "model_target_type": F.lit(space), "model_horizon": lit(cfg.model_horizon)})
    imp_df = frame.sparkSession.createDataFrame(importances, "model string, feature string, importance double")
    return {"frame": out, "model_comparison": metrics, "label_diagnostics": diag, "model_feature_importance": imp_df}


# -------------------------------------------------------------------- runs


def pick_cell(summary: DataFrame, min_trades: int) -> tuple[float, int]:
    row = R.best_row(summary, min_trades).first()
    return (0.20, 1) if row is None or row["threshold"] is None else (float(row["threshold"]), int(row["holding_period"]))


def gate_row(name: str, bundle: dict[str, DataFrame], test: DataFrame) -> DataFrame:
    """Metrics of the deployment gate, one row, from the run's own reports."""
    one = lambda df, c: df.agg(F.first(c)).scalar()
    v, w, a, e = bundle["validation"], bundle["walkforward_summary"], bundle["advanced_validation"], bundle["ev_diagnostics"]
    st = S.stability_ratios(bundle["stability_time"])
    pess = bundle["execution_sensitivity"].where(F.col("execution_regime") == "pessimistic")
    folds = bundle["walkforward_folds"].where("valid_fold")
    return test.agg(F.count(F.lit(1)).cast("double").alias("n_test_trades")).withColumns(
        {
            "strategy": F.lit(name),
            "test_mean_return": one(v, "test_mean_return"),
            "ci_low": one(v, "mean_return_ci_low"),
            "ci_high": one(v, "mean_return_ci_high"),
            "ttest_pvalue": one(v, "ttest_pvalue"),
            "permutation_pvalue": one(v, "permutation_pvalue"),
            "n_walkforward_trades": F.coalesce(folds.agg(F.sum("trade_count")).scalar(), lit(0)),
            "walkforward_mean_expectancy": one(w, "mean_expectancy"),
            "walkforward_valid_folds": one(w, "valid_folds"),
            "stability_time_positive_ratio": one(st, "stability_time_positive_ratio"),
            "stability_score": one(st, "stability_score"),
            "pessimistic_avg_expected_ev": one(pess, "avg_expected_ev"),
            "white_pvalue": one(a, "white_pvalue"),
            "pbo": one(a, "pbo"),
            "ev_monotonic_pass": one(e, "ev_monotonic_pass"),
            "ev_spearman": one(e, "ev_spearman"),
            "hit_rate_pos_ev": one(e, "hit_rate_pos_ev"),
            "ev_model_valid": one(e, "ev_model_valid"),
            "top_market_profit_share": S.market_concentration(test).scalar(),
        }
    )


def evaluate(s: Strategy, signals: DataFrame, train: DataFrame, test: DataFrame, run_grid, cells, sens_regimes, sens_impacts, walk: V.WalkConfig, reps: int, perms: int, paired: bool, forest: int) -> dict[str, DataFrame]:
    """Grid on train, choice, grid on test, and every report of the chosen cell."""
    cfg = s.config
    tr = materialise(run_grid(train))
    te = materialise(run_grid(test))
    train_summary = materialise(R.full_grid(R.trade_summary(tr, paired=paired), cells))
    test_summary = materialise(R.full_grid(R.trade_summary(te, paired=paired), cells))
    thr, hp = pick_cell(train_summary, cfg.min_train_trades)
    if cfg.reselect_on_test:
        enough = test_summary.where(F.col("trade_count") >= cfg.min_test_trades_target)
        row = R.best_row(enough, cfg.min_test_trades_target).first()
        if row is not None and row["threshold"] is not None:
            thr, hp = float(row["threshold"]), int(row["holding_period"])
    chosen = (F.col("threshold") == lit(thr)) & (F.col("holding_period") == hp)
    ev_train, ev_test = tr.where(chosen), materialise(te.where(chosen))
    out: dict[str, DataFrame] = {"train_summary": train_summary.where(F.col("threshold") == lit(thr)), "test_summary": test_summary, "train_trades": tr.where(F.col("threshold") == lit(thr)), "test_trades": te}
    out["validation"] = materialise(V.with_p_values(V.validation_row(ev_train, ev_test, s.tie, reps, perms)))
    feats = [f for f in s.features if has(ev_test, f)]
    out["feature_importance"] = M.return_importance(ev_test, feats, trees=forest) if ev_test.take(1) else ev_test.sparkSession.createDataFrame([], "feature string, importance double")
    top = [r["feature"] for r in out["feature_importance"].limit(3).collect()]
    if top:
        cond = G.condition_tables(ev_test, top)
        out["strong_conditions"], out["weak_conditions"] = cond.where("side = 'strong'"), cond.where("side = 'weak'")
    out["capacity"] = R.capacity(ev_test, cfg.max_participation, cfg.impact_coeff)
    out["cost_decomposition"] = R.cost_decomposition(ev_test)
    out.update({k: v for k, v in G.bundle(signals, ev_test, feats, s.tie).items()})
    out["ev_diagnostics"] = materialise(out["ev_diagnostics"])
    out["advanced_validation"] = materialise(V.advanced_row(te, thr, hp, reps, perms))
    both = materialise(train.unionByName(test, allowMissingColumns=True))
    wf = V.walk_forward(both, tr.unionByName(te, allowMissingColumns=True), walk, None if paired else cfg.model_horizon, s.tie)
    out["walkforward_folds"], out["walkforward_summary"] = wf["folds"], materialise(wf["aggregate"])
    out["stability_time"], out["stability_category"] = wf["stability_time"], wf["stability_category"]
    out["parameter_sensitivity"] = V.heatmap(wf["parameter_sensitivity"], cfg.holding_periods)
    out["regime_splits"] = G.regime_splits(wf["test_trades"])
    reg = materialise(sens_regimes(test, thr, hp))
    imp = materialise(sens_impacts(test, thr, hp))
    sens = R.sensitivity(R.trade_summary(reg, paired=paired), "execution_regime").unionByName(R.sensitivity(R.trade_summary(imp, paired=paired), "impact_coeff_grid"))
    out["execution_sensitivity"] = materialise(sens)
    fills = ("expected_pair_fill", "realized_pair_fill_pct") if paired else ("expected_fill_pct", "actual_fill_proxy")
    out["execution_calibration"] = R.fill_calibration(reg, *fills, keys=["execution_regime"], tie=s.tie)
    out["deployment_metrics"] = materialise(gate_row(s.name, out, ev_test))
    out["deployment_readiness"] = S.deployment_gate(out["deployment_metrics"])
    out["tuned_params"] = signals.sparkSession.createDataFrame([(s.name, thr, hp)], "strategy string, threshold double, holding_period int")
    return out


def run_strategy(s: Strategy, inputs: dict[str, DataFrame], walk: V.WalkConfig | None = None, reps: int = 1000, perms: int = 2000, trees: int = 250, forest: int = 200) -> dict[str, DataFrame]:
    """Full run of a single-leg strategy; ``trees`` of the models, ``forest`` trees of the feature importance."""
    cfg = s.config
    walk = walk or V.WalkConfig(cfg.walk_folds, cfg.walk_min_train_periods, cfg.walk_min_train_samples, cfg.walk_test_periods, cfg.walk_min_test_trades, cfg.walk_embargo, cfg.min_train_trades)
    signals = materialise(s.build(inputs))
    if signals.count() < cfg.min_history_rows:
        return {"signals": signals, "label_diagnostics": signals.sparkSession.createDataFrame([("insufficient_history_rows",)], "label_warning string")}
    modelled = apply_models(materialise(V.time_split(signals, cfg.train_ratio)), cfg, list(s.features), trees)
    frame = materialise(C.strategy_value(modelled["frame"], cfg.costs(), cfg.model_horizon))
    half = lambda k: frame.where(F.col("split") == k)
    grid = materialise(R.ev_threshold_grid(half("train"), cfg.ev_grid, "train").unionByName(R.ev_threshold_grid(half("test"), cfg.ev_grid, "test")))
    best = R.best_row(grid.where("split = 'train'"), cfg.min_train_trades, "proxy_expectancy", "rows", tie=["ev_threshold"]).first()
    floor = float(best["ev_threshold"]) if best is not None and best["ev_threshold"] is not None else cfg.min_expected_net_ev
    opts = dict(top_confidence=cfg.top_confidence_pct, min_liquidity_log=cfg.min_liquidity_log, max_vol=cfg.max_prob_vol_6, max_spread=cfg.max_spread_bps, regimes=cfg.allowed_vol_regimes, min_edge=cfg.min_expected_edge)
    train, rep_a = S.filter_funnel(half("train"), "train", floor, **opts)
    test, rep_b = S.filter_funnel(half("test"), "test", floor, **opts)
    train, test = materialise(train), materialise(test)
    costs = cfg.costs()
    one = lambda thr, hp: replace(costs, holding_periods=(hp,))
    out = evaluate(
        s, frame, train, test,
        lambda f: C.run_grid(f, costs, cfg.thresholds),
        C.grid_of(costs, cfg.thresholds),
        lambda f, thr, hp: C.run_grid(f, one(thr, hp), (thr,), ("optimistic", "base", "pessimistic")),
        lambda f, thr, hp: C.run_grid(f, one(thr, hp), (thr,), ("base",), (0.03, 0.05, 0.08, 0.10, 0.15, 0.20)),
        walk, reps, perms, False, forest,
    )
    out.update({k: v for k, v in modelled.items() if k != "frame"})
    out.update({"signals": frame, "filter_impact": rep_a.unionByName(rep_b), "ev_threshold_grid": grid})
    return out


def run_pair_strategy(s: Strategy, inputs: dict[str, DataFrame], walk: V.WalkConfig | None = None, reps: int = 1000, perms: int = 2000, shuffles: int = 500, forest: int = 200) -> dict[str, DataFrame]:
    """Full run of the two-leg parity strategy, gated on its hedged subset."""
    cfg: PairStrategyConfig = s.config
    walk = walk or V.WalkConfig(cfg.walk_folds, cfg.walk_min_train_periods, cfg.walk_min_train_samples, cfg.walk_test_periods, cfg.walk_min_test_trades, cfg.walk_embargo, cfg.min_train_trades)
    signals = materialise(s.build(inputs))
    if signals.count() < cfg.min_history_rows:
        return {"signals": signals, "label_diagnostics": signals.sparkSession.createDataFrame([("insufficient_history_rows",)], "label_warning string")}
    frame = materialise(V.time_split(signals, cfg.train_ratio))
    half = lambda k: frame.where(F.col("split") == k)
    ahead = F.col("forward_ret_1")
    grid = materialise(R.ev_threshold_grid(half("train"), cfg.ev_grid, "train", ahead, True).unionByName(R.ev_threshold_grid(half("test"), cfg.ev_grid, "test", ahead, True)))
    best = R.best_row(grid.where("split = 'train'"), cfg.min_train_trades, "proxy_expectancy", "rows", tie=["ev_threshold"]).first()
    floor = float(best["ev_threshold"]) if best is not None and best["ev_threshold"] is not None else 0.0
    keep = (number("min_pair_depth", 0.0) >= cfg.pair_min_depth) & (number("min_fill_prob_pair", 0.0) >= cfg.min_pair_fill) & (number("expected_net_ev") >= floor)
    train, test = materialise(half("train").where(keep)), materialise(half("test").where(keep))
    costs = cfg.pair_costs()
    out = evaluate(
        s, frame, train, test,
        lambda f: X.run_pair_grid(f, costs, cfg.thresholds),
        X.pair_grid(costs, cfg.thresholds),
        lambda f, thr, hp: X.run_pair_grid(f, replace(costs, holding_periods=(hp,)), (thr,), ("optimistic", "base", "pessimistic")),
        lambda f, thr, hp: X.run_pair_grid(f, replace(costs, holding_periods=(hp,)), (thr,), ("base",), (0.03, 0.05, 0.08, 0.10, 0.15, 0.20)),
        walk, reps, perms, True, forest,
    )
    t = out["tuned_params"].first()
    ev = out["test_trades"].where((F.col("threshold") == lit(t["threshold"])) & (F.col("holding_period") == t["holding_period"]))
    out["hedged_validation"] = V.hedged_columns(ev, s.tie, reps)
    out["null_shuffle"] = B.shuffle_null(ev, s.tie, shuffles)
    # the gate of the parity strategy reads the hedged subset
    h = out["hedged_validation"].agg(F.first(F.struct("hedged_mean_return", "hedged_mean_return_ci_low", "hedged_mean_return_ci_high", "hedged_n")).alias("h")).scalar()
    m = out["deployment_metrics"].withColumn("_h", h)
    m = m.withColumns({"test_mean_return": F.col("_h.hedged_mean_return"), "ci_low": F.col("_h.hedged_mean_return_ci_low"), "ci_high": F.col("_h.hedged_mean_return_ci_high"), "n_test_trades": F.col("_h.hedged_n")}).drop("_h")
    out["deployment_readiness"] = S.deployment_gate(m)
    out.update({"signals": frame, "filter_impact": X.structural_funnel(half("train"), cfg, floor, "train").unionByName(X.structural_funnel(half("test"), cfg, floor, "test")), "ev_threshold_grid": grid, "model_comparison": unavailable(frame, cfg.model_candidates, "model_type_heuristic")})
    return out


def run_by_name(name: str, inputs: dict[str, DataFrame], **kw) -> dict[str, DataFrame]:
    """Single-strategy entry, pair strategy included."""
    s = strategy_by_name(name)
    if isinstance(s.config, PairStrategyConfig):
        kw.pop("trees", None)
        return run_pair_strategy(s, inputs, **kw)
    return run_strategy(s, inputs, **kw)


def report_row(name: str, b: dict[str, DataFrame]) -> DataFrame:
    """One report row per strategy from its named frames."""
    one = lambda df, c, d=None: F.coalesce(df.agg(F.first(c)).scalar(), lit(d)) if d is not None else df.agg(F.first(c)).scalar()
    t = b["tuned_params"].select(F.lit(name).alias("strategy"), "threshold", "holding_period")
    thr, hp = one(b["tuned_params"], "threshold"), one(b["tuned_params"], "holding_period")
    best = materialise(b["test_summary"].withColumns({"_t": thr, "_h": hp}).where((F.col("threshold") == F.col("_t")) & (F.col("holding_period") == F.col("_h")) & (F.col("execution_regime") == "base")))
    v, c, w, a = b["validation"], b["cost_decomposition"], b["walkforward_summary"], b["advanced_validation"]
    cost = c.select("*", S.cost_dominance(c).alias("cost_dominance_ratio"))
    overall = b["edge_attribution"].where("segment = 'overall'")
    gate = b["deployment_readiness"]
    label = b.get("label_diagnostics")
    sel = b["model_comparison"].where("selected").agg(F.array_join(F.array_sort(F.collect_list("model")), ",")).scalar()
    reason = b["model_comparison"].agg(F.max("reason")).scalar()
    s = {
        "model": F.when(F.length(F.coalesce(sel, F.lit(""))) > 0, sel).otherwise("heuristic"),
        "model_reason": F.coalesce(reason, F.lit("")),
        **{k: one(best, src, 0.0) for k, src in (("test_trade_count", "trade_count"), ("test_expectancy", "expectancy"), ("expectancy_per_trade", "expectancy_per_trade"), ("return_per_day", "return_per_day"), ("return_per_event", "return_per_event"), ("test_sharpe", "sharpe"), ("test_drawdown", "max_drawdown"))},
        "hedged_fill_rate": one(best, "hedged_fill_rate", 0.0) if has(best, "hedged_fill_rate") else lit(1),
        "cost_dominance_ratio": one(cost, "cost_dominance_ratio", 0.0),
        **{k: one(v, k, 0.0) for k in ("ttest_stat", "ttest_pvalue", "ttest_pvalue_pos", "stability_score", "overfit_gap")},
        "capacity_usd": one(b["capacity"], "estimated_daily_capacity_usd", 0.0),
        "bootstrap_mean_ci_low": one(v, "mean_return_ci_low", 0.0),
        "bootstrap_mean_ci_high": one(v, "mean_return_ci_high", 0.0),
        "walkforward_mean_expectancy": one(w, "mean_expectancy", 0.0),
        "walkforward_folds": one(w, "folds", 0.0),
        "walkforward_valid_folds": one(w, "valid_folds", 0.0),
        "perm_pvalue": one(a, "perm_pvalue", 1.0),
        "validation_permutation_pvalue": one(v, "permutation_pvalue", 1.0),
        "white_pvalue": one(a, "white_pvalue", 1.0),
        "pbo": one(a, "pbo"),
        "av_n_candidates": one(a, "n_candidates", 0.0),
        "av_n_obs": one(a, "white_n_obs", 0.0),
        "brier_improvement": one(overall, "brier_improvement", 0.0),
        "ev_calibration_beta": one(b["ev_diagnostics"], "ev_calibration_beta", 0.0),
        "ev_realized_corr": one(b["ev_diagnostics"], "ev_realized_corr", 0.0),
        **{k: one(c, k, 0.0) for k in ("gross_pnl", "fees", "spread_cost", "vol_slippage", "impact_cost", "net_pnl")},
        "pessimistic_avg_expected_ev": one(b["deployment_metrics"], "pessimistic_avg_expected_ev", -1.0),
        "deployment_n_test_trades": one(b["deployment_metrics"], "n_test_trades", 0.0),
        "deployment_n_walkforward_trades": one(b["deployment_metrics"], "n_walkforward_trades", 0.0),
        "deployment_ev_spearman": one(b["deployment_metrics"], "ev_spearman", 0.0),
        "deployable": F.coalesce(gate.where("criterion = 'deployment_decision'").agg(F.max("value")).scalar(), lit(0)),
    }
    if label is not None and has(label, "pos_rate"):
        s |= {"label_mode": one(label, "label_mode"), "label_warning": one(label, "label_warning"), "label_pos_rate": one(label, "pos_rate", 0.0), "label_n_samples": one(label, "n_samples", 0.0), "label_y_unique": one(label, "y_unique", 0.0)}
    return t.withColumns(s)
