"""Gate, scores, funnels, portfolios, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.catalog.edges import amb_of, book_pairs, pre_of, quotes_of, yes_hist
from marketlab.catalog.pairing import pair_trades_of
from marketlab.catalog.registry import CTES, memo, query
from marketlab.catalog.trading import CFG, chosen_of, grid_trades, modelled, signal_of, trades_of
from marketlab.functions.columns import lit
from marketlab.functions.tails import two_sided
from marketlab.operators import costing as C, models as M, pairs as X, portfolio as PF, reports as RP, scoring as S, studies as E, validate as V
from marketlab.session import materialise

# ------------------------------------------------------------------ funnel

_FUN = "rows avg_signal avg_expected_ev proxy_expectancy proxy_sharpe"
CTES["fun"] = "SELECT *, CASE WHEN NOT book_tradable > 0 THEN 0 WHEN NOT confidence >= (SELECT quantile_cont(confidence, 0.25) FROM sig) THEN 1 WHEN NOT spread_bps <= 1500 THEN 2 WHEN vol_regime NOT IN (0, 1) THEN 3 WHEN expected_net_ev < 0 THEN 4 ELSE 5 END AS reach FROM proxy0"
_STEPS = ("raw", "book_tradable_only", "top_confidence_0.75", "max_spread_bps", "allowed_vol_regimes", "min_expected_net_ev_0.000000")


@query(
    "p20_filter_funnel",
    "SELECT 'train' AS split, g.step::BIGINT AS step, g.filter, count(*)::DOUBLE AS rows, avg(abs(signal)) AS avg_signal, avg(expected_net_ev) AS avg_expected_ev, coalesce(avg(proxy), 0) AS proxy_expectancy, CASE WHEN count(proxy) >= 3 AND stddev_pop(proxy) > 0 THEN avg(proxy) / stddev_pop(proxy) * sqrt(8760) ELSE 0 END AS proxy_sharpe FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_STEPS))
    + ") AS g(step, filter) JOIN fun f ON f.reach >= g.step GROUP BY 2, 3",
    "fun",
    _FUN,
)
def p20(lake):
    v = memo(lake, "valued", lambda: C.strategy_value(modelled(signal_of(lake)), CFG))
    return S.filter_funnel(v, "train", 0.0, top_confidence=0.75, max_spread=1500.0, regimes=(0, 1))[1]


@query("p20_filtered_rows", "SELECT ts, token_id FROM fun WHERE reach = 5", "fun")
def p20b(lake):
    v = memo(lake, "valued", lambda: C.strategy_value(modelled(signal_of(lake)), CFG))
    return S.filter_funnel(v, "train", 0.0, top_confidence=0.75, max_spread=1500.0, regimes=(0, 1))[0].select("ts", "token_id")


# --------------------------------------------------------------- gate inputs

CTES["smet"] = """
SELECT strategy, avg(trade_return) AS test_mean_return, avg(trade_return) - 1.96 * stddev_samp(trade_return) / sqrt(count(*)) AS ci_low, avg(trade_return) + 1.96 * stddev_samp(trade_return) / sqrt(count(*)) AS ci_high, count(*)::DOUBLE AS n_test_trades,
 coalesce(avg(trade_return) FILTER (WHERE ts < TIMESTAMP '2024-01-15'), 0) AS walkforward_mean_expectancy, count(DISTINCT date_trunc('week', ts))::DOUBLE AS walkforward_valid_folds, avg(expected_ev) + 1 AS pessimistic_avg_expected_ev, CASE WHEN any_value(holding_period) <> 12 THEN avg((trade_return > 0)::INT) END AS pbo,
 CASE WHEN corr(expected_ev, trade_return) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ev_monotonic_pass, corr(expected_ev, trade_return) AS ev_spearman, sum(net_pnl) AS net_pnl
FROM (SELECT *, 'thr=' || printf('%.4f', threshold) || '|hp=' || holding_period::VARCHAR AS strategy FROM tr) GROUP BY 1"""
CTES["scon"] = "SELECT strategy, CASE WHEN sum(greatest(p, 0)) > 0 THEN max(greatest(p, 0)) / sum(greatest(p, 0)) ELSE (sum(p) > 0)::INT END AS top_market_profit_share FROM (SELECT 'thr=' || printf('%.4f', threshold) || '|hp=' || holding_period::VARCHAR AS strategy, market_id, sum(net_pnl) AS p FROM tr GROUP BY 1, 2) GROUP BY 1"


def named(trades):
    from marketlab.operators.resample import candidate_key

    return trades.withColumn("strategy", candidate_key(F.col("threshold"), F.col("holding_period")))


def metrics_of(lake):
    t = named(trades_of(lake))
    r = F.col("trade_return")
    half = 1.96 * F.stddev_samp(r) / F.sqrt(F.count(F.lit(1)).cast("double"))
    rho = F.corr("expected_ev", "trade_return")
    m = t.groupBy("strategy").agg(
        F.avg(r).alias("test_mean_return"),
        (F.avg(r) - half).alias("ci_low"),
        (F.avg(r) + half).alias("ci_high"),
        F.count(F.lit(1)).cast("double").alias("n_test_trades"),
        F.coalesce(F.avg(F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), r)), lit(0)).alias("walkforward_mean_expectancy"),
        F.countDistinct(F.date_trunc("week", "ts")).cast("double").alias("walkforward_valid_folds"),
        (F.avg("expected_ev") + 1.0).alias("pessimistic_avg_expected_ev"),
        F.when(F.max("holding_period") != 12, F.avg(F.when(r > 0, lit(1)).otherwise(lit(0)))).alias("pbo"),
        F.when(rho > 0, lit(1)).otherwise(lit(0)).alias("ev_monotonic_pass"),
        rho.alias("ev_spearman"),
        F.sum("net_pnl").alias("net_pnl"),
    )
    return m.join(S.market_concentration(t, ["strategy"]), "strategy")


_crit = [
    ("ci_lower_bound_positive", "ci_low", "ci_low > 0"),
    ("walkforward_mean_positive", "walkforward_mean_expectancy", "walkforward_mean_expectancy > 0"),
    ("walkforward_valid_folds_min", "walkforward_valid_folds", "walkforward_valid_folds >= 3"),
    ("test_mean_return_positive", "test_mean_return", "test_mean_return > 0"),
    ("test_trade_count_minimum", "n_test_trades", "n_test_trades >= 200"),
    ("pessimistic_execution_ev_nonnegative", "pessimistic_avg_expected_ev", "pessimistic_avg_expected_ev >= 0"),
    ("pbo_below_threshold", "pbo", "coalesce(pbo < 0.5, true)"),
    ("market_profit_concentration", "top_market_profit_share", "top_market_profit_share <= 0.4"),
    ("ev_deciles_monotonic", "ev_spearman", "(ev_monotonic_pass >= 0.5 AND ev_spearman >= 0.2)"),
]
_allok = " AND ".join(c for _, _, c in _crit)
_why = " || ".join(
    f"CASE WHEN NOT ({c}) THEN ';{n}' ELSE '' END"
    for c, n in (
        ("ci_low > 0", "ci_low<=0"), ("walkforward_mean_expectancy > 0", "wf_mean<=0"), ("walkforward_valid_folds >= 3", "valid_folds<3"), ("test_mean_return > 0", "test_mean<=0"), ("n_test_trades >= 200", "n_test<200"),
        ("pessimistic_avg_expected_ev >= 0", "pessimistic_ev<0"), ("coalesce(pbo < 0.5, true)", "pbo>=threshold"), ("top_market_profit_share <= 0.4", "market_profit_concentration"), ("ev_monotonic_pass >= 0.5", "ev_deciles_nonmonotonic"), ("ev_spearman >= 0.2", "ev_spearman<0.2"),
    )
)
CTES["gate"] = "SELECT * FROM smet JOIN scon USING (strategy)"
_gsql = " UNION ALL ".join([f"SELECT strategy, '{n}' AS criterion, {v}::DOUBLE AS value, {c} AS passed, '' AS decision FROM gate" for n, v, c in _crit])


@query(
    "p39_deployment_gate",
    f"{_gsql} UNION ALL SELECT strategy, 'summary', ({_allok})::INT::DOUBLE, {_allok}, CASE WHEN {_allok} THEN 'PASS' ELSE 'FAIL' END FROM gate UNION ALL SELECT strategy, 'deployment_decision', ({_allok})::INT::DOUBLE, {_allok}, CASE WHEN {_allok} THEN 'PASS' ELSE 'FAIL' END FROM gate",
    "gate",
    "value",
)
def p39(lake):
    return S.deployment_gate(metrics_of(lake)).select("strategy", "criterion", "value", "passed", "decision")


@query("p39_gate_notes", f"SELECT strategy, CASE WHEN {_allok} THEN 'GO: all_checks_passed' ELSE 'NO_GO: ' || substr({_why}, 2) END AS notes, top_market_profit_share, ev_spearman FROM gate", "gate", "top_market_profit_share ev_spearman")
def p39b(lake):
    return S.deployment_gate(metrics_of(lake)).where("criterion = 'summary'").select("strategy", "notes", "top_market_profit_share", "ev_spearman")


CTES["srep"] = "SELECT strategy, n_test_trades AS test_trade_count, ci_low AS bootstrap_mean_ci_low, walkforward_mean_expectancy, walkforward_valid_folds, pessimistic_avg_expected_ev, CASE WHEN walkforward_valid_folds > 4 THEN 2.0 ELSE 1.0 END AS label_y_unique, n_test_trades AS label_n_samples, CASE WHEN n_test_trades > 150 THEN 'logistic' ELSE 'heuristic' END AS model, CASE WHEN n_test_trades < 100 THEN 'degenerate_train_labels' ELSE '' END AS model_reason, abs(test_mean_return) AS mean_return FROM smet"


def report_of(lake):
    m = metrics_of(lake)
    return m.select(
        "strategy", F.col("n_test_trades").alias("test_trade_count"), F.col("ci_low").alias("bootstrap_mean_ci_low"), "walkforward_mean_expectancy", "walkforward_valid_folds", "pessimistic_avg_expected_ev",
        F.when(F.col("walkforward_valid_folds") > 4, lit(2)).otherwise(lit(1)).alias("label_y_unique"), F.col("n_test_trades").alias("label_n_samples"), F.when(F.col("n_test_trades") > 150, "logistic").otherwise("heuristic").alias("model"), F.when(F.col("n_test_trades") < 100, "degenerate_train_labels").otherwise("").alias("model_reason"), F.abs("test_mean_return").alias("mean_return"),
    )


@query(
    "p40_readiness",
    "SELECT strategy, d::BIGINT AS DATA_READY, m::BIGINT AS MODEL_READY, a::BIGINT AS ALPHA_READY, 0::BIGINT AS DEPLOYABLE, CASE WHEN a THEN 'ALPHA_READY' WHEN m THEN 'MODEL_READY' WHEN d THEN 'DATA_READY' ELSE 'INSUFFICIENT_DATA' END AS readiness_state, CASE WHEN r = '' THEN 'ok' ELSE substr(r, 2) END AS reason FROM (SELECT *, (SELECT count(DISTINCT ts) FROM sig) >= 20 AND test_trade_count >= 150 AS d, label_y_unique >= 2 AND label_n_samples >= 150 AND model_reason = '' AND model <> 'heuristic' AS m, bootstrap_mean_ci_low > 0 AND walkforward_mean_expectancy > 0 AS a, CASE WHEN (SELECT count(DISTINCT ts) FROM sig) < 20 THEN ';n_unique_ts<20' ELSE '' END || CASE WHEN test_trade_count < 150 THEN ';test_trade_count<150' ELSE '' END || CASE WHEN label_y_unique < 2 THEN ';degenerate_labels' ELSE '' END || CASE WHEN model = 'heuristic' THEN ';model_not_trained' ELSE '' END || CASE WHEN bootstrap_mean_ci_low <= 0 THEN ';ci_low<=0' ELSE '' END || CASE WHEN walkforward_mean_expectancy <= 0 THEN ';wf_mean<=0' ELSE '' END AS r FROM srep)",
    "srep sig",
)
def p40(lake):
    n = signal_of(lake).agg(F.countDistinct("ts")).scalar()
    return S.readiness(report_of(lake), n, 20, 150)


CTES["edg"] = "SELECT strategy AS edge_name, mean_return, greatest(1e-12, least(1, abs(bootstrap_mean_ci_low))) AS p_value, mean_return / 2 - 0.02 AS ci_low, test_trade_count * 100 AS capacity_usd, least(1, abs(walkforward_mean_expectancy)) AS stability, test_trade_count, walkforward_valid_folds, (model_reason <> '')::INT::DOUBLE AS label_degenerate FROM srep"


def edges_of(lake):
    r = report_of(lake)
    return r.select(
        F.col("strategy").alias("edge_name"), "mean_return", F.greatest(lit(1e-12), F.least(lit(1), F.abs("bootstrap_mean_ci_low"))).alias("p_value"), (F.col("mean_return") / 2 - 0.02).alias("ci_low"), (F.col("test_trade_count") * 100).alias("capacity_usd"), F.least(lit(1), F.abs("walkforward_mean_expectancy")).alias("stability"), "test_trade_count", "walkforward_valid_folds", F.when(F.col("model_reason") != "", lit(1)).otherwise(lit(0)).alias("label_degenerate"),
    )


_SC = "profitability_score significance_score capacity_score stability_score reliability_score edge_score"


@query(
    "p41_edge_scores",
    """SELECT edge_name, prof AS profitability_score, sigs AS significance_score, capa AS capacity_score, stab AS stability_score, rel AS reliability_score, CASE WHEN mean_return <= 0 OR ci_low <= 0 OR label_degenerate > 0.5 THEN 0 ELSE (0.45 * prof + 0.15 * sigs + 0.10 * capa + 0.10 * stab + 0.20 * rel) * CASE WHEN test_trade_count < 50 THEN 0.25 ELSE 1 END * CASE WHEN walkforward_valid_folds < 2 THEN 0.25 ELSE 1 END END AS edge_score FROM (
SELECT *, CASE WHEN ci_low > 0 THEN least(1, cons / greatest(1e-6, (SELECT quantile_cont(greatest(0, least(mean_return, ci_low)), 0.75) FROM edg))) ELSE 0 END AS prof, CASE WHEN mean_return > 0 AND ci_low > 0 THEN greatest(0, least(1, -log10(greatest(1e-12, 0.5 * p_value)) / 6)) ELSE 0 END AS sigs, least(1, ln(1 + capacity_usd) / ln(50001)) AS capa, least(1, greatest(0, stability)) AS stab, 0.5 * least(1, test_trade_count / 200) + 0.3 * least(1, walkforward_valid_folds / 4) + 0.2 * (label_degenerate <= 0.5)::INT AS rel FROM (SELECT *, greatest(0, least(mean_return, ci_low)) AS cons FROM edg))""",
    "edg",
    _SC,
)
def p41(lake):
    return S.score_edges(edges_of(lake)).select("edge_name", *_SC.split())


@query("p44_one_sided_p")
def p44(lake):
    e = edges_of(lake).withColumns({"t_stat": F.when(F.col("test_trade_count") > 60, (F.col("ci_low") - 0.02) * 20), "n_obs": F.col("test_trade_count")})
    return e.select("edge_name", "t_stat", S.one_sided_p(e).alias("p_value_pos"))


@query("p42_score_input", "SELECT strategy AS edge_name, bootstrap_mean_ci_low AS ci_low, mean_return, test_trade_count, walkforward_valid_folds, (model_reason LIKE '%degenerate_train_labels%')::INT::DOUBLE AS label_degenerate, 1.0::DOUBLE AS p_value FROM srep", "srep", "ci_low mean_return test_trade_count walkforward_valid_folds label_degenerate p_value")
def p42(lake):
    r = report_of(lake).withColumn("return_per_day", F.col("mean_return"))
    return S.score_input(r).select("edge_name", "ci_low", "mean_return", "test_trade_count", "walkforward_valid_folds", "label_degenerate", "p_value")


@query("p43_report_costs", "SELECT strategy, CASE WHEN g > 0 THEN c / greatest(g, 1e-9) ELSE (c > 0)::INT END AS cost_dominance_ratio FROM (SELECT 'thr=' || printf('%.4f', threshold) || '|hp=' || holding_period::VARCHAR AS strategy, abs(sum(gross_pnl)) AS g, abs(sum(fees)) + abs(sum(spread_component)) + abs(sum(vol_slippage_component)) + abs(sum(impact_component)) AS c FROM tr GROUP BY 1)", "tr", "cost_dominance_ratio")
def p43(lake):
    from marketlab.operators.summary import cost_decomposition

    c = cost_decomposition(named(grid_trades(lake)), ["strategy"])
    return c.select("strategy", S.cost_dominance(c).alias("cost_dominance_ratio"))


def metrics_long(lake):
    return S.metric_rows(edges_of(lake), "edge_name", F.lit("2024-02-01").cast("timestamp"), ["mean_return", "p_value", "capacity_usd", "stability"])


_MET = " UNION ALL ".join(f"SELECT TIMESTAMP '2024-02-01' AS run_ts, edge_name, edge_name AS entity_id, '{c}' AS metric_name, {c}::DOUBLE AS metric_value FROM edg" for c in ("mean_return", "p_value", "capacity_usd", "stability"))
CTES["melong"] = _MET


@query("s19_metric_rows", "SELECT * FROM melong", "melong", "metric_value")
def s19(lake):
    return metrics_long(lake).drop("meta_json")


@query("a53_pattern_aggregates", "SELECT edge_name, min(metric_value) FILTER (WHERE metric_name ILIKE '%pvalue%') AS p_value, avg(metric_value) FILTER (WHERE metric_name = 'capacity_usd') AS capacity_usd, avg(metric_value) FILTER (WHERE metric_name = 'stability') AS stability, avg(metric_value) FILTER (WHERE metric_name = 'mean_return') AS mean_return FROM (SELECT * REPLACE (CASE WHEN metric_name = 'p_value' THEN 'linreg_pvalue' ELSE metric_name END AS metric_name) FROM melong) GROUP BY 1", "melong", "p_value capacity_usd stability mean_return")
def a53(lake):
    m = metrics_long(lake).withColumn("metric_name", F.when(F.col("metric_name") == "p_value", "linreg_pvalue").otherwise(F.col("metric_name")))
    return S.edges_from_metrics(m)


def study_rows(lake):
    """The five study summaries of the first research run."""
    cross = E.unit_root_stat(book_pairs(lake), yes_hist(lake)).join(E.pair_spreads(book_pairs(lake), yes_hist(lake)), ["market_a", "market_b"])
    cross = cross.withColumn("stationary_p", two_sided(F.col("unit_root_t"), F.col("n").cast("double") - 2))
    pre = pre_of(lake)
    rules = E.rule_summary(amb_of(lake)).withColumn("p_value", two_sided(F.col("t_stat"), F.col("n").cast("double") - 2))
    liq = E.regression(pre.withColumn("x", -F.log1p("liquidity_score")), "x", "abs_error")
    liq = liq.withColumn("p_value", two_sided(F.col("t_stat"), F.col("n").cast("double") - 2))
    mom = E.momentum_summary(E.momentum_frame(lake.snapshots, lake.markets))
    mom = mom.withColumn("p_value", two_sided(F.col("t_stat"), F.col("n").cast("double") - 2))
    wh = E.welch(E.whale_flags(E.resolved_trades(lake.trades, lake.markets, lake.resolutions), E.wallet_stats(lake.trades)).where("is_early"), "alpha_per_share", "is_whale", True, False)
    wh = wh.withColumn("p_value", two_sided(F.col("t_stat"), F.col("dof")))
    return RP.edge_roll_up(cross, rules, liq, mom, wh)


@query("a52_edge_roll_up")
def a52(lake):
    return study_rows(lake)


@query("p46_live_rows", "SELECT strategy, market_id, direction, expected_net_ev FROM (SELECT 'consistency_arb' AS strategy, market_id, 'PAIR_HEDGE' AS direction, round(expected_net_return, 9) AS expected_net_ev FROM parity UNION ALL SELECT 'microstructure_mm', market_id, 'MARKET_MAKE', max(round(greatest(-0.05, least(0.05, g)) - 0.004 * fp, 9)) FROM mm GROUP BY market_id, token_id) ORDER BY expected_net_ev DESC, strategy, market_id LIMIT 200", "parity mm", "expected_net_ev")
def p46(lake):
    r = lambda df: df.withColumn("expected_net_return", F.round("expected_net_return", 9))
    parity = r(X.complement_parity(X.latest_books(lake.snapshots, lake.outcomes)))
    return S.live_rows({"consistency_arb": (parity, {"direction": "PAIR_HEDGE"}), "microstructure_mm": (r(quotes_of(lake)), {"direction": "MARKET_MAKE"})}).select("strategy", "market_id", "direction", "expected_net_ev")


@query("a55_direction_stats", "SELECT CASE WHEN ls THEN 'LONG_SET' ELSE 'SHORT_SET' END AS pair_direction, count(*) AS n, avg(trade_return) AS avg_return FROM ptr GROUP BY 1", "ptr", "avg_return")
def a55(lake):
    return RP.direction_stats(pair_trades_of(lake))


CTES["p55"] = "SELECT ts, market_id, trade_return AS r, 'depth' AS field, pd AS x FROM ptr WHERE threshold = 0.004 AND holding_period = 1 UNION ALL SELECT ts, market_id, trade_return, 'edge', edge_raw FROM ptr WHERE threshold = 0.004 AND holding_period = 1"


@query("a55_return_deciles", "SELECT field, greatest(0, CAST(ceil((rn - 1) * 10 / greatest(n - 1, 1)::DOUBLE) AS BIGINT) - 1) AS decile, count(*) AS n, avg(r) AS avg_return FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round(x, 9), ts, market_id) AS rn, count(*) OVER (PARTITION BY field) AS n FROM p55) GROUP BY 1, 2", "p55", "avg_return")
def a55b(lake):
    t = pair_trades_of(lake).where("threshold = 0.004 AND holding_period = 1").withColumns({"depth": F.col("depth_total"), "edge": F.col("edge_raw")})
    return RP.return_deciles(t, ["depth", "edge"])


# --------------------------------------------------------------- portfolios

NAMES = ["0.1", "0.15", "0.2", "0.25"]
CTES["sret"] = "SELECT CASE threshold WHEN 0.1 THEN '0.1' WHEN 0.15 THEN '0.15' WHEN 0.2 THEN '0.2' ELSE '0.25' END AS strategy, ts, sum(net_pnl) / 100000 AS ret FROM tr WHERE holding_period = 1 GROUP BY 1, 2"
CTES["swide"] = "SELECT ts, " + ", ".join(f"coalesce(sum(ret) FILTER (WHERE strategy = '{n}'), 0) AS \"{n}\"" for n in NAMES) + " FROM sret GROUP BY 1"


def hp1(lake):
    return trades_of(lake).where("holding_period = 1").withColumn("strategy", F.col("threshold").cast("string"))


def returns_of(lake):
    t = grid_trades(lake).where("holding_period = 1").withColumn("strategy", F.col("threshold").cast("string"))
    return memo(lake, "strategy_returns", lambda: PF.strategy_returns(t, F.col("strategy")))


def wide_of(lake):
    return memo(lake, "wide_returns", lambda: PF.aligned(returns_of(lake), NAMES))


@query("a54_strategy_returns", "SELECT * FROM sret", "sret", "ret")
def a54(lake):
    return returns_of(lake)


@query("j22_aligned_returns", "SELECT * FROM swide", "swide", " ".join(f'"{n}"' for n in NAMES))
def j22(lake):
    return PF.aligned(returns_of(lake), NAMES)


@query("a32_covariance", " UNION ALL ".join(f"SELECT '{a}' AS strategy_a, '{b}' AS strategy_b, corr(\"{a}\", \"{b}\") AS correlation, (covar_pop(\"{a}\", \"{b}\") + {1e-6 if a == b else 0.0}) * 1000000 AS covariance FROM swide" for a in NAMES for b in NAMES), "swide", "correlation covariance")
def a32(lake):
    return PF.covariance(wide_of(lake), NAMES, 1e-6).withColumn("covariance", F.col("covariance") * 1e6)


_w = "[x.a, x.b, x.c, x.d]"
_cols = ["a", "b", "c", "d"]
_muv = {k: f"(SELECT avg(\"{n}\") FROM swide)" for k, n in zip(_cols, NAMES)}
CTES["wst4"] = "SELECT " + ", ".join([f"avg(\"{n}\") AS mu_{k}" for k, n in zip(_cols, NAMES)] + [f"covar_pop(\"{m}\", \"{n}\") + {1e-6 if m == n else 0.0} AS c_{i}{j}" for i, m in zip(_cols, NAMES) for j, n in zip(_cols, NAMES)]) + " FROM swide"
CTES["wgrid"] = "SELECT a / 20.0::DOUBLE AS a, b / 20.0::DOUBLE AS b, c / 20.0::DOUBLE AS c, d / 20.0::DOUBLE AS d FROM (SELECT a, b, c, 20 - a - b - c AS d FROM (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b), (SELECT unnest(range(11)) AS c)) WHERE d BETWEEN 0 AND 10"
_mrc = {i: " + ".join(f"s.c_{i}{j} * g.{j}" for j in _cols) for i in _cols}
CTES["wobj"] = "SELECT *, " + ", ".join(f"{i} * m_{i} / sqrt(v + 1e-12) AS rc_{i}" for i in _cols) + " FROM (SELECT *, " + " + ".join(f"{i} * m_{i}" for i in _cols) + " AS v FROM (SELECT g.*, " + ", ".join(f"{_mrc[i]} AS m_{i}" for i in _cols) + ", " + " + ".join(f"s.mu_{i} * g.{i}" for i in _cols) + " AS r, " + " + ".join(f"(g.{i} - 0.25) * (g.{i} - 0.25)" for i in _cols) + " AS far FROM wgrid g CROSS JOIN wst4 s))"
_rcm = "((rc_a + rc_b + rc_c + rc_d) / 4)"
_obj = {
    "risk_parity": (" + ".join(f"(rc_{i} - {_rcm}) * (rc_{i} - {_rcm})" for i in _cols), "true"),
    "mean_variance": ("-(r - 0.5::DOUBLE * 6.0 * v - 0.01 * far)", "true"),
    "max_sharpe": ("-(r / (sqrt(v) + 1e-12) - 0.01 * far)", "true"),
    "kelly": ("-(r - 0.5::DOUBLE * v)", "greatest(a, b, c, d) <= 0.3 + 1e-9"),
}
CTES["wbest"] = " UNION ALL ".join(f"(SELECT '{m}' AS method, a, b, c, d FROM wobj WHERE {cond} ORDER BY round({o}, 15), a, b, c, d LIMIT 1)" for m, (o, cond) in _obj.items())
_cap = {"0.1": 30000.0, "0.15": 20000.0, "0.2": 60000.0, "0.25": 40000.0}
CTES["wts"] = " UNION ALL ".join(f"SELECT method, '{n}' AS strategy, least({k}, {min(c / 100000, 0.5)}) AS weight, {min(c / 100000, 0.5)}::DOUBLE AS capacity_weight_cap, (least({k}, {min(c / 100000, 0.5)}) >= {min(c / 100000, 0.5)} - 1e-10)::BIGINT AS capacity_bound FROM wbest" for k, (n, c) in zip(_cols, _cap.items()))
CTES["wall"] = "SELECT * FROM wts UNION ALL SELECT method, 'cash', greatest(0, 1 - sum(weight)), NULL, NULL FROM wts GROUP BY 1"


def weights_of(lake):
    return memo(lake, "weights", lambda: PF.choose_weights(wide_of(lake), NAMES, caps=_cap))


@query("m11_portfolio_weights", "SELECT * FROM wall", "wall", "weight capacity_weight_cap")
def m11(lake):
    return PF.choose_weights(wide_of(lake), NAMES, caps=_cap)


CTES["pser"] = "SELECT *, eq / max(eq) OVER (PARTITION BY method ORDER BY ts) - 1 AS portfolio_drawdown FROM (SELECT *, 100000 * exp(sum(ln(1 + portfolio_ret)) OVER (PARTITION BY method ORDER BY ts)) AS eq FROM (SELECT w.method, r.ts, sum(r.ret * w.weight) AS portfolio_ret FROM sret r JOIN wts w ON w.strategy = r.strategy GROUP BY 1, 2))"


@query("m11_portfolio_series", "SELECT method, ts, portfolio_ret, eq AS portfolio_equity, portfolio_drawdown FROM pser", "pser", "portfolio_ret portfolio_equity portfolio_drawdown")
def m11b(lake):
    return PF.portfolio_series(returns_of(lake), weights_of(lake))


_PSUM = "portfolio_sharpe portfolio_max_drawdown portfolio_total_pnl portfolio_mean_return portfolio_vol n_periods cash_weight gross_allocated_weight n_strategies"


@query("m11_portfolio_summary", "SELECT p.method, CASE WHEN count(*) >= 3 AND stddev_pop(portfolio_ret) > 0 THEN avg(portfolio_ret) / stddev_pop(portfolio_ret) * sqrt(8760) ELSE 0 END AS portfolio_sharpe, min(portfolio_drawdown) AS portfolio_max_drawdown, arg_max(eq, ts) - 100000 AS portfolio_total_pnl, avg(portfolio_ret) AS portfolio_mean_return, stddev_pop(portfolio_ret) AS portfolio_vol, count(*)::DOUBLE AS n_periods, any_value(w.cash) AS cash_weight, any_value(w.g) AS gross_allocated_weight, 4.0::DOUBLE AS n_strategies, CASE WHEN count(*) < 30 THEN 'insufficient_sample_n_periods_lt_30' ELSE '' END AS warning FROM pser p JOIN (SELECT method, sum(weight) FILTER (WHERE strategy = 'cash') AS cash, sum(weight) FILTER (WHERE strategy <> 'cash') AS g FROM wall GROUP BY 1) w ON w.method = p.method GROUP BY 1", "pser wall", _PSUM)
def m11c(lake):
    return PF.portfolio_summary(PF.portfolio_series(returns_of(lake), weights_of(lake)), weights_of(lake))


CTES["rexp"] = "SELECT t.*, notional * w.weight AS ex, CASE WHEN time_to_resolution_h <= 24 THEN '<=24h' WHEN time_to_resolution_h <= 72 THEN '24-72h' WHEN time_to_resolution_h <= 168 THEN '3-7d' ELSE '>7d' END AS tb FROM (SELECT *, CASE threshold WHEN 0.1 THEN '0.1' WHEN 0.15 THEN '0.15' WHEN 0.2 THEN '0.2' ELSE '0.25' END AS strategy FROM tr WHERE holding_period = 1) t JOIN wts w ON w.method = 'risk_parity' AND w.strategy = t.strategy AND w.weight > 0"


@query("a31_risk_report", "SELECT 'strategy_concentration' AS risk_type, 'hhi_strategy_weights' AS metric, sum(weight * weight) AS value FROM wts WHERE method = 'risk_parity' UNION ALL SELECT 'strategy_concentration', 'n_active_strategies', count(*) FILTER (WHERE weight > 1e-6) FROM wts WHERE method = 'risk_parity' UNION ALL SELECT 'market_concentration', 'hhi_markets', sum(s * s) FROM (SELECT sum(ex) / (SELECT sum(ex) FROM rexp) AS s FROM rexp GROUP BY market_id) UNION ALL SELECT 'market_concentration', 'top_market_exposure_share', max(s) FROM (SELECT sum(ex) / (SELECT sum(ex) FROM rexp) AS s FROM rexp GROUP BY market_id) UNION ALL SELECT 'category_exposure', category, sum(ex) / (SELECT sum(ex) FROM rexp) FROM rexp GROUP BY 2 UNION ALL SELECT 'time_to_resolution_exposure', tb, sum(ex) / (SELECT sum(ex) FROM rexp) FROM rexp GROUP BY 2", "rexp wts", "value")
def a31(lake):
    return PF.risk_report(hp1(lake), weights_of(lake).where("method = 'risk_parity'"))


CTES["m2m"] = "SELECT *, coalesce(sum(q) OVER (PARTITION BY token_id ORDER BY ts), 0) AS pos, mid - lag(mid) OVER (PARTITION BY token_id ORDER BY ts) AS st FROM (SELECT s.snapshot_ts AS ts, s.token_id, s.mid, m.category, f.q FROM snap s LEFT JOIN mkt m ON m.market_id = s.market_id LEFT JOIN (SELECT date_trunc('day', trade_ts) AS d, token_id, sum(CASE WHEN side = 'BUY' THEN size ELSE -size END) AS q FROM trd GROUP BY 1, 2) f ON f.d = s.snapshot_ts AND f.token_id = s.token_id)"


def marked(lake):
    f = lake.trades.select(F.date_trunc("day", "trade_ts").alias("ts"), "token_id", F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size")).alias("qty"))
    return PF.mark_to_market(f, E.price_frame(lake.snapshots, lake.markets))


@query("w22_mark_to_market", "SELECT ts, sum(pos * coalesce(st, 0)) AS price_pnl, sum(abs(pos * mid)) AS gross_exposure, sum(pos * mid) AS net_exposure FROM m2m GROUP BY 1", "m2m", "price_pnl gross_exposure net_exposure")
def w22(lake):
    return marked(lake)[0]


@query("w22_pnl_by_category", "SELECT coalesce(category, 'unknown') AS category, sum(pos * coalesce(st, 0)) AS pnl FROM m2m GROUP BY 1", "m2m", "pnl")
def w22b(lake):
    return marked(lake)[1]


# ------------------------------------------------------------------- models

COLS = ["velocity_1", "book_imbalance", "liquidity_log", "prob_vol_6", "spread_bps"]


def labelled(lake):
    return memo(lake, "labelled", lambda: signal_of(lake).where("future_mid_1 IS NOT NULL").withColumn("label", F.when(F.col("future_mid_1") > F.col("mid"), 1).otherwise(0)))


CTES["lab"] = "SELECT *, (future_mid_1 > mid)::INT AS label FROM sig WHERE future_mid_1 IS NOT NULL"
CTES["bfit"] = "SELECT " + ", ".join(["greatest(1e-3, least(1 - 1e-3, avg(label))) AS base"] + [f"avg({c}) FILTER (WHERE label = {k}) AS m{k}_{c}, greatest(1e-4, stddev_pop({c}) FILTER (WHERE label = {k})) AS s{k}_{c}" for c in COLS for k in (0, 1)]) + " FROM lab"
_bll = " + ".join(f"(-ln(s1_{c}) - 0.5 * pow(({c} - m1_{c}) / s1_{c}, 2)) - (-ln(s0_{c}) - 0.5 * pow(({c} - m0_{c}) / s0_{c}, 2))" for c in COLS)


@query("m3_bayesian_update", f"SELECT ts, token_id, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-greatest(-50, least(50, ln(pr / (1 - pr)) + {_bll})))))) AS p FROM (SELECT *, greatest(1e-3, least(1 - 1e-3, mid)) AS pr FROM lab, bfit)", "lab bfit", "p")
def m3(lake):
    d = labelled(lake)
    return M.bayes_predict(d, M.bayes_fit(d, COLS), COLS).select("ts", "token_id", "p")


@query("m3_effect_sizes", " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(m1_{c} - m0_{c}) / greatest(sqrt(0.5 * (s0_{c} * s0_{c} + s1_{c} * s1_{c})), 1e-6) AS importance FROM bfit" for c in COLS), "bfit", "importance")
def m3b(lake):
    return M.bayes_importance(M.bayes_fit(labelled(lake), COLS), COLS)


@query("m1_logistic")
def m1(lake):
    d = labelled(lake)
    return M.fit_model("logistic", d, COLS).predict(d).select("ts", "token_id", "label", "p")


@query("m2_boosted_trees")
def m2(lake):
    d = labelled(lake)
    return M.fit_model("gb", d, COLS, trees=10).predict(d).select("ts", "token_id", "label", "p")


@query("m4_model_signals")
def m4(lake):
    d = labelled(lake)
    p = M.fit_model("bayes", d, COLS).predict(d)
    return p.select("ts", "token_id", *[c.alias(n) for n, c in M.signals_from(F.col("p")).items()])


@query("p38_signal_blend")
def p38(lake):
    d = labelled(lake)
    return M.blend(M.fit_model("logistic", d, COLS).predict(d), 0.5, True).select("ts", "token_id", "signal", "confidence", "model_proba")


CTES["xf"] = "SELECT l.ts, l.token_id, f.fold, CASE WHEN t.idx < 4 + f.fold * (t.n // 5) THEN 'train' ELSE 'test' END AS role FROM lab l JOIN (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM lab)) t ON t.ts = l.ts, (SELECT unnest([0, 1, 2, 3])::BIGINT AS fold) f WHERE 4 + (f.fold + 1) * (t.n // 5) <= t.n AND t.idx < 4 + (f.fold + 1) * (t.n // 5)"


@query("m5_expanding_folds", "SELECT fold, role, ts, token_id FROM xf", "xf")
def m5(lake):
    return M.expanding_folds(labelled(lake).select("ts", "token_id")).select("fold", "role", "ts", "token_id")


def compared(lake):
    return memo(lake, "models", lambda: M.compare_models(labelled(lake), COLS, ("logistic", "bayesian"), 3))


@query("m5_model_comparison")
def m5b(lake):
    return M.compare_models(labelled(lake), COLS, ("logistic", "bayesian"), 3)


@query("t6_best_models")
def t6(lake):
    return M.rank_models(compared(lake), 2)


@query("m6_future_mid_ensemble")
def m6(lake):
    d = labelled(lake)
    return M.future_mid_ensemble(d, {"all": d}, COLS, "future_mid_1", trees=10)[0]["all"].select("ts", "token_id", "mid", "model_pred_future_mid")


@query("m8_return_importance")
def m8(lake):
    return M.return_importance(chosen_of(lake), COLS)


@query("m9_wallet_clusters")
def m9(lake):
    return M.wallet_clusters(E.wallet_stats(lake.trades))
