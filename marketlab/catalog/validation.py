"""Validation: resampling, folds, labels, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.catalog.registry import CTES, memo, query
from marketlab.catalog.trading import CFG, THRESHOLDS, binned_sql, chosen_of, signal_of, trades_of
from marketlab.catalog.pairing import pair_trades_of
from marketlab.functions.columns import flag, sharpe
from marketlab.operators import diagnostics as G, resample as B, summary as R, validate as V

P = "2147483647"


def draw_sql(i: str, r: str) -> str:
    x0 = f"((48271::BIGINT * ({i} + 1) + 70247589::BIGINT * ({r} + 1)) % {P})"
    x1 = f"(({x0} * {x0} + {i} + 1) % {P})"
    return f"(({x1} * {x1} + {r} + 1) % {P})"


def pick_sql(i: str, r: str, n: str) -> str:
    return f"CAST(floor(CAST({draw_sql(i, r)} AS DOUBLE) * {n} / {P}) AS BIGINT)"


# the chosen cell, split by time
CTES["evs"] = "SELECT *, CASE WHEN epoch_us(ts) <= (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.5) FROM ev_tr) THEN 'train' ELSE 'test' END AS split FROM ev_tr"
CTES["ten"] = "SELECT ts, token_id, trade_return AS x, row_number() OVER (ORDER BY ts, token_id) - 1 AS id, count(*) OVER () AS n FROM evs WHERE split = 'test'"


def split_of(lake):
    return memo(lake, "chosen_split", lambda: V.time_split(chosen_of(lake), 0.5))


def test_of(lake):
    return split_of(lake).where("split = 'test'")


@query("w19_time_split", "SELECT ts, token_id, split FROM evs", "evs")
def w19(lake):
    return V.time_split(chosen_of(lake), 0.5).select("ts", "token_id", "split")


_STAB = "avg_return win_rate sharpe"
_STABS = "count(*) AS trade_count, avg(trade_return) AS avg_return, avg((trade_return > 0)::INT) AS win_rate, CASE WHEN count(*) >= 3 AND stddev_pop(trade_return) > 0 THEN avg(trade_return) / stddev_pop(trade_return) * sqrt(8760) ELSE 0 END AS sharpe"


@query("a15_stability_by_day", f"SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, {_STABS} FROM tr GROUP BY 1", "tr", _STAB)
def a15(lake):
    return R.stability(trades_of(lake), "day")


@query("a15_stability_by_category", f"SELECT category AS bucket, {_STABS} FROM tr GROUP BY 1", "tr", _STAB)
def a15b(lake):
    return R.stability(trades_of(lake), "category")


@query("a41_sharpe", "SELECT threshold, holding_period::BIGINT AS holding_period, CASE WHEN count(*) >= 3 AND stddev_pop(trade_return) > 0 THEN avg(trade_return) / stddev_pop(trade_return) * sqrt(8760) ELSE 0 END AS sharpe FROM tr GROUP BY 1, 2", "tr", "threshold sharpe")
def a41(lake):
    return trades_of(lake).groupBy("threshold", "holding_period").agg(sharpe(F.col("trade_return")).alias("sharpe"))


_rg = " UNION ALL ".join(f"SELECT '{g}' AS regime_group, round({c}, 12) AS x, trade_return FROM ev_tr" for g, c in (("volatility", "prob_vol_6"), ("liquidity", "liquidity_log"), ("time_to_resolution", "time_to_resolution_h")))
CTES["rgl"] = _rg


@query("a16_regime_splits", "SELECT regime_group, CASE WHEN lo = hi THEN 'all' WHEN x <= q1 THEN 'low' WHEN x <= q2 THEN 'mid' ELSE 'high' END AS regime_bucket, count(*) AS n, avg(trade_return) AS avg_return, avg((trade_return > 0)::INT) AS win_rate, CASE WHEN count(*) >= 3 AND stddev_pop(trade_return) > 0 THEN avg(trade_return) / stddev_pop(trade_return) * sqrt(8760) ELSE 0 END AS sharpe FROM rgl JOIN (SELECT regime_group, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.33) AS q1, quantile_cont(x, 0.66) AS q2 FROM rgl GROUP BY 1) USING (regime_group) GROUP BY 1, 2", "rgl", _STAB)
def a16(lake):
    return G.regime_splits(chosen_of(lake))


# ------------------------------------------------------------------- folds

WCFG = V.WalkConfig(n_folds=4, min_train_periods=4, min_train_samples=60, test_periods=4, min_test_trades=10, embargo_periods=1)
CTES["tsi"] = "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM sig)"
CTES["fplan"] = """
SELECT fold, min(ts) FILTER (WHERE tr) AS train_start, max(ts) FILTER (WHERE tr) AS train_end, min(ts) FILTER (WHERE te) AS test_start, max(ts) FILTER (WHERE te) AS test_end FROM (
SELECT *, idx >= st AND idx < st + len AS tr, idx >= st + len + 1 AND idx < st + len + 5 AS te FROM (
SELECT *, f AS fold, f * 4 AS st, greatest(4, (n - 5) // 4) AS len FROM tsi, (SELECT unnest([0, 1, 2, 3])::BIGINT AS f)) WHERE st <= n - len - 5) WHERE tr OR te GROUP BY 1"""


@query("w21_fold_plan", "SELECT * FROM fplan", "fplan")
def w21(lake):
    return V.fold_plan(signal_of(lake), WCFG)


CTES["fmem"] = "SELECT s.*, f.fold, CASE WHEN s.ts BETWEEN f.train_start AND f.train_end THEN 'train' ELSE 'test' END AS role FROM sig s JOIN fplan f ON s.ts BETWEEN f.train_start AND f.train_end OR s.ts BETWEEN f.test_start AND f.test_end"


@query("j31_fold_membership", "SELECT fold, role, ts, token_id FROM fmem", "fmem")
def j31(lake):
    s = signal_of(lake).select("ts", "token_id")
    return V.fold_rows(s, V.fold_plan(s, WCFG)).select("fold", "role", "ts", "token_id")


CTES["ftr"] = "SELECT t.*, f.fold, CASE WHEN t.ts BETWEEN f.train_start AND f.train_end THEN 'train' ELSE 'test' END AS role FROM tr t JOIN fplan f ON t.ts BETWEEN f.train_start AND f.train_end OR t.ts BETWEEN f.test_start AND f.test_end"
CTES["feq"] = "SELECT *, max(equity) OVER (PARTITION BY role, fold, threshold, holding_period ORDER BY ts) AS peak, CASE WHEN row_number() OVER (PARTITION BY role, fold, threshold, holding_period ORDER BY ts) = 1 THEN 0 ELSE p / 100000 END AS r FROM (SELECT role, fold, threshold, holding_period, ts, p, 100000 + sum(p) OVER (PARTITION BY role, fold, threshold, holding_period ORDER BY ts) AS equity FROM (SELECT role, fold, threshold, holding_period, ts, sum(net_pnl) AS p FROM ftr GROUP BY ALL))"
CTES["fsum"] = "SELECT * FROM (SELECT role, fold, threshold, holding_period, count(*)::DOUBLE AS trade_count, avg(trade_return) AS expectancy, sum(net_pnl) AS total_pnl FROM ftr GROUP BY ALL) JOIN (SELECT role, fold, threshold, holding_period, CASE WHEN count(*) >= 3 AND stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(8760) ELSE 0 END AS sharpe, min(equity / peak - 1) AS max_drawdown FROM feq GROUP BY ALL) USING (role, fold, threshold, holding_period)"
CTES["fold"] = """
SELECT p.fold, p.train_start, p.train_end, p.test_start, p.test_end, n.ntr, n.nte, b.threshold AS bt, b.holding_period AS bh, b.trade_count AS btc, t.trade_count AS tc, t.expectancy, t.sharpe, t.max_drawdown, t.total_pnl,
 CASE WHEN n.ntr < 60 THEN 'insufficient_train_samples' WHEN b.threshold IS NULL THEN 'no_train_candidate' WHEN coalesce(t.trade_count, 0) < 10 THEN 'insufficient_test_trades' ELSE 'ok' END AS status
FROM fplan p JOIN (SELECT fold, count(*) FILTER (WHERE role = 'train') AS ntr, count(*) FILTER (WHERE role = 'test') AS nte FROM fmem GROUP BY 1) n ON n.fold = p.fold
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN trade_count >= 20 THEN 0 ELSE 1 END, round(expectancy * sqrt(trade_count), 12) DESC, threshold, holding_period) AS rn FROM fsum WHERE role = 'train') WHERE rn = 1) b ON b.fold = p.fold
LEFT JOIN fsum t ON t.role = 'test' AND t.fold = p.fold AND t.threshold = b.threshold AND t.holding_period = b.holding_period"""
_judge = "status IN ('ok', 'insufficient_test_trades')"
CTES["foldr"] = f"""
SELECT fold, train_start, train_end, test_start, test_end, CASE WHEN {_judge} THEN bt ELSE 0 END AS threshold, CASE WHEN {_judge} THEN bh ELSE 0 END::BIGINT AS holding_period,
 CASE WHEN {_judge} THEN btc WHEN status = 'insufficient_train_samples' THEN ntr ELSE 0 END::DOUBLE AS n_trades_train, CASE WHEN {_judge} THEN coalesce(tc, 0) WHEN status = 'insufficient_train_samples' THEN nte ELSE 0 END::DOUBLE AS n_trades_test,
 CASE WHEN {_judge} THEN coalesce(tc, 0) ELSE 0 END AS trade_count, CASE WHEN {_judge} THEN coalesce(expectancy, 0) ELSE 0 END AS expectancy, CASE WHEN {_judge} THEN coalesce(sharpe, 0) ELSE 0 END AS sharpe, CASE WHEN {_judge} THEN coalesce(max_drawdown, 0) ELSE 0 END AS max_drawdown, CASE WHEN {_judge} THEN coalesce(total_pnl, 0) ELSE 0 END AS total_pnl,
 status, status = 'ok' AS valid_fold, CASE WHEN status = 'ok' THEN '' ELSE status END AS invalid_reason, 1.0::DOUBLE AS embargo_periods FROM fold"""


def walk_of(lake):
    cache = lake.__dict__.setdefault("_walk", {})
    if "w" not in cache:
        cache["w"] = V.walk_forward(signal_of(lake), trades_of(lake), WCFG)
    return cache["w"]


@query("c4_walk_forward", "SELECT * FROM foldr", "foldr", "threshold n_trades_train n_trades_test trade_count expectancy sharpe max_drawdown total_pnl embargo_periods")
def c4(lake):
    return V.walk_forward(signal_of(lake), trades_of(lake), WCFG)["folds"]


CTES["flm"] = "SELECT fold, ts, token_id, winner, round(future_mid_1 - mid, 12) AS move FROM fmem WHERE role = 'train'"
CTES["flr"] = "SELECT *, row_number() OVER (PARTITION BY fold ORDER BY move, ts, token_id) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM flm WHERE move IS NOT NULL"
CTES["flc"] = " UNION ALL ".join([f"SELECT fold, {i} AS no, avg((move > q)::INT) AS rate FROM (SELECT *, round(quantile_cont(move, {q}) OVER (PARTITION BY fold), 12) AS q FROM flr) GROUP BY 1" for i, q in enumerate((0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0, 0.65))] + ["SELECT fold, 8, avg((round(rn / n::DOUBLE, 12) >= 0.65)::INT) FROM flr GROUP BY 1"])
CTES["flb"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN rate BETWEEN 0.1 AND 0.9 THEN 0 ELSE 1 END, round(abs(rate - 0.35), 12), CASE WHEN rate > 0 AND rate < 1 THEN 0 ELSE 1 END, no) AS k FROM flc) WHERE k = 1"


@query("a51_fold_labels", "SELECT m.fold, CASE WHEN u >= 2 AND c >= 30 THEN 'resolved_outcome' ELSE 'future_price_move' END AS label_mode_train, CASE WHEN u >= 2 AND c >= 30 THEN r ELSE b.rate END AS label_pos_rate_train, CASE WHEN u >= 2 AND c >= 30 THEN u ELSE CASE WHEN b.rate > 0 AND b.rate < 1 THEN 2 ELSE 1 END END::DOUBLE AS label_y_unique_train FROM (SELECT fold, count(winner) AS c, count(DISTINCT winner) AS u, avg(winner) AS r FROM flm GROUP BY 1) m JOIN flb b ON b.fold = m.fold", "flm flb", "label_pos_rate_train label_y_unique_train")
def a51c(lake):
    s = signal_of(lake)
    return V.fold_labels(V.fold_rows(s, V.fold_plan(s, WCFG)).where("role = 'train'"), ["fold"], 1, QS, min_samples=30)


_A18 = "folds valid_folds mean_expectancy std_expectancy mean_sharpe mean_drawdown mean_trade_count mean_trades_test invalid_folds embargo_periods"


@query("a18_walk_roll_up", "SELECT count(*)::DOUBLE AS folds, count(*) FILTER (WHERE valid_fold)::DOUBLE AS valid_folds, coalesce(avg(expectancy) FILTER (WHERE valid_fold), 0) AS mean_expectancy, coalesce(stddev_pop(expectancy) FILTER (WHERE valid_fold), 0) AS std_expectancy, coalesce(avg(sharpe) FILTER (WHERE valid_fold), 0) AS mean_sharpe, coalesce(avg(max_drawdown) FILTER (WHERE valid_fold), 0) AS mean_drawdown, coalesce(avg(trade_count) FILTER (WHERE valid_fold), 0) AS mean_trade_count, coalesce(avg(trade_count) FILTER (WHERE valid_fold), 0) AS mean_trades_test, count(*) FILTER (WHERE NOT valid_fold)::DOUBLE AS invalid_folds, coalesce((SELECT string_agg(status || ':' || c::VARCHAR, ';' ORDER BY status) FROM (SELECT status, count(*) AS c FROM foldr WHERE status <> 'ok' GROUP BY 1)), '') AS invalid_reason_counts, 1.0::DOUBLE AS embargo_periods FROM foldr", "foldr", _A18)
def a18(lake):
    return walk_of(lake)["aggregate"]


@query("a17_parameter_heatmap", "SELECT threshold, " + ", ".join(f"avg(expectancy) FILTER (WHERE holding_period = {h}) AS \"{h}\"" for h in (1, 3, 6, 12)) + " FROM fsum WHERE role = 'train' GROUP BY 1", "fsum", "threshold \"1\" \"3\" \"6\" \"12\"")
def a17(lake):
    return V.heatmap(walk_of(lake)["parameter_sensitivity"], CFG.holding_periods)


# ------------------------------------------------------------- diagnostics

CTES["prob"] = """
SELECT *, CASE WHEN is_yes THEN mid_c ELSE 1 - mid_c END AS market_prob_dir, CASE WHEN is_yes THEN po ELSE 1 - po END AS model_prob_dir, (trade_return > 0)::INT::DOUBLE AS realized_win, abs(signal) AS signal_strength,
 CASE WHEN is_yes THEN po ELSE 1 - po END - CASE WHEN is_yes THEN mid_c ELSE 1 - mid_c END AS model_edge_prob FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, mid)) AS mid_c FROM ev_tr)"""
_A27 = "market_prob_dir model_prob_dir realized_win signal_strength model_edge_prob"


@query("a27_probability_columns", f"SELECT ts, token_id, {', '.join(_A27.split())} FROM prob", "prob", _A27)
def a27(lake):
    return G.with_probabilities(chosen_of(lake)).select("ts", "token_id", *_A27.split())


def _loss(p):
    q = f"greatest(1e-6, least(1 - 1e-6, {p}))"
    return f"avg(-(realized_win * ln({q}) + (1 - realized_win) * ln(1 - {q})))"


_SEG = "n avg_return win_rate model_brier market_brier model_logloss market_logloss avg_model_edge_prob brier_improvement"
_SEGS = f"count(*)::DOUBLE AS n, avg(trade_return) AS avg_return, avg(realized_win) AS win_rate, avg(pow(model_prob_dir - realized_win, 2)) AS model_brier, avg(pow(market_prob_dir - realized_win, 2)) AS market_brier, {_loss('model_prob_dir')} AS model_logloss, {_loss('market_prob_dir')} AS market_logloss, avg(model_edge_prob) AS avg_model_edge_prob, avg(pow(market_prob_dir - realized_win, 2)) - avg(pow(model_prob_dir - realized_win, 2)) AS brier_improvement"
_ATTR = " UNION ALL ".join([f"SELECT 'overall' AS segment, {_SEGS} FROM prob"] + [f"SELECT '{c}=' || {c}::VARCHAR AS segment, {_SEGS} FROM prob GROUP BY 1" for c in ("category", "vol_regime", "is_low_liq_regime", "is_high_vol_regime")])


@query("a22_edge_attribution", _ATTR, "prob", _SEG)
def a22(lake):
    return G.edge_attribution(chosen_of(lake))


CTES["strb"] = binned_sql("prob", "signal_strength", "5", "ts, token_id")


@query("a25_model_vs_market", f"SELECT 'strength_bin=' || bin::VARCHAR AS segment, {_SEGS} FROM strb GROUP BY 1 UNION ALL SELECT 'category=' || category AS segment, {_SEGS} FROM prob GROUP BY 1", "strb", _SEG)
def a25(lake):
    return G.model_vs_market(chosen_of(lake))


CTES["call"] = "SELECT ts, token_id, realized_win, trade_return, 'model' AS source, model_prob_dir AS pred FROM prob UNION ALL SELECT ts, token_id, realized_win, trade_return, 'market', market_prob_dir FROM prob"


@query("a23_calibration_curve", f"SELECT source, bin, count(*)::DOUBLE AS n, avg(pred) AS avg_pred, avg(realized_win) AS observed_win_rate, avg(trade_return) AS avg_return, avg(pred) - avg(realized_win) AS calibration_gap FROM ({binned_sql('call', 'pred', '10', 'ts, token_id', part='source')}) GROUP BY 1, 2", "call", "n avg_pred observed_win_rate avg_return calibration_gap")
def a23(lake):
    return G.calibration_curve(chosen_of(lake))


CTES["decb"] = binned_sql("prob", "signal_strength", "10", "ts, token_id")
_A24 = "signal_decile n avg_return win_rate sharpe avg_expected_ev avg_model_edge_prob ret_p10 ret_p50 ret_p90"


@query("a24_signal_deciles", "SELECT bin::DOUBLE AS signal_decile, count(*)::DOUBLE AS n, avg(trade_return) AS avg_return, avg((trade_return > 0)::INT) AS win_rate, CASE WHEN count(*) >= 3 AND stddev_pop(trade_return) > 0 THEN avg(trade_return) / stddev_pop(trade_return) * sqrt(8760) ELSE 0 END AS sharpe, avg(expected_ev) AS avg_expected_ev, avg(model_edge_prob) AS avg_model_edge_prob, quantile_cont(trade_return, 0.1) AS ret_p10, quantile_cont(trade_return, 0.5) AS ret_p50, quantile_cont(trade_return, 0.9) AS ret_p90 FROM decb GROUP BY 1", "decb", _A24)
def a24(lake):
    return G.signal_deciles(chosen_of(lake))


CTES["evb"] = "SELECT bin, count(*)::DOUBLE AS n, avg(expected_ev) AS avg_expected_ev, avg(trade_return) AS avg_realized_return, avg(trade_return - expected_ev) AS ev_gap, avg((trade_return > 0)::INT) AS ev_hit_rate FROM (" + binned_sql("ev_tr", "expected_ev", "10", "ts, token_id") + ") GROUP BY 1"
CTES["evm"] = "SELECT bool_and(coalesce(d >= -1e-12, true)) AS ok, count(*) AS k, min(n) AS low FROM (SELECT *, avg_realized_return - lag(avg_realized_return) OVER (ORDER BY avg_expected_ev, bin) AS d FROM evb)"
CTES["evs1"] = "SELECT count(*) AS n, regr_slope(trade_return, expected_ev) AS beta, corr(expected_ev, trade_return) AS c, coalesce(avg((trade_return > 0)::INT) FILTER (WHERE expected_ev > 0), 0) AS hit, (SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM (SELECT round(expected_ev, 12) AS a, round(trade_return, 12) AS b FROM ev_tr))) AS rho FROM ev_tr"
_A26 = "ev_bin n avg_expected_ev avg_realized_return ev_gap ev_hit_rate ev_calibration_beta ev_realized_corr ev_spearman ev_monotonic_pass hit_rate_pos_ev n_trades ev_bins_populated ev_min_bin_count ev_model_valid"


@query("a26_ev_diagnostics", "SELECT b.bin::DOUBLE AS ev_bin, b.n, b.avg_expected_ev, b.avg_realized_return, b.ev_gap, b.ev_hit_rate, s.beta AS ev_calibration_beta, s.c AS ev_realized_corr, s.rho AS ev_spearman, CASE WHEN m.k >= 2 AND m.ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ev_monotonic_pass, s.hit AS hit_rate_pos_ev, s.n::DOUBLE AS n_trades, m.k::DOUBLE AS ev_bins_populated, m.low AS ev_min_bin_count, CASE WHEN m.k >= 5 AND m.low > 0 AND (s.n < 100 OR s.rho >= 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ev_model_valid FROM evb b, evm m, evs1 s", "evb evm evs1", _A26)
def a26(lake):
    return G.ev_diagnostics(chosen_of(lake)).select(*_A26.split())


FEATURES = ["prob_vol_6", "spread_bps", "depth_total", "velocity_1", "liquidity_log", "time_to_resolution_h"]
CTES["drl"] = " UNION ALL ".join(f"SELECT '{f}' AS feature, e, l, {f} AS v FROM drt" for f in FEATURES)
CTES["drt"] = "SELECT *, (rn <= greatest(10, n // 3))::INT AS e, (rn > n - greatest(10, n // 3))::INT AS l FROM (SELECT *, row_number() OVER (ORDER BY ts, token_id) AS rn, count(*) OVER () AS n FROM sig)"
CTES["drq"] = "SELECT feature, avg(v) FILTER (WHERE e = 1) AS me, avg(v) FILTER (WHERE l = 1) AS ml, stddev_pop(v) FILTER (WHERE e = 1) AS sd, count(v) FILTER (WHERE e = 1) AS ne, count(v) FILTER (WHERE l = 1) AS nl, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (WHERE e = 1) AS cuts FROM drl GROUP BY 1"
CTES["drh"] = "SELECT feature, slot, sum(e) AS ce, sum(l) AS cl FROM (SELECT d.feature, d.e, d.l, len(list_filter(q.cuts, lambda c: round(d.v, 12) >= round(c, 12))) AS slot FROM drl d JOIN drq q ON q.feature = d.feature WHERE d.e + d.l > 0) GROUP BY 1, 2"


@query("a28_feature_drift", "SELECT *, CASE WHEN abs(drift_z) >= 0.5 OR psi >= 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS drift_flag FROM (SELECT q.feature, me AS mean_early, ml AS mean_late, ml - me AS mean_shift, (ml - me) / greatest(sd, 1e-6) AS drift_z, p.psi FROM drq q JOIN (SELECT g.feature, sum((pl - pe) * ln(pl / pe)) AS psi FROM (SELECT q.feature, greatest(coalesce(h.ce, 0) / ne::DOUBLE, 1e-6) AS pe, greatest(coalesce(h.cl, 0) / nl::DOUBLE, 1e-6) AS pl FROM drq q CROSS JOIN (SELECT unnest(range(10)) AS slot) s LEFT JOIN drh h ON h.feature = q.feature AND h.slot = s.slot) g GROUP BY 1) p ON p.feature = q.feature)", "drq drh drt drl", "mean_early mean_late mean_shift drift_z psi drift_flag")
def a28(lake):
    return G.feature_drift(signal_of(lake), FEATURES)


CTES["cdl"] = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, trade_return AS r FROM ev_tr" for f in FEATURES[:3])
CTES["cdq"] = "SELECT *, round(quantile_cont(v, 0.25) OVER (PARTITION BY feature), 12) AS q25, round(quantile_cont(v, 0.75) OVER (PARTITION BY feature), 12) AS q75 FROM cdl"


@query("a58_condition_tables", "SELECT 'strong' AS side, feature, feature || '>=Q75' AS condition, count(*) AS n, avg(r) AS avg_return, avg((r > 0)::INT) AS win_rate FROM cdq WHERE round(v, 12) >= q75 GROUP BY 2 UNION ALL SELECT 'weak', feature, feature || '<=Q25', count(*), avg(r), avg((r > 0)::INT) FROM cdq WHERE round(v, 12) <= q25 GROUP BY 2", "cdq", "avg_return win_rate")
def a58(lake):
    return G.condition_tables(chosen_of(lake), FEATURES[:3])


@query("c5_diagnostics", "SELECT 'edge_attribution' AS report, count(*) AS n_rows FROM (SELECT 1 FROM prob GROUP BY GROUPING SETS ((), (category), (vol_regime), (is_low_liq_regime), (is_high_vol_regime))) UNION ALL SELECT 'calibration_curve', 20 UNION ALL SELECT 'signal_deciles', count(DISTINCT bin) FROM decb UNION ALL SELECT 'feature_drift', count(*) FROM drq UNION ALL SELECT 'model_vs_market', count(DISTINCT bin) + count(DISTINCT category) FROM strb UNION ALL SELECT 'ev_diagnostics', count(*) FROM evb", "prob decb drq drt drl strb evb")
def c5(lake):
    reports = G.bundle(signal_of(lake), chosen_of(lake), FEATURES)
    out = None
    for name, df in reports.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("report"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


# -------------------------------------------------------------- resampling

REPS, PERMS = 1000, 2000
CUTS_SQL = lambda d: "(" + " + ".join(f"({d} >= {c})::INT" for c in B.POISSON_CUTS) + ")"
SIGN_SQL = f"CASE WHEN (({draw_sql('t.id', f'(r.rep // {B.BITS})')}) >> (r.rep % {B.BITS})::INT) % 2 = 1 THEN 1 ELSE -1 END"


def boot_sql(src: str, cols: str) -> str:
    """Rows of ``src`` with their weight w in every replicate."""
    return f"SELECT rep, {cols}, {CUTS_SQL('d')} AS w FROM (SELECT t.*, r.rep, {draw_sql('t.id', 'r.rep')} AS d FROM {src} t, (SELECT unnest(range({REPS}))::BIGINT AS rep) r)"


CTES["bst"] = f"SELECT * FROM ({boot_sql('ten', 'id, x')}) WHERE w > 0"
CTES["bsr"] = f"""
SELECT s.rep, s.mean, s.sharpe, d.drawdown FROM (SELECT rep, s / c AS mean, CASE WHEN c >= 3 AND q / c - (s / c) * (s / c) > 1e-18 THEN (s / c) / sqrt(q / c - (s / c) * (s / c)) * sqrt(8760) ELSE 0 END AS sharpe FROM (SELECT rep, sum(w) AS c, sum(w * x) AS s, sum(w * x * x) AS q FROM bst GROUP BY 1)) s
JOIN (SELECT rep, min(CASE WHEN pk > 0 THEN eq / pk - 1 ELSE -1 END) AS drawdown FROM (SELECT rep, eq, max(eq) OVER (PARTITION BY rep ORDER BY h, id) AS pk FROM (SELECT rep, t.id, h, product(pow(greatest(1 + x, 0), w)) OVER (PARTITION BY rep ORDER BY h, t.id) AS eq FROM bst t JOIN (SELECT id, {draw_sql('id', str(B.ORDER_DRAW))} AS h FROM ten) o ON o.id = t.id)) GROUP BY 1) d ON d.rep = s.rep"""


def ci_sql(src: str, names: dict[str, str]) -> str:
    return ", ".join(f"avg({a}) AS {b}, quantile_cont({a}, 0.025) AS {b}_ci_low, quantile_cont({a}, 0.975) AS {b}_ci_high" for a, b in names.items())


_A42 = " ".join(f"{b} {b}_ci_low {b}_ci_high" for b in ("mean_return", "sharpe", "max_drawdown"))


@query("a42_bootstrap", f"SELECT {ci_sql('bsr', {'mean': 'mean_return', 'sharpe': 'sharpe', 'drawdown': 'max_drawdown'})} FROM bsr", "bsr ten", _A42)
def a42(lake):
    return B.bootstrap(test_of(lake), ["ts", "token_id"], REPS)


CTES["dbl"] = "SELECT *, row_number() OVER (ORDER BY day) - 1 AS id, count(*) OVER () AS n FROM (SELECT date_trunc('day', ts) AS day, count(*) AS c, sum(x) AS s, sum(x * x) AS q FROM ten GROUP BY 1)"
CTES["bbr"] = f"SELECT rep, s / c AS mean, CASE WHEN c >= 3 AND q / c - (s / c) * (s / c) > 1e-18 THEN (s / c) / sqrt(q / c - (s / c) * (s / c)) * sqrt(8760) ELSE 0 END AS sharpe FROM (SELECT d.rep, sum(v.c) AS c, sum(v.s) AS s, sum(v.q) AS q FROM (SELECT r.rep, {pick_sql('t.id', 'r.rep', 't.n')} AS src FROM dbl t, (SELECT unnest(range({REPS}))::BIGINT AS rep) r) d JOIN dbl v ON v.id = d.src GROUP BY 1)"
_A42B = " ".join(f"{b} {b}_ci_low {b}_ci_high" for b in ("mean_return_block", "sharpe_block"))


@query("a42_block_bootstrap", f"SELECT {ci_sql('bbr', {'mean': 'mean_return_block', 'sharpe': 'sharpe_block'})} FROM bbr", "bbr dbl ten", _A42B)
def a42b(lake):
    return B.block_bootstrap(test_of(lake), REPS)


CTES["flip"] = f"SELECT (SELECT avg(x) FROM ten) AS perm_stat, avg((round(abs(m), 12) >= (SELECT round(abs(avg(x)), 12) FROM ten))::INT) AS perm_pvalue FROM (SELECT r.rep, avg(t.x * {SIGN_SQL}) AS m FROM ten t, (SELECT unnest(range({PERMS}))::BIGINT AS rep) r GROUP BY 1)"


@query("a43_sign_flip", "SELECT * FROM flip", "flip ten", "perm_stat perm_pvalue")
def a43(lake):
    return B.sign_flip(test_of(lake), ["ts", "token_id"], PERMS)


CTES["cand"] = "SELECT ts, 'thr=' || printf('%.4f', threshold) || '|hp=' || holding_period::VARCHAR AS candidate, avg(trade_return) AS ret FROM tr GROUP BY 1, 2"
CTES["cden"] = "SELECT t.ts, t.id, t.n, c.candidate, coalesce(x.ret, 0) AS ret FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS id, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM cand)) t CROSS JOIN (SELECT DISTINCT candidate FROM cand) c LEFT JOIN cand x ON x.ts = t.ts AND x.candidate = c.candidate"


@query("a46_candidate_returns", "SELECT ts, candidate, ret FROM cden", "cden", "ret")
def a46(lake):
    return B.dense_returns(B.candidate_returns(trades_of(lake))).select("ts", "candidate", "ret")


@query("a46_candidate_matrix", "SELECT ts, " + ", ".join(f"coalesce(max(ret) FILTER (WHERE candidate = 'thr={t:.4f}|hp={h}'), 0) AS \"thr={t:.4f}|hp={h}\"" for t in THRESHOLDS for h in CFG.holding_periods) + " FROM cden GROUP BY 1", "cden", " ".join(f'"thr={t:.4f}|hp={h}"' for t in THRESHOLDS for h in CFG.holding_periods))
def a46b(lake):
    return B.candidate_matrix(trades_of(lake), [f"thr={t:.4f}|hp={h}" for t in THRESHOLDS for h in CFG.holding_periods])


CTES["wrc"] = f"""
SELECT (SELECT max(mu) FROM (SELECT avg(ret) AS mu FROM cden GROUP BY candidate)) AS white_stat, avg((round(m, 12) >= (SELECT round(max(mu), 12) FROM (SELECT avg(ret) AS mu FROM cden GROUP BY candidate)))::INT) AS white_pvalue,
 (SELECT count(DISTINCT candidate)::DOUBLE FROM cden) AS n_candidates, (SELECT count(DISTINCT ts)::DOUBLE FROM cden) AS white_n_obs FROM (
SELECT rep, max(m) AS m FROM (SELECT d.rep, c.candidate, sum(d.w * (c.ret - c.mu)) / sum(d.w) AS m FROM ({boot_sql('(SELECT DISTINCT id FROM cden)', 'id')}) d JOIN (SELECT *, avg(ret) OVER (PARTITION BY candidate) AS mu FROM cden) c ON c.id = d.id WHERE d.w > 0 GROUP BY 1, 2) GROUP BY 1)"""


@query("a44_reality_check", "SELECT * FROM wrc", "wrc cden", "white_stat white_pvalue n_candidates white_n_obs")
def a44(lake):
    return B.reality_check(B.candidate_returns(trades_of(lake)), REPS)


CTES["csl"] = "SELECT slice, candidate, avg(ret) AS perf FROM (SELECT *, CASE WHEN id < (n % 8) * (n // 8 + 1) THEN id // (n // 8 + 1) ELSE n % 8 + (id - (n % 8) * (n // 8 + 1)) // (n // 8) END AS slice FROM cden) GROUP BY 1, 2"
CTES["cmb"] = "SELECT combo FROM (SELECT unnest(range(256))::BIGINT AS combo) WHERE bit_count(combo) = 4"
CTES["cpf"] = "SELECT c.combo, s.candidate, round(avg(perf) FILTER (WHERE (c.combo >> s.slice) % 2 = 1), 12) AS ip, round(avg(perf) FILTER (WHERE (c.combo >> s.slice) % 2 = 0), 12) AS op FROM cmb c CROSS JOIN csl s GROUP BY 1, 2"
CTES["pbo"] = "SELECT combo, m::DOUBLE AS n_configs, candidate AS chosen_config, ir::DOUBLE AS chosen_is_rank, orank::DOUBLE AS chosen_oos_rank, ln(greatest(1e-4, least(1 - 1e-4, orank / (m + 1.0::DOUBLE))) / greatest(1e-4, 1 - greatest(1e-4, least(1 - 1e-4, orank / (m + 1.0::DOUBLE))))) AS \"lambda\" FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY ip DESC, candidate) AS ir, row_number() OVER (PARTITION BY combo ORDER BY op DESC, candidate) AS orank, count(*) OVER (PARTITION BY combo) AS m FROM cpf) WHERE ir = 1"
_PBO = "n_configs chosen_is_rank chosen_oos_rank \"lambda\""


@query("w16_split_ranks", "SELECT * FROM pbo", "pbo", _PBO)
def w16(lake):
    return B.overfit_trials(B.candidate_returns(trades_of(lake)))


@query("j34_half_splits", "SELECT combo, count(*) AS n_rows FROM (SELECT c.combo FROM cmb c CROSS JOIN csl s) GROUP BY 1", "cmb csl")
def j34(lake):
    sl = B.time_slices(B.candidate_returns(trades_of(lake)))
    combos = B.half_splits(sl).agg(F.collect_list("combo").alias("v")).scalar()
    return sl.withColumn("combo", F.explode(combos)).groupBy("combo").agg(F.count(F.lit(1)).alias("n_rows"))


CTES["pbr"] = "SELECT CASE WHEN n >= 24 THEN p END AS pbo, CASE WHEN n >= 24 THEN k ELSE 0 END AS pbo_trials, CASE WHEN n >= 24 THEN med END AS pbo_median_logit, n AS pbo_n_obs, c AS pbo_n_candidates, CASE WHEN n >= 24 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pbo_computable, CASE WHEN n >= 24 THEN '' ELSE 'insufficient_matrix' END AS pbo_reason FROM (SELECT avg((\"lambda\" > 0)::INT) AS p, count(*)::DOUBLE AS k, median(\"lambda\") AS med, (SELECT count(DISTINCT ts)::DOUBLE FROM cden) AS n, (SELECT count(DISTINCT candidate)::DOUBLE FROM cden) AS c FROM pbo)"
_PBR = "pbo pbo_trials pbo_median_logit pbo_n_obs pbo_n_candidates pbo_computable"


@query("a45_overfit_probability", "SELECT * FROM pbr", "pbr", _PBR)
def a45(lake):
    return B.overfit_probability(B.candidate_returns(trades_of(lake)))


@query("a50_advanced_validation", f"SELECT w.*, p.*, 'thr=0.1500|hp=3' AS chosen_candidate, (SELECT avg(ret) FROM cden WHERE candidate = 'thr=0.1500|hp=3') AS perm_stat, (SELECT avg((round(abs(m), 12) >= (SELECT round(abs(avg(ret)), 12) FROM cden WHERE candidate = 'thr=0.1500|hp=3'))::INT) FROM (SELECT r.rep, avg(t.ret * {SIGN_SQL}) AS m FROM (SELECT * FROM cden WHERE candidate = 'thr=0.1500|hp=3') t, (SELECT unnest(range({PERMS}))::BIGINT AS rep) r GROUP BY 1)) AS perm_pvalue FROM wrc w, pbr p", "wrc pbr cden", "white_stat white_pvalue n_candidates white_n_obs perm_stat perm_pvalue " + _PBR)
def a50(lake):
    return V.advanced_row(trades_of(lake), 0.15, 3, REPS, PERMS)


CTES["ost"] = "SELECT count(*) AS n_obs, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS ttest_stat FROM ten"
CTES["wcx"] = "SELECT least(coalesce(sum(rk) FILTER (WHERE x > 0), 0), coalesce(sum(rk) FILTER (WHERE x < 0), 0)) AS wilcoxon_stat, count(*) AS n_nonzero FROM (SELECT x, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS rk FROM (SELECT x, round(abs(x), 12) AS a FROM ten WHERE x <> 0))"


@query("a40_one_sample_tests", "SELECT o.n_obs, o.ttest_stat, w.wilcoxon_stat, w.n_nonzero, (SELECT coalesce(sum(t * t * t - t), 0) FROM (SELECT count(*)::DOUBLE AS t FROM ten WHERE x <> 0 GROUP BY round(abs(x), 12))) AS tie_term FROM ost o, wcx w", "ost wcx ten", "ttest_stat wilcoxon_stat tie_term")
def a40(lake):
    return V.one_sample_tests(test_of(lake)).drop("degenerate")


@query("a40_one_sample_p_values")
def a40p(lake):
    return V.with_p_values(V.one_sample_tests(test_of(lake)))


_A49 = "mean_return mean_return_ci_low mean_return_ci_high mean_return_ci_low_iid sharpe max_drawdown train_mean_return test_mean_return ttest_stat wilcoxon_stat permutation_pvalue n_obs overfit_gap stability_score"


@query("a49_validation_row", f"SELECT b.mean_return, least(b.mean_return_ci_low, k.mean_return_block_ci_low) AS mean_return_ci_low, greatest(b.mean_return_ci_high, k.mean_return_block_ci_high) AS mean_return_ci_high, b.mean_return_ci_low AS mean_return_ci_low_iid, b.sharpe, b.max_drawdown, tm AS train_mean_return, em AS test_mean_return, o.ttest_stat, w.wilcoxon_stat, f.perm_pvalue AS permutation_pvalue, o.n_obs::DOUBLE AS n_obs, tm - em AS overfit_gap, greatest(0, 1 - abs(tm - em)) AS stability_score FROM (SELECT {ci_sql('bsr', {'mean': 'mean_return', 'sharpe': 'sharpe', 'drawdown': 'max_drawdown'})} FROM bsr) b, (SELECT {ci_sql('bbr', {'mean': 'mean_return_block', 'sharpe': 'sharpe_block'})} FROM bbr) k, ost o, wcx w, flip f, (SELECT avg(trade_return) FILTER (WHERE split = 'train') AS tm, avg(trade_return) FILTER (WHERE split = 'test') AS em FROM evs)", "bsr bbr dbl ost wcx flip evs ten", _A49)
def a49(lake):
    s = split_of(lake)
    return V.validation_row(s.where("split = 'train'"), s.where("split = 'test'"), reps=REPS, perms=PERMS).select(*_A49.split())


CTES["hgt"] = "SELECT trade_return AS x, row_number() OVER (ORDER BY ts, market_id) - 1 AS id, count(*) OVER () AS n FROM ptr WHERE threshold = 0.004 AND holding_period = 1 AND realized_pair_fill_pct >= 0.3"


@query("a48_hedged_subset", f"SELECT (SELECT avg(x) FROM hgt) AS hedged_mean_return, quantile_cont(m, 0.025) AS hedged_mean_return_ci_low, quantile_cont(m, 0.975) AS hedged_mean_return_ci_high, (SELECT count(*)::DOUBLE FROM hgt) AS hedged_n FROM (SELECT rep, sum(w * x) / sum(w) AS m FROM ({boot_sql('hgt', 'x')}) GROUP BY 1 HAVING sum(w) > 0)", "hgt", "hedged_mean_return hedged_mean_return_ci_low hedged_mean_return_ci_high hedged_n")
def a48(lake):
    t = pair_trades_of(lake).where("threshold = 0.004 AND holding_period = 1")
    # the driver books are thin: a looser mark than the 95 % of the trade rows
    return V.hedged_columns(t.withColumn("fully_hedged", flag(F.col("realized_pair_fill_pct") >= 0.3)), reps=REPS)


CTES["nz"] = "SELECT ts, market_id, round(coalesce(edge_raw, 0), 9) AS x, round(coalesce(trade_return, 0), 9) AS y FROM ptr WHERE threshold = 0.004 AND holding_period = 1"
CTES["nr"] = "SELECT market_id, row_number() OVER (ORDER BY market_id, ts) - 1 AS id, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM nz"
CTES["nd"] = f"SELECT rep, market_id, id, rx, ry, row_number() OVER (PARTITION BY rep, market_id ORDER BY id) AS k, row_number() OVER (PARTITION BY rep, market_id ORDER BY {draw_sql('id', 'rep')}, id) AS kh FROM nr CROSS JOIN (SELECT unnest(range(500)) AS rep)"
CTES["nc"] = "SELECT a.rep, corr(b.rx, a.ry) AS c FROM nd a JOIN nd b ON a.rep = b.rep AND a.market_id = b.market_id AND a.k = b.kh GROUP BY 1"
CTES["nobs"] = "SELECT corr(rx, ry) AS c, count(*) AS n FROM nr"


@query("a47_shuffle_null", "SELECT CASE WHEN n < 20 OR c IS NULL THEN 1.0::DOUBLE ELSE (SELECT avg((round(abs(nc.c), 12) >= round(abs(nobs.c), 12))::INT) FROM nc WHERE nc.c IS NOT NULL) END AS null_shuffle_pvalue, c AS observed FROM nobs", "nc nobs", "null_shuffle_pvalue observed")
def a47(lake):
    return B.shuffle_null(pair_trades_of(lake).where("threshold = 0.004 AND holding_period = 1"), ("ts", "market_id"))


# ------------------------------------------------------------------ labels

QS = (0.60, 0.50, 0.40, 0.30, 0.20, 0.10, 0.0)
CTES["mv"] = "SELECT *, row_number() OVER (ORDER BY move, ts, token_id) AS rn, count(*) OVER () AS n FROM (SELECT ts, token_id, round(future_mid_1 - mid, 12) AS move FROM sig WHERE future_mid_1 IS NOT NULL)"
CTES["mvc"] = " UNION ALL ".join([f"SELECT {i} AS no, (SELECT round(quantile_cont(move, {q}), 12) FROM mv) AS thr" for i, q in enumerate((*QS, 0.65))])
CTES["mvr"] = "SELECT c.no, c.thr, avg((m.move > c.thr)::INT) AS rate FROM mvc c, mv m GROUP BY 1, 2 UNION ALL SELECT 8, (SELECT thr FROM mvc WHERE no = 7), avg((round(rn / n::DOUBLE, 12) >= 0.65)::INT) FROM mv"
CTES["mvb"] = "SELECT * FROM mvr ORDER BY CASE WHEN rate BETWEEN 0.1 AND 0.9 THEN 0 ELSE 1 END, round(abs(rate - 0.35), 12), CASE WHEN rate > 0 AND rate < 1 THEN 0 ELSE 1 END, no LIMIT 1"


@query("a51_label_choice", "SELECT 'future_price_move' AS label_mode, 'future_mid_1' AS label_source, CASE WHEN rate <= 0 OR rate >= 1 THEN 'degenerate_train_labels' WHEN rate NOT BETWEEN 0.1 AND 0.9 THEN 'label_imbalance' ELSE '' END AS label_warning, (SELECT count(*)::DOUBLE FROM mv) AS n_samples, CASE WHEN rate > 0 AND rate < 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS y_unique, rate AS pos_rate, thr AS move_threshold FROM mvb", "mvb mv", "n_samples y_unique pos_rate move_threshold")
def a51(lake):
    return V.move_labels(signal_of(lake), 1, QS)[1]


@query("a51_outcome_labels", "SELECT 'resolved_outcome' AS label_mode, 'winner' AS label_source, CASE WHEN count(DISTINCT winner) < 2 THEN 'degenerate_train_labels' ELSE '' END AS label_warning, count(winner)::DOUBLE AS n_samples, count(DISTINCT winner)::DOUBLE AS y_unique, avg(winner) AS pos_rate, 0.0::DOUBLE AS move_threshold FROM sig", "sig", "n_samples y_unique pos_rate move_threshold")
def a51b(lake):
    return V.outcome_labels(signal_of(lake))[1]


@query("w18_rank_labels", "SELECT ts, token_id, CASE WHEN (SELECT no FROM mvb) = 8 THEN (round(rn / n::DOUBLE, 12) >= 0.65)::BIGINT ELSE (move > (SELECT thr FROM mvb))::BIGINT END AS label FROM mv", "mv mvb")
def w18(lake):
    return V.move_labels(signal_of(lake), 1, QS)[0].select("ts", "token_id", "label")


@query("j32_move_sizes", "SELECT s.ts, s.token_id, greatest(1e-4, least(0.4, coalesce(c.m, (SELECT greatest(1e-4, least(0.25, avg(abs(future_mid_1 - mid)))) FROM sig WHERE ts <= TIMESTAMP '2024-01-15')))) AS expected_move_size FROM sig s LEFT JOIN (SELECT category, avg(abs(future_mid_1 - mid)) AS m FROM sig WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1) c ON c.category = s.category", "sig", "expected_move_size")
def j32(lake):
    s = signal_of(lake)
    return V.move_sizes(s.where("ts <= TIMESTAMP '2024-01-15'"), s, "future_mid_1").select("ts", "token_id", "expected_move_size")


@query("a56_classifier_metrics", "SELECT (sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS log_loss, avg((q - y) * (q - y)) AS brier FROM (SELECT *, rank() OVER (ORDER BY round(q, 12)) + (count(*) OVER (PARTITION BY round(q, 12)) - 1) / 2.0::DOUBLE AS rk FROM (SELECT winner AS y, greatest(1e-6, least(1 - 1e-6, mid)) AS q FROM sig WHERE winner IS NOT NULL))", "sig", "auc log_loss brier")
def a56(lake):
    return V.classifier_metrics(signal_of(lake).where("winner IS NOT NULL"), "winner", "mid")
