"""Pairs: outer and inner pairing, parity scans, two-leg costing."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.catalog.registry import CTES, memo, query
from marketlab.catalog.trading import _SUMM, equity_sql, summary_sql
from marketlab.operators import pairs as X, summary as R
from marketlab.operators.config import PairCostConfig, PairStrategyConfig
from marketlab.session import materialise

PCFG = PairStrategyConfig(base_trade_notional=20.0, pair_min_depth=5.0, min_pair_fill=0.05)  # the driver books are thin
PCOST = PairCostConfig()
THR = (0.004, 0.01, 0.05)

CTES["lastb"] = "SELECT snapshot_ts AS ts, s.* EXCLUDE (snapshot_ts) FROM snap s WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM snap) AND mid IS NOT NULL"


@query("j11_latest_books", "SELECT ts, market_id, token_id, mid, spread, bid_depth, ask_depth, outcome_label, token_id % 2 AS outcome_index FROM lastb", "lastb", "mid spread bid_depth ask_depth")
def j11(lake):
    return X.latest_books(lake.snapshots, lake.outcomes).select("ts", "market_id", "token_id", "mid", "spread", "bid_depth", "ask_depth", "outcome_label", "outcome_index")


CTES["parity"] = """
SELECT y.ts, y.market_id, y.mid AS mid_yes, n.mid AS mid_no, y.mid + n.mid AS sum_prob, abs(y.mid + n.mid - 1) AS violation_prob,
  y.spread + n.spread + 0.007::DOUBLE AS cost_buffer_return, abs(y.mid + n.mid - 1) AS expected_gross_return, abs(y.mid + n.mid - 1) - (y.spread + n.spread + 0.007::DOUBLE) AS expected_net_return,
  CASE WHEN y.mid + n.mid > 1 THEN 'BUY_CHEAPER_LEG' ELSE 'SELL_RICHER_LEG' END AS trade_side, y.mid + n.mid > 1 AS sum_gt_one, 1::BIGINT AS hedged
FROM lastb y JOIN lastb n ON y.market_id = n.market_id AND y.ts = n.ts WHERE y.outcome_label = 'Yes' AND n.outcome_label = 'No' AND abs(y.mid + n.mid - 1) >= 0.005"""
_PAR = "mid_yes mid_no sum_prob violation_prob cost_buffer_return expected_gross_return expected_net_return"


@query("j12_complement_parity", "SELECT * FROM parity", "parity", _PAR)
def j12(lake):
    return X.complement_parity(X.latest_books(lake.snapshots, lake.outcomes)).orderBy(F.col("expected_net_return").desc(), "market_id")


CTES["multi"] = """
SELECT ts, market_id, n_outcomes, sum_prob, avg_spread, max_prob, min_prob, v AS violation_prob, v AS expected_gross_return, avg_spread + 0.0035::DOUBLE AS cost_buffer_return, v - (avg_spread + 0.0035::DOUBLE) AS expected_net_return FROM (
SELECT *, CASE WHEN n_outcomes >= 2 THEN abs(sum_prob - 1) ELSE 0 END AS v FROM (SELECT ts, market_id, count(token_id) AS n_outcomes, sum(mid) AS sum_prob, avg(spread) AS avg_spread, max(mid) AS max_prob, min(mid) AS min_prob FROM lastb GROUP BY 1, 2)) WHERE v >= 0.005"""


@query("a6_outcome_sums", "SELECT * FROM multi", "multi", "sum_prob avg_spread max_prob min_prob violation_prob expected_gross_return cost_buffer_return expected_net_return")
def a6(lake):
    return X.outcome_sums(X.latest_books(lake.snapshots, lake.outcomes))


@query("a61_parity_summary", "SELECT 'consistency_arb' AS module, c::DOUBLE AS n_complement_candidates, m::DOUBLE AS n_multioutcome_candidates, 0.0::DOUBLE AS n_timewindow_candidates, coalesce(a, 0) AS avg_expected_net_return FROM (SELECT count(*) FILTER (WHERE k = 'c') AS c, count(*) FILTER (WHERE k = 'm') AS m, avg(v) AS a FROM (SELECT 'c' AS k, expected_net_return AS v FROM parity UNION ALL SELECT 'm', expected_net_return FROM multi))", "parity multi", "n_complement_candidates n_multioutcome_candidates n_timewindow_candidates avg_expected_net_return")
def a61(lake):
    b = X.latest_books(lake.snapshots, lake.outcomes)
    return X.parity_summary(X.complement_parity(b), X.outcome_sums(b))


@query("j26_recent_books", "SELECT snapshot_ts AS ts, market_id, token_id, lower(outcome_label) AS outcome_label, best_bid, best_ask, mid FROM snap WHERE snapshot_ts >= (SELECT max(snapshot_ts) - INTERVAL 72 HOUR FROM snap)", "snap", "best_bid best_ask mid")
def j26(lake):
    return X.outcome_books(lake.snapshots, lake.outcomes, 72).select("ts", "market_id", "token_id", "outcome_label", "best_bid", "best_ask", "mid")


CTES["pairo"] = """
SELECT coalesce(y.snapshot_ts, n.snapshot_ts) AS ts, coalesce(y.market_id, n.market_id) AS market_id, y.token_id AS token_id_yes, n.token_id AS token_id_no,
 y.best_bid AS best_bid_yes, y.best_ask AS best_ask_yes, n.best_bid AS best_bid_no, n.best_ask AS best_ask_no, y.mid AS mid_yes, n.mid AS mid_no, y.spread AS spread_yes, n.spread AS spread_no, y.spread_bps AS spread_bps_yes, n.spread_bps AS spread_bps_no,
 coalesce(y.bid_depth, 0) + coalesce(y.ask_depth, 0) AS depth_yes, coalesce(n.bid_depth, 0) + coalesce(n.ask_depth, 0) AS depth_no
FROM (SELECT * FROM snap WHERE outcome_label = 'Yes') y FULL JOIN (SELECT * FROM snap WHERE outcome_label = 'No') n ON y.snapshot_ts = n.snapshot_ts AND y.market_id = n.market_id"""


@query("j23_outer_pairing", "SELECT ts, market_id, token_id_yes, token_id_no, mid_yes, mid_no, depth_yes, depth_no, least(depth_yes, depth_no) AS min_pair_depth, token_id_yes IS NOT NULL AND token_id_no IS NOT NULL AS both_legs_present, best_bid_yes IS NOT NULL AND best_ask_yes IS NOT NULL AND best_bid_no IS NOT NULL AND best_ask_no IS NOT NULL AS both_legs_two_sided FROM pairo", "pairo", "mid_yes mid_no depth_yes depth_no min_pair_depth")
def j23(lake):
    p = X.pair_presence(X.side_by_side(X.outcome_books(lake.snapshots, lake.outcomes)))
    return p.select("ts", "market_id", "token_id_yes", "token_id_no", "mid_yes", "mid_no", "depth_yes", "depth_no", "min_pair_depth", "both_legs_present", "both_legs_two_sided")


def books(lake):
    return X.pair_books(lake.snapshots, lake.outcomes, lake.markets, lake.resolutions)


@query("j25_pair_books", "SELECT s.snapshot_ts AS ts, s.market_id, s.token_id, lower(s.outcome_label) AS outcome_label, s.mid, m.event_id, m.category, m.created_ts, coalesce(m.close_ts, m.end_ts) AS close_ts, r.resolved_ts FROM snap s LEFT JOIN mkt m ON m.market_id = s.market_id LEFT JOIN res r ON r.market_id = s.market_id", "snap mkt res", "mid")
def j25(lake):
    return books(lake).select("ts", "market_id", "token_id", "outcome_label", "mid", *X.ATTRS)


CTES["pairi"] = """
SELECT p.*, m.event_id, coalesce(m.category, 'unknown') AS category, m.created_ts, coalesce(m.close_ts, m.end_ts) AS close_ts, r.resolved_ts,
  best_bid_yes IS NOT NULL AND best_ask_yes IS NOT NULL AND best_bid_no IS NOT NULL AND best_ask_no IS NOT NULL AS two
FROM pairo p LEFT JOIN mkt m ON m.market_id = p.market_id LEFT JOIN res r ON r.market_id = p.market_id WHERE token_id_yes IS NOT NULL AND token_id_no IS NOT NULL"""


@query("j24_inner_pairing", "SELECT ts, market_id, event_id, mid_yes, mid_no, CASE WHEN two THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS book_tradable FROM pairi", "pairi", "mid_yes mid_no book_tradable")
def j24(lake):
    return X.complete_pairs(books(lake)).select("ts", "market_id", "event_id", "mid_yes", "mid_no", "book_tradable")


CTES["pairf0"] = """
SELECT *, pm / lag(pm) OVER (PARTITION BY market_id ORDER BY ts) - 1 AS ret FROM (
SELECT *, best_ask_yes + best_ask_no AS sum_ask, best_bid_yes + best_bid_no AS sum_bid, least(depth_yes, depth_no) AS mpd, spread_bps_yes + spread_bps_no AS sbps,
 CASE WHEN two THEN greatest(1e-6, least(0.999999, (best_bid_yes + best_bid_no + best_ask_yes + best_ask_no) / 2)) END AS pm,
 coalesce(date_diff('second', ts, coalesce(resolved_ts, close_ts)) / 3600.0::DOUBLE, 9999) AS time_to_resolution_h FROM pairi)"""
CTES["pairf"] = """
SELECT *, edge_raw * ff AS g, 0.002::DOUBLE * ff + (1 - fill) * 0.0025::DOUBLE + least(0.03::DOUBLE, 0.05::DOUBLE * ld) * ff + 0.1::DOUBLE * vol * (1 + ld) * ff AS c,
  lead(best_bid_yes, 1) OVER w AS fby1, lead(best_ask_yes, 1) OVER w AS fay1, lead(best_bid_no, 1) OVER w AS fbn1, lead(best_ask_no, 1) OVER w AS fan1, lead(edge_raw, 1) OVER w AS fe1,
  lead(best_bid_yes, 3) OVER w AS fby3, lead(best_ask_yes, 3) OVER w AS fay3, lead(best_bid_no, 3) OVER w AS fbn3, lead(best_ask_no, 3) OVER w AS fan3,
  lead(best_bid_yes, 6) OVER w AS fby6, lead(best_ask_yes, 6) OVER w AS fay6, lead(best_bid_no, 6) OVER w AS fbn6, lead(best_ask_no, 6) OVER w AS fan6 FROM (
SELECT *, fill * fill AS ff, CASE WHEN pair_direction = 'LONG_SET' THEN edge_raw ELSE -edge_raw END AS signal,
  CASE WHEN two THEN greatest(0.05::DOUBLE, least(1, least(1, edge_raw / 0.02) / (1 + sbps / 400) * (ln(1 + mpd) / ln(501)))) END AS confidence FROM (
SELECT *, 1 / (1 + exp(-greatest(-20, least(20, 1.5::DOUBLE - 2 * ld - sbps / 250)))) AS fill FROM (
SELECT *, CASE WHEN two THEN greatest(1 - sum_ask, sum_bid - 1, 0) END AS edge_raw, CASE WHEN 1 - sum_ask >= sum_bid - 1 THEN 'LONG_SET' ELSE 'SHORT_SET' END AS pair_direction,
  20 / greatest(mpd, 1) AS ld, coalesce(CASE WHEN count(ret) OVER w6 >= 3 THEN stddev_samp(ret) OVER w6 END, 0) AS vol FROM pairf0
WINDOW w6 AS (PARTITION BY market_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))))
WINDOW w AS (PARTITION BY market_id ORDER BY ts)"""
_P22 = "sum_ask sum_bid edge_raw signal confidence pair_volatility min_fill_prob_pair expected_pair_fill expected_gross_return expected_cost_return expected_net_ev min_pair_depth time_to_resolution_h"


@query("p22_pair_features", "SELECT ts, market_id, pair_direction, sum_ask, sum_bid, edge_raw, signal, confidence, vol AS pair_volatility, fill AS min_fill_prob_pair, ff AS expected_pair_fill, g AS expected_gross_return, c AS expected_cost_return, g - c AS expected_net_ev, mpd AS min_pair_depth, time_to_resolution_h FROM pairf", "pairf", _P22)
def p22(lake):
    return X.pair_features(X.complete_pairs(books(lake)), PCFG).select("ts", "market_id", "pair_direction", *_P22.split())


@query("w7_pair_volatility", "SELECT ts, market_id, vol AS pair_volatility FROM pairf", "pairf", "pair_volatility")
def w7p(lake):
    return X.pair_features(X.complete_pairs(books(lake)), PCFG).select("ts", "market_id", "pair_volatility")


CTES["psig"] = "SELECT *, coalesce(fe1 - edge_raw, 0) AS forward_ret_1, g - c AS expected_net_ev FROM pairf WHERE two AND mpd >= 5 AND fill >= 0.05"


def pair_signal_of(lake):
    return memo(lake, "pair_signal", lambda: X.pair_signals(books(lake), PCFG))


@query("p23_pair_signals", "SELECT ts, market_id, signal, confidence, CASE WHEN signal >= 0 THEN 'LONG_YES' ELSE 'LONG_NO' END AS direction, 'BASKET' AS traded_side, lower(pair_direction) AS position_type, forward_ret_1, fby3 AS future_bid_yes_3, expected_net_ev FROM psig", "psig", "signal confidence forward_ret_1 future_bid_yes_3 expected_net_ev")
def p23(lake):
    return pair_signal_of(lake).select("ts", "market_id", "signal", "confidence", "direction", "traded_side", "position_type", "forward_ret_1", "future_bid_yes_3", "expected_net_ev")


@query("w5_pair_forward_quotes", "SELECT ts, market_id, fby1 AS future_bid_yes_1, fay1 AS future_ask_yes_1, fbn6 AS future_bid_no_6, fan6 AS future_ask_no_6 FROM pairf", "pairf", "future_bid_yes_1 future_ask_yes_1 future_bid_no_6 future_ask_no_6")
def w5p(lake):
    return X.forward_quotes(X.pair_features(X.complete_pairs(books(lake)), PCFG), PCFG.holding_periods).select("ts", "market_id", "future_bid_yes_1", "future_ask_yes_1", "future_bid_no_6", "future_ask_no_6")


_FUN = "rows avg_signal avg_expected_ev proxy_expectancy proxy_sharpe"


@query(
    "p21_structural_funnel",
    """SELECT 'all' AS split, step::BIGINT AS step, filter, coalesce(n, 0)::DOUBLE AS rows, coalesce(s, 0) AS avg_signal, coalesce(e, 0) AS avg_expected_ev, coalesce(x, 0) AS proxy_expectancy, CASE WHEN n > 1 THEN x / greatest(sd, 1e-9) ELSE 0 END AS proxy_sharpe FROM (
SELECT g.step, g.filter, count(p.x) AS n, avg(abs(p.signal)) AS s, avg(p.expected_net_ev) AS e, avg(p.x) AS x, stddev_pop(p.x) AS sd
FROM (VALUES (0, 'raw'), (1, 'book_tradable'), (2, 'min_depth'), (3, 'min_fill_prob'), (4, 'min_expected_net_ev_0.000000')) AS g(step, filter)
LEFT JOIN (SELECT coalesce(signal, 0) AS signal, g - c AS expected_net_ev, coalesce(fe1 - edge_raw, 0) AS x, CASE WHEN NOT two THEN 0 WHEN mpd < 5 THEN 1 WHEN fill < 0.05 THEN 2 WHEN g - c < 0 THEN 3 ELSE 4 END AS reach FROM pairf) p ON p.reach >= g.step GROUP BY 1, 2)""",
    "pairf",
    _FUN,
)
def p21(lake):
    p = X.forward_quotes(X.pair_features(X.complete_pairs(books(lake)), PCFG), PCFG.holding_periods)
    return X.structural_funnel(p, PCFG, 0.0, "all")


@query("a21_structural_ev_grid", "SELECT 'train' AS split, g.ev_threshold, count(expected_net_ev)::DOUBLE AS rows, coalesce(avg(expected_net_ev), 0) AS avg_expected_net_ev, coalesce(avg(forward_ret_1), 0) AS proxy_expectancy, CASE WHEN count(forward_ret_1) > 1 THEN avg(forward_ret_1) / greatest(stddev_pop(forward_ret_1), 1e-9) ELSE 0 END AS proxy_sharpe FROM (SELECT unnest([0.0::DOUBLE, 0.001, 0.002, 0.005]) AS ev_threshold) g LEFT JOIN psig p ON p.expected_net_ev >= g.ev_threshold GROUP BY 2", "psig", "ev_threshold rows avg_expected_net_ev proxy_expectancy proxy_sharpe")
def a21s(lake):
    return R.ev_threshold_grid(pair_signal_of(lake), (0.0, 0.001, 0.002, 0.005), "train", F.col("forward_ret_1"), structural=True)


def pair_sql(cells: list[dict]) -> str:
    d = "::DOUBLE"
    vals = ", ".join(
        f"({c['threshold']}{d}, {c['holding_period']}, '{c['execution_regime']}', {c['impact_coeff_input']}{d}, {c['impact_coeff']}{d}, {c['max_impact']}{d}, {c['vol_slippage_coeff']}{d}, {c['fill_alpha']}{d}, {c['fill_beta']}{d}, {c['fill_gamma']}{d}, {c['fill_buffer_bps']}{d})"
        for c in cells
    )
    px = lambda x: f"greatest(1e-6, least(0.999, {x}))"
    fut = lambda x: px(f"CASE holding_period WHEN 1 THEN {x}1 WHEN 3 THEN {x}3 ELSE {x}6 END")
    return f"""
SELECT *, edge * epf AS expected_gross_return, efee + esp + eimp + evs AS expected_cost_return, edge * epf - (efee + esp + eimp + evs) AS expected_ev, trade_return - (edge * epf - (efee + esp + eimp + evs)) AS ev_gap,
 CASE WHEN realized_pair_fill_pct >= 0.95 THEN 1.0{d} ELSE 0.0{d} END AS fully_hedged, epf AS expected_fill_pct, epf AS expected_pair_fill, (1 - epf) * holding_period AS time_to_fill_h FROM (
SELECT *, net_pnl / notional AS trade_return, gross_pnl / notional AS gross_return, 0.002{d} * (iny + inn) * epf AS efee, fill_buffer / 10000 * (1 - epf) AS esp, imp * least(fpy, fpn) AS eimp, slp * least(fpy, fpn) AS evs FROM (
SELECT *, gross_pnl - fees - spread_component - impact_component - vol_slippage_component - unwind_penalty_component AS net_pnl FROM (
SELECT *, 0.002{d} * turn AS fees, turn * imp AS impact_component, turn * slp AS vol_slippage_component FROM (
SELECT *, iny * qy + inn * qn + outy * uy + outn * un AS turn, qp * edge + CASE WHEN ls THEN outy - iny ELSE iny - outy END * uy + CASE WHEN ls THEN outn - inn ELSE inn - outn END * un AS gross_pnl,
 0.5{d} * greatest(0, fay - fby) * uy + 0.5{d} * greatest(0, fan - fbn) * un AS spread_component, fill_buffer / 10000 * (uy + un) AS unwind_penalty_component FROM (
SELECT *, qy - qp AS uy, qn - qp AS un, least(1, qp / notional) AS realized_pair_fill_pct FROM (
SELECT *, least(qy, qn) AS qp FROM (
SELECT *, notional * ry AS qy, notional * rn AS qn, 0.5{d} * (ry + rn) AS realized_fill_pct, least(ry, rn) AS actual_fill_proxy FROM (
SELECT *, fpy * (1 - 0.5{d} * qpen) AS ry, fpn * (1 - 0.5{d} * qpen) AS rn, fpy * fpn AS epf FROM (
SELECT *, 1 / (1 + exp(-greatest(-20, least(20, fill_alpha - 2 * (notional / greatest(1, depth_yes)) - fill_beta * (wide / 200))))) AS fpy, 1 / (1 + exp(-greatest(-20, least(20, fill_alpha - 2 * (notional / greatest(1, depth_no)) - fill_beta * (wide / 200))))) AS fpn,
 (1 - conf) * (0.25{d} + notional / pd) AS qpen, least(max_impact, impact_coeff * (notional / pd)) AS imp, vol_coeff * vol * (1 + notional / pd) AS slp FROM (
SELECT *, greatest(1, least(250{d} * conf, 0.10{d} * pd)) AS notional, CASE WHEN ls THEN 1 - (ay + an) ELSE by_ + bn - 1 END AS edge, CASE WHEN ls THEN ay ELSE by_ END AS iny, CASE WHEN ls THEN an ELSE bn END AS inn, CASE WHEN ls THEN fby ELSE fay END AS outy, CASE WHEN ls THEN fbn ELSE fan END AS outn FROM (
SELECT s.ts, s.market_id, s.category, s.edge_raw, s.depth_yes, s.depth_no, s.vol, s.signal, g.*, signal > 0 AS ls, greatest(0.05{d}, least(1, confidence)) AS conf, greatest(1, least(depth_yes, depth_no)) AS pd, (spread_yes + spread_no) * 10000 AS wide,
 {px('best_ask_yes')} AS ay, {px('best_ask_no')} AS an, {px('best_bid_yes')} AS by_, {px('best_bid_no')} AS bn, {fut('fby')} AS fby, {fut('fay')} AS fay, {fut('fbn')} AS fbn, {fut('fan')} AS fan
FROM psig s JOIN (VALUES {vals}) AS g(threshold, holding_period, execution_regime, impact_coeff_input, impact_coeff, max_impact, vol_coeff, fill_alpha, fill_beta, fill_gamma, fill_buffer)
 ON abs(signal) >= g.threshold AND CASE holding_period WHEN 1 THEN fby1 + fay1 + fbn1 + fan1 WHEN 3 THEN fby3 + fay3 + fbn3 + fan3 ELSE fby6 + fay6 + fbn6 + fan6 END IS NOT NULL
)))))))))))"""


CTES["ptr"] = pair_sql(X.pair_grid(PCOST, THR))
PREG = PairCostConfig(holding_periods=(3,))
CTES["ptrr"] = pair_sql(X.pair_grid(PREG, (0.01,), ("optimistic", "base", "pessimistic")))
for _s in ("ptr", "ptrr"):
    CTES[f"{_s}_eq"] = equity_sql(_s)
    CTES[f"{_s}_sum"] = summary_sql(_s, True)
_P24 = "notional qp fully_hedged gross_pnl fees spread_component impact_component vol_slippage_component unwind_penalty_component net_pnl trade_return gross_return expected_gross_return expected_cost_return expected_ev ev_gap realized_pair_fill_pct"


def pair_trades_of(lake):
    return memo(lake, "pair_trades", lambda: X.run_pair_grid(pair_signal_of(lake), PCOST, THR))


@query("p24_pair_costs", f"SELECT ts, market_id, threshold, holding_period::BIGINT AS holding_period, {', '.join(_P24.split())} FROM ptr", "ptr", "threshold " + _P24)
def p24(lake):
    t = X.run_pair_grid(pair_signal_of(lake), PCOST, THR)
    return t.withColumn("qp", F.col("qty_pair_hedged")).select("ts", "market_id", "threshold", "holding_period", *_P24.split())


@query("p25_pair_trade_rows", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || market_id::VARCHAR || '|hp=' || holding_period::VARCHAR AS paired_trade_id, threshold, CASE WHEN ls THEN 'LONG_SET' ELSE 'SHORT_SET' END AS pair_direction, CASE WHEN ls THEN 'LONG_YES' ELSE 'LONG_NO' END AS direction, 'BASKET' AS traded_side, 'RETURN_NEXT_H' AS prediction_space, least(0.999999, greatest(1e-6, (ay + an + by_ + bn) / 2)) AS mid, least(0.999999, greatest(1e-6, (fby + fbn + fay + fan) / 2)) AS future_mid_1, (1 - realized_pair_fill_pct) * holding_period AS hedging_delay_proxy, time_to_fill_h FROM ptr", "ptr", "threshold mid future_mid_1 hedging_delay_proxy time_to_fill_h")
def p25(lake):
    return pair_trades_of(lake).select("paired_trade_id", "threshold", "pair_direction", "direction", "traded_side", "prediction_space", "mid", "future_mid_1", "hedging_delay_proxy", "time_to_fill_h")


_PS = _SUMM.replace(" mid_cost_bps", "") + " hedged_fill_rate fully_hedged_trade_count avg_pair_fill_pct avg_expected_pair_fill"


@query("a11_pair_summary", f"SELECT g.threshold, g.holding_period::BIGINT AS holding_period, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _PS.split()) + " FROM (SELECT unnest([0.004::DOUBLE, 0.01, 0.05]) AS threshold, h AS holding_period FROM (SELECT unnest([1, 3, 6]) AS h)) g LEFT JOIN ptr_sum s ON s.threshold = g.threshold AND s.holding_period = g.holding_period", "ptr_sum", "threshold " + _PS)
def a11(lake):
    return R.full_grid(R.trade_summary(pair_trades_of(lake), paired=True), X.pair_grid(PCOST, THR)).select("threshold", "holding_period", *_PS.split())


_A13 = "trade_count expectancy sharpe total_pnl avg_expected_ev observed_cost_bps breakeven_cost_bps hedged_fill_rate"


@query("a13_pair_regime_sensitivity", f"SELECT 'execution_regime' AS analysis_type, execution_regime, breakeven_cost_bps - observed_cost_bps AS cost_headroom_bps, {', '.join(_A13.split())} FROM ptrr_sum", "ptrr_sum", "cost_headroom_bps " + _A13)
def a13p(lake):
    t = materialise(X.run_pair_grid(pair_signal_of(lake), PREG, (0.01,), ("optimistic", "base", "pessimistic")))
    return R.sensitivity(R.trade_summary(t, paired=True), "execution_regime").select("analysis_type", "execution_regime", "cost_headroom_bps", *_A13.split())


@query("a14_pair_fill_calibration", "SELECT bin::DOUBLE AS fill_bin, count(*)::DOUBLE AS n, avg(expected_pair_fill) AS avg_expected_fill_pct, avg(realized_pair_fill_pct) AS avg_actual_fill_proxy, avg(expected_pair_fill - realized_pair_fill_pct) AS fill_gap FROM (SELECT *, greatest(0, CAST(ceil((rn_ - 1) * q_ / greatest(n_ - 1, 1)::DOUBLE) AS BIGINT) - 1) AS bin FROM (SELECT *, row_number() OVER (ORDER BY round(expected_pair_fill, 9), ts, market_id) AS rn_, count(*) OVER () AS n_, (SELECT least(10, count(DISTINCT round(expected_pair_fill, 9))) FROM ptr WHERE threshold = 0.01 AND holding_period = 3) AS q_ FROM ptr WHERE threshold = 0.01 AND holding_period = 3)) GROUP BY 1", "ptr", "fill_bin n avg_expected_fill_pct avg_actual_fill_proxy fill_gap")
def a14p(lake):
    t = pair_trades_of(lake).where("threshold = 0.01 AND holding_period = 3")
    return R.fill_calibration(t, "expected_pair_fill", "realized_pair_fill_pct", tie=("ts", "market_id"))


@query("a61_latest_pairs", "SELECT ts, market_id, signal, expected_net_ev FROM psig WHERE ts = (SELECT max(ts) FROM psig)", "psig", "signal expected_net_ev")
def a61b(lake):
    s = pair_signal_of(lake)
    return s.where(F.col("ts") == s.agg(F.max("ts")).scalar()).select("ts", "market_id", "signal", "expected_net_ev")
