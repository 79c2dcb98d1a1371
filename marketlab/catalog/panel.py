"""Panel queries: scans, sanity, joins, windows, context."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from marketlab.catalog.base import UNIT, panel_of, sane_of, yes_of
from marketlab.catalog.registry import query
from marketlab.operators import panel as P

KEY = ["ts", "market_id", "token_id"]


def pick(df, cols):
    return df.select(*KEY, *cols.split())


@query("s15_snapshot_scan", "SELECT snapshot_ts AS ts, market_id, token_id, best_bid, best_ask, mid, spread, spread_bps, bid_depth, ask_depth, liquidity_score FROM snap WHERE mid IS NOT NULL", "snap", "best_bid best_ask mid spread spread_bps bid_depth ask_depth liquidity_score")
def s15(lake):
    return P.scan_snapshots(lake.snapshots)


_SAN = "mid spread spread_bps best_bid_present best_ask_present book_two_sided depth_total_raw spread_reasonable mid_extreme extreme_depth_ok book_tradable"


@query("p1_book_sanity", f"SELECT ts, market_id, token_id, {', '.join(_SAN.split())} FROM psan", "psan", _SAN)
def p1(lake):
    return pick(sane_of(lake), _SAN)


@query("j2_market_resolution", "SELECT m.market_id, m.event_id, m.category, coalesce(m.close_ts, m.end_ts) AS target_close_ts, m.created_ts, r.resolved_ts FROM mkt m LEFT JOIN res r ON m.market_id = r.market_id", "mkt res")
def j2(lake):
    return P.market_base(lake.markets, lake.resolutions)


@query("j1_snapshot_market", "SELECT s.snapshot_ts AS ts, s.token_id, s.mid, m.event_id, m.category, m.created_ts FROM snap s LEFT JOIN mkt m ON s.market_id = m.market_id WHERE s.mid IS NOT NULL", "snap mkt", "mid")
def j1(lake):
    return P.scan_snapshots(lake.snapshots).join(lake.markets, "market_id", "left").select("ts", "token_id", "mid", "event_id", "category", "created_ts")


@query(
    "j3_winner_map",
    "SELECT o.market_id, o.token_id, CASE WHEN r.winner_token_id IS NULL THEN NULL WHEN o.token_id = r.winner_token_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS winner, CASE WHEN r.winner_token_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS resolution_known FROM outc o LEFT JOIN res r ON o.market_id = r.market_id",
    "outc res",
    "winner resolution_known",
)
def j3(lake):
    return P.winner_map(lake.outcomes, lake.resolutions)


@query("w1_yes_token", "SELECT market_id, token_id FROM ytok", "ytok")
def w1(lake):
    return P.yes_tokens(lake.outcomes)


@query("a1_trade_flow", "SELECT hr, token_id, trade_notional, trade_count, buy_notional, sell_notional FROM (SELECT date_trunc('hour', trade_ts) AS hr, token_id, sum(notional) AS trade_notional, count(*) AS trade_count, sum(CASE WHEN upper(side) = 'BUY' THEN notional ELSE 0 END) AS buy_notional, sum(CASE WHEN upper(side) = 'SELL' THEN notional ELSE 0 END) AS sell_notional FROM trd WHERE trade_ts IS NOT NULL AND token_id IS NOT NULL GROUP BY 1, 2)", "trd", "trade_notional buy_notional sell_notional")
def a1(lake):
    return P.trade_flow(lake.trades)


@query("j5_trade_flow_join", "SELECT ts, market_id, token_id, trade_notional_h, trade_count_h, order_flow_imbalance_h AS trade_buy_sell_imbalance_h FROM pdyn3", "pdyn3", "trade_notional_h trade_count_h trade_buy_sell_imbalance_h")
def j5(lake):
    p = sane_of(lake).where("book_tradable > 0")
    return pick(P.join_trade_flow(p, P.trade_flow(lake.trades, UNIT), UNIT), "trade_notional_h trade_count_h trade_buy_sell_imbalance_h")


@query("p26_category_encoding", "SELECT p.ts, p.market_id, p.token_id, coalesce(p.category, 'unknown') AS category, c.category_code, CASE WHEN coalesce(p.category, 'unknown') = 'c1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat_c1, CASE WHEN p.category IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat_unknown FROM psan p JOIN pcode c ON c.category = coalesce(p.category, 'unknown') WHERE p.book_tradable > 0", "psan pcode", "category_code cat_c1 cat_unknown")
def p26(lake):
    p = sane_of(lake).where("book_tradable > 0")
    return pick(P.encode_category(p, P.category_codes(p), ["c1", "unknown"]), "category category_code cat_c1 cat_unknown")


@query("p27_clock", "SELECT ts, market_id, token_id, ttr0 AS time_to_resolution_h, market_age_h FROM pdyn1", "pdyn1", "time_to_resolution_h market_age_h")
def p27(lake):
    return pick(P.clock_features(sane_of(lake).where("book_tradable > 0")), "time_to_resolution_h market_age_h")


@query("p28_resolution_clock", "SELECT ts, market_id, token_id, ln(1 + greatest(ttr0, 0)) AS ttr_log, least(greatest(ttr0, 0), 720) * least(greatest(ttr0, 0), 720) AS ttr_sq, CASE WHEN ttr0 <= 24 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_resolution_24h, CASE WHEN ttr0 <= 72 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_resolution_72h FROM pdyn1", "pdyn1", "ttr_log ttr_sq near_resolution_24h near_resolution_72h")
def p28(lake):
    return pick(P.resolution_clock(P.clock_features(sane_of(lake).where("book_tradable > 0"))), "ttr_log ttr_sq near_resolution_24h near_resolution_72h")


def dyn(lake):
    return P.dynamic_features(P.clock_features(sane_of(lake).where("book_tradable > 0")))


@query("p29_log_transforms", "SELECT ts, market_id, token_id, liquidity_log, depth_log, spread_bps, prob_vol_6, prob_vol_24, velocity_1, velocity_3, acceleration, time_to_resolution_h, market_age_h FROM pdyn3", "pdyn3", "liquidity_log depth_log spread_bps prob_vol_6 prob_vol_24 velocity_1 velocity_3 acceleration time_to_resolution_h market_age_h")
def p29(lake):
    return pick(P.log_transforms(dyn(lake)), "liquidity_log depth_log spread_bps prob_vol_6 prob_vol_24 velocity_1 velocity_3 acceleration time_to_resolution_h market_age_h")


@query("p30_regime_flags", "SELECT ts, market_id, token_id, vol_regime, is_high_vol_regime, is_low_liq_regime FROM panel", "panel", "vol_regime is_high_vol_regime is_low_liq_regime")
def p30(lake):
    p = P.log_transforms(dyn(lake)).withColumns({"trade_buy_sell_imbalance_h": F.lit(0.0), "trade_count_h": F.lit(0.0)})
    return pick(P.regime_flags(p), "vol_regime is_high_vol_regime is_low_liq_regime")


@query(
    "w4_lagged_returns",
    "SELECT token_id, ts, CASE WHEN l1 > 0 THEN mid / l1 - 1 END AS ret_1h, CASE WHEN l6 > 0 THEN mid / l6 - 1 END AS ret_6h, CASE WHEN l24 > 0 THEN mid / l24 - 1 END AS ret_24h FROM (SELECT token_id, snapshot_ts AS ts, mid, lag(mid, 1) OVER w AS l1, lag(mid, 6) OVER w AS l6, lag(mid, 24) OVER w AS l24 FROM snap WHERE mid IS NOT NULL WINDOW w AS (PARTITION BY token_id ORDER BY snapshot_ts))",
    "snap",
    "ret_1h ret_6h ret_24h",
)
def w4(lake):
    from marketlab.operators.returns import lagged_returns

    return lagged_returns(lake.snapshots)


@query(
    "w4_timed_returns",
    "SELECT s.token_id, s.snapshot_ts AS ts, CASE WHEN a.mid > 0 THEN s.mid / a.mid - 1 END AS ret_24h, CASE WHEN b.mid > 0 THEN s.mid / b.mid - 1 END AS ret_72h FROM snap s ASOF LEFT JOIN snap a ON a.token_id = s.token_id AND a.snapshot_ts <= s.snapshot_ts - INTERVAL 24 HOUR ASOF LEFT JOIN snap b ON b.token_id = s.token_id AND b.snapshot_ts <= s.snapshot_ts - INTERVAL 72 HOUR",
    "snap",
    "ret_24h ret_72h",
)
def w4t(lake):
    from marketlab.operators.returns import timed_returns

    return timed_returns(lake.snapshots, (24, 72))


@query("w5_forward_targets", "SELECT ts, market_id, token_id, future_mid_1, future_spread_1, forward_ret_1, future_mid_12, future_mid_3 / mid - 1 AS forward_ret_3 FROM (SELECT *, future_mid_1 / mid - 1 AS forward_ret_1 FROM pdyn2)", "pdyn2", "future_mid_1 future_spread_1 forward_ret_1 future_mid_12 forward_ret_3")
def w5(lake):
    return pick(P.forward_targets(sane_of(lake).where("book_tradable > 0")), "future_mid_1 future_spread_1 forward_ret_1 future_mid_12 forward_ret_3")


@query("w6_percent_change", "SELECT ts, market_id, token_id, v1 AS velocity_1, v3 AS velocity_3, acc0 AS acceleration FROM pdyn2", "pdyn2", "velocity_1 velocity_3 acceleration")
def w6(lake):
    return pick(dyn(lake), "velocity_1 velocity_3 acceleration")


@query("w7_rolling_vol", "SELECT ts, market_id, token_id, pv6 AS prob_vol_6, pv24 AS prob_vol_24, book_imbalance, spread_bps / (abs(pv6) * 10000.0::DOUBLE + 1) AS spread_to_vol_6 FROM pdyn2", "pdyn2", "prob_vol_6 prob_vol_24 book_imbalance spread_to_vol_6")
def w7(lake):
    return pick(dyn(lake), "prob_vol_6 prob_vol_24 book_imbalance spread_to_vol_6")


@query("w8_momentum_decay", "SELECT ts, market_id, token_id, momentum_decay, momentum_decay_rate, velocity_abs FROM panel", "panel", "momentum_decay momentum_decay_rate velocity_abs")
def w8(lake):
    return pick(P.momentum_decay(P.log_transforms(dyn(lake))), "momentum_decay momentum_decay_rate velocity_abs")


@query("w9_group_context", "SELECT ts, market_id, token_id, event_mean_mid, related_prob_spread, event_prob_dispersion, category_mean_mid, category_prob_spread FROM panel", "panel", "event_mean_mid related_prob_spread event_prob_dispersion category_mean_mid category_prob_spread")
def w9(lake):
    return pick(P.group_context(sane_of(lake).where("book_tradable > 0")), "event_mean_mid related_prob_spread event_prob_dispersion category_mean_mid category_prob_spread")


@query("w10_correlation_cluster", "SELECT token_id, token_corr_category, corr_cluster FROM pcorr", "pcorr", "token_corr_category corr_cluster")
def w10(lake):
    return P.token_correlation(P.group_context(sane_of(lake).where("book_tradable > 0")))


@query("j35_context_join", "SELECT ts, market_id, token_id, category_ret_1, token_corr_category, corr_cluster FROM panel", "panel", "category_ret_1 token_corr_category corr_cluster")
def j35(lake):
    return pick(P.cross_market_context(sane_of(lake).where("book_tradable > 0")), "category_ret_1 token_corr_category corr_cluster")


_ALL = (
    "mid spread spread_bps depth_total book_tradable winner resolution_known time_to_resolution_h market_age_h velocity_1 velocity_3 acceleration prob_vol_6 prob_vol_24 book_imbalance "
    "spread_to_vol_6 trade_notional_h trade_count_h order_flow_imbalance_h trade_frequency_h category_code future_mid_1 future_mid_3 future_mid_6 future_mid_12 future_spread_1 future_spread_12 "
    "liquidity_log depth_log vol_regime is_high_vol_regime is_low_liq_regime ttr_log ttr_sq near_resolution_24h near_resolution_72h momentum_decay momentum_decay_rate velocity_abs "
    "event_mean_mid related_prob_spread event_prob_dispersion category_mean_mid category_prob_spread category_ret_1 token_corr_category corr_cluster forward_ret_1"
)


@query("c1_feature_panel", f"SELECT ts, market_id, token_id, event_id, category, {', '.join(_ALL.split())} FROM panel", "panel", _ALL)
def c1(lake):
    return pick(panel_of(lake), "event_id category " + _ALL)


@query("j4_yes_panel", f"SELECT ts, market_id, token_id, {', '.join(_ALL.split())} FROM yes", "yes", _ALL)
def j4(lake):
    return pick(yes_of(lake), _ALL)
