"""Shared frames of the catalogue: the panel and its SQL statement."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlab.catalog.registry import CTES, memo
from marketlab.operators import panel as P
from marketlab.sources.driver_tables import Lake

UNIT = "day"  # the driver snapshots are daily


def panel_of(lake: Lake) -> DataFrame:
    return memo(lake, "panel", lambda: P.build_panel(lake.snapshots, lake.markets, lake.outcomes, lake.resolutions, lake.trades, UNIT))


def yes_of(lake: Lake) -> DataFrame:
    return P.yes_panel(panel_of(lake), lake.outcomes)


def sane_of(lake: Lake) -> DataFrame:
    base = P.scan_snapshots(lake.snapshots).join(P.market_base(lake.markets, lake.resolutions), "market_id", "left")
    return P.book_sanity(base)


CTES["psan0"] = """
SELECT s.snapshot_ts AS ts, s.market_id, s.token_id, s.best_bid, s.best_ask, s.bid_depth, s.ask_depth, s.liquidity_score,
       m.event_id, m.category, coalesce(m.close_ts, m.end_ts) AS target_close_ts, m.created_ts, r.resolved_ts,
       s.best_bid IS NOT NULL AND s.best_ask IS NOT NULL AS two,
       CASE WHEN s.best_bid IS NOT NULL AND s.best_ask IS NOT NULL THEN 0.5::DOUBLE * (s.best_bid + s.best_ask) END AS mid,
       CASE WHEN s.best_bid IS NOT NULL AND s.best_ask IS NOT NULL THEN s.best_ask - s.best_bid END AS spread,
       coalesce(s.bid_depth, 0) + coalesce(s.ask_depth, 0) AS depth_total_raw
FROM snap s LEFT JOIN mkt m ON s.market_id = m.market_id LEFT JOIN res r ON s.market_id = r.market_id
WHERE s.mid IS NOT NULL"""
CTES["psan"] = """
SELECT *, CASE WHEN two AND coalesce(spread_bps, 1e300) <= 2500 AND (mid_extreme = 0 OR extreme_depth_ok = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS book_tradable
FROM (SELECT *, CASE WHEN mid > 0 THEN spread / mid * 10000.0::DOUBLE END AS spread_bps,
  CASE WHEN best_bid IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS best_bid_present,
  CASE WHEN best_ask IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS best_ask_present,
  CASE WHEN two THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS book_two_sided,
  CASE WHEN mid > 0 AND spread / mid * 10000.0::DOUBLE <= 2500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS spread_reasonable,
  CASE WHEN mid >= 0.99 OR mid <= 1.0 - 0.99 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mid_extreme,
  CASE WHEN depth_total_raw >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS extreme_depth_ok FROM psan0)"""
CTES["flow"] = """
SELECT date_trunc('day', trade_ts) AS hr, token_id, sum(notional) AS trade_notional, count(*) AS trade_count,
  sum(CASE WHEN upper(side) = 'BUY' THEN notional ELSE 0 END) AS buy_notional,
  sum(CASE WHEN upper(side) = 'SELL' THEN notional ELSE 0 END) AS sell_notional
FROM trd WHERE trade_ts IS NOT NULL AND token_id IS NOT NULL GROUP BY 1, 2"""
CTES["pcode"] = """
SELECT category, CAST(row_number() OVER (ORDER BY f.token_id, f.ts) - 1 AS DOUBLE) AS category_code
FROM (SELECT coalesce(category, 'unknown') AS category, min(struct_pack(token_id := token_id, ts := ts)) AS f
      FROM psan WHERE book_tradable > 0 GROUP BY 1)"""
CTES["pdyn1"] = """
SELECT p.*, CASE WHEN r.winner_token_id IS NULL THEN NULL WHEN p.token_id = r.winner_token_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS winner,
  CASE WHEN r.winner_token_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS resolution_known,
  date_diff('second', p.ts, coalesce(p.resolved_ts, p.target_close_ts)) / 3600.0::DOUBLE AS ttr0,
  date_diff('second', p.created_ts, p.ts) / 3600.0::DOUBLE AS market_age_h,
  p.mid / lag(p.mid, 1) OVER w - 1 AS v1, p.mid / lag(p.mid, 3) OVER w - 1 AS v3, depth_total_raw AS depth_total
FROM psan p LEFT JOIN res r ON p.market_id = r.market_id WHERE book_tradable > 0
WINDOW w AS (PARTITION BY p.token_id ORDER BY p.ts)"""
CTES["pdyn2"] = """
SELECT *, v1 - lag(v1) OVER w AS acc0,
  CASE WHEN count(v1) OVER w6 >= 3 THEN stddev_samp(v1) OVER w6 END AS pv6,
  CASE WHEN count(v1) OVER w24 >= 6 THEN stddev_samp(v1) OVER w24 END AS pv24,
  CASE WHEN depth_total > 0 THEN (bid_depth - ask_depth) / depth_total ELSE 0.0::DOUBLE END AS book_imbalance,
  lead(mid, 1) OVER w AS future_mid_1, lead(mid, 3) OVER w AS future_mid_3, lead(mid, 6) OVER w AS future_mid_6, lead(mid, 12) OVER w AS future_mid_12,
  lead(spread, 1) OVER w AS future_spread_1, lead(spread, 3) OVER w AS future_spread_3, lead(spread, 6) OVER w AS future_spread_6, lead(spread, 12) OVER w AS future_spread_12,
  row_number() OVER w AS rn
FROM pdyn1 WINDOW w AS (PARTITION BY token_id ORDER BY ts),
  w6 AS (PARTITION BY token_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  w24 AS (PARTITION BY token_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""
CTES["pewm"] = """
SELECT a.token_id, a.rn, sum(coalesce(b.v1, 0) * pow(0.5, a.rn - b.rn)) / sum(pow(0.5, a.rn - b.rn)) AS fast0,
  sum(coalesce(b.v1, 0) * pow(1 - 2.0::DOUBLE / 13, a.rn - b.rn)) / sum(pow(1 - 2.0::DOUBLE / 13, a.rn - b.rn)) AS slow0
FROM pdyn2 a JOIN pdyn2 b ON a.token_id = b.token_id AND b.rn <= a.rn GROUP BY 1, 2"""
CTES["pdyn3"] = """
SELECT d.ts, d.market_id, d.token_id, coalesce(d.event_id, 'unknown_event') AS event_id, coalesce(d.category, 'unknown') AS category,
  d.best_bid, d.best_ask, d.mid, d.spread, d.spread_bps, d.bid_depth, d.ask_depth, d.liquidity_score, d.book_tradable, d.winner, d.resolution_known,
  coalesce(d.ttr0, 9999) AS time_to_resolution_h, coalesce(d.market_age_h, 0) AS market_age_h, d.depth_total,
  coalesce(v1, 0) AS velocity_1, coalesce(v3, 0) AS velocity_3, coalesce(acc0, 0) AS acceleration,
  coalesce(pv6, 0) AS prob_vol_6, coalesce(pv24, 0) AS prob_vol_24, d.book_imbalance,
  d.spread_bps / (abs(pv6) * 10000.0::DOUBLE + 1) AS spread_to_vol_6,
  coalesce(f.trade_notional, 0.0::DOUBLE) AS trade_notional_h, CAST(coalesce(f.trade_count, 0) AS DOUBLE) AS trade_count_h,
  CASE WHEN f.trade_notional > 0 THEN (f.buy_notional - f.sell_notional) / f.trade_notional ELSE 0.0::DOUBLE END AS order_flow_imbalance_h,
  c.category_code, future_mid_1, future_mid_3, future_mid_6, future_mid_12, future_spread_1, future_spread_3, future_spread_6, future_spread_12,
  ln(1 + d.liquidity_score) AS liquidity_log, ln(1 + d.depth_total) AS depth_log,
  CASE WHEN d.rn >= 2 THEN fast0 END AS fast1, CASE WHEN d.rn >= 4 THEN slow0 END AS slow1, d.rn
FROM pdyn2 d LEFT JOIN flow f ON f.hr = date_trunc('day', d.ts) AND f.token_id = d.token_id
LEFT JOIN pcode c ON c.category = coalesce(d.category, 'unknown')
LEFT JOIN pewm e ON e.token_id = d.token_id AND e.rn = d.rn"""
CTES["pcut"] = """
SELECT quantile_cont(round(abs(prob_vol_6), 12), 0.33) AS q1, quantile_cont(round(abs(prob_vol_6), 12), 0.66) AS q2, quantile_cont(round(liquidity_log, 12), 0.33) AS ql FROM pdyn3"""
CTES["pctx"] = """
SELECT d.*, coalesce(d.mid / lag(d.mid) OVER (PARTITION BY d.token_id ORDER BY d.ts) - 1, 0) AS ret_1,
  avg(mid) OVER (PARTITION BY event_id, ts) AS event_mean_mid,
  max(mid) OVER (PARTITION BY event_id, ts) - min(mid) OVER (PARTITION BY event_id, ts) AS event_prob_dispersion,
  avg(mid) OVER (PARTITION BY category, ts) AS category_mean_mid,
  CASE WHEN round(abs(prob_vol_6), 12) <= (SELECT q1 FROM pcut) THEN 0.0::DOUBLE WHEN round(abs(prob_vol_6), 12) <= (SELECT q2 FROM pcut) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS vol_regime,
  CASE WHEN round(liquidity_log, 12) <= (SELECT ql FROM pcut) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_low_liq_regime,
  greatest(time_to_resolution_h, 0) AS ttr, coalesce(fast1 - slow1, 0) AS momentum_decay
FROM pdyn3 d"""
CTES["pctx2"] = "SELECT *, avg(ret_1) OVER (PARTITION BY category, ts) AS category_ret_1 FROM pctx"
CTES["pcorr"] = """
SELECT token_id, c AS token_corr_category,
  least(3.0::DOUBLE, floor(round((rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE) / count(*) OVER () * 4, 9))) AS corr_cluster
FROM (SELECT token_id, round(coalesce(CASE WHEN count(*) >= 12 AND stddev_pop(ret_1) > 1e-12 AND stddev_pop(category_ret_1) > 1e-12 THEN corr(ret_1, category_ret_1) END, 0), 12) AS c FROM pctx2 GROUP BY 1)"""
CTES["panel"] = """
SELECT p.* EXCLUDE (fast1, slow1, rn, ret_1, ttr), ln(1 + ttr) AS ttr_log, least(ttr, 720) * least(ttr, 720) AS ttr_sq,
  CASE WHEN ttr <= 24 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_resolution_24h, CASE WHEN ttr <= 72 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS near_resolution_72h,
  greatest(-5, least(5, momentum_decay / (abs(slow1) + 1e-6))) AS mdr_raw, slow1 IS NOT NULL AS has_slow,
  CASE WHEN slow1 IS NOT NULL THEN greatest(-5, least(5, momentum_decay / (abs(slow1) + 1e-6))) END AS momentum_decay_rate,
  abs(velocity_1) AS velocity_abs, trade_count_h AS trade_frequency_h,
  CASE WHEN vol_regime >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_high_vol_regime,
  coalesce(mid - event_mean_mid, 0) AS related_prob_spread, coalesce(mid - category_mean_mid, 0) AS category_prob_spread,
  k.token_corr_category, k.corr_cluster, future_mid_1 / mid - 1 AS forward_ret_1, future_mid_3 / mid - 1 AS forward_ret_3
FROM pctx2 p LEFT JOIN pcorr k ON k.token_id = p.token_id"""
CTES["ytok"] = """
SELECT market_id, token_id FROM (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY CASE WHEN lower(coalesce(outcome_label, '')) = 'yes' THEN 0 ELSE 1 END, outcome_index) AS rn FROM outc) WHERE rn = 1"""
CTES["yes"] = "SELECT p.* FROM panel p JOIN ytok y ON p.market_id = y.market_id AND p.token_id = y.token_id"
