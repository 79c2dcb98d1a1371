"""Quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.catalog.base import panel_of, yes_of
from marketlab.catalog.registry import CTES, query
from marketlab.operators import pairs as X, panel as P, quality as Q

_A2 = "bid_missing_rate ask_missing_rate two_sided_rate spread_zero_rate mid_extreme_rate avg_mid avg_spread avg_depth_total"
CTES["miss"] = """
SELECT market_id, count(token_id) AS n_snapshots, avg((best_bid IS NULL)::INT) AS bid_missing_rate, avg((best_ask IS NULL)::INT) AS ask_missing_rate, avg((best_bid IS NOT NULL AND best_ask IS NOT NULL)::INT) AS two_sided_rate,
 avg((spread <= 0)::INT) AS spread_zero_rate, avg((mid >= 0.99 OR mid <= 1.0 - 0.99)::INT) AS mid_extreme_rate, avg(mid) AS avg_mid, avg(spread) AS avg_spread, avg(bid_depth + ask_depth) AS avg_depth_total FROM snap GROUP BY 1"""


@query("a2_book_missingness", "SELECT * FROM miss", "miss", _A2)
def a2(lake):
    return Q.book_missingness(P.scan_snapshots(lake.snapshots))


def _case(x, edges):
    names = Q.bin_names(edges)
    return "CASE " + " ".join(f"WHEN {x} <= {'1e308' if h == float('inf') else h}::DOUBLE THEN '{n}'" for h, n in zip(edges[1:], names)) + " END"


_BINS = ", ".join([f"('mid', '{b}')" for b in Q.bin_names(Q.MID_EDGES)] + [f"('spread', '{b}')" for b in Q.bin_names(Q.SPREAD_EDGES)])


@query(
    "a3_book_distribution",
    f"""SELECT distribution_type, bucket, n::DOUBLE AS count, n / sum(n) OVER (PARTITION BY distribution_type) AS pct FROM (
SELECT b.distribution_type, b.bucket, coalesce(n, 0) AS n FROM (VALUES {_BINS}) AS b(distribution_type, bucket) LEFT JOIN (
 SELECT 'mid' AS d, {_case('mid', Q.MID_EDGES)} AS k, count(*) AS n FROM snap GROUP BY 1, 2 UNION ALL SELECT 'spread', {_case('spread', Q.SPREAD_EDGES)}, count(*) FROM snap GROUP BY 1, 2) c ON c.d = b.distribution_type AND c.k = b.bucket
UNION ALL SELECT 'quote_presence', 'bid=' || CASE WHEN best_bid IS NOT NULL THEN 'True' ELSE 'False' END || '_ask=' || CASE WHEN best_ask IS NOT NULL THEN 'True' ELSE 'False' END, count(*) FROM snap GROUP BY 1, 2)""",
    "snap",
    "count pct",
)
def a3(lake):
    return Q.book_distribution(P.scan_snapshots(lake.snapshots))


_A4 = "rows n_unique_ts n_unique_markets missing_mid_rate missing_bid_rate missing_ask_rate bid_gt_ask_rate mid_out_of_bounds_rate pinned_mid_rate"


@query("a4_panel_audit", "SELECT count(*)::DOUBLE AS rows, count(DISTINCT snapshot_ts)::DOUBLE AS n_unique_ts, count(DISTINCT market_id)::DOUBLE AS n_unique_markets, avg((mid IS NULL)::INT) AS missing_mid_rate, avg((best_bid IS NULL)::INT) AS missing_bid_rate, avg((best_ask IS NULL)::INT) AS missing_ask_rate, avg(coalesce(best_bid > best_ask, false)::INT) AS bid_gt_ask_rate, avg((mid < 0 OR mid > 1)::INT) AS mid_out_of_bounds_rate, avg((mid <= 0.01 OR mid >= 0.99)::INT) AS pinned_mid_rate FROM snap", "snap", _A4)
def a4(lake):
    return Q.audit_summary(P.scan_snapshots(lake.snapshots))


_FLD = "best_bid best_ask mid spread spread_bps bid_depth ask_depth liquidity_score"


@query("a4_field_missingness", " UNION ALL ".join(f"SELECT '{f}' AS field, 1 - count({f}) / count(*)::DOUBLE AS missing_rate, count({f})::DOUBLE AS non_null_count FROM snap" for f in _FLD.split()), "snap", "missing_rate non_null_count")
def a4b(lake):
    return Q.field_missingness(P.scan_snapshots(lake.snapshots))


@query("a4_pinned_markets", "SELECT *, (pinned_rate >= 0.8 AND (two_sided_rate < 0.5 OR avg_depth_total < 50))::BIGINT AS exclude_default FROM (SELECT market_id, count(*) AS n, avg((mid <= 0.01 OR mid >= 0.99)::INT) AS pinned_rate, avg(mid) AS avg_mid, avg(bid_depth + ask_depth) AS avg_depth_total, avg((best_bid IS NOT NULL AND best_ask IS NOT NULL)::INT) AS two_sided_rate FROM snap GROUP BY 1)", "snap", "pinned_rate avg_mid avg_depth_total two_sided_rate")
def a4c(lake):
    return Q.pinned_markets(P.scan_snapshots(lake.snapshots).withColumn("depth_total", F.lit(None).cast("double")))


_PQ = {
    "both_legs_coverage": "avg(b)",
    "both_legs_two_sided_rate": "avg(t)",
    "yes_missing_bid_rate": "avg((best_bid_yes IS NULL)::INT)",
    "yes_missing_ask_rate": "avg((best_ask_yes IS NULL)::INT)",
    "no_missing_bid_rate": "avg((best_bid_no IS NULL)::INT)",
    "no_missing_ask_rate": "avg((best_ask_no IS NULL)::INT)",
    "spread_yes_median": "median(spread_yes)",
    "spread_no_median": "median(spread_no)",
    "depth_yes_median": "median(depth_yes)",
    "depth_no_median": "median(depth_no)",
    "min_pair_depth_median": "median(least(depth_yes, depth_no))",
    "snapshot_pairs": "count(*)::DOUBLE",
    "markets_with_pairs": "count(DISTINCT market_id)::DOUBLE",
}
CTES["pq"] = "SELECT *, (token_id_yes IS NOT NULL AND token_id_no IS NOT NULL)::INT AS b, (best_bid_yes IS NOT NULL AND best_ask_yes IS NOT NULL AND best_bid_no IS NOT NULL AND best_ask_no IS NOT NULL)::INT AS t FROM pairo WHERE ts >= (SELECT max(snapshot_ts) - INTERVAL 72 HOUR FROM snap)"
_agg = " UNION ALL ".join(
    f"SELECT 'aggregate' AS level, '{k}' AS metric, NULL::BIGINT AS market_id, coalesce({e}, 0) AS value, {'0.8::DOUBLE' if k == 'both_legs_coverage' else 'NULL::DOUBLE'} AS required_min, NULL::BIGINT AS n_snapshot_pairs, NULL::DOUBLE AS both_legs_coverage, NULL::DOUBLE AS both_legs_two_sided_rate, NULL::DOUBLE AS yes_missing_bid_rate, NULL::DOUBLE AS yes_missing_ask_rate, NULL::DOUBLE AS no_missing_bid_rate, NULL::DOUBLE AS no_missing_ask_rate, NULL::DOUBLE AS spread_yes_median, NULL::DOUBLE AS spread_no_median, NULL::DOUBLE AS min_pair_depth_median FROM pq"
    for k, e in _PQ.items()
)


@query(
    "a5_pair_quality",
    f"SELECT *, CASE WHEN required_min IS NOT NULL AND value < required_min THEN 0 ELSE 1 END::BIGINT AS passed, CASE WHEN required_min IS NULL OR value >= required_min THEN '' WHEN level = 'market' THEN 'low_both_legs_coverage' ELSE 'both_legs_coverage_below_threshold' END AS reason FROM ({_agg} UNION ALL SELECT 'market', 'per_market', market_id, avg(b), 0.8, count(*), avg(b), avg(t), avg((best_bid_yes IS NULL)::INT), avg((best_ask_yes IS NULL)::INT), avg((best_bid_no IS NULL)::INT), avg((best_ask_no IS NULL)::INT), median(spread_yes), median(spread_no), median(least(depth_yes, depth_no)) FROM pq GROUP BY market_id)",
    "pq",
    "value required_min both_legs_coverage both_legs_two_sided_rate yes_missing_bid_rate yes_missing_ask_rate no_missing_bid_rate no_missing_ask_rate spread_yes_median spread_no_median min_pair_depth_median",
)
def a5(lake):
    return Q.pair_quality(X.pair_presence(X.side_by_side(X.outcome_books(lake.snapshots, lake.outcomes, 72))))


_COV = "SELECT avg(CASE WHEN y = 1 AND n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS both_legs_coverage FROM (SELECT snapshot_ts, market_id, max((outcome_label = 'Yes')::INT) AS y, max((outcome_label = 'No')::INT) AS n FROM snap {0} GROUP BY 1, 2)"


@query("a34_legs_coverage_24h", _COV.format("WHERE snapshot_ts >= (SELECT max(snapshot_ts) - INTERVAL 24 HOUR FROM snap)"), "snap", "both_legs_coverage")
def a34(lake):
    return Q.legs_coverage(lake.snapshots, lake.outcomes)


@query("a34_legs_coverage_all", _COV.format(""), "snap", "both_legs_coverage")
def a34b(lake):
    return Q.legs_coverage(lake.snapshots, lake.outcomes, None)


@query("a35_time_depth", "SELECT count(DISTINCT snapshot_ts) AS n_unique_ts, min(snapshot_ts) AS ts_min, max(snapshot_ts) AS ts_max FROM snap", "snap")
def a35(lake):
    return Q.time_depth(lake.snapshots)


CTES["third"] = "SELECT *, CASE WHEN rn <= greatest(1, n // 3) THEN 1 ELSE 0 END AS e, CASE WHEN rn > n - greatest(1, n // 3) THEN 1 ELSE 0 END AS l FROM (SELECT *, row_number() OVER (ORDER BY ts, token_id) AS rn, count(*) OVER () AS n FROM panel)"
CTES["stat"] = "SELECT 'stationarity' AS check_group, metric, em AS early_mean, lm AS late_mean, lm - em AS drift_abs, abs(lm - em) / (abs(em) + 1e-9) AS drift_ratio, CASE WHEN abs(lm - em) / (abs(em) + 1e-9) > 1 THEN 'warning_regime_drift' ELSE 'ok' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS metric, avg({c}) FILTER (WHERE e = 1) AS em, avg({c}) FILTER (WHERE l = 1) AS lm FROM third" for k, c in (("spread_bps", "spread_bps"), ("liquidity", "liquidity_log"), ("volatility", "prob_vol_6"))
) + ")"


@query("a29_stationarity", "SELECT * FROM stat", "stat", "early_mean late_mean drift_abs drift_ratio")
def a29(lake):
    return Q.stationarity(panel_of(lake))


@query("w20_time_thirds", "SELECT 'early' AS part, ts, token_id FROM third WHERE e = 1 UNION ALL SELECT 'late', ts, token_id FROM third WHERE l = 1", "third")
def w20(lake):
    return Q.thirds(panel_of(lake).select("ts", "token_id"), ["token_id"]).select("part", "ts", "token_id")


CTES["depthrow"] = "SELECT 'data_depth' AS check_group, metric, value, need::DOUBLE AS required_min, (value >= need)::BIGINT AS passed, greatest(0, need - value) AS missing_qty, CASE WHEN value >= need THEN '' ELSE why END AS reason FROM (SELECT 'unique_timestamps' AS metric, count(DISTINCT ts)::DOUBLE AS value, 500 AS need, 'need_more_time_slices' AS why FROM panel UNION ALL SELECT 'unique_markets', count(DISTINCT market_id), 200, 'need_more_market_coverage' FROM panel UNION ALL SELECT 'total_snapshots', count(*), 50000, 'need_more_snapshots' FROM panel)"


@query("a30_integrity", "SELECT *, NULL::DOUBLE AS early_mean, NULL::DOUBLE AS late_mean, NULL::DOUBLE AS drift_abs, NULL::DOUBLE AS drift_ratio FROM depthrow UNION ALL SELECT check_group, metric, late_mean, NULL, 1, 0, status, early_mean, late_mean, drift_abs, drift_ratio FROM stat", "depthrow stat", "value required_min missing_qty early_mean late_mean drift_abs drift_ratio")
def a30(lake):
    return Q.integrity(panel_of(lake))


@query("a57_panel_sanity", "SELECT count(DISTINCT ts)::DOUBLE AS n_unique_ts, min(ts) AS ts_min, max(ts) AS ts_max, count(DISTINCT market_id)::DOUBLE AS markets_covered, count(DISTINCT token_id)::DOUBLE AS tokens_covered, count(*)::DOUBLE AS rows, (SELECT avg(bid_missing_rate) FROM miss) AS missing_best_bid_rate, (SELECT avg(ask_missing_rate) FROM miss) AS missing_best_ask_rate, (SELECT avg(two_sided_rate) FROM miss) AS two_sided_rate FROM yes", "yes miss", "n_unique_ts markets_covered tokens_covered rows missing_best_bid_rate missing_best_ask_rate two_sided_rate")
def a57(lake):
    return Q.panel_sanity(yes_of(lake), Q.book_missingness(P.scan_snapshots(lake.snapshots)))
