"""Edge studies, text functions, linking, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.catalog.base import UNIT, panel_of, yes_of
from marketlab.catalog.registry import CTES, memo, query
from marketlab.catalog.trading import KEY, binned_sql, fixed, signal_of
from marketlab.functions import text as T
from marketlab.functions.columns import flag, lit
from marketlab.operators import linking as L, panel as P, signals as S, similarity as M, studies as E
from marketlab.operators.topk import latest_slice, newest_first, best_per_key
from marketlab.session import materialise

# ------------------------------------------------------------------ signals

_SIG = "signal confidence raw_signal"


def _z(c, t):
    return f"(({c} - (SELECT avg({c}) FROM {t})) / ((SELECT stddev_pop({c}) FROM {t}) + 1e-9))"


@query("p35_momentum_signal", "SELECT ts, token_id, regime_signal, signal, confidence, raw_signal FROM sig", "sig", "regime_signal " + _SIG)
def p35(lake):
    return fixed(S.momentum(yes_of(lake))).select("ts", "token_id", "regime_signal", *_SIG.split())


@query(
    "p33_dispersion_signal",
    """SELECT ts, token_id, event_n, tanh(-z * ln(1 + event_n) / 2) AS signal, greatest(0.05, least(1, abs(z) / 3 / (1 + greatest(0, spread_bps) / 250) * (1 + depth_log / 6))) AS confidence, -z * ln(1 + event_n) AS raw_signal FROM (
SELECT y.*, e.event_n, (mid - e.m) / CASE WHEN coalesce(e.s, 0) <> 0 THEN e.s ELSE 0.01 END AS z FROM yes y JOIN (SELECT event_id, ts, count(DISTINCT market_id) AS event_n, avg(mid) AS m, stddev_samp(mid) AS s FROM yes GROUP BY 1, 2) e USING (event_id, ts) WHERE e.event_n >= 2)""",
    "yes",
    _SIG,
)
def p33(lake):
    return S.cross_market(yes_of(lake)).select("ts", "token_id", "event_n", *_SIG.split())


@query(
    "p34_liquidity_signal",
    """SELECT ts, token_id, low_liq_score, tanh(raw_signal) AS signal, greatest(0.05, least(1, low_liq_score / (1 + low_liq_score) * (0.5 + 0.5 * pen) * (0.5 + 0.5 * least(1, boost / 2)))) AS confidence, raw_signal FROM (
SELECT *, -(mid - 0.5) * low_liq_score * boost * pen AS raw_signal FROM (
SELECT *, low / ((SELECT stddev_pop(greatest(0, (SELECT quantile_cont(liquidity_log, 0.35) FROM yes) - liquidity_log)) FROM yes) + 1e-9) AS low_liq_score, 1 + greatest(0, least(2, abs(prob_vol_6) * 40)) AS boost, 1 / (1 + greatest(0, spread_bps) / 300) AS pen FROM (
SELECT *, greatest(0, (SELECT quantile_cont(liquidity_log, 0.35) FROM yes) - liquidity_log) AS low FROM yes)))""",
    "yes",
    "low_liq_score " + _SIG,
)
def p34(lake):
    return S.liquidity_premium(yes_of(lake)).select("ts", "token_id", "low_liq_score", *_SIG.split())


def _amb(x: str) -> str:
    hits = " + ".join(f"(length(lo) - length(replace(lo, '{p}', ''))) / {len(p)}.0::DOUBLE" for p in T.AMBIGUITY_PHRASES)
    marks = " + ".join(f"(length(lo) - length(replace(lo, '{p}', '')))" for p in (";", ":", "("))
    return f"(SELECT length(lo) / 400.0::DOUBLE + 0.8::DOUBLE * ({hits}) + 0.2::DOUBLE * ({marks}) FROM (SELECT lower({x}) AS lo))"


CTES["amb"] = f"SELECT *, {_amb('question || chr(32) || description')} AS ambiguity_score FROM txt"


@query("f4_ambiguity", "SELECT market_id, ambiguity_score FROM amb", "amb", "ambiguity_score")
def f4(lake):
    return lake.texts.select("market_id", T.ambiguity_score(F.concat("question", F.lit(" "), "description")).alias("ambiguity_score"))


CTES["yamb"] = "SELECT y.*, coalesce(a.ambiguity_score, 1 / 400.0::DOUBLE) AS sc FROM yes y LEFT JOIN amb a ON a.market_id = y.market_id"


@query(
    "p36_rule_signal",
    """SELECT ts, token_id, sc AS ambiguity_score, tanh(raw_signal * (1 + thin)) AS signal, greatest(0.05, least(1, un * pen * (0.5 + thin))) AS confidence, raw_signal FROM (
SELECT *, -(mid - 0.5) * (1 + un) * pen AS raw_signal, 1 / (1 + exp(liquidity_log - (SELECT median(liquidity_log) FROM yamb WHERE sc >= 0.15))) AS thin FROM (
SELECT *, greatest(0, (sc - (SELECT median(sc) FROM yamb)) / ((SELECT stddev_pop(sc) FROM yamb) + 1e-9)) AS un, 1 / (1 + greatest(0, spread_bps) / 250) AS pen FROM yamb WHERE sc >= 0.15))""",
    "yamb",
    "ambiguity_score " + _SIG,
)
def p36(lake):
    # a text is scored once, not beside every price of its market
    scores = lake.texts.join(lake.markets.select("market_id"), "market_id", "left_semi").select("market_id", T.ambiguity_score(S.rule_text()).alias("ambiguity_score"))
    blank = lit(1 / 400)  # the score of a market without text
    p = yes_of(lake).join(materialise(scores), "market_id", "left").withColumn("ambiguity_score", F.coalesce("ambiguity_score", blank))
    return S.rule_ambiguity(p).select("ts", "token_id", "ambiguity_score", *_SIG.split())


_ALPHA = "CASE WHEN r.winner_token_id IS NULL THEN NULL WHEN t.side = 'BUY' THEN (t.token_id = r.winner_token_id)::INT - t.price ELSE t.price - (t.token_id = r.winner_token_id)::INT END"
CTES["alpha"] = f"SELECT t.*, m.close_ts, r.winner_token_id, {_ALPHA} AS alpha, CASE WHEN t.side = 'BUY' THEN notional ELSE -notional END AS signed FROM trd t LEFT JOIN mkt m ON m.market_id = t.market_id LEFT JOIN res r ON r.market_id = t.market_id"
CTES["wflow"] = """
SELECT date_trunc('day', trade_ts) AS hr, token_id, sum(signed) AS whale_flow_raw, sum(signed * (0.5::DOUBLE + coalesce(wallet_alpha, 0))) AS whale_flow, avg(wallet_alpha) AS whale_alpha FROM (
SELECT *, avg(alpha) OVER (PARTITION BY trader) AS wallet_alpha FROM alpha WHERE trader IN (SELECT trader FROM (SELECT trader, sum(notional) AS s FROM trd GROUP BY 1) WHERE round(s, 6) >= (SELECT quantile_cont(round(s, 6), 0.9) FROM (SELECT sum(notional) AS s FROM trd GROUP BY trader))))
GROUP BY 1, 2"""


@query("f14_trade_alpha", "SELECT trade_id, token_id, trader, side, trade_ts, price, alpha AS alpha_per_share FROM alpha", "alpha", "price alpha_per_share")
def f14(lake):
    t = E.resolved_trades(lake.trades, lake.markets, lake.resolutions)
    return t.select("trade_id", "token_id", "trader", "side", "trade_ts", "price", E.trade_alpha().alias("alpha_per_share"))


@query("j29_resolved_trades", "SELECT trade_id, market_id, token_id, trader, close_ts, winner_token_id, size FROM alpha", "alpha", "size")
def j29(lake):
    return E.resolved_trades(lake.trades, lake.markets, lake.resolutions).select("trade_id", "market_id", "token_id", "trader", "close_ts", "winner_token_id", "size")


def flow_of(lake):
    return memo(lake, "whale_flow", lambda: E.wallet_flow(lake.trades, lake.resolutions, 0.9, UNIT))


@query("a8_whale_flow", "SELECT * FROM wflow", "wflow", "whale_flow_raw whale_flow whale_alpha")
def a8(lake):
    return E.wallet_flow(lake.trades, lake.resolutions, 0.9, UNIT)


CTES["ywf"] = "SELECT y.*, coalesce(whale_flow, 0) AS wf, coalesce(whale_flow_raw, 0) AS wr, coalesce(whale_alpha, 0) AS wa FROM yes y LEFT JOIN wflow f ON f.hr = date_trunc('day', y.ts) AND f.token_id = y.token_id"


@query("j21_whale_flow_join", "SELECT ts, token_id, wf AS whale_flow, wr AS whale_flow_raw, wa AS whale_alpha FROM ywf", "ywf", "whale_flow whale_flow_raw whale_alpha")
def j21(lake):
    return S.whale_flow_signal(yes_of(lake), flow_of(lake), UNIT).select("ts", "token_id", "whale_flow", "whale_flow_raw", "whale_alpha")


@query(
    "p37_whale_signal",
    f"SELECT ts, token_id, tanh(raw_signal / 2) AS signal, greatest(0.05, least(1, least(1, abs(fz) / 3) * least(1, 0.5 + greatest(0, az) / 2))) AS confidence, raw_signal FROM (SELECT *, 0.6 * rz + 0.4 * (fz * (1 + greatest(-1, least(2, az)))) AS raw_signal FROM (SELECT *, {_z('wf', 'ywf')} AS fz, {_z('wa', 'ywf')} AS az, {_z('wr', 'ywf')} AS rz FROM ywf))",
    "ywf",
    _SIG,
)
def p37(lake):
    return S.whale_flow_signal(yes_of(lake), flow_of(lake), UNIT).select("ts", "token_id", *_SIG.split())


CTES["mom"] = """
SELECT * FROM (SELECT s.snapshot_ts, s.market_id, s.token_id, s.mid, coalesce(m.close_ts, m.end_ts) AS close_ts, m.category, s.mid / lag(s.mid, 3) OVER w - 1 AS ret_lb, lead(s.mid, 3) OVER w / s.mid - 1 AS ret_fw,
 date_diff('second', s.snapshot_ts, coalesce(m.close_ts, m.end_ts)) / 3600.0::DOUBLE AS hours_to_close FROM snap s JOIN mkt m ON m.market_id = s.market_id WHERE s.mid IS NOT NULL WINDOW w AS (PARTITION BY s.token_id ORDER BY s.snapshot_ts))
WHERE hours_to_close BETWEEN 1 AND 8760 AND ret_lb IS NOT NULL AND ret_fw IS NOT NULL"""


@query("j30_momentum_frame", "SELECT snapshot_ts, market_id, token_id, category, ret_lb, ret_fw, hours_to_close FROM mom", "mom", "ret_lb ret_fw hours_to_close")
def j30(lake):
    return E.momentum_frame(lake.snapshots, lake.markets).select("snapshot_ts", "market_id", "token_id", "category", "ret_lb", "ret_fw", "hours_to_close")


@query(
    "w11_cross_section_z",
    "SELECT ts, token_id, greatest(-2, least(2, CASE WHEN n < 3 THEN (x - (SELECT avg(ret_lb) FROM mom)) / (SELECT stddev_pop(ret_lb) FROM mom) WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END)) / 2 AS signal FROM (SELECT snapshot_ts AS ts, token_id, ret_lb AS x, count(*) OVER w AS n, avg(ret_lb) OVER w AS m, stddev_pop(ret_lb) OVER w AS s FROM mom WINDOW w AS (PARTITION BY snapshot_ts))",
    "mom",
    "signal",
)
def w11(lake):
    f = E.momentum_frame(lake.snapshots, lake.markets).withColumnRenamed("snapshot_ts", "ts")
    return S.cross_section_z(f).select("ts", "token_id", "signal")


_REG = "slope intercept r r2 t_stat"
_RSQL = "count(*) AS n, regr_slope(ret_fw, ret_lb) AS slope, regr_intercept(ret_fw, ret_lb) AS intercept, corr(ret_lb, ret_fw) AS r, regr_r2(ret_fw, ret_lb) AS r2, corr(ret_lb, ret_fw) * sqrt((count(*) - 2) / (1 - corr(ret_lb, ret_fw) * corr(ret_lb, ret_fw))) AS t_stat"


@query("a36_regression", f"SELECT {_RSQL} FROM mom", "mom", _REG)
def a36(lake):
    return E.regression(E.momentum_frame(lake.snapshots, lake.markets), "ret_lb", "ret_fw")


@query("a36_bucket_regression", f"SELECT CASE WHEN hours_to_close <= 24 THEN '0-24h' WHEN hours_to_close <= 72 THEN '24-72h' ELSE '72h+' END AS bucket, {_RSQL} FROM mom GROUP BY 1 HAVING count(*) >= 30", "mom", _REG)
def a36b(lake):
    f = E.momentum_frame(lake.snapshots, lake.markets).withColumn("bucket", E.hours_bucket(F.col("hours_to_close")))
    return E.regression(f, "ret_lb", "ret_fw", ("bucket",)).where("n >= 30")


@query("f12_time_buckets", "SELECT CASE WHEN hours_to_close <= 24 THEN '0-24h' WHEN hours_to_close <= 72 THEN '24-72h' ELSE '72h+' END AS close_bucket, CASE WHEN hours_to_close <= 24 THEN '<=24h' WHEN hours_to_close <= 72 THEN '24-72h' WHEN hours_to_close <= 168 THEN '3-7d' ELSE '>7d' END AS resolution_bucket, count(*) AS n FROM mom GROUP BY 1, 2", "mom")
def f12(lake):
    h = F.col("hours_to_close")
    return E.momentum_frame(lake.snapshots, lake.markets).groupBy(E.hours_bucket(h).alias("close_bucket"), E.resolution_bucket(h).alias("resolution_bucket")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- price joins

CTES["lasty"] = "SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.token_id ORDER BY snapshot_ts DESC) AS rn FROM snap s WHERE mid IS NOT NULL) WHERE rn = 1"


@query("w2_latest_per_token", "SELECT token_id, snapshot_ts, market_id, mid, spread_bps, liquidity_score FROM lasty", "lasty", "mid spread_bps liquidity_score")
def w2(lake):
    return E.latest_per_token(lake.snapshots)


@query("j6_latest_yes", "SELECT l.market_id, l.token_id, l.snapshot_ts, l.mid AS prob, m.event_id, m.category, m.close_ts FROM lasty l JOIN ytok y ON y.token_id = l.token_id JOIN mkt m ON m.market_id = l.market_id", "lasty ytok mkt", "prob")
def j6(lake):
    return E.latest_yes_probabilities(lake.snapshots, lake.outcomes, lake.markets)


@query("j7_yes_history", "SELECT s.snapshot_ts, s.market_id, s.mid AS prob FROM snap s JOIN ytok y ON y.token_id = s.token_id WHERE s.market_id IN (SELECT market_id FROM res)", "snap ytok res", "prob")
def j7(lake):
    return E.yes_probability_panel(lake.snapshots, lake.outcomes, lake.resolutions.select("market_id"))


CTES["tgt"] = "SELECT r.market_id, r.winner_token_id, coalesce(r.resolved_ts, m.close_ts) AS resolved_ts, coalesce(r.resolved_ts, m.close_ts) - INTERVAL 24 HOUR AS target_ts, m.category FROM res r JOIN mkt m ON m.market_id = r.market_id"
CTES["nq"] = "SELECT * FROM (SELECT t.*, s.token_id, s.snapshot_ts, s.mid AS prob, s.spread_bps, s.liquidity_score, row_number() OVER (PARTITION BY t.market_id, s.token_id ORDER BY abs(date_diff('second', s.snapshot_ts, t.target_ts)), s.snapshot_ts) AS rn FROM tgt t JOIN snap s ON s.market_id = t.market_id WHERE s.mid IS NOT NULL) WHERE rn = 1"
CTES["nt"] = "SELECT * FROM (SELECT t.*, s.token_id, s.trade_ts AS snapshot_ts, s.price AS prob, NULL::DOUBLE AS spread_bps, s.notional AS liquidity_score, row_number() OVER (PARTITION BY t.market_id, s.token_id ORDER BY abs(date_diff('second', s.trade_ts, t.target_ts)), s.trade_ts, s.trade_id, s.price, s.size) AS rn FROM tgt t JOIN trd s ON s.market_id = t.market_id) WHERE rn = 1"
_NEAR = ["market_id", "token_id", "winner_token_id", "resolved_ts", "target_ts", "category", "snapshot_ts", "prob", "spread_bps", "liquidity_score"]


@query("j8_nearest_quote", f"SELECT {', '.join(_NEAR)} FROM nq", "nq", "prob spread_bps liquidity_score")
def j8(lake):
    return E.nearest_quotes(E.resolution_targets(lake.markets, lake.resolutions), lake.snapshots).select(*_NEAR)


@query("j9_nearest_trade", f"SELECT {', '.join(_NEAR)} FROM nt", "nt", "prob spread_bps liquidity_score")
def j9(lake):
    return E.nearest_trades(E.resolution_targets(lake.markets, lake.resolutions), lake.trades).select(*_NEAR)


@query("w3_nearest_in_time", "SELECT market_id, token_id, snapshot_ts, abs(date_diff('second', snapshot_ts, target_ts)) AS seconds_away FROM nq", "nq")
def w3(lake):
    q = E.nearest_quotes(E.resolution_targets(lake.markets, lake.resolutions), lake.snapshots)
    return q.select("market_id", "token_id", "snapshot_ts", F.abs(F.unix_seconds("snapshot_ts") - F.unix_seconds("target_ts")).alias("seconds_away"))


CTES["nqs"] = "SELECT * FROM nq WHERE market_id % 2 = 0"
CTES["pre"] = "SELECT *, abs(prob - y) AS abs_error, prob - y AS signed_error, y - prob AS edge_long, date_diff('second', snapshot_ts, resolved_ts) / 3600.0::DOUBLE AS hours_to_resolution FROM (SELECT *, (token_id = winner_token_id)::INT::DOUBLE AS y FROM (SELECT * FROM nq UNION ALL SELECT * FROM nt t WHERE NOT EXISTS (SELECT 1 FROM nq q WHERE q.market_id = t.market_id AND q.token_id = t.token_id)))"
_PRE = "prob y abs_error signed_error edge_long hours_to_resolution"


@query("j10_quote_or_trade", f"SELECT market_id, token_id, snapshot_ts, {', '.join(_PRE.split())} FROM pre", "pre", _PRE)
def j10(lake):
    return E.pre_resolution_frame(lake.snapshots, lake.trades, lake.markets, lake.resolutions).select("market_id", "token_id", "snapshot_ts", *_PRE.split())


def pre_of(lake):
    return memo(lake, "pre", lambda: E.pre_resolution_frame(lake.snapshots, lake.trades, lake.markets, lake.resolutions))


@query("u3_except_keys", "SELECT market_id, token_id FROM outc EXCEPT SELECT market_id, token_id FROM nq", "outc nq")
def u3(lake):
    q = E.nearest_quotes(E.resolution_targets(lake.markets, lake.resolutions), lake.snapshots)
    return lake.outcomes.select("market_id", "token_id").join(q, ["market_id", "token_id"], "left_anti")


_LB = binned_sql("pre", "liquidity_score", "5", "market_id, token_id")


@query("a38_liquidity_buckets", f"SELECT bin AS liq_bucket, avg(abs_error) AS mean_abs_error, median(abs_error) AS median_abs_error, avg(liquidity_score) AS avg_liquidity_score, count(*) AS n FROM ({_LB}) GROUP BY 1", "pre", "mean_abs_error median_abs_error avg_liquidity_score")
def a38(lake):
    return E.bucket_errors(pre_of(lake), "liquidity_score", 5, ("market_id", "token_id"), "liq_bucket")


CTES["liqb"] = _LB
CTES["prea"] = "SELECT p.*, a.ambiguity_score FROM pre p JOIN amb a ON a.market_id = p.market_id"


def amb_of(lake):
    def build():
        t = lake.texts.select("market_id", "question", "description")
        return E.ambiguity_frame(pre_of(lake).join(t, "market_id"))

    return memo(lake, "ambiguity", build)


@query("a38_ambiguity_buckets", "SELECT len(list_filter(e[2:len(e) - 1], lambda c: c < round(ambiguity_score, 12)))::BIGINT AS ambiguity_bucket, avg(abs_error) AS mean_abs_error, median(abs_error) AS median_abs_error, count(*) AS n FROM prea, (SELECT list_sort(list_distinct(list_transform(quantile_cont(ambiguity_score, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda q: round(q, 12)))) AS e FROM prea) GROUP BY 1", "prea", "mean_abs_error median_abs_error")
def a38b(lake):
    return E.ambiguity_buckets(amb_of(lake))


@query("a39_rule_spearman", "SELECT n, rho AS spearman, rho * sqrt((n - 2) / (1 - rho * rho)) AS t_stat FROM (SELECT count(*) AS n, corr(ra, rb) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM (SELECT round(ambiguity_score, 9) AS a, round(abs_error, 9) AS b FROM prea)))", "prea", "spearman t_stat")
def a39b(lake):
    return E.rule_summary(amb_of(lake))


@query("a36_momentum_summary", "SELECT w.*, CASE WHEN w.slope > 0 THEN 'momentum' ELSE 'mean_reversion' END AS dominant_style, coalesce((SELECT avg(((b.s > 0) = (w.slope > 0))::INT) FROM (SELECT regr_slope(ret_fw, ret_lb) AS s FROM mom GROUP BY CASE WHEN hours_to_close <= 24 THEN 1 WHEN hours_to_close <= 72 THEN 2 ELSE 3 END HAVING count(*) >= 30) b), 0.5) AS agreement FROM (SELECT " + _RSQL + " FROM mom) w", "mom", _REG + " agreement")
def a36c(lake):
    return E.momentum_summary(E.momentum_frame(lake.snapshots, lake.markets))


@query(
    "a37_welch_test",
    "SELECT na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, (ma - mb) / sqrt(va / na + vb / nb) AS t_stat, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof FROM (SELECT count(abs_error) FILTER (WHERE bin = 0) AS na, count(abs_error) FILTER (WHERE bin = 4) AS nb, avg(abs_error) FILTER (WHERE bin = 0) AS ma, avg(abs_error) FILTER (WHERE bin = 4) AS mb, var_samp(abs_error) FILTER (WHERE bin = 0) AS va, var_samp(abs_error) FILTER (WHERE bin = 4) AS vb FROM liqb)",
    "liqb",
    "mean_a mean_b t_stat dof",
)
def a37(lake):
    from marketlab.operators.ranking import bin_rows

    b = bin_rows(pre_of(lake), "liquidity_score", 5, ("market_id", "token_id"), "b")
    return E.welch(b, "abs_error", "b", 0, 4)


@query("a39_spearman", "SELECT count(*) AS n, corr(ra, rb) AS spearman FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb FROM (SELECT round(liquidity_score, 9) AS a, round(abs_error, 9) AS b FROM pre))", "pre", "spearman")
def a39(lake):
    from marketlab.operators.diagnostics import spearman

    return spearman(pre_of(lake).select(F.round("liquidity_score", 9).alias("a"), F.round("abs_error", 9).alias("b")), "a", "b")


# ------------------------------------------------------------------- wallets

_WS = "total_notional avg_trade_notional buy_ratio"
CTES["wst"] = "SELECT * FROM (SELECT trader, count(DISTINCT trade_id) AS trades, sum(notional) AS total_notional, avg(notional) AS avg_trade_notional, count(DISTINCT market_id) AS markets, avg((side = 'BUY')::INT) AS buy_ratio FROM trd GROUP BY 1) WHERE trades >= 30"


@query("a7_wallet_stats", "SELECT * FROM wst", "wst", _WS)
def a7(lake):
    return E.wallet_stats(lake.trades)


CTES["whales"] = "SELECT trader FROM wst WHERE total_notional >= (SELECT quantile_cont(total_notional, 0.95) FROM wst)"


@query("j19_whale_trades", "SELECT trade_id, token_id, trader, trade_ts, price FROM trd WHERE trader IN (SELECT trader FROM whales)", "trd whales", "price")
def j19(lake):
    from marketlab.operators.ranking import quantile_row

    st = E.wallet_stats(lake.trades)
    cut = quantile_row(st, {"c": ("total_notional", 0.95)}).scalar()
    return lake.trades.join(st.where(F.col("total_notional") >= cut).select("trader"), "trader", "left_semi").select("trade_id", "token_id", "trader", "trade_ts", "price")


CTES["wtr"] = "SELECT a.*, a.trader IN (SELECT trader FROM whales) AS is_whale, coalesce(date_diff('second', mo, trade_ts) >= 0 AND date_diff('second', mo, trade_ts) <= 0.2::DOUBLE * date_diff('second', mo, close_ts), false) AS is_early FROM (SELECT *, min(trade_ts) OVER (PARTITION BY market_id) AS mo FROM alpha) a"


@query("j20_market_open", "SELECT trade_id, token_id, trader, trade_ts, mo AS market_open, is_whale, is_early FROM wtr", "wtr")
def j20(lake):
    t = E.resolved_trades(lake.trades, lake.markets, lake.resolutions)
    return E.whale_flags(t, E.wallet_stats(lake.trades)).select("trade_id", "token_id", "trader", "trade_ts", "market_open", "is_whale", "is_early")


@query(
    "a9_early_whale_alpha",
    "SELECT na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, (ma - mb) / sqrt(va / na + vb / nb) AS t_stat, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof FROM (SELECT count(alpha) FILTER (WHERE is_whale) AS na, count(alpha) FILTER (WHERE NOT is_whale) AS nb, avg(alpha) FILTER (WHERE is_whale) AS ma, avg(alpha) FILTER (WHERE NOT is_whale) AS mb, var_samp(alpha) FILTER (WHERE is_whale) AS va, var_samp(alpha) FILTER (WHERE NOT is_whale) AS vb FROM wtr WHERE is_early)",
    "wtr",
    "mean_a mean_b t_stat dof",
)
def a9(lake):
    t = E.whale_flags(E.resolved_trades(lake.trades, lake.markets, lake.resolutions), E.wallet_stats(lake.trades)).where("is_early")
    return E.welch(t, "alpha_per_share", "is_whale", True, False)


# ------------------------------------------------------------ market tables


def text_markets(lake):
    """Markets of the order books with the texts that share their id."""
    # other texts stay out before the join moves them
    own = lake.texts.join(lake.markets.select("market_id"), "market_id", "left_semi")
    return lake.markets.join(own.select("market_id", "question", "description"), "market_id", "left")


CTES["tmk"] = "SELECT m.*, t.question, t.description, a.ambiguity_score FROM mkt m LEFT JOIN txt t ON t.market_id = m.market_id LEFT JOIN amb a ON a.market_id = m.market_id"
CTES["lasta"] = "SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.token_id ORDER BY snapshot_ts DESC) AS rn FROM snap s) WHERE rn = 1"
_J14 = "prob spread_bps liquidity_score ambiguity_score candidate_score"


@query("j14_unresolved_candidates", "SELECT m.market_id, m.category, l.mid AS prob, l.spread_bps, l.liquidity_score, m.ambiguity_score, m.ambiguity_score * greatest(0, l.spread_bps) / (ln(1 + l.liquidity_score) + 1) AS candidate_score FROM tmk m JOIN ytok y ON y.market_id = m.market_id JOIN lasta l ON l.token_id = y.token_id WHERE m.market_id NOT IN (SELECT market_id FROM res) ORDER BY candidate_score DESC, market_id LIMIT 50", "tmk ytok lasta res", _J14)
def j14(lake):
    return E.unresolved_candidates(text_markets(lake), lake.snapshots, lake.outcomes, lake.resolutions)


@query("j15_active_probability", "SELECT m.market_id, m.category, coalesce((SELECT avg(mid) FROM snap s WHERE s.market_id = m.market_id AND outcome_label = 'Yes'), (SELECT avg(mid) FROM snap s WHERE s.market_id = m.market_id), 0.5) AS market_prob_yes FROM tmk m WHERE active AND question IS NOT NULL", "tmk snap", "market_prob_yes")
def j15(lake):
    return E.active_market_probability(text_markets(lake), lake.snapshots, lake.outcomes).select("market_id", "category", "market_prob_yes")


def _contains(words, x="t"):
    return " + ".join(f"contains({x}, '{w}')::INT" for w in words)


CTES["rule"] = f"""
SELECT *, greatest(0, least(1, 0.15::DOUBLE * h + 0.10::DOUBLE * (1 - (s > 0)::INT) + 0.05::DOUBLE * (1 - d))) AS rule_risk_score, greatest(0, least(1, 0.30::DOUBLE * (s > 0)::INT + 0.20::DOUBLE * d + 0.05::DOUBLE * greatest(0, 6 - h))) AS rule_clarity_score,
 greatest(0, least(1, 0.15::DOUBLE * h + 0.10::DOUBLE * (s > 1)::INT)) AS resolution_lag_risk FROM (
SELECT *, ({_contains(T.HEDGES)}) AS h, ({_contains(T.SOURCES)}) AS s, regexp_matches(t, '{T.LOOSE_DATE}')::INT AS d FROM (
SELECT *, trim(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) || ' ' || trim(regexp_replace(lower(description), '\\s+', ' ', 'g'))) AS t FROM txt))"""
_F5 = "rule_risk_score rule_clarity_score resolution_lag_risk ambiguous_term_hits"


@query("f5_rule_scores", "SELECT market_id, rule_risk_score, rule_clarity_score, resolution_lag_risk, h::DOUBLE AS ambiguous_term_hits FROM rule", "rule", _F5)
def f5(lake):
    sc = T.rule_scores("question", "description")
    return lake.texts.select("market_id", *[sc[c].alias(c) for c in _F5.split()])


@query("f1_normal_text", "SELECT market_id, md5(trim(regexp_replace(lower(question), '\\s+', ' ', 'g'))) AS title, length(trim(regexp_replace(lower(description), '\\s+', ' ', 'g'))) AS body_length FROM txt", "txt")
def f1(lake):
    return lake.texts.select("market_id", F.md5(T.normal_text("question")).alias("title"), F.length(T.normal_text("description")).cast("long").alias("body_length"))


CTES["ttok"] = "SELECT *, list_sort(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS toks FROM txt"


@query("f2_token_set", "SELECT market_id, array_to_string(toks, ' ') AS tokens, len(toks) AS n FROM ttok", "ttok")
def f2(lake):
    t = F.array_sort(T.words(F.lower("question")))
    return lake.texts.select("market_id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


# the split is on non-word characters of any script, as the word boundary of the Spark side
_STOPS = ", ".join(f"'{w}'" for w in T.STEM_WORDS)
CTES["stem"] = f"""
SELECT *, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE trim(regexp_replace(regexp_replace(norm, '\\b(?:{'|'.join(T.STEM_WORDS)})\\b', ' ', 'g'), '\\s+', ' ', 'g')) END AS question_stem FROM (
SELECT *, list_sort(list_distinct(regexp_extract_all(array_to_string(list_filter(regexp_split_to_array(norm, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOPS})), ' '), '[a-z0-9]+'))) AS k FROM (
SELECT *, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS norm FROM txt))"""


@query("f7_question_stem", "SELECT market_id, question_stem FROM stem", "stem")
def f7(lake):
    return lake.texts.select("market_id", T.question_stem("question").alias("question_stem"))


@query("f8_content_ids", "SELECT market_id, md5(least(market_id::VARCHAR, event_id) || '|' || greatest(market_id::VARCHAR, event_id) || '|same_event') AS link_id FROM txt", "txt")
def f8(lake):
    return lake.texts.select("market_id", L.link_id(F.col("market_id").cast("string"), F.col("event_id"), F.lit("same_event")).alias("link_id"))


@query("f11_time_arithmetic", "SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day, date_diff('second', date_trunc('day', ts), date_trunc('second', ts)) / 3600.0::DOUBLE AS hours_of_day, ts + INTERVAL 24 HOUR AS next_day FROM events", "", "hours_of_day")
def f11(lake):
    e = lake.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_trunc("day", "ts")
    return e.select("event_id", F.date_trunc("hour", "ts").alias("hour"), day.alias("day"), ((F.unix_seconds("ts") - F.unix_seconds(day)) / lit(3600)).alias("hours_of_day"), (F.col("ts") + F.make_dt_interval(hours=F.lit(24))).alias("next_day"))


@query("f13_numeric_kit", "SELECT event_id, greatest(1.0::DOUBLE, least(50.0::DOUBLE, value)) AS clipped, ln(1 + value) AS log1, tanh(value / 100) AS squashed, 1 / (1 + exp(-(value - 50) / 10)) AS logit, sign(value - 50)::DOUBLE AS sgn, value * value AS sq FROM events", "", "clipped log1 squashed logit sgn sq")
def f13(lake):
    from marketlab.functions.columns import clip, logistic

    v = F.col("value")
    return lake.table("events").select("event_id", clip(v, 1.0, 50.0).alias("clipped"), F.log1p(v).alias("log1"), F.tanh(v / 100).alias("squashed"), logistic((v - 50) / 10).alias("logit"), F.signum(v - 50).alias("sgn"), (v * v).alias("sq"))


@query("p45_numeric_reading", "SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), -1) AS from_text, greatest(0, least(90, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.5))) AS from_json FROM events", "", "from_text from_json")
def p45(lake):
    from marketlab.functions.columns import number

    return lake.table("events").select("event_id", number("event_type", -1.0).alias("from_text"), number(F.get_json_object("props", "$.k"), 0.5, 0.0, 90.0).alias("from_json"))


# ------------------------------------------------------------------- linking


@query("j27_outcome_links", "SELECT y.market_id, y.token_id AS yes_token_id, n.token_id AS no_token_id, 'market_outcomes_yes_no_labels' AS link_source FROM outc y JOIN outc n ON n.market_id = y.market_id WHERE y.outcome_label = 'Yes' AND n.outcome_label = 'No'", "outc")
def j27(lake):
    return L.outcome_links(lake.outcomes).select("market_id", "yes_token_id", "no_token_id", "link_source")


@query("j28_linked_markets", "SELECT m.market_id, coalesce(m.event_id, '') AS event_id, coalesce(m.category, 'unknown') AS category FROM tmk m JOIN outc y ON y.market_id = m.market_id AND y.outcome_label = 'Yes' JOIN outc n ON n.market_id = m.market_id AND n.outcome_label = 'No'", "tmk outc")
def j28(lake):
    return L.linked_markets(text_markets(lake), L.outcome_links(lake.outcomes)).select("market_id", "event_id", "category")


CTES["mset"] = "SELECT DISTINCT md5(event_id || '|' || category || '|' || question_stem || '|exclusive') AS set_id, market_id::VARCHAR AS market_id, 'YES' AS outcome_label, 1.0::DOUBLE AS weight, 'exclusive' AS set_type, 0.85::DOUBLE AS link_confidence FROM (SELECT *, count(*) OVER (PARTITION BY event_id, category, question_stem) AS c FROM stem) WHERE c >= 2 AND trim(question_stem) <> ''"


@query("a59_market_sets", "SELECT * FROM mset", "mset", "weight link_confidence")
def a59(lake):
    m = lake.texts.select("market_id", "event_id", "category", "question", "active")
    return L.market_sets(m).drop("metadata_json")


CTES["jacp"] = """
SELECT a.market_id AS market_a, b.market_id AS market_b, len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks)))::DOUBLE AS jaccard, a.event_id, a.toks = b.toks AS same
FROM ttok a JOIN ttok b ON a.event_id = b.event_id AND a.market_id < b.market_id AND len(a.toks) > 0 AND len(b.toks) > 0"""


@query("u4_token_jaccard", "SELECT event_id, count(*) FILTER (WHERE NOT same) AS distinct_pairs, sum(jaccard) FILTER (WHERE NOT same) AS jaccard_sum, max(jaccard) FILTER (WHERE NOT same) AS best FROM jacp WHERE jaccard >= 0.25 GROUP BY 1 HAVING count(*) FILTER (WHERE NOT same) > 0", "jacp", "jaccard_sum best")
def u4(lake):
    # pairs of distinct word sets, weighted by how many markets share them
    t = lake.texts.select("market_id", "event_id", T.words(F.lower("question")).alias("toks"))
    sets = memo(lake, "title_sets", lambda: M.fold_sets(t, "event_id", "toks", "market_id"))
    p = M.jaccard_join(sets, sets, "event_id", 0.25, ordered_pairs=True)
    n = lambda s, c: sets.select(F.col("set_id").alias(s), F.col("members").alias(c), *(["event_id"] if s == "l" else []))
    p = p.join(n("l", "nl"), "l").join(n("r", "nr"), "r").withColumn("k", F.col("nl") * F.col("nr"))
    return p.groupBy("event_id").agg(F.sum("k").alias("distinct_pairs"), F.sum(F.col("jaccard") * F.col("k")).alias("jaccard_sum"), F.max("jaccard").alias("best"))


CTES["tfv"] = """
SELECT doc, event_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM (
SELECT t.doc, t.event_id, t.token, t.tf * (ln((1 + n.n) / (1 + t.df)::DOUBLE) + 1) AS w FROM (SELECT *, count(*) OVER (PARTITION BY event_id, token) AS df FROM (SELECT market_id AS doc, event_id, token, count(*) AS tf FROM (SELECT market_id, event_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]{2,}')) AS token FROM txt) GROUP BY ALL)) t
JOIN (SELECT event_id, count(*) AS n FROM txt GROUP BY 1) n ON n.event_id = t.event_id)"""
CTES["cosp"] = "SELECT a.doc AS market_a, b.doc AS market_b, a.event_id, sum(a.w * b.w) AS similarity FROM tfv a JOIN tfv b ON a.event_id = b.event_id AND a.token = b.token AND a.doc < b.doc GROUP BY ALL HAVING sum(a.w * b.w) >= 0.72::DOUBLE - 1e-9"


def related_of(lake):
    return memo(lake, "related", lambda: related(lake))


def related(lake):
    return L.representative_questions(lake.texts)


CTES["qrep"] = "SELECT *, min(market_id) OVER (PARTITION BY event_id, question) AS rep FROM txt"
CTES["relp"] = "SELECT c.market_a, c.market_b, c.similarity FROM cosp c JOIN qrep x ON x.market_id = c.market_a AND x.rep = c.market_a JOIN qrep y ON y.market_id = c.market_b AND y.rep = c.market_b UNION ALL SELECT rep, market_id, 1.0 FROM qrep WHERE rep <> market_id AND regexp_matches(lower(question), '[a-z0-9]{2,}')"


@query("j17_related_questions", "SELECT * FROM relp", "relp", "similarity")
def j17(lake):
    return related(lake)


@query(
    "j18_precedents",
    """SELECT a.market_id, count(r.market_id)::DOUBLE AS precedent_count, coalesce(avg(r.rule_risk_score), 0) AS precedent_rule_risk_mean FROM (SELECT market_id, category, list_distinct(list_filter(string_split(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS k FROM txt WHERE active) a
LEFT JOIN (SELECT market_id, category, rule_risk_score, list_distinct(list_filter(string_split(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS k FROM rule WHERE NOT active) r
 ON r.category = a.category AND len(list_intersect(a.k, r.k)) / greatest(1, len(a.k) + len(r.k) - len(list_intersect(a.k, r.k)))::DOUBLE >= 0.25 GROUP BY 1""",
    "rule txt",
    "precedent_count precedent_rule_risk_mean",
)
def j18(lake):
    t = lake.texts
    return E.precedent_counts(t.where("active"), t.where("NOT active"))


def _ratio_sql(a: str, b: str) -> str:
    x, y = (f"regexp_replace({c}, '[^\\x00-\\x7F]', '?', 'g')" for c in (a, b))
    return f"CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN 1.0 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))::DOUBLE ELSE 0 END"


CTES["ttit"] = "SELECT market_id::VARCHAR AS m, event_id, category, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS title, list_sort(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS toks, CASE WHEN coalesce(event_id, '') <> '' AND lower(event_id) <> 'none' THEN 'e:' || event_id ELSE 'c:' || coalesce(category, 'unknown') END AS block FROM txt WHERE question IS NOT NULL"
CTES["trep"] = "SELECT block, toks, min(m) AS m, arg_min(title, m) AS title, arg_min(event_id, m) AS ev FROM ttit WHERE len(toks) > 0 GROUP BY block, toks"
CTES["tpair"] = """SELECT a.m AS ma, b.m AS mb, a.title AS ta, b.title AS tb, a.ev AS ea, b.ev AS eb, len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))::DOUBLE AS jac FROM trep a JOIN trep b ON a.block = b.block AND a.m < b.m
UNION ALL SELECT r.m, t.m, r.title, t.title, r.ev, t.event_id, 1.0 FROM ttit t JOIN trep r ON r.block = t.block AND r.toks = t.toks WHERE r.m <> t.m"""
CTES["tscore"] = f"SELECT *, 0.6::DOUBLE * sim + 0.4::DOUBLE * jac AS score FROM (SELECT *, {_ratio_sql('ta', 'tb')} AS sim FROM tpair WHERE jac >= 0.55::DOUBLE - 1e-12)"
CTES["tlink"] = f"""SELECT *, CASE WHEN ea <> '' AND ea = eb THEN 'same_event' WHEN regexp_matches(ta, '{T.DATE_HINT}') AND regexp_matches(tb, '{T.DATE_HINT}') AND (sim >= 0.7 OR jac >= 0.5) THEN 'time_window_consistency_candidate' WHEN sim >= 0.8 OR jac >= 0.65 THEN 'fuzzy_related' ELSE 'weak_related' END AS relation_type FROM tscore"""
CTES["tbest"] = "SELECT least(me, you) AS lo, greatest(me, you) AS hi, min(rk) AS rk FROM (SELECT me, you, row_number() OVER (PARTITION BY me ORDER BY score DESC, you DESC) AS rk FROM (SELECT ma AS me, mb AS you, score FROM tlink UNION ALL SELECT mb, ma, score FROM tlink)) GROUP BY 1, 2"
_LINKS = "SELECT md5(least(ma, mb) || '|' || greatest(ma, mb) || '|' || relation_type) AS link_id, least(ma, mb) AS market_id_a, greatest(ma, mb) AS market_id_b, relation_type, least(greatest(score, 0), 1) AS link_confidence FROM tlink JOIN tbest ON lo = least(ma, mb) AND hi = greatest(ma, mb) AND rk <= {k}"
CTES["links12"] = _LINKS.format(k=12)
LINK = ("link_id", "market_id_a", "market_id_b", "relation_type", "link_confidence")


def links_of(lake):
    return memo(lake, "links", lambda: L.similar_titles(lake.texts))


@query("j16_similar_titles", "SELECT * FROM links12", "links12", "link_confidence")
def j16(lake):
    return links_of(lake).select(*LINK)


@query("t3_best_partners", _LINKS.format(k=3), "tlink tbest", "link_confidence")
def t3(lake):
    return L.similar_titles(lake.texts, per_market=3).select(*LINK)


@query("f3_sequence_ratio", f"SELECT market_a, market_b, {_ratio_sql('a.title', 'b.title')} AS ratio FROM relp JOIN ttit a ON a.m = market_a::VARCHAR JOIN ttit b ON b.m = market_b::VARCHAR", "relp ttit", "ratio")
def f3(lake):
    p = related_of(lake)
    q = lake.texts.select("market_id", T.normal_text("question").alias("q"))
    j = p.join(q.select(F.col("market_id").alias("market_a"), F.col("q").alias("qa")), "market_a").join(q.select(F.col("market_id").alias("market_b"), F.col("q").alias("qb")), "market_b")
    return j.select("market_a", "market_b", L.edit_ratio(F.col("qa"), F.col("qb")).alias("ratio"))


@query("f6_relation_type", "SELECT market_a, market_b, CASE WHEN NOT dated THEN CASE WHEN similarity >= 0.8 THEN 'fuzzy_related' ELSE 'weak_related' END ELSE 'time_window_consistency_candidate' END AS relation_type FROM (SELECT c.*, regexp_matches(trim(regexp_replace(lower(a.question), '\\s+', ' ', 'g')), '" + T.DATE_HINT + "') AND regexp_matches(trim(regexp_replace(lower(b.question), '\\s+', ' ', 'g')), '" + T.DATE_HINT + "') AS dated FROM relp c JOIN txt a ON a.market_id = c.market_a JOIN txt b ON b.market_id = c.market_b)", "relp txt")
def f6(lake):
    p = related_of(lake)
    # pairs meet the date mark of a question, not its text
    q = lake.texts.select("market_id", L.has_date("question").alias("dated"))
    j = p.join(q.select(F.col("market_id").alias("market_a"), F.col("dated").alias("da")), "market_a").join(q.select(F.col("market_id").alias("market_b"), F.col("dated").alias("db")), "market_b")
    return j.select("market_a", "market_b", L.relation_kind(F.lit(False), F.col("da") & F.col("db"), F.col("similarity"), lit(0)).alias("relation_type"))


@query(
    "a33_links_summary",
    """SELECT 'outcome_links' AS metric, count(*)::DOUBLE AS value, 'markets=' || count(DISTINCT y.market_id) AS detail FROM outc y JOIN outc n ON n.market_id = y.market_id WHERE y.outcome_label = 'Yes' AND n.outcome_label = 'No'
UNION ALL SELECT 'market_sets', count(DISTINCT set_id)::DOUBLE, 'members=' || count(*) || ' avg_conf=' || printf('%.3f', coalesce(avg(link_confidence), 0)) FROM mset
UNION ALL SELECT 'market_links:' || relation_type, count(*)::DOUBLE, '' FROM links12 GROUP BY relation_type""",
    "outc mset links12",
    "value",
)
def a33(lake):
    return L.links_summary(L.outcome_links(lake.outcomes), L.market_sets(lake.texts.select("market_id", "event_id", "category", "question", "active")), links_of(lake))


def book_pairs(lake):
    """Related questions as pairs of markets with books.

    As trades do in their view, a text belongs to the book whose id is its own
    id modulo the number of books.
    """
    k = lake.markets.agg(F.max("market_id") + 1).scalar()
    p = related_of(lake).select((F.col("market_a") % k).alias("x"), (F.col("market_b") % k).alias("y")).where("x <> y")
    return p.select(F.least("x", "y").alias("market_a"), F.greatest("x", "y").alias("market_b")).distinct()


def all_book_pairs(lake):
    """As :func:`book_pairs`, of all related questions: every copy of a question counts, not its representative alone.

    Sets of equal questions become sets of books before their members meet.
    """

    def build():
        k = lake.markets.agg(F.max("market_id") + 1).scalar()
        members, pairs = L.question_sets(lake.texts)
        books = members.select("event_id", "doc", (F.col("market_id") % k).alias("market_id")).distinct()
        return L.member_pairs(books, pairs).where("market_a <> market_b").select("market_a", "market_b").distinct()

    return memo(lake, "all_book_pairs", build)


CTES["bpair"] = "SELECT DISTINCT least(x, y) AS market_a, greatest(x, y) AS market_b FROM (SELECT market_a % k AS x, market_b % k AS y FROM relp, (SELECT max(market_id) + 1 AS k FROM mkt)) WHERE x <> y"
CTES["cpair"] = "SELECT DISTINCT least(x, y) AS market_a, greatest(x, y) AS market_b FROM (SELECT market_a % k AS x, market_b % k AS y FROM cosp, (SELECT max(market_id) + 1 AS k FROM mkt)) WHERE x <> y"
CTES["bgap"] = "SELECT p.*, a.snapshot_ts, a.mid - b.mid AS gap FROM bpair p JOIN snap a ON a.market_id = p.market_a AND a.outcome_label = 'Yes' JOIN snap b ON b.market_id = p.market_b AND b.outcome_label = 'Yes' AND b.snapshot_ts = a.snapshot_ts"
CTES["cgap"] = "SELECT p.*, a.snapshot_ts, a.mid - b.mid AS gap FROM cpair p JOIN snap a ON a.market_id = p.market_a AND a.outcome_label = 'Yes' JOIN snap b ON b.market_id = p.market_b AND b.outcome_label = 'Yes' AND b.snapshot_ts = a.snapshot_ts"


def yes_hist(lake):
    return E.yes_probability_panel(lake.snapshots, lake.outcomes, lake.markets.select("market_id"))


@query("a60_pair_spreads", "SELECT market_a, market_b, count(*) AS n_obs, avg(gap) AS spread_mean, stddev_pop(gap) AS spread_std, (arg_max(gap, snapshot_ts) - avg(gap)) / stddev_pop(gap) AS spread_zscore FROM bgap GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_pop(gap) > 1e-12", "bgap", "spread_mean spread_std spread_zscore")
def a60(lake):
    return E.pair_spreads(book_pairs(lake), yes_hist(lake))


@query("a60_inequality_violation", "SELECT a.market_id AS market_a, b.market_id AS market_b, CASE WHEN contains(lower(b.question), lower(a.question)) AND pb > pa THEN pb - pa WHEN contains(lower(a.question), lower(b.question)) AND pa > pb THEN pa - pb ELSE 0 END AS inequality_violation FROM (SELECT p.market_a, p.market_b, la.mid AS pa, lb.mid AS pb FROM cpair p JOIN lasty la ON la.token_id = 2 * p.market_a JOIN lasty lb ON lb.token_id = 2 * p.market_b) x JOIN tmk a ON a.market_id = x.market_a JOIN tmk b ON b.market_id = x.market_b WHERE a.question IS NOT NULL AND b.question IS NOT NULL", "cpair lasty tmk", "inequality_violation")
def a60b(lake):
    now = E.latest_yes_probabilities(lake.snapshots, lake.outcomes, text_markets(lake)).where("question IS NOT NULL")
    side = lambda s: now.select(F.col("market_id").alias(f"market_{s}"), F.col("question").alias(f"q{s}"), F.col("prob").alias(f"p{s}"))
    j = all_book_pairs(lake).join(side("a"), "market_a").join(side("b"), "market_b")
    return j.select("market_a", "market_b", E.inequality_violation(F.col("qa"), F.col("qb"), F.col("pa"), F.col("pb")).alias("inequality_violation"))


@query("m10_unit_root", "SELECT market_a, market_b, n, slope, CASE WHEN s2 > 1e-15 THEN slope / sqrt(s2 / sxx) END AS unit_root_t FROM (SELECT *, (syy - slope * slope * sxx) / (n - 2) AS s2 FROM (SELECT market_a, market_b, count(*) AS n, regr_slope(dy, x) AS slope, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy FROM (SELECT *, gap - x AS dy FROM (SELECT *, lag(gap) OVER (PARTITION BY market_a, market_b ORDER BY snapshot_ts) AS x FROM cgap) WHERE x IS NOT NULL) GROUP BY 1, 2) WHERE n >= 8 AND sxx > 1e-12)", "cgap", "slope unit_root_t")
def m10(lake):
    return E.unit_root_stat(all_book_pairs(lake), yes_hist(lake))


@query("j13_window_consistency", "SELECT CASE WHEN ca < cb THEN market_a ELSE market_b END AS market_id_earlier, CASE WHEN ca < cb THEN market_b ELSE market_a END AS market_id_later, CASE WHEN ca < cb THEN pa - pb ELSE pb - pa END AS violation_prob, CASE WHEN ca < cb THEN pa - pb ELSE pb - pa END - 0.0035::DOUBLE AS expected_net_return FROM (SELECT p.market_a, p.market_b, a.close_ts AS ca, b.close_ts AS cb, la.mid AS pa, lb.mid AS pb FROM bpair p JOIN mkt a ON a.market_id = p.market_a JOIN mkt b ON b.market_id = p.market_b JOIN lastb la ON la.market_id = p.market_a AND la.outcome_label = 'Yes' JOIN lastb lb ON lb.market_id = p.market_b AND lb.outcome_label = 'Yes' WHERE a.close_ts <> b.close_ts) WHERE CASE WHEN ca < cb THEN pa - pb ELSE pb - pa END >= 0.005", "bpair mkt lastb", "violation_prob expected_net_return")
def j13(lake):
    from marketlab.operators.pairs import latest_books, window_consistency

    links = book_pairs(lake).select(F.col("market_a").alias("market_id_a"), F.col("market_b").alias("market_id_b"), F.lit("time_window_consistency_candidate").alias("relation_type"), lit(0.9).alias("link_confidence"))
    w = window_consistency(links, latest_books(lake.snapshots, lake.outcomes), lake.markets)
    return w.select("market_id_earlier", "market_id_later", "violation_prob", "expected_net_return")


@query("a62_rule_review", "SELECT m.market_id, m.category, q.market_prob_yes, q.rule_edge_score, 0.15 * q.rule_edge_score - 0.02 AS expected_net_return, CASE WHEN q.rule_edge_score > 0 THEN 'price_extreme_vs_rule_clarity_or_precedent' ELSE 'no_clear_rule_edge' END AS rationale, 'PENDING' AS review_status FROM tmk m JOIN (SELECT r.market_id, r.rule_risk_score, p.market_prob_yes, greatest(-1, least(1, r.rule_clarity_score - r.rule_risk_score + 0.25 * abs(p.market_prob_yes - 0.5) * 2)) AS rule_edge_score FROM rule r JOIN (SELECT m.market_id, coalesce((SELECT avg(mid) FROM snap s WHERE s.market_id = m.market_id AND outcome_label = 'Yes'), (SELECT avg(mid) FROM snap s WHERE s.market_id = m.market_id), 0.5) AS market_prob_yes FROM tmk m WHERE active AND question IS NOT NULL) p ON p.market_id = r.market_id) q ON q.market_id = m.market_id WHERE q.rule_risk_score >= 0.05 AND 0.15 * q.rule_edge_score - 0.02 >= -0.05 ORDER BY expected_net_return DESC, market_id LIMIT 200", "tmk rule snap", "market_prob_yes rule_edge_score expected_net_return")
def a62(lake):
    act = E.active_market_probability(text_markets(lake), lake.snapshots, lake.outcomes)
    sc = T.rule_scores("question", "description")
    # written once: the empty precedents are made of its rows, and the texts are scored for both
    scored = materialise(act.select("market_id", "category", "market_prob_yes", *[c.alias(n) for n, c in sc.items()]))
    none = scored.select("market_id", lit(0).alias("precedent_count"), lit(0).alias("precedent_rule_risk_mean"))
    _, review = E.rule_candidates(scored, none, 0.05, -0.05)
    return review.select("market_id", "category", "market_prob_yes", "rule_edge_score", "expected_net_return", "rationale", "review_status")


# ------------------------------------------------------- quotes, top-k, sets

_Q = "quote_bid quote_ask quote_width expected_fill_probability quoted_notional expected_net_return"
CTES["mm"] = """
SELECT *, fp * 0.5 * ((half - greatest(0, quote_bid - nx)) / mid + (half - greatest(0, nx - quote_ask)) / mid) AS g FROM (
SELECT *, greatest(0.001, least(0.999, fair - half)) AS quote_bid, greatest(0.001, least(0.999, fair + half)) AS quote_ask, 1 / (1 + exp(-greatest(-20, least(20, 0.9 * ln(1 + depth_total / 100) - 1.2 * (spread_bps / 200) + 0.4 * ln(1 + trade_notional_h) - 0.5)))) AS fp, coalesce(future_mid_1, mid) AS nx FROM (
SELECT *, greatest(0.001, least(0.999, mid - 0.25 * greatest(-0.05, least(0.05, velocity_1)))) AS fair, least(0.25 * mid, greatest(0.001, least(0.10, greatest(0.001, least(0.05, spread / 2)) * (1 + 1.5 * (prob_vol_6 / ((SELECT median(prob_vol_6) FROM yes WHERE depth_total >= 20 AND prob_vol_6 <= 2 AND mid BETWEEN 0.1 AND 0.9 AND abs(velocity_1) < 0.5) + 1e-6))) * (1 + 0.5 * (time_to_resolution_h <= 24)::INT)))) AS half, (time_to_resolution_h <= 24)::INT AS near
FROM yes WHERE depth_total >= 20 AND prob_vol_6 <= 2 AND mid BETWEEN 0.1 AND 0.9 AND abs(velocity_1) < 0.5))"""


def quotes_of(lake):
    return S.quote_scores(yes_of(lake), min_depth=20, max_vol=2, adverse=0.5)


@query("p32_quote_scores", "SELECT ts, token_id, quote_bid, quote_ask, quote_ask - quote_bid AS quote_width, fp AS expected_fill_probability, greatest(10, least(100, 100 * (1 - 0.4 * near) * (1 - 0.2 * least(1, prob_vol_6)))) AS quoted_notional, greatest(-0.05, least(0.05, g)) - 0.004 * fp AS expected_net_return FROM mm", "mm", _Q)
def p32(lake):
    return quotes_of(lake).select("ts", "token_id", *_Q.split())


@query("p31_fill_probability", "SELECT ts, token_id, 1 / (1 + exp(-greatest(-20, least(20, 0.9 * ln(1 + depth_total / 100) - 1.2 * (spread_bps / 200) + 0.4 * ln(1 + trade_notional_h) - 0.5)))) AS fill_prob FROM panel", "panel", "fill_prob")
def p31(lake):
    return panel_of(lake).select("ts", "token_id", S.fill_probability(F.col("depth_total"), F.col("spread_bps"), F.col("trade_notional_h")).alias("fill_prob"))


@query("t1_top_quotes", "SELECT ts, token_id, round(greatest(-0.05, least(0.05, g)) - 0.004 * fp, 9) AS expected_net_return FROM mm ORDER BY 3 DESC, ts, token_id LIMIT 200", "mm", "expected_net_return")
def t1(lake):
    q = quotes_of(lake).select("ts", "token_id", F.round("expected_net_return", 9).alias("expected_net_return"))
    return q.orderBy(F.col("expected_net_return").desc(), "ts", "token_id").limit(200)


@query("t2_best_per_market", "SELECT market_id, token_id, ts, v AS expected_net_return FROM (SELECT *, row_number() OVER (PARTITION BY market_id, token_id ORDER BY v DESC, ts) AS rn FROM (SELECT *, round(greatest(-0.05, least(0.05, g)) - 0.004 * fp, 9) AS v FROM mm)) WHERE rn = 1 ORDER BY v DESC, market_id, token_id LIMIT 200", "mm", "expected_net_return")
def t2(lake):
    q = quotes_of(lake).withColumn("expected_net_return", F.round("expected_net_return", 9))
    return best_per_key(q, ["market_id", "token_id"], "expected_net_return", ["ts"], 200).select("market_id", "token_id", "ts", "expected_net_return")


@query("t4_last_per_key", "SELECT trade_ts, market_id, trade_id, price FROM (SELECT *, row_number() OVER (PARTITION BY trade_ts, market_id ORDER BY trade_id DESC, price DESC) AS rn FROM trd) WHERE rn = 1", "trd", "price")
def t4(lake):
    from marketlab.operators.topk import last_per_key

    return last_per_key(lake.trades, ["trade_ts", "market_id"], ["trade_id", "price"]).select("trade_ts", "market_id", "trade_id", "price")


@query("t5_newest_markets", "SELECT market_id, close_ts FROM mkt ORDER BY close_ts DESC NULLS LAST, market_id LIMIT 40", "mkt")
def t5(lake):
    return newest_first(lake.markets.select("market_id", "close_ts"), "close_ts", ["market_id"], 40)


@query("t7_latest_slice", "SELECT strategy, ts, token_id, signal FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY abs(signal) DESC, token_id) AS rn FROM (SELECT coalesce(category, '') AS strategy, ts, token_id, signal FROM sig WHERE ts = (SELECT max(ts) FROM sig))) WHERE rn <= 5", "sig", "signal")
def t7(lake):
    s = signal_of(lake).withColumn("strategy", F.col("category"))
    return latest_slice(s, "strategy", F.abs("signal"), ["token_id"], 5).select("strategy", "ts", "token_id", "signal")


@query("u1_union_all", "SELECT 'quote' AS kind, ts, token_id, mid, NULL::DOUBLE AS signal FROM yes UNION ALL SELECT 'signal', ts, token_id, NULL, signal FROM sig", "yes sig", "mid signal")
def u1(lake):
    a = yes_of(lake).select(F.lit("quote").alias("kind"), "ts", "token_id", "mid")
    b = signal_of(lake).select(F.lit("signal").alias("kind"), "ts", "token_id", "signal")
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_union_distinct", "SELECT market_id FROM trd UNION SELECT market_id FROM snap", "trd snap")
def u2(lake):
    return lake.trades.select("market_id").unionByName(lake.snapshots.select("market_id")).distinct()


@query("s16_price_scan", "SELECT s.snapshot_ts AS ts, s.token_id, s.market_id, m.category, s.mid, s.spread, s.bid_depth, s.ask_depth FROM snap s LEFT JOIN mkt m ON m.market_id = s.market_id WHERE s.mid IS NOT NULL", "snap mkt", "mid spread bid_depth ask_depth")
def s16(lake):
    return E.price_frame(lake.snapshots, lake.markets).select("ts", "token_id", "market_id", "category", "mid", "spread", "bid_depth", "ask_depth")


@query("j33_notional_by_category", "SELECT coalesce(m.category, 'unknown') AS category, sum(t.notional) AS notional, count(*) AS fills FROM trd t LEFT JOIN outc o ON o.token_id = t.token_id LEFT JOIN mkt m ON m.market_id = o.market_id GROUP BY 1", "trd outc mkt", "notional")
def j33(lake):
    from marketlab.operators.reports import notional_by_category

    return notional_by_category(lake.trades, lake.outcomes, lake.markets)
