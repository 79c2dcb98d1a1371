"""Signals, expected value, single-leg costing and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlab.catalog.base import yes_of
from marketlab.catalog.registry import CTES, memo, query
from marketlab.functions import direction as D
from marketlab.functions.columns import clip, lit
from marketlab.operators import costing as C, signals as S, summary as R
from marketlab.operators.config import CostConfig, regime_costs
from marketlab.session import materialise

CFG = CostConfig()
THRESHOLDS = (0.10, 0.15, 0.20, 0.25)
KEY = ["ts", "market_id", "token_id"]


def fixed(df):
    """Nine digits, so that thresholds and ranks fall alike in both engines."""
    return df.withColumns({"signal": F.round("signal", 9), "confidence": F.round("confidence", 9)})


def signal_of(lake):
    return memo(lake, "signal", lambda: fixed(S.momentum(yes_of(lake))))


def modelled(df):
    """Signal frame with model outputs of all target types, some missing."""
    t = F.col("token_id")
    return df.withColumns(
        {
            "model_target_type": F.when(t % 8 == 0, "FUTURE_MID").when(t % 8 == 2, "OUTCOME_PROB").when(t % 8 == 4, "UP_MOVE_PROB").otherwise(" return "),
            "model_pred_future_mid": F.when(t % 10 != 0, F.col("mid") + 0.5 * clip("velocity_1", -0.2, 0.2)),
            "model_pred_outcome_prob_yes": F.when(t % 14 != 0, 0.3 + 0.4 * F.col("mid")),
            "model_pred_up_move_proba": F.when(t % 6 != 0, 0.5 + 0.4 * F.col("signal")),
            "expected_move_size": F.when(t % 12 != 0, F.col("prob_vol_6") * F.col("mid")),
        }
    )


def trades_of(lake):
    return memo(lake, "trades", lambda: C.run_grid(signal_of(lake), CFG, THRESHOLDS))


def grid_trades(lake):
    """The trades for one pass: those written before, else computed with the columns the pass reads alone."""
    written = "trades" in lake.__dict__.get("_memo", {})
    return trades_of(lake) if written else C.run_grid(signal_of(lake), CFG, THRESHOLDS)


CTES["sig"] = """
SELECT * REPLACE (round(signal, 9) AS signal, round(confidence, 9) AS confidence) FROM (
SELECT *, tanh(raw_signal / 2) AS signal, greatest(0.05, least(1, 0.5 * least(1, abs(vz) / 3) + 0.5 / (1 + abs(prob_vol_24) * 30))) AS confidence FROM (
SELECT *, CASE WHEN time_to_resolution_h <= 72 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS regime_signal,
  (CASE WHEN time_to_resolution_h <= 72 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (0.7::DOUBLE * vz + 0.3::DOUBLE * az) AS raw_signal FROM (
SELECT y.*, (velocity_1 - (SELECT avg(velocity_1) FROM yes)) / ((SELECT stddev_pop(velocity_1) FROM yes) + 1e-9) AS vz,
  (acceleration - (SELECT avg(acceleration) FROM yes)) / ((SELECT stddev_pop(acceleration) FROM yes) + 1e-9) AS az FROM yes y)))"""
CTES["sigm"] = """
SELECT *, CASE token_id % 8 WHEN 0 THEN 'FUTURE_MID' WHEN 2 THEN 'OUTCOME_PROB' WHEN 4 THEN 'UP_MOVE_PROB' ELSE ' return ' END AS model_target_type,
  CASE WHEN token_id % 10 <> 0 THEN mid + 0.5::DOUBLE * greatest(-0.2, least(0.2, velocity_1)) END AS model_pred_future_mid,
  CASE WHEN token_id % 14 <> 0 THEN 0.3::DOUBLE + 0.4::DOUBLE * mid END AS model_pred_outcome_prob_yes,
  CASE WHEN token_id % 6 <> 0 THEN 0.5::DOUBLE + 0.4::DOUBLE * signal END AS model_pred_up_move_proba,
  CASE WHEN token_id % 12 <> 0 THEN prob_vol_6 * mid END AS expected_move_size FROM sig"""


def trades_sql(src: str, cells: list[dict], model: bool) -> str:
    """Plain statement of the costing model for the oracle."""
    d = "::DOUBLE"
    vals = ", ".join(
        f"({c['threshold']}{d}, {c['holding_period']}, '{c['execution_regime']}', {c['impact_coeff_input']}{d}, {c['impact_coeff']}{d}, {c['max_impact']}{d}, {c['vol_slippage_coeff']}{d}, {c['fill_alpha']}{d}, {c['fill_beta']}{d}, {c['fill_gamma']}{d})"
        for c in cells
    )
    tt = "CASE WHEN upper(trim(model_target_type)) = '' THEN 'FUTURE_MID' ELSE upper(trim(model_target_type)) END" if model else "'FUTURE_MID'"
    cl = lambda x: f"greatest(1e-6, least(1 - 1e-6, {x}))"
    outcome = f"{cl('coalesce(model_pred_outcome_prob_yes, my)')}" if model else f"{cl('my + greatest(-1, least(1, signal)) * (0.10::DOUBLE * least(my, 1 - my) * conf)')}"
    up = cl("coalesce(model_pred_up_move_proba, 0.5)") if model else cl("coalesce((greatest(-1, least(1, signal)) + 1) / 2, 0.5)")
    move = "greatest(1e-4, least(0.4, coalesce(expected_move_size, 0.01)))" if model else "greatest(1e-4, least(0.4, typical))"
    nxt = cl("coalesce(model_pred_future_mid, my)") if model else cl(f"my + greatest(-1, least(1, signal)) * ({move})")
    return f"""
SELECT *, expected_gross - expected_cost AS expected_ev, trade_return - (expected_gross - expected_cost) AS ev_gap FROM (
SELECT *, CASE tt WHEN 'OUTCOME_PROB' THEN eg_out WHEN 'FUTURE_MID' THEN eg_mid ELSE eg_up END AS expected_gross,
  fee_r + spread_r + impact_r + slip_r AS expected_cost FROM (
SELECT *, fees / greatest(notional, 1) AS fee_r, (0.5{d} * sp + 0.5{d} * fsp) / entry_price AS spread_r, 2 * impact / entry_price AS impact_r, 2 * slip / entry_price AS slip_r,
  ({cl('CASE WHEN is_yes THEN po ELSE 1 - po END')} - {cl('CASE WHEN is_yes THEN my ELSE 1 - my END')}) / entry_price AS eg_out,
  sgn * (pm - my) / entry_price AS eg_mid, sgn * (2 * pu - 1) * (mv / entry_price) AS eg_up FROM (
SELECT *, gross_pnl - fees AS net_pnl, gross_pnl / notional AS gross_return, (gross_pnl - fees) / notional AS trade_return, (xm - em) * qty / notional AS mid_return,
  sp2 * qty AS spread_component, 2 * impact * qty AS impact_component, 2 * slip * qty AS vol_slippage_component, entry_price - m AS realized_slippage,
  greatest(0, least(1, least(1, ln(1 + fl + 1) / ln(1 + target_notional + 1)) * exp(-bps / 250))) AS actual_fill_proxy,
  {tt} AS tt, {outcome} AS po, {up} AS pu, {nxt} AS pm, {move} AS mv FROM (
SELECT *, 0.5{d} * sp + 0.5{d} * fsp AS sp2, greatest(1.0{d}, entry_price * qty) AS notional, (exit_price - entry_price) * qty AS gross_pnl, 0.002{d} * (entry_price * qty + exit_price * qty) AS fees FROM (
SELECT *, target_notional / m * realized_fill_pct AS qty, least(0.999999, {cl('m')} + 0.5{d} * sp + impact + slip) AS entry_price, greatest(1e-6, {cl('fm')} - 0.5{d} * fsp - impact - slip) AS exit_price, {cl('m')} AS em, {cl('fm')} AS xm FROM (
SELECT *, least(max_impact, impact_coeff * size_ratio) AS impact, vol_slippage_coeff * abs(prob_vol_6) * (1 + size_ratio) AS slip,
  greatest(0, least(1, expected_fill_pct * least(1, greatest(1, holding_period) / (time_to_fill_h + 1e-6)))) AS realized_fill_pct FROM (
SELECT *, 1 / (1 + exp(-greatest(-30, least(30, fill_alpha - 2.5{d} * size_ratio - fill_beta * (bps / 150) + fill_gamma * ln(1 + fl / (target_notional + 1)))))) AS expected_fill_pct,
  greatest(0.05{d}, least(0.95{d}, 1 - conf)) / (ln(1 + fl + 1) / (dp + 1) + 1e-6) AS time_to_fill_h FROM (
SELECT *, target_notional / (dp * m + 1e-9) AS size_ratio FROM (
SELECT *, greatest(1.0{d}, least(250.0{d} * conf, 0.15{d} * dp * m)) AS target_notional FROM (
SELECT *, {cl('CASE WHEN is_yes THEN my ELSE 1 - my END')} AS m, {cl('CASE WHEN is_yes THEN fy ELSE 1 - fy END')} AS fm, avg(abs(fy - my)) OVER (PARTITION BY threshold, holding_period, execution_regime, impact_coeff_input) AS typical FROM (
SELECT s.*, g.*, signal > 0 AS is_yes, CASE WHEN signal > 0 THEN 1.0{d} ELSE -1.0{d} END AS sgn, {cl('mid')} AS my,
  {cl('CASE holding_period WHEN 1 THEN future_mid_1 WHEN 3 THEN future_mid_3 WHEN 6 THEN future_mid_6 ELSE future_mid_12 END')} AS fy,
  greatest(0, coalesce(CASE holding_period WHEN 1 THEN future_spread_1 WHEN 3 THEN future_spread_3 WHEN 6 THEN future_spread_6 ELSE future_spread_12 END, 0)) AS fsp,
  greatest(0.05{d}, least(1, confidence)) AS conf, greatest(1, depth_total) AS dp, greatest(0, spread) AS sp, greatest(0, spread_bps) AS bps, greatest(0, trade_notional_h) AS fl
FROM {src} s JOIN (VALUES {vals}) AS g(threshold, holding_period, execution_regime, impact_coeff_input, impact_coeff, max_impact, vol_slippage_coeff, fill_alpha, fill_beta, fill_gamma)
  ON abs(signal) > g.threshold AND CASE holding_period WHEN 1 THEN future_mid_1 WHEN 3 THEN future_mid_3 WHEN 6 THEN future_mid_6 ELSE future_mid_12 END IS NOT NULL
WHERE book_tradable > 0 AND best_bid IS NOT NULL AND best_ask IS NOT NULL AND ((mid < 0.99 AND mid > 0.01) OR depth_total >= 50)
)))))))))))"""


CTES["tr"] = trades_sql("sig", C.grid_of(CFG, THRESHOLDS), False)
SHORT = CostConfig(holding_periods=(1, 3))
CTES["trm"] = trades_sql("sigm", C.grid_of(SHORT, (0.1,)), True)
REG = CostConfig(holding_periods=(3,))
IMPACTS = (0.03, 0.05, 0.08, 0.10, 0.15, 0.20)
CTES["trr"] = trades_sql("sig", C.grid_of(REG, (0.15,), ("optimistic", "base", "pessimistic")), False)
CTES["tri"] = trades_sql("sig", C.grid_of(REG, (0.15,), ("base",), IMPACTS), False)

TK = ["ts", "token_id", "threshold", "holding_period"]


# ------------------------------------------------------------- direction


@query("p2_direction", "SELECT ts, token_id, CASE WHEN signal > 0.15 THEN 'LONG_YES' WHEN signal < -0.15 THEN 'LONG_NO' ELSE 'FLAT' END AS direction, CASE WHEN signal > 0.15 THEN 1.0::DOUBLE WHEN signal < -0.15 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS direction_sign, CASE WHEN signal > 0.15 THEN 'YES' WHEN signal < -0.15 THEN 'NO' ELSE 'NONE' END AS traded_side FROM sig", "sig", "direction_sign")
def p2(lake):
    lab = D.label("signal", 0.15)
    return signal_of(lake).select("ts", "token_id", lab.alias("direction"), D.sign_of(lab).alias("direction_sign"), D.side_of(lab).alias("traded_side"))


_SPACE = "CASE upper(trim({0})) WHEN 'OUTCOME_PROB' THEN 'OUTCOME_PROB_YES' WHEN 'OUTCOME_PROB_YES' THEN 'OUTCOME_PROB_YES' WHEN 'FUTURE_MID' THEN 'FUTURE_MID_YES' WHEN 'FUTURE_MID_YES' THEN 'FUTURE_MID_YES' WHEN 'RETURN_NEXT_H' THEN 'RETURN_NEXT_H' WHEN 'RETURN' THEN 'RETURN_NEXT_H' WHEN 'UP_MOVE_PROB' THEN 'UP_MOVE_PROB' ELSE 'FUTURE_MID_YES' END"


@query("p3_prediction_space", f"SELECT ts, token_id, {_SPACE.format('model_target_type')} AS prediction_space FROM sigm", "sigm")
def p3(lake):
    return modelled(signal_of(lake)).select("ts", "token_id", D.prediction_space("model_target_type").alias("prediction_space"))


@query("p4_contract", f"SELECT ts, token_id, CASE WHEN signal > 0 THEN 'LONG_YES' WHEN signal < 0 THEN 'LONG_NO' ELSE 'FLAT' END AS direction, CASE WHEN signal > 0 THEN 'YES' WHEN signal < 0 THEN 'NO' ELSE 'NONE' END AS traded_side, {_SPACE.format('model_target_type')} AS prediction_space, 2.0::DOUBLE AS horizon, 2.0::DOUBLE AS horizon_steps, 7200.0::DOUBLE AS horizon_seconds, expected_move_size AS expected_return, coalesce(expected_move_size, 0) AS expected_net_return FROM (SELECT * REPLACE (coalesce(expected_move_size, 0) AS expected_move_size) FROM sigm)", "sigm", "horizon horizon_steps horizon_seconds expected_return expected_net_return")
def p4(lake):
    df = modelled(signal_of(lake)).select("ts", "token_id", "signal", "model_target_type", F.col("expected_move_size").alias("ev"))
    out = D.attach_contract(df, 2.0, "ev")
    return out.drop("signal", "model_target_type", "ev")


@query("p5_contract_check", "SELECT false AS valid, 'invalid_direction_values;expected_return_non_numeric' AS issues FROM (SELECT count(*) FILTER (WHERE token_id % 10 = 4) AS b, count(*) FILTER (WHERE token_id % 12 = 0) AS m FROM sig) WHERE b > 0 AND m > 0", "sig")
def p5(lake):
    df = D.attach_contract(modelled(signal_of(lake)))
    df = df.withColumns({"direction": F.when(F.col("token_id") % 10 == 4, "UP").otherwise(F.col("direction")), "expected_net_return": F.col("expected_move_size")})
    return D.check_contract(df, True)


@query("p6_unit_check", "SELECT abs(r) BETWEEN 1e-3 AND 1e3 AS comparable, r AS p95_ratio FROM (SELECT quantile_cont(abs(expected_ev), 0.95) / greatest(quantile_cont(abs(trade_return), 0.95), 1e-9) AS r FROM tr)", "tr", "p95_ratio")
def p6(lake):
    from marketlab.operators.diagnostics import units_comparable

    return units_comparable(trades_of(lake), "expected_ev", "trade_return")


@query("p7_side_labels", "SELECT trade_id, token_id, trader, trade_ts, CASE WHEN side = 'BUY' THEN 'LONG_YES' ELSE 'LONG_NO' END AS from_sign, CASE WHEN token_id % 3 = 0 THEN 'LONG_YES' WHEN token_id % 3 = 1 THEN 'LONG_NO' ELSE 'FLAT' END AS from_text, count(*) AS n FROM trd GROUP BY ALL", "trd")
def p7(lake):
    t = lake.trades
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-2)
    text = F.when(F.col("token_id") % 3 == 0, " yes").when(F.col("token_id") % 3 == 1, "LONG_NO ").otherwise("maybe")
    return t.groupBy("trade_id", "token_id", "trader", "trade_ts", D.normal_side(sign, True).alias("from_sign"), D.normal_side(text, False).alias("from_text")).agg(F.count(F.lit(1)).alias("n"))


_P8 = "entry_mid exit_mid entry_price exit_price notional gross_pnl fees net_pnl gross_return mid_return trade_return"


@query(
    "p8_trade_return",
    """SELECT ts, token_id, em AS entry_mid, xm AS exit_mid, ep AS entry_price, xp AS exit_price, no AS notional, gp AS gross_pnl, fe AS fees, gp - fe AS net_pnl, gp / no AS gross_return, (xm - em) * q / no AS mid_return, (gp - fe) / no AS trade_return FROM (
SELECT *, (xp - ep) * q AS gp, 0.002::DOUBLE * (ep * q + xp * q) AS fe, greatest(1e-9, ep * q) AS no FROM (
SELECT *, greatest(1e-6, least(0.999999, em + spread / 2 + 0.01 + 0.1::DOUBLE * prob_vol_6)) AS ep, greatest(1e-6, least(0.999999, xm - future_spread_1 / 2 - 0.01 - 0.1::DOUBLE * prob_vol_6)) AS xp FROM (
SELECT *, greatest(1e-6, least(1 - 1e-6, CASE WHEN signal > 0 THEN mid ELSE 1 - mid END)) AS em, greatest(1e-6, least(1 - 1e-6, CASE WHEN signal > 0 THEN future_mid_1 ELSE 1 - future_mid_1 END)) AS xm, depth_total / 100 AS q FROM sig WHERE signal <> 0 AND future_mid_1 IS NOT NULL)))""",
    "sig",
    _P8,
)
def p8(lake):
    s = signal_of(lake).where("signal <> 0 AND future_mid_1 IS NOT NULL")
    drift = 0.1 * F.col("prob_vol_6")
    t = C.trade_return(F.col("mid"), F.col("future_mid_1"), D.label("signal"), lit(0.002), F.col("depth_total") / 100, (F.col("spread") / 2, F.col("future_spread_1") / 2), (lit(0.01), lit(0.01)), (drift, drift))
    return s.select("ts", "token_id", *[t[c].alias(c) for c in _P8.split()])


_P9 = "impact_coeff max_impact vol_slippage_coeff fill_alpha fill_beta fill_gamma"


@query(
    "p9_regime_costs",
    "SELECT g.*, least(g.max_impact, g.impact_coeff * s.load) AS impact_at_mean FROM (SELECT avg(250 / (depth_total * mid + 1e-9)) AS load FROM sig) s CROSS JOIN (VALUES ('optimistic', 0.07::DOUBLE, 0.035::DOUBLE, 0.15::DOUBLE, 2.1::DOUBLE, 1.4::DOUBLE, 0.96::DOUBLE), ('base', 0.1, 0.05, 0.25, 1.5, 2.0, 0.8), ('pessimistic', 0.14, 0.07, 0.375, 0.9, 2.8, 0.56)) AS g(execution_regime, impact_coeff, max_impact, vol_slippage_coeff, fill_alpha, fill_beta, fill_gamma)",
    "sig",
    _P9 + " impact_at_mean",
)
def p9(lake):
    rows = [F.struct(F.lit(r).alias("execution_regime"), *[lit(v).alias(k) for k, v in regime_costs(CFG, r).items()]) for r in ("optimistic", "base", "pessimistic")]
    load = signal_of(lake).agg(F.avg(250.0 / (F.col("depth_total") * F.col("mid") + 1e-9)).alias("load"))
    return load.select("load", F.inline(F.array(*rows))).withColumn("impact_at_mean", F.least("max_impact", F.col("impact_coeff") * F.col("load"))).drop("load")


@query("p10_local_shift", "SELECT ts, token_id, greatest(1e-6, least(1 - 1e-6, mid + signal * (0.10::DOUBLE * least(mid, 1 - mid) * confidence))) AS model_prob FROM sig", "sig", "model_prob")
def p10(lake):
    return signal_of(lake).select("ts", "token_id", C.local_shift(F.col("mid"), F.col("signal"), F.col("confidence")).alias("model_prob"))


@query("p11_model_probability", "SELECT ts, token_id, mid + 0.25::DOUBLE * confidence * (coalesce(model_pred_outcome_prob_yes, mid) - mid) AS model_prob FROM sigm", "sigm", "model_prob")
def p11(lake):
    df = modelled(signal_of(lake))
    return df.select("ts", "token_id", C.model_probability(df).alias("model_prob"))


@query("p12_admission", "SELECT ts, token_id, signal, threshold, holding_period FROM (SELECT ts, token_id, signal, threshold, CAST(holding_period AS BIGINT) AS holding_period FROM tr)", "tr", "signal threshold")
def p12(lake):
    return C.explode_grid(C.admitted(signal_of(lake)), C.grid_of(CFG, THRESHOLDS)).select("ts", "token_id", "signal", "threshold", "holding_period")


def _cell(cols):
    return f"SELECT ts, token_id, threshold, CAST(holding_period AS BIGINT) AS holding_period, {', '.join(cols.split())} FROM tr"


_P13 = "target_notional expected_fill_pct time_to_fill_h realized_fill_pct"


@query("p13_size_and_fill", _cell(_P13), "tr", "threshold " + _P13)
def p13(lake):
    t = C.size_and_fill(C.explode_grid(C.admitted(signal_of(lake)), C.grid_of(CFG, THRESHOLDS)), CFG)
    return t.select(*TK, *_P13.split())


_P14 = "entry_price exit_price notional gross_pnl fees spread_component impact_component vol_slippage_component net_pnl trade_return gross_return mid_return actual_fill_proxy realized_slippage"


@query("p14_execution_costs", _cell(_P14), "tr", "threshold " + _P14)
def p14(lake):
    t = C.size_and_fill(C.explode_grid(C.admitted(signal_of(lake)), C.grid_of(CFG, THRESHOLDS)), CFG)
    return C.execution_costs(t, CFG).select(*TK, *_P14.split())


_P15 = "expected_gross expected_cost expected_ev ev_gap"


@query("p15_expected_ev", f"SELECT ts, token_id, threshold, CAST(holding_period AS BIGINT) AS holding_period, {', '.join(_P15.split())} FROM trm", "trm", "threshold " + _P15)
def p15(lake):
    return C.run_grid(modelled(signal_of(lake)), SHORT, (0.1,)).select(*TK, *_P15.split())


_P16 = "signal confidence mid target_notional notional expected_fill_pct realized_fill_pct actual_fill_proxy entry_price exit_price gross_pnl fees net_pnl trade_return expected_ev ev_gap"


@query("p16_trade_rows", f"SELECT ts, token_id, market_id, category, threshold, CAST(holding_period AS BIGINT) AS holding_period, execution_regime, CASE WHEN is_yes THEN 'LONG_YES' ELSE 'LONG_NO' END AS direction, CASE WHEN is_yes THEN 'YES' ELSE 'NO' END AS traded_side, CASE WHEN is_yes THEN 'long_yes' ELSE 'long_no' END AS position_type, 'FUTURE_MID_YES' AS prediction_space, holding_period * 3600.0::DOUBLE AS horizon_seconds, {', '.join(_P16.split())} FROM tr", "tr", "threshold horizon_seconds " + _P16)
def p16(lake):
    return trades_of(lake).select(*TK, "market_id", "category", "execution_regime", "direction", "traded_side", "position_type", "prediction_space", "horizon_seconds", *_P16.split())


_COST = """
SELECT *, 0.004::DOUBLE AS fee_r, (0.5::DOUBLE * spread + 0.5::DOUBLE * fs) / e AS spread_r, 2 * least(0.05::DOUBLE, 0.1::DOUBLE * ld) / e AS impact_r, 2 * 0.25::DOUBLE * prob_vol_6 * (1 + ld) / e AS slip_r FROM (
SELECT *, tn / (greatest(depth_total, 1) * e + 1e-9) AS ld FROM (
SELECT *, greatest(1.0::DOUBLE, least(250 * confidence, 0.15::DOUBLE * greatest(depth_total, 1) * e)) AS tn FROM (
SELECT *, greatest(1e-6, least(1 - 1e-6, CASE WHEN signal > 0 THEN mid ELSE 1 - mid END)) AS e, coalesce(future_spread_1, spread) AS fs FROM sigm)))"""
CTES["cost0"] = _COST
_P17 = "entry_price target_notional expected_fee_return expected_spread_cost_return expected_impact_return expected_vol_slippage_return expected_cost_return"


@query("p17_expected_costs", "SELECT ts, token_id, e AS entry_price, tn AS target_notional, fee_r AS expected_fee_return, spread_r AS expected_spread_cost_return, impact_r AS expected_impact_return, slip_r AS expected_vol_slippage_return, fee_r + spread_r + impact_r + slip_r AS expected_cost_return FROM cost0", "cost0", _P17)
def p17(lake):
    df = signal_of(lake)
    c = C.expected_costs(df, CFG)
    return df.select("ts", "token_id", *[c[k].alias(k) for k in _P17.split()])


CTES["ev0"] = f"""
SELECT *, CASE prediction_space WHEN 'OUTCOME_PROB_YES' THEN g_out WHEN 'UP_MOVE_PROB' THEN g_up ELSE g_mid END AS g, fee_r + spread_r + impact_r + slip_r AS cst FROM (
SELECT *, {_SPACE.format('model_target_type')} AS prediction_space,
  (CASE WHEN signal > 0 THEN po ELSE 1 - po END - CASE WHEN signal > 0 THEN mid ELSE 1 - mid END) / e AS g_out,
  sgn * (pm - mid) / e AS g_mid, sgn * (2 * pu - 1) * (mv / e) AS g_up FROM (
SELECT *, greatest(1e-6, least(1 - 1e-6, coalesce(model_pred_outcome_prob_yes, mid))) AS po, greatest(1e-6, least(1 - 1e-6, coalesce(model_pred_future_mid, mid))) AS pm,
  greatest(1e-6, least(1 - 1e-6, coalesce(model_pred_up_move_proba, 0.5))) AS pu, greatest(1e-4, least(0.4, coalesce(expected_move_size, 0.01))) AS mv,
  CASE WHEN signal > 0 THEN 1.0::DOUBLE WHEN signal < 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS sgn FROM cost0))"""
_P18 = "expected_gross_outcome_return expected_gross_future_mid_return expected_gross_up_move_return expected_gross_return_next_h expected_gross_return expected_cost_return expected_net_return"


@query("p18_expected_value", "SELECT ts, token_id, prediction_space, g_out AS expected_gross_outcome_return, g_mid AS expected_gross_future_mid_return, g_up AS expected_gross_up_move_return, g_mid AS expected_gross_return_next_h, g AS expected_gross_return, cst AS expected_cost_return, g - cst AS expected_net_return FROM ev0", "ev0", _P18)
def p18(lake):
    return C.expected_value(modelled(signal_of(lake)), CFG).select("ts", "token_id", "prediction_space", *_P18.split())


_P19 = "expected_edge expected_cost expected_net_ev expected_fees expected_slippage_cost model_prob_dir market_prob_dir expected_payoff"


@query("p19_strategy_value", "SELECT ts, token_id, CASE WHEN signal > 0 THEN 'long_yes' WHEN signal < 0 THEN 'long_no' ELSE 'flat' END AS position_type, g AS expected_edge, cst AS expected_cost, g - cst AS expected_net_ev, fee_r AS expected_fees, slip_r AS expected_slippage_cost, CASE WHEN signal > 0 THEN po ELSE 1 - po END AS model_prob_dir, CASE WHEN signal > 0 THEN mid ELSE 1 - mid END AS market_prob_dir, 1.0::DOUBLE AS expected_payoff FROM ev0", "ev0", _P19)
def p19(lake):
    return C.strategy_value(modelled(signal_of(lake)), CFG).select("ts", "token_id", "position_type", *_P19.split())


# ------------------------------------------------------------- summaries

_SUMM = (
    "trade_count win_rate expectancy expectancy_per_trade total_pnl sharpe max_drawdown drawdown_duration ret_p10 ret_p50 ret_p90 avg_expected_fill_pct avg_realized_fill_pct avg_actual_fill_proxy avg_fill_calibration_error "
    "avg_time_to_fill_h avg_realized_slippage_bps avg_gross_return avg_expected_ev avg_ev_gap ev_hit_rate gross_pnl_total fees_total spread_cost_total impact_cost_total vol_slippage_cost_total observed_cost_bps breakeven_cost_bps "
    "mid_cost_bps return_per_day return_per_event n_days n_events"
)


def summary_sql(src: str, paired: bool = False) -> str:
    k = "threshold, holding_period, execution_regime, impact_coeff_input"
    slip = "avg(spread_component / greatest(notional, 1)) * 10000" if paired else "avg(abs(realized_slippage) * 10000)"
    extra = "avg(fully_hedged) AS hedged_fill_rate, sum(fully_hedged) AS fully_hedged_trade_count, avg(realized_pair_fill_pct) AS avg_pair_fill_pct, avg(expected_pair_fill) AS avg_expected_pair_fill" if paired else "avg(mid_return - trade_return) * 10000 AS mid_cost_bps"
    return f"""
SELECT b.*, e.sharpe, e.max_drawdown, coalesce(l.drawdown_duration, 0) AS drawdown_duration, d.return_per_day, d.n_days, v.return_per_event, v.n_events FROM (
SELECT {k}, count(*)::DOUBLE AS trade_count, avg((trade_return > 0)::INT) AS win_rate, avg(trade_return) AS expectancy, avg(trade_return) AS expectancy_per_trade, sum(net_pnl) AS total_pnl,
 quantile_cont(trade_return, 0.1) AS ret_p10, quantile_cont(trade_return, 0.5) AS ret_p50, quantile_cont(trade_return, 0.9) AS ret_p90,
 avg(expected_fill_pct) AS avg_expected_fill_pct, avg(realized_fill_pct) AS avg_realized_fill_pct, avg(actual_fill_proxy) AS avg_actual_fill_proxy, avg(expected_fill_pct - actual_fill_proxy) AS avg_fill_calibration_error,
 avg(time_to_fill_h) AS avg_time_to_fill_h, {slip} AS avg_realized_slippage_bps, avg(gross_return) AS avg_gross_return, avg(expected_ev) AS avg_expected_ev, avg(ev_gap) AS avg_ev_gap,
 coalesce(avg((trade_return > 0)::INT) FILTER (WHERE expected_ev > 0), 0) AS ev_hit_rate, sum(gross_pnl) AS gross_pnl_total, sum(fees) AS fees_total, sum(spread_component) AS spread_cost_total, sum(impact_component) AS impact_cost_total,
 sum(vol_slippage_component) AS vol_slippage_cost_total, avg(gross_return - trade_return) * 10000 AS observed_cost_bps, greatest(0, avg(gross_return)) * 10000 AS breakeven_cost_bps, {extra}
FROM {src} GROUP BY {k}) b
JOIN (SELECT {k}, CASE WHEN count(*) >= 3 AND stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(8760) ELSE 0 END AS sharpe, min(equity / peak - 1) AS max_drawdown FROM {src}_eq GROUP BY {k}) e USING ({k})
LEFT JOIN (SELECT {k}, max(c)::DOUBLE AS drawdown_duration FROM (SELECT {k}, isle, count(*) FILTER (WHERE equity < peak) AS c FROM (SELECT *, sum((equity >= peak)::INT) OVER (PARTITION BY {k} ORDER BY ts) AS isle FROM {src}_eq) GROUP BY {k}, isle) GROUP BY {k}) l USING ({k})
JOIN (SELECT {k}, avg(p) AS return_per_day, count(*)::DOUBLE AS n_days FROM (SELECT {k}, date_trunc('day', ts) AS dy, sum(net_pnl) / 100000 AS p FROM {src} GROUP BY {k}, dy) GROUP BY {k}) d USING ({k})
JOIN (SELECT {k}, avg(p) AS return_per_event, count(*)::DOUBLE AS n_events FROM (SELECT {k}, market_id, sum(net_pnl) / 100000 AS p FROM {src} GROUP BY {k}, market_id) GROUP BY {k}) v USING ({k})"""


def equity_sql(src: str) -> str:
    k = "threshold, holding_period, execution_regime, impact_coeff_input"
    return f"""
SELECT *, max(equity) OVER (PARTITION BY {k} ORDER BY ts) AS peak, CASE WHEN row_number() OVER (PARTITION BY {k} ORDER BY ts) = 1 THEN 0 ELSE p / 100000 END AS r FROM (
SELECT {k}, ts, p, 100000 + sum(p) OVER (PARTITION BY {k} ORDER BY ts) AS equity FROM (SELECT {k}, ts, sum(net_pnl) AS p FROM {src} GROUP BY {k}, ts))"""


for _s in ("tr", "trr", "tri"):
    CTES[f"{_s}_eq"] = equity_sql(_s)
    CTES[f"{_s}_sum"] = summary_sql(_s)

_CELL = "threshold, CAST(holding_period AS BIGINT) AS holding_period, execution_regime, impact_coeff_input"


@query("a10_trade_summary", f"SELECT {_CELL}, {', '.join(_SUMM.split())} FROM tr_sum", "tr_sum", "threshold impact_coeff_input " + _SUMM)
def a10(lake):
    return R.trade_summary(trades_of(lake)).select(*R.CELL, *_SUMM.split())


_A12 = "trade_count win_rate expectancy sharpe total_pnl ret_p50"


@query("a12_parameter_grid", f"SELECT g.threshold, CAST(g.holding_period AS BIGINT) AS holding_period, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _A12.split()) + " FROM (SELECT unnest([0.10::DOUBLE, 0.15, 0.20, 0.25]) AS threshold, h AS holding_period FROM (SELECT unnest([1, 3, 6, 12]) AS h)) g LEFT JOIN tr_sum s ON s.threshold = g.threshold AND s.holding_period = g.holding_period", "tr_sum", "threshold " + _A12)
def a12(lake):
    cells = C.grid_of(CFG, THRESHOLDS)
    t = materialise(C.run_grid(signal_of(lake), CFG, THRESHOLDS))
    return R.full_grid(R.trade_summary(t), cells).select("threshold", "holding_period", *_A12.split())


_A13 = "trade_count expectancy sharpe total_pnl avg_expected_ev observed_cost_bps breakeven_cost_bps"


@query("a13_regime_sensitivity", f"SELECT 'execution_regime' AS analysis_type, execution_regime, impact_coeff_input, breakeven_cost_bps - observed_cost_bps AS cost_headroom_bps, {', '.join(_A13.split())} FROM trr_sum", "trr_sum", "impact_coeff_input cost_headroom_bps " + _A13)
def a13(lake):
    t = materialise(C.run_grid(signal_of(lake), REG, (0.15,), ("optimistic", "base", "pessimistic")))
    return R.sensitivity(R.trade_summary(t), "execution_regime").select("analysis_type", "execution_regime", "impact_coeff_input", "cost_headroom_bps", *_A13.split())


@query("a13_impact_sensitivity", f"SELECT 'impact_coeff_grid' AS analysis_type, execution_regime, impact_coeff_input, breakeven_cost_bps - observed_cost_bps AS cost_headroom_bps, {', '.join(_A13.split())} FROM tri_sum", "tri_sum", "impact_coeff_input cost_headroom_bps " + _A13)
def a13b(lake):
    t = materialise(C.run_grid(signal_of(lake), REG, (0.15,), ("base",), IMPACTS))
    return R.sensitivity(R.trade_summary(t), "impact_coeff_grid").select("analysis_type", "execution_regime", "impact_coeff_input", "cost_headroom_bps", *_A13.split())


def binned_sql(src: str, value: str, bins: str, tie: str, where: str = "true", part: str = "", fallback_one: bool = False) -> str:
    p = f"PARTITION BY {part} " if part else ""
    po = f"PARTITION BY {part}" if part else ""
    return f"SELECT *, greatest(0, CAST(ceil((rn_ - 1) * {bins} / greatest(n_ - 1, 1)::DOUBLE) AS BIGINT) - 1) AS bin FROM (SELECT *, row_number() OVER ({p}ORDER BY round({value}, 9), {tie}) AS rn_, count(*) OVER ({po}) AS n_ FROM {src} WHERE {where})"


@query("a14_fill_calibration", f"SELECT execution_regime, bin::DOUBLE AS fill_bin, count(*)::DOUBLE AS n, avg(expected_fill_pct) AS avg_expected_fill_pct, avg(actual_fill_proxy) AS avg_actual_fill_proxy, avg(expected_fill_pct - actual_fill_proxy) AS fill_gap FROM ({binned_sql('trr', 'expected_fill_pct', '10', 'ts, token_id', part='execution_regime')}) GROUP BY 1, 2", "trr", "fill_bin n avg_expected_fill_pct avg_actual_fill_proxy fill_gap")
def a14(lake):
    t = C.run_grid(signal_of(lake), REG, (0.15,), ("optimistic", "base", "pessimistic"))
    return R.fill_calibration(t, keys=["execution_regime"])


_A19 = "gross_pnl fees spread_cost vol_slippage impact_cost unwind_cost net_pnl trade_count"


@query("a19_cost_decomposition", "SELECT threshold, CAST(holding_period AS BIGINT) AS holding_period, sum(gross_pnl) AS gross_pnl, sum(fees) AS fees, sum(spread_component) AS spread_cost, sum(vol_slippage_component) AS vol_slippage, sum(impact_component) AS impact_cost, 0.0::DOUBLE AS unwind_cost, sum(net_pnl) AS net_pnl, count(*)::DOUBLE AS trade_count FROM tr GROUP BY 1, 2", "tr", "threshold " + _A19)
def a19(lake):
    return R.cost_decomposition(trades_of(lake), ["threshold", "holding_period"])


_EVAL = "threshold = 0.15 AND holding_period = 3"
CTES["ev_tr"] = f"SELECT * FROM tr WHERE {_EVAL}"


def chosen_of(lake):
    return trades_of(lake).where(_EVAL)


@query("a20_capacity", "SELECT (SELECT median(p) FROM (SELECT sum(notional) AS p FROM ev_tr GROUP BY date_trunc('day', ts))) AS estimated_daily_capacity_usd, median(0.15::DOUBLE * (greatest(depth_total, 1) * greatest(mid, 1e-4))) AS median_trade_capacity_usd, count(DISTINCT market_id)::DOUBLE AS active_markets, avg(0.1::DOUBLE * notional / (greatest(depth_total, 1) * greatest(mid, 1e-4)) * 10000) AS avg_impact_bps FROM ev_tr", "ev_tr", "estimated_daily_capacity_usd median_trade_capacity_usd active_markets avg_impact_bps")
def a20(lake):
    return R.capacity(chosen_of(lake))


CTES["proxy0"] = "SELECT *, (x - en) / en AS proxy FROM (SELECT *, g - cst AS expected_net_ev, greatest(1e-6, CASE WHEN sgn >= 0 THEN mid ELSE 1 - mid END) AS en, greatest(1e-6, CASE WHEN future_mid_1 IS NULL THEN NULL WHEN sgn >= 0 THEN future_mid_1 ELSE 1 - future_mid_1 END) AS x0, CASE WHEN future_mid_1 IS NULL THEN NULL ELSE greatest(1e-6, CASE WHEN sgn >= 0 THEN future_mid_1 ELSE 1 - future_mid_1 END) END AS x FROM ev0)"
_A21 = "ev_threshold rows avg_expected_net_ev proxy_expectancy proxy_sharpe"
GRID = (0.0, 0.001, 0.002, 0.005)


def ev_grid_sql(src: str, sharpe: str) -> str:
    return f"SELECT 'train' AS split, g.ev_threshold, count(expected_net_ev)::DOUBLE AS rows, coalesce(avg(expected_net_ev), 0) AS avg_expected_net_ev, coalesce(avg(proxy), 0) AS proxy_expectancy, {sharpe} AS proxy_sharpe FROM (SELECT unnest([0.0::DOUBLE, 0.001, 0.002, 0.005]) AS ev_threshold) g LEFT JOIN {src} p ON p.expected_net_ev >= g.ev_threshold GROUP BY 2"


@query("a21_ev_threshold_grid", ev_grid_sql("proxy0", "CASE WHEN count(proxy) >= 3 AND stddev_pop(proxy) > 0 THEN avg(proxy) / stddev_pop(proxy) * sqrt(8760) ELSE 0 END"), "proxy0", _A21)
def a21(lake):
    return R.ev_threshold_grid(C.strategy_value(modelled(signal_of(lake)), CFG), GRID, "train")


_W12 = "pnl cum_pnl equity peak drawdown"


@query("w12_equity_curve", "SELECT ts, threshold, CAST(holding_period AS BIGINT) AS holding_period, p AS pnl, equity - 100000 AS cum_pnl, equity, peak, equity / peak - 1 AS drawdown FROM tr_eq", "tr_eq", "threshold " + _W12)
def w12(lake):
    return R.equity_curve(trades_of(lake), keys=["threshold", "holding_period"]).select("ts", "threshold", "holding_period", *_W12.split())


@query("w13_equal_count_bins", f"SELECT ts, token_id, bin FROM ({binned_sql('sig', 'liquidity_log', '10', 'ts, token_id')})", "sig")
def w13(lake):
    from marketlab.operators.ranking import bin_rows

    return bin_rows(signal_of(lake), "liquidity_log", 10, ["ts", "token_id"]).select("ts", "token_id", "bin")


@query("w14_longest_below_peak", "SELECT threshold, CAST(holding_period AS BIGINT) AS holding_period, drawdown_duration FROM tr_sum", "tr_sum", "threshold drawdown_duration")
def w14(lake):
    k = ["threshold", "holding_period"]
    return R.below_peak_runs(R.equity_curve(trades_of(lake), keys=k), k)


@query("w15_period_returns", "SELECT ts, threshold, CAST(holding_period AS BIGINT) AS holding_period, r AS step_return, equity / lag(equity) OVER (PARTITION BY threshold, holding_period ORDER BY ts) - 1 AS pct_return FROM tr_eq", "tr_eq", "threshold step_return pct_return")
def w15(lake):
    from marketlab.operators.returns import period_returns

    return period_returns(R.equity_curve(trades_of(lake), keys=["threshold", "holding_period"]), ["threshold", "holding_period"])


@query("w17_best_cell", "SELECT threshold, CAST(holding_period AS BIGINT) AS holding_period, expectancy, trade_count FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN trade_count >= 20 THEN 0 WHEN trade_count > 0 THEN 1 ELSE 2 END, round(expectancy * sqrt(trade_count), 12) DESC, threshold, holding_period) AS rn FROM tr_sum) WHERE rn = 1", "tr_sum", "threshold expectancy trade_count")
def w17(lake):
    return R.best_row(R.trade_summary(trades_of(lake)), 20).select("threshold", "holding_period", "expectancy", "trade_count")
