"""Expected value, execution costs and trades of single-leg signals.

Every step is a column expression over the signal frame. Grids of thresholds,
holding periods and cost regimes are exploded from a literal array, so a grid
of any size is one pass over the signals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions import direction as D
from marketlab.functions.columns import HIGH, LOW, clip, col, flag, has, lit, logistic, number, optional, ratio
from marketlab.operators.config import CostConfig, regime_costs


def prob(x: Column) -> Column:
    return clip(x, LOW, HIGH)


def any_value(df: DataFrame, name: str) -> Column:
    """Does the column exist and hold any number, over the whole frame?"""
    if name not in df.columns:
        return F.lit(False)
    return F.coalesce(df.agg(F.bool_or(number(name).isNotNull()).alias("v")).scalar(), F.lit(False))


def first_present(df: DataFrame, choices: Sequence[tuple[str, Column]], otherwise: Column) -> Column:
    """The expression of the first column that holds any number."""
    out = otherwise
    for name, expr in reversed(list(choices)):
        if name in df.columns:
            out = F.when(any_value(df, name), expr).otherwise(out)
    return out


def local_shift(mid: Column, signal: Column, confidence: Column) -> Column:
    """A signal as a bounded move of the market probability."""
    return prob(mid + clip(signal, -1.0, 1.0) * (0.10 * F.least(mid, 1.0 - mid) * confidence))


def trade_return(
    entry: Column,
    exit_: Column,
    side: Column,
    fee_rate: Column,
    qty: Column,
    spread: tuple[Column, Column],
    impact: tuple[Column, Column],
    vol: tuple[Column, Column],
    extra: Column | None = None,
    yes_mids: bool = True,
    min_notional: float = 1e-9,
) -> dict[str, Column]:
    """Executable prices, pnl components and returns of one trade."""
    long_yes, long_no = side == D.LONG_YES, side == D.LONG_NO
    own = lambda p: F.when(long_yes, p).when(long_no, 1.0 - p) if yes_mids else p
    nn = lambda c: clip(F.coalesce(c, lit(0)), 0.0)
    e_mid, x_mid = prob(own(entry)), prob(own(exit_))
    (es, xs), (ei, xi), (ev, xv) = [(nn(a), nn(b)) for a, b in (spread, impact, vol)]
    q = clip(F.coalesce(qty, lit(1)), 0.0)
    e_px = clip(e_mid + es + ei + ev, LOW, 0.999999)
    x_px = clip(x_mid - xs - xi - xv, LOW, 0.999999)
    gross = (x_px - e_px) * q
    fees = fee_rate * (e_px * q + x_px * q)
    net = gross - fees - (nn(extra) if extra is not None else lit(0))
    notional = clip(e_px * q, min_notional)
    return {
        "entry_mid": e_mid,
        "exit_mid": x_mid,
        "entry_price": e_px,
        "exit_price": x_px,
        "qty": q,
        "notional": notional,
        "gross_pnl": gross,
        "fees": fees,
        "spread_component": (es + xs) * q,
        "impact_component": (ei + xi) * q,
        "vol_slippage_component": (ev + xv) * q,
        "net_pnl": net,
        "gross_return": gross / notional,
        "mid_return": (x_mid - e_mid) * q / notional,
        "trade_return": net / notional,
    }


def expected_costs(df: DataFrame, cfg: CostConfig, entry: Column | None = None, horizon: int = 1) -> dict[str, Column]:
    """Cost part of the expected value, in return units of the entry price."""
    spread = clip(optional(df, "spread", 0.0), 0.0)
    depth = clip(optional(df, "depth_total", 1.0), 1.0)
    conf = clip(optional(df, "confidence", 0.5), 0.05, 1.0)
    vol = F.abs(optional(df, "prob_vol_6", 0.0))
    ahead = first_present(df, [(f"future_spread_{horizon}", optional(df, f"future_spread_{horizon}"))], optional(df, "future_spread_1"))
    ahead = clip(F.coalesce(ahead, spread), 0.0)
    if entry is None:
        mid = prob(optional(df, "mid", 0.5))
        entry = F.when(D.label(optional(df, "signal", 0.0)) == D.LONG_YES, mid).otherwise(1.0 - mid)
    entry = clip(F.coalesce(entry, lit(0.5)), LOW, 1.0)
    target = clip(F.least(cfg.base_trade_notional * conf, cfg.max_participation * depth * entry), 1.0)
    load = target / (depth * entry + 1e-9)
    impact = F.least(lit(cfg.max_impact), cfg.impact_coeff * load)
    slip = cfg.vol_slippage_coeff * vol * (1.0 + load)
    fee = lit(2.0 * cfg.fee_bps / 1e4)
    spread_ret = (0.5 * spread + 0.5 * ahead) / entry
    return {
        "entry_price": entry,
        "target_notional": target,
        "impact": impact,
        "vol_slippage": slip,
        "expected_fee_return": fee,
        "expected_spread_cost_return": spread_ret,
        "expected_impact_return": 2.0 * impact / entry,
        "expected_vol_slippage_return": 2.0 * slip / entry,
        "expected_cost_return": fee + spread_ret + 2.0 * impact / entry + 2.0 * slip / entry,
    }


def expected_value(df: DataFrame, cfg: CostConfig, horizon: int = 1) -> DataFrame:
    """Expected gross, cost and net return per prediction space."""
    signal = optional(df, "signal", 0.0)
    lab = D.label(signal)
    sgn = D.sign_of(lab)
    mid = prob(optional(df, "mid", 0.5))
    long_yes = lab == D.LONG_YES
    default = "FUTURE_MID_YES" if has(df, "model_pred_future_mid") else "UP_MOVE_PROB"
    source = next((c for c in ("prediction_space", "model_target_type") if has(df, c)), None)
    space = D.prediction_space(source, default) if source else F.lit(default)
    entry = prob(F.when(long_yes, mid).otherwise(1.0 - mid))
    conf = clip(optional(df, "confidence", 0.5), 0.05, 1.0)
    pull = clip(signal, -1.0, 1.0)

    read = lambda c: optional(df, c)
    outcome = first_present(
        df,
        [("model_pred_outcome_prob_yes", prob(F.coalesce(read("model_pred_outcome_prob_yes"), mid))), ("model_proba", prob(F.coalesce(read("model_proba"), mid)))],
        local_shift(mid, signal, conf),
    )
    toward = lambda p: prob(F.when(long_yes, p).otherwise(1.0 - p))
    gross_outcome = (toward(outcome) - toward(mid)) / entry
    base_move = clip(optional(df, "expected_move_size", 0.01), 1e-4, 0.4)
    nxt = first_present(df, [("model_pred_future_mid", prob(F.coalesce(read("model_pred_future_mid"), mid)))], prob(mid + pull * base_move))
    gross_mid = sgn * (nxt - mid) / entry
    up = first_present(df, [("model_pred_up_move_proba", read("model_pred_up_move_proba")), ("model_proba", read("model_proba"))], (pull + 1.0) / 2.0)
    up = prob(F.coalesce(up, lit(0.5)))
    h_move = f"expected_move_size_{horizon}"
    move = clip(F.coalesce(first_present(df, [(h_move, read(h_move))], optional(df, "expected_move_size", 0.01)), lit(0.01)), 1e-4, 0.4)
    gross_up = sgn * (2.0 * up - 1.0) * (move / entry)
    ret = first_present(df, [("model_pred_return_next", sgn * F.coalesce(read("model_pred_return_next"), lit(0))), ("model_pred_return", sgn * F.coalesce(read("model_pred_return"), lit(0)))], gross_mid)

    cost = expected_costs(df, cfg, entry, horizon)
    cost["entry_price"] = clip(entry, LOW, 1.0)
    out = df.withColumns(
        {
            "prediction_space": space,
            "horizon": number("model_horizon", float(horizon)) if has(df, "model_horizon") else lit(horizon),
            **cost,
            "direction": lab,
            "direction_sign": sgn,
            "traded_side": D.side_of(lab),
            "expected_gross_outcome_return": gross_outcome,
            "expected_gross_future_mid_return": gross_mid,
            "expected_gross_up_move_return": gross_up,
            "expected_gross_return_next_h": ret,
            "model_pred_outcome_prob_yes": outcome,
            "model_pred_future_mid": nxt,
            "model_pred_up_move_proba": up,
        }
    )
    sp = F.col("prediction_space")
    gross = (
        F.when(sp == "OUTCOME_PROB_YES", F.col("expected_gross_outcome_return"))
        .when(sp == "UP_MOVE_PROB", F.col("expected_gross_up_move_return"))
        .when(sp == "RETURN_NEXT_H", F.col("expected_gross_return_next_h"))
        .otherwise(F.col("expected_gross_future_mid_return"))
    )
    out = out.withColumn("expected_gross_return", gross)
    net = F.col("expected_gross_return") - F.col("expected_cost_return")
    return D.attach_contract(out.withColumns({"expected_net_return": net, "expected_return": net}), float(horizon), "expected_return")


def model_probability(df: DataFrame) -> Column:
    """Outcome probability shrunk towards the market price."""
    mid = prob(optional(df, "mid", 0.5))
    conf = clip(optional(df, "confidence", 0.5), 0.05, 1.0)
    shrunk = lambda c: mid + 0.25 * conf * (prob(F.coalesce(optional(df, c), mid)) - mid)
    drift = mid + optional(df, "signal", 0.0) * (0.10 * F.least(mid, 1.0 - mid) * conf)
    out = drift
    if has(df, "model_proba"):
        kinds = [c for c in ("model_target_type", "model_proba_target_type") if has(df, c)]
        named = F.lit(False)
        for c in kinds:
            named = named | F.coalesce(df.agg(F.bool_or(F.upper(F.trim(F.col(c))) == "OUTCOME_PROB").alias("v")).scalar(), F.lit(False))
        out = F.when(any_value(df, "model_proba") & named, shrunk("model_proba")).otherwise(out)
    if has(df, "model_pred_outcome_prob_yes"):
        out = F.when(any_value(df, "model_pred_outcome_prob_yes"), shrunk("model_pred_outcome_prob_yes")).otherwise(out)
    return prob(out)


def strategy_value(df: DataFrame, cfg: CostConfig, horizon: int = 1) -> DataFrame:
    """Expected value with the column names of the strategy layer."""
    out = df
    if not has(df, "model_pred_outcome_prob_yes"):
        out = out.withColumn("model_pred_outcome_prob_yes", model_probability(df))
    if not has(out, "prediction_space"):
        if has(out, "model_target_type"):
            out = out.withColumn("prediction_space", F.col("model_target_type"))
        else:
            out = out.withColumn("prediction_space", F.when(any_value(df, "model_pred_future_mid"), "FUTURE_MID_YES").otherwise("UP_MOVE_PROB"))
    if not has(out, "model_horizon"):
        out = out.withColumn("model_horizon", lit(horizon))
    out = expected_value(out, cfg, horizon)
    mid = prob(optional(out, "mid", 0.5))
    yes = F.col("direction") == D.LONG_YES
    p = F.col("model_pred_outcome_prob_yes")
    if not has(out, "model_target_type"):
        out = out.withColumn("model_target_type", F.col("prediction_space"))
    same = {
        "expected_edge": "expected_gross_return",
        "expected_gross": "expected_gross_return",
        "expected_cost": "expected_cost_return",
        "expected_net_ev": "expected_net_return",
        "expected_ev_signal": "expected_net_return",
        "expected_fees": "expected_fee_return",
        "expected_spread_cost": "expected_spread_cost_return",
        "expected_impact_cost": "expected_impact_return",
        "expected_slippage_cost": "expected_vol_slippage_return",
    }
    return out.withColumns(
        {
            "model_prob_up": p,
            "market_prob_up": mid,
            "model_prob_dir": F.when(yes, p).otherwise(1.0 - p),
            "market_prob_dir": F.when(yes, mid).otherwise(1.0 - mid),
            "position_type": D.position_of("direction"),
            "expected_payoff": lit(1),
            **{new: F.coalesce(old, lit(0)) for new, old in same.items()},
        }
    )


def forward_proxy(df: DataFrame) -> Column:
    """Return of the traded side to the next mid, before costs."""
    sgn = D.sign_of(D.label("signal"))
    if has(df, "future_mid_1", "mid"):
        entry = clip(F.when(sgn >= 0, F.col("mid")).otherwise(1.0 - F.col("mid")), LOW)
        exit_ = clip(F.when(sgn >= 0, F.col("future_mid_1")).otherwise(1.0 - F.col("future_mid_1")), LOW)
        return ratio(exit_ - entry, entry)
    if has(df, "forward_ret_1"):
        return sgn * F.col("forward_ret_1")
    return F.lit(None).cast("double")


# ---------------------------------------------------------------- trades


def grid_of(cfg: CostConfig, thresholds: Sequence[float], regimes: Sequence[str] = ("base",), impacts: Sequence[float] | None = None) -> list[dict]:
    """Parameter cells: threshold x holding period x regime (x impact coefficient)."""
    cells = []
    for reg in regimes:
        p = regime_costs(cfg, reg)
        for imp in impacts if impacts is not None else (None,):
            q = dict(p)
            if imp is not None:
                q["impact_coeff"] = regime_costs(_with_impact(cfg, imp), reg)["impact_coeff"]
            for thr in thresholds:
                for hp in cfg.holding_periods:
                    cells.append({"threshold": float(thr), "holding_period": int(hp), "execution_regime": reg, "impact_coeff_input": float(cfg.impact_coeff if imp is None else imp), **q})
    return cells


def _with_impact(cfg: CostConfig, imp: float) -> CostConfig:
    from dataclasses import replace

    return replace(cfg, impact_coeff=float(imp))


def explode_grid(df: DataFrame, cells: Sequence[dict], carried: Sequence[str] = ("future_mid", "future_spread"), needed: Sequence[str] = ("future_mid",), strict: bool = True) -> DataFrame:
    """One row per signal and grid cell that the signal can trade in.

    Each cell also carries the forward columns of its own horizon. Cells are
    filtered inside the array, so rows below every threshold never multiply.
    """
    num = lambda v: F.lit(v) if isinstance(v, (str, int)) else lit(v)
    items = []
    for c in cells:
        h = c["holding_period"]
        ahead = [(F.col(f"{n}_{h}") if has(df, f"{n}_{h}") else F.lit(None).cast("double")).alias(n) for n in carried]
        items.append(F.struct(*[num(v).alias(k) for k, v in c.items()], *ahead))
    strength = F.abs(number("signal", 0.0))


    def usable_cell(x: Column) -> Column:
        cut = F.greatest(x["threshold"], lit(0))
        ok = strength > cut if strict else strength >= cut
        for n in needed:
            ok = ok & x[n].isNotNull()
        return ok

    usable = F.filter(F.array(*items), usable_cell)
    keep = [c for c in df.columns if not any(c.startswith(f"{n}_") and c.removeprefix(f"{n}_").isdigit() for n in carried) and c not in cells[0]]
    return df.select(*keep, F.explode(usable).alias("_g")).select(*keep, "_g.*")


def admitted(df: DataFrame) -> DataFrame:
    """Rows a trade may start from: tradable, quoted, deep enough when extreme."""
    cond = F.lit(True)
    if has(df, "book_tradable"):
        cond = cond & (number("book_tradable", 0.0) > 0)
    for c in ("best_bid", "best_ask"):
        if has(df, c):
            cond = cond & F.col(c).isNotNull()
    if has(df, "mid", "depth_total"):
        m = number("mid", 0.5)
        cond = cond & (((m < 0.99) & (m > 0.01)) | (number("depth_total", 0.0) >= 50))
    return df.where(cond & (D.label("signal") != D.FLAT))


def size_and_fill(df: DataFrame, cfg: CostConfig) -> DataFrame:
    """Target size, fill chance, queue and realised quantity per grid row."""
    lab = D.label("signal")
    yes = lab == D.LONG_YES
    mid_yes = prob(number("mid", 0.5))
    conf = clip("confidence", 0.05, 1.0)
    out = df.withColumns(
        {
            "direction": lab,
            "_yes": yes,
            "_mid_yes": mid_yes,
            "_fut_yes": prob(number("future_mid")),
            "_conf": conf,
            "_depth": clip("depth_total", 1.0),
            "_spread": clip(F.coalesce("spread", lit(0)), 0.0),
            "_bps": clip(optional(df, "spread_bps", 0.0), 0.0),
            "_vol": F.abs(optional(df, "prob_vol_6", 0.0)),
            "_flow": clip(optional(df, "trade_notional_h", 0.0), 0.0),
            "_fspread": clip(F.coalesce("future_spread", lit(0)), 0.0),
        }
    )
    out = out.withColumns({"_mid": prob(F.when(F.col("_yes"), F.col("_mid_yes")).otherwise(1.0 - F.col("_mid_yes"))), "_fut": prob(F.when(F.col("_yes"), F.col("_fut_yes")).otherwise(1.0 - F.col("_fut_yes")))})
    out = out.withColumn("target_notional", clip(F.least(cfg.base_trade_notional * F.col("_conf"), cfg.max_participation * F.col("_depth") * F.col("_mid")), 1.0))
    load = F.col("target_notional") / (F.col("_depth") * F.col("_mid") + 1e-9)
    logit = F.col("fill_alpha") - 2.5 * load - F.col("fill_beta") * (F.col("_bps") / 150.0) + F.col("fill_gamma") * F.log1p(F.col("_flow") / (F.col("target_notional") + 1.0))
    pace = F.log1p(F.col("_flow") + 1.0) / (F.col("_depth") + 1.0)
    wait = cfg.snapshot_hours * clip(1.0 - F.col("_conf"), 0.05, 0.95) / (pace + 1e-6)
    out = out.withColumns({"_load": load, "expected_fill_pct": logistic(clip(logit, -30.0, 30.0)), "time_to_fill_h": wait})
    span = F.greatest(lit(cfg.snapshot_hours), F.col("holding_period") * cfg.snapshot_hours)
    real = clip(F.col("expected_fill_pct") * F.least(lit(1), span / (F.col("time_to_fill_h") + 1e-6)), 0.0, 1.0)
    return out.withColumn("realized_fill_pct", real).withColumn("_qty", F.col("target_notional") / F.col("_mid") * F.col("realized_fill_pct"))


def execution_costs(df: DataFrame, cfg: CostConfig) -> DataFrame:
    """Impact, slippage, executable prices, pnl and fill proxies."""
    out = df.withColumns({"_impact": F.least(F.col("max_impact"), F.col("impact_coeff") * F.col("_load")), "_slip": F.col("vol_slippage_coeff") * F.col("_vol") * (1.0 + F.col("_load"))})
    half, fhalf = 0.5 * F.col("_spread"), 0.5 * F.col("_fspread")
    t = trade_return(
        F.col("_mid_yes"), F.col("_fut_yes"), F.col("direction"), lit(cfg.fee_bps / 1e4), F.col("_qty"), (half, fhalf), (F.col("_impact"), F.col("_impact")), (F.col("_slip"), F.col("_slip")), min_notional=1.0
    )
    keep = ["entry_price", "exit_price", "notional", "gross_pnl", "fees", "spread_component", "impact_component", "vol_slippage_component", "net_pnl", "gross_return", "mid_return", "trade_return"]
    out = out.withColumns({k: t[k] for k in keep})
    thick = F.least(lit(1), F.log1p(F.col("_flow") + 1.0) / F.log1p(F.col("target_notional") + 1.0))
    return out.withColumns({"actual_fill_proxy": clip(thick * F.exp(-F.col("_bps") / 250.0), 0.0, 1.0), "realized_slippage": F.col("entry_price") - F.col("_mid")})


def expected_ev(df: DataFrame, source: DataFrame) -> DataFrame:
    """Expected value of a trade in the space of its model target, and the gap to the result."""
    mid, sgn, yes, px = F.col("_mid_yes"), D.sign_of("direction"), F.col("_yes"), F.col("entry_price")
    default = "FUTURE_MID" if has(source, "model_pred_future_mid") else "OUTCOME_PROB" if has(source, "model_pred_outcome_prob_yes") else "UP_MOVE_PROB" if has(source, "model_proba") else "FUTURE_MID"
    kind = lambda c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) if has(source, c) else F.lit("")
    target = F.when(kind("model_target_type") == "", default).otherwise(kind("model_target_type"))
    read = lambda c: optional(source, c)

    def named(space: str) -> Column:
        hit = F.lit(False)
        for c in ("model_target_type", "model_proba_target_type"):
            if has(source, c):
                hit = hit | F.coalesce(source.agg(F.bool_or(F.upper(F.trim(F.col(c))) == space).alias("v")).scalar(), F.lit(False))
        return hit | F.lit(default == space and not has(source, "model_target_type"))

    signal = number("signal", 0.0)
    pull = clip(signal, -1.0, 1.0)
    outcome = first_present(source, [("model_prob_up", prob(F.coalesce(read("model_prob_up"), mid)))], local_shift(mid, signal, clip(optional(source, "confidence", 0.5), 0.05, 1.0)))
    if has(source, "model_proba"):
        outcome = F.when(any_value(source, "model_proba") & named("OUTCOME_PROB"), prob(F.coalesce(read("model_proba"), mid))).otherwise(outcome)
    outcome = first_present(source, [("model_pred_outcome_prob_yes", prob(F.coalesce(read("model_pred_outcome_prob_yes"), mid)))], outcome)
    up = (pull + 1.0) / 2.0
    if has(source, "model_proba"):
        up = F.when(any_value(source, "model_proba") & named("UP_MOVE_PROB"), read("model_proba")).otherwise(up)
    up = prob(F.coalesce(first_present(source, [("model_pred_up_move_proba", read("model_pred_up_move_proba"))], up), lit(0.5)))

    # mean absolute move of the rows that trade at this cell, as the last resort
    typical = F.col("typical_move") if has(df, "typical_move") else lit(0.01)
    horizons = sorted({int(c.removeprefix("expected_move_size_")) for c in source.columns if c.startswith("expected_move_size_") and c.removeprefix("expected_move_size_").isdigit()})
    sized = F.lit(None).cast("double")
    if has(source, "expected_move_size"):
        sized = F.when(any_value(source, "expected_move_size"), F.coalesce(read("expected_move_size"), lit(0.01))).otherwise(sized)
    for h in horizons:
        c = f"expected_move_size_{h}"
        sized = F.when((F.col("holding_period") == h) & any_value(source, c), F.coalesce(read(c), lit(0.01))).otherwise(sized)
    move = clip(F.coalesce(sized, typical, lit(0.01)), 1e-4, 0.40)
    nxt = first_present(source, [("model_pred_future_mid", prob(F.coalesce(read("model_pred_future_mid"), mid)))], prob(mid + pull * move))

    toward = lambda p: prob(F.when(yes, p).otherwise(1.0 - p))
    out = df.withColumns(
        {
            "direction_sign": sgn,
            "model_target_type": target,
            "model_horizon": number("model_horizon") if has(source, "model_horizon") else F.lit(None).cast("double"),
            "model_pred_outcome_prob_yes": outcome,
            "model_pred_up_move_proba": up,
            "model_pred_future_mid": nxt,
            "expected_move_size": move,
            "market_prob_up": mid,
        }
    )
    fee = F.col("fees") / clip("notional", 1.0)
    parts = {
        "expected_fee_return": fee,
        "expected_spread_cost_return": (0.5 * F.col("_spread") + 0.5 * F.col("_fspread")) / px,
        "expected_impact_return": 2.0 * F.col("_impact") / px,
        "expected_vol_slippage_return": 2.0 * F.col("_slip") / px,
        "expected_gross_outcome_return": (toward(F.col("model_pred_outcome_prob_yes")) - toward(mid)) / px,
        "expected_gross_future_mid_return": sgn * (F.col("model_pred_future_mid") - mid) / px,
        "expected_gross_up_move_return": sgn * (2.0 * F.col("model_pred_up_move_proba") - 1.0) * (F.col("expected_move_size") / px),
    }
    out = out.withColumns({**parts, "model_horizon": F.coalesce("model_horizon", F.col("holding_period").cast("double"))})
    tt = F.col("model_target_type")
    gross = F.when(tt == "OUTCOME_PROB", F.col("expected_gross_outcome_return")).when(tt == "FUTURE_MID", F.col("expected_gross_future_mid_return")).otherwise(F.col("expected_gross_up_move_return"))
    cost = F.col("expected_fee_return") + F.col("expected_spread_cost_return") + F.col("expected_impact_return") + F.col("expected_vol_slippage_return")
    out = out.withColumns({"expected_gross": gross, "expected_cost": cost})
    ev = F.col("expected_gross") - F.col("expected_cost")
    return out.withColumns({"expected_ev": ev, "ev_gap": F.col("trade_return") - ev})


def trade_layout(df: DataFrame) -> DataFrame:
    """Final trade columns; working columns are dropped."""
    lab = F.col("direction")
    out = df.withColumns(
        {
            "traded_side": D.side_of(lab),
            "position_type": D.position_of(lab),
            "instrument_mid_entry": F.col("_mid"),
            "instrument_mid_exit": F.col("_fut"),
            "exec_mid_used": F.col("_mid"),
            "exec_spread_used": F.col("_spread"),
            "execution_vs_mid": F.col("entry_price") - F.col("_mid"),
            "prediction_space": D.prediction_space("model_target_type"),
            "horizon": F.col("model_horizon"),
            "model_prob_up": F.col("model_pred_outcome_prob_yes"),
            "expected_cost_return": F.col("expected_cost"),
            "expected_net_return": F.col("expected_ev"),
            "expected_return": F.col("expected_ev"),
        }
    )
    work = [c for c in out.columns if c.startswith("_")]
    params = ["impact_coeff", "max_impact", "vol_slippage_coeff", "fill_alpha", "fill_beta", "fill_gamma", "future_mid", "future_spread", "typical_move"]
    return D.attach_contract(out.drop(*work, *params))


def typical_moves(df: DataFrame, cells: Sequence[dict]) -> tuple[list[dict], Column]:
    """Mean absolute forward move of the rows each cell trades.

    One aggregate over the signals gives one number per (threshold, holding
    period); every cell carries the position of its number.
    """
    seen = sorted({(c["threshold"], c["holding_period"]) for c in cells})
    strength = F.abs(number("signal", 0.0))
    mid = prob(number("mid", 0.5))
    aggs = []
    for thr, h in seen:
        fut = F.col(f"future_mid_{h}") if has(df, f"future_mid_{h}") else F.lit(None).cast("double")
        aggs.append(F.avg(F.when((strength > thr) & fut.isNotNull(), F.abs(prob(fut) - mid))))
    numbers = df.agg(F.array(*aggs).alias("v")).scalar()
    at = {cell: i for i, cell in enumerate(seen)}
    return [{**c, "_move_no": at[(c["threshold"], c["holding_period"])]} for c in cells], F.get(numbers, F.col("_move_no"))


def run_grid(signals: DataFrame, cfg: CostConfig, thresholds: Sequence[float], regimes: Sequence[str] = ("base",), impacts: Sequence[float] | None = None) -> DataFrame:
    """Trades of every grid cell in one plan."""
    ok = admitted(signals)
    cells = grid_of(cfg, thresholds, regimes, impacts)
    sized = has(ok, "expected_move_size") or any(c.startswith("expected_move_size_") for c in ok.columns)
    moves = None
    if not (sized and has(ok, "model_pred_future_mid")):
        cells, moves = typical_moves(ok, cells)
    t = explode_grid(ok, cells)
    if moves is not None:
        t = t.withColumn("typical_move", moves)
    t = execution_costs(size_and_fill(t, cfg), cfg)
    return trade_layout(expected_ev(t, ok))
