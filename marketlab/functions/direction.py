"""Direction of a signal, prediction spaces and the prediction contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions.columns import col, has, lit, number

LONG_YES, LONG_NO, FLAT = "LONG_YES", "LONG_NO", "FLAT"
# fixed values: accepted spellings of the four prediction spaces
SPACES = {
    "OUTCOME_PROB": "OUTCOME_PROB_YES",
    "OUTCOME_PROB_YES": "OUTCOME_PROB_YES",
    "FUTURE_MID": "FUTURE_MID_YES",
    "FUTURE_MID_YES": "FUTURE_MID_YES",
    "RETURN_NEXT_H": "RETURN_NEXT_H",
    "RETURN": "RETURN_NEXT_H",
    "UP_MOVE_PROB": "UP_MOVE_PROB",
}


def label(signal: Column | str, threshold: float | Column = 0.0) -> Column:
    """LONG_YES above the threshold, LONG_NO below its negative, else FLAT."""
    s = number(signal, 0.0)
    cut = F.greatest(threshold if isinstance(threshold, Column) else lit(threshold), lit(0))
    return F.when(s > cut, LONG_YES).when(s < -cut, LONG_NO).otherwise(FLAT)


def sign_of(lab: Column | str) -> Column:
    d = F.upper(F.trim(col(lab)))
    return F.when(d == LONG_YES, lit(1)).when(d == LONG_NO, lit(-1)).otherwise(lit(0))


def side_of(lab: Column | str) -> Column:
    d = F.upper(F.trim(col(lab)))
    return F.when(d == LONG_YES, "YES").when(d == LONG_NO, "NO").otherwise("NONE")


def position_of(lab: Column | str) -> Column:
    d = col(lab)
    return F.when(d == LONG_YES, "long_yes").when(d == LONG_NO, "long_no").otherwise("flat")


def normal_side(side: Column, numeric: bool) -> Column:
    """Any numeric sign or YES/NO wording as a direction label."""
    if numeric:
        return label(side, 0.0)
    d = F.upper(F.trim(side.cast("string")))
    return F.when(d.isin("YES", LONG_YES), LONG_YES).when(d.isin("NO", LONG_NO), LONG_NO).otherwise(FLAT)


def prediction_space(value: Column | str, default: str = "FUTURE_MID_YES") -> Column:
    names = F.create_map(*[F.lit(x) for kv in SPACES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(col(value)))), F.lit(default))


def attach_contract(df: DataFrame, horizon: float = 1.0, expected: str | None = None, threshold: float = 0.0) -> DataFrame:
    """Fill whatever the prediction contract still lacks; present columns stay."""
    new: dict[str, Column] = {}
    if not has(df, "direction"):
        new["direction"] = label("signal", threshold)
    lab = new.get("direction", F.col("direction") if has(df, "direction") else None)
    if not has(df, "traded_side"):
        new["traded_side"] = side_of(lab)
    source = "prediction_space" if has(df, "prediction_space") else "model_target_type" if has(df, "model_target_type") else None
    new["prediction_space"] = prediction_space(source) if source else F.lit("FUTURE_MID_YES")
    if not has(df, "horizon"):
        new["horizon"] = number("model_horizon", horizon) if has(df, "model_horizon") else lit(horizon)
    steps = number("model_horizon", 1.0) if has(df, "model_horizon") else F.coalesce(new.get("horizon", F.col("horizon") if has(df, "horizon") else lit(horizon)), lit(1))
    if not has(df, "horizon_steps"):
        new["horizon_steps"] = steps
    if not has(df, "horizon_seconds"):
        new["horizon_seconds"] = (F.col("horizon_steps") if has(df, "horizon_steps") else steps) * lit(3600)
    known = expected if expected and has(df, expected) else "expected_return" if has(df, "expected_return") else "expected_net_return" if has(df, "expected_net_return") else None
    if known:
        for name in ("expected_return", "expected_net_return"):
            if not has(df, name):
                new[name] = number(known, 0.0)
    return df.withColumns(new)


def check_contract(df: DataFrame, need_return: bool = False) -> DataFrame:
    """One row: is the contract met, and the list of what is wrong."""
    needed = ["prediction_space", "horizon", "direction", "horizon_steps", "horizon_seconds"] + (["expected_net_return"] if need_return else [])
    missing = [c for c in needed if c not in df.columns]
    if missing:
        return df.sparkSession.range(1).select(F.lit(False).alias("valid"), F.lit(";".join(f"missing:{c}" for c in missing)).alias("issues"))
    bad_dir = F.count_if(~F.coalesce(F.col("direction").isin(LONG_YES, LONG_NO, FLAT), F.lit(False)))
    parts = [F.when(bad_dir > 0, "invalid_direction_values")]
    if need_return:
        parts.append(F.when(F.count_if(number("expected_net_return").isNull()) > 0, "expected_return_non_numeric"))
    issues = F.concat_ws(";", *parts)
    return df.agg(issues.alias("issues")).select((F.col("issues") == "").alias("valid"), "issues")
