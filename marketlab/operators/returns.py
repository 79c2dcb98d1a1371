"""Past returns per token, by row and by clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marketlab.operators.ranking import carry_forward
from marketlab.operators.series import CHUNK_ROWS, series_window, split_series, whole_series
from marketlab.session import materialise


def lagged_returns(snapshots: DataFrame, lags: Sequence[int] = (1, 6, 24), size: int = CHUNK_ROWS) -> DataFrame:
    """Row form: return against the quote k rows earlier, only if it was positive."""
    s = snapshots.where(F.col("mid").isNotNull()).select("token_id", F.col("snapshot_ts").alias("ts"), "mid")
    s = split_series(s, "token_id", "ts", max(lags), size=size)
    w = series_window(s, "token_id", "ts")
    past = lambda k: F.lag("mid", k).over(w)
    s = s.withColumns({f"ret_{k}h": F.when(past(k) > 0, F.col("mid") / past(k) - 1) for k in lags})
    return whole_series(s).select("token_id", "ts", *[f"ret_{k}h" for k in lags])


def timed_returns(snapshots: DataFrame, hours: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """Clock form: return against the latest quote at least h hours old, one row per quote.

    Quotes and probes (each quote shifted by h) are sorted together, quotes of
    an instant before its probes, and the last quote is carried across range
    slices: no series is sorted in one task. Of quotes of one instant the
    highest is the latest.
    """
    s = snapshots.where(F.col("mid").isNotNull()).select("token_id", F.col("snapshot_ts").alias("ts"), "mid", F.unix_micros("snapshot_ts").alias("_at"))
    s = materialise(s.withColumn("_row", F.monotonically_increasing_id()))
    kinds = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("k")), *[F.struct(F.lit(h).cast("long").alias("h"), F.lit(1).alias("k")) for h in hours])
    both = s.withColumn("_x", F.explode(kinds)).select("token_id", "ts", "mid", "_row", F.col("_x.h").alias("_h"), F.col("_x.k").alias("_kind"), (F.col("_at") - F.col("_x.h") * 3_600_000_000).alias("_t"))
    both = both.withColumn("_q", F.when(F.col("_kind") == 0, F.col("mid")))
    seen = carry_forward(both, [F.col("_t").asc(), F.col("_kind").asc(), F.col("_q").asc_nulls_first(), F.col("_row").asc()], "_q", "_p", ["token_id"])
    past = {h: F.max(F.when(F.col("_h") == h, F.col("_p"))) for h in hours}
    rows = seen.where(F.col("_kind") == 1).groupBy("_row", "token_id", "ts", "mid").agg(*[past[h].alias(f"_p{h}") for h in hours])
    return rows.select("token_id", "ts", *[F.when(F.col(f"_p{h}") > 0, F.col("mid") / F.col(f"_p{h}") - 1).alias(f"ret_{h}h") for h in hours])


def period_returns(curve: DataFrame, keys: Sequence[str], capital: float = 100_000.0) -> DataFrame:
    """Step return on the starting capital and percent change of equity."""
    c = split_series(curve.select("ts", *keys, "pnl", "equity"), keys, "ts", 1)
    last = F.lag("equity").over(series_window(c, keys, "ts"))
    c = c.withColumns({"_p": F.coalesce(F.when(last.isNotNull(), F.col("pnl")), F.lit(0.0)), "pct_return": F.col("equity") / last - 1})
    return whole_series(c).select("ts", *keys, (F.col("_p") / capital).alias("step_return"), "pct_return")
