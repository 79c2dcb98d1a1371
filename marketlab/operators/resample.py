"""Resampling with portable hashed draws: bootstrap, sign flips, reality check.

Draws come from integer arithmetic on (row id, replicate), so any engine gets
the same ones and a lost task repeats them. Rows never meet replicates in a
shuffle: a task turns its rows into one state per replicate (weighted sums, sign
sums, or the ordered growth, peak and fall of a path) and only these states are
merged. Bootstrap weights are Poisson(1) numbers per (row, replicate), which
need no look-up of drawn rows. The shuffle null alone looks rows up by drawn
position, which shuffles rows times replicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlab.functions.columns import correlation, lit, number
from marketlab.operators.ranking import rank_rows

PRIME = 2147483647
SLICE, SLICES = 1024, 4096  # rows of a path slice at least, slices at most
ORDER_DRAW = 1_000_003  # number of the draw that orders paths
BITS = 30  # sign bits taken from one draw
BLOCK = 256  # rows times replicates held at once
#: A draw is worth as many rows as it passes cuts: the Poisson(1) distribution in units of 1 / PRIME.
POISSON_CUTS = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(10))


def draw(row: Column, rep: Column) -> Column:
    """Integer in [0, PRIME) from a row id and a replicate number."""
    i, r = row.cast("long"), rep.cast("long")
    x0 = (F.lit(48271) * (i + 1) + F.lit(69621 * 1009).cast("long") * (r + 1)) % PRIME
    x1 = (x0 * x0 + i + 1) % PRIME
    return (x1 * x1 + r + 1) % PRIME


def pick(row: Column, rep: Column, n: Column) -> Column:
    """Row position 0..n-1 drawn with replacement."""
    return F.floor(draw(row, rep).cast("double") * n / PRIME).cast("long")


def hashed(ids: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """:func:`draw` of all ids (rows) and replicates (columns)."""
    i, r = ids.astype(np.int64)[:, None], reps.astype(np.int64)[None, :]
    x0 = (48271 * (i + 1) + 69621 * 1009 * (r + 1)) % PRIME
    x1 = (x0 * x0 + i + 1) % PRIME
    return (x1 * x1 + r + 1) % PRIME


def weights(ids: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) weight of each id in each replicate."""
    return np.searchsorted(POISSON_CUTS, hashed(ids, np.arange(reps)), side="right")


def signs(ids: np.ndarray, reps: int) -> np.ndarray:
    """+1 or -1 of each id in each replicate; a draw serves ``BITS`` replicates."""
    words = hashed(ids, np.arange(-(-reps // BITS)))
    return (((words[:, :, None] >> np.arange(BITS)) & 1) * 2 - 1).reshape(len(ids), -1)[:, :reps]


def blocks(n: int) -> Iterator[slice]:
    return (slice(a, a + BLOCK) for a in range(0, n, BLOCK))


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with a dense 0-based id and the row count."""
    out = rank_rows(df, [F.col(c).asc() for c in order], (), "_rn", "n")
    return out.withColumn("id", F.col("_rn") - 1).drop("_rn")


def replicate(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))


def path_states(ids: np.ndarray, x: np.ndarray, reps: int) -> dict[str, np.ndarray]:
    """State of every replicate after rows in path order.

    c, s, q: weight, weighted sum and sum of squares. prod, top, low, floor:
    growth, its highest and lowest value at drawn rows, and the worst fall below
    the running peak; a row drawn k times moves the path once, by its k-th power.
    """
    c, s, q = np.zeros((3, reps))
    prod, top, low, floor = np.ones(reps), np.zeros(reps), np.zeros(reps), np.full(reps, 1e300)
    gain = np.maximum(x + 1.0, 0.0)
    for b in blocks(len(x)):
        w = weights(ids[b], reps)
        c += w.sum(0)
        s += x[b] @ w
        q += (x[b] * x[b]) @ w
        path = prod * np.cumprod(gain[b][:, None] ** w, axis=0)
        drawn = w > 0
        peak = np.maximum(np.maximum.accumulate(np.where(drawn, path, 0.0), axis=0), top)
        fall = np.where(peak > 0, path / np.where(peak > 0, peak, 1.0) - 1.0, -1.0)
        low = np.minimum(low, np.where(drawn, fall, 0.0).min(0))
        floor = np.minimum(floor, np.where(drawn, path, 1e300).min(0))
        prod, top = path[-1], peak[-1]
    return {"c": c, "s": s, "q": q, "prod": prod, "top": top, "low": low, "floor": floor}


def bootstrap(returns: DataFrame, order: Sequence[str], reps: int = 1000, value: str = "trade_return") -> DataFrame:
    """Mean, Sharpe and drawdown of resampled returns: centre and 95 % interval.

    Rows lie on the path in hashed order, as independent draws would. A slice of
    that order is one group of rows and gives one state per replicate; states
    are joined in order, ``SLICES`` per replicate at most. A loss above 100 %
    counts as a total loss.
    """
    base = numbered(returns.where(F.col(value).isNotNull()).select(*order, number(value).alias("x")), order).select("id", "n", "x")
    h = draw(F.col("id"), F.lit(ORDER_DRAW))
    count = F.least(F.lit(SLICES), F.ceil(F.col("n") / SLICE))
    sliced = base.select("id", "x", h.alias("h"), F.floor(h.cast("double") * count / PRIME).cast("long").alias("slice"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["h", "id"])
        state = path_states(p["id"].to_numpy(), p["x"].to_numpy(np.float64), reps)
        return pd.DataFrame({"slice": key[0], "rep": np.arange(reps), **state})

    states = sliced.groupBy("slice").applyInPandas(run, "slice long, rep long, c double, s double, q double, prod double, top double, low double, floor double")
    stats = states.groupBy("rep").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"), path_fall().alias("drawdown")).where("c > 0")
    mean, sh = moments()
    return interval(stats.select(mean.alias("mean"), sh.alias("sharpe"), "drawdown"), {"mean": "mean_return", "sharpe": "sharpe", "drawdown": "max_drawdown"})


def moments() -> tuple[Column, Column]:
    """Mean and yearly Sharpe ratio from count c, sum s and sum of squares q."""
    mean = F.col("s") / F.col("c")
    var = F.col("q") / F.col("c") - mean * mean
    return mean, F.when((F.col("c") >= 3) & (var > 1e-18), mean / F.sqrt(F.greatest(var, lit(1e-18))) * lit(8760.0**0.5)).otherwise(lit(0))


def path_fall() -> Column:
    """Worst fall of a replicate's path from the states of its slices: a later slice starts at the growth so far."""
    zero = F.struct(lit(1).alias("prod"), lit(0).alias("top"), lit(0).alias("low"))

    def join(a: Column, e: Column) -> Column:
        base = a["prod"]
        across = F.when(a["top"] > 0, base * e["floor"] / a["top"] - 1.0).otherwise(lit(0))
        return F.struct((base * e["prod"]).alias("prod"), F.greatest(a["top"], base * e["top"]).alias("top"), F.least(a["low"], e["low"], across).alias("low"))

    return F.aggregate(F.array_sort(F.collect_list(F.struct("slice", "prod", "top", "low", "floor"))), zero, join, lambda a: a["low"])


def block_bootstrap(returns: DataFrame, reps: int = 1000, value: str = "trade_return") -> DataFrame:
    """Mean and Sharpe with whole days resampled.

    Days are reduced to (count, sum, sum of squares) first, so a replicate
    touches days, not rows.
    """
    d = returns.where(F.col(value).isNotNull() & F.col("ts").isNotNull()).groupBy(F.date_trunc("day", "ts").alias("day"))
    d = d.agg(F.count(F.lit(1)).alias("c"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    base = numbered(d, ["day"])
    draws = replicate(base.select("id", "n"), reps).withColumn("src", pick(F.col("id"), F.col("rep"), F.col("n")))
    got = draws.join(base.select(F.col("id").alias("src"), "c", "s", "q"), "src").groupBy("rep").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, sh = moments()
    return interval(got.select("rep", mean.alias("mean"), sh.alias("sharpe")), {"mean": "mean_return_block", "sharpe": "sharpe_block"})


def interval(stats: DataFrame, names: dict[str, str]) -> DataFrame:
    """Centre and 2.5 / 97.5 % quantiles of each replicate statistic, one row.

    There are as many rows as replicates, a fixed number.
    """
    cols = []
    for src, out in names.items():
        q = F.percentile(src, F.array(lit(0.025), lit(0.975)))
        cols += [F.coalesce(F.avg(src), lit(0)).alias(out), F.coalesce(q[0], lit(0)).alias(f"{out}_ci_low"), F.coalesce(q[1], lit(0)).alias(f"{out}_ci_high")]
    return stats.agg(*cols)


def sign_flip(returns: DataFrame, order: Sequence[str], reps: int = 2000, value: str = "trade_return") -> DataFrame:
    """Share of random sign patterns with at least the observed absolute mean."""
    base = numbered(returns.where(F.col(value).isNotNull()).select(*order, number(value).alias("x")), order).select("id", "n", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(reps), 0
        for batch in batches:
            ids, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "x"))
            n += len(ids)
            for b in blocks(len(ids)):
                s += x[b] @ signs(ids[b], reps)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array(s), pa.array(np.full(reps, n))], names=["rep", "s", "n"])

    per = base.select("id", "x").mapInArrow(run, "rep long, s double, n long").groupBy("rep").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    seen = base.agg(F.struct(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).alias("v")).scalar()
    out = per.agg(F.avg(F.when(F.round(F.abs("m"), 12) >= F.round(F.abs(seen["m"]), 12), lit(1)).otherwise(lit(0))).alias("p"))
    few = seen["n"] < 5
    return out.select(F.when(few, lit(0)).otherwise(seen["m"]).alias("perm_stat"), F.when(few, lit(1)).otherwise(F.col("p")).alias("perm_pvalue"))


# ------------------------------------------------------------- candidates


def candidate_key(threshold: Column, holding: Column) -> Column:
    return F.concat(F.lit("thr="), F.format_string("%.4f", threshold), F.lit("|hp="), holding.cast("long").cast("string"))


def candidate_returns(trades: DataFrame) -> DataFrame:
    """Mean return per (ts, candidate), long form; missing pairs mean zero."""
    key = candidate_key(F.coalesce(number("threshold"), lit(0)), F.coalesce(number("holding_period"), lit(0)))
    return trades.groupBy("ts", key.alias("candidate")).agg(F.avg("trade_return").alias("ret"))


def candidate_matrix(trades: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Wide ts x candidate matrix for a known candidate list."""
    return candidate_returns(trades).groupBy("ts").pivot("candidate", list(candidates)).agg(F.first("ret")).na.fill(0.0)


def return_rows(long: DataFrame) -> DataFrame:
    """One row per timestamp: ts, id, n and v, the returns of all candidates in name order, zero where nothing traded.

    The candidate list is an array scalar (one entry per grid cell).
    """
    names = long.agg(F.array_sort(F.collect_set("candidate")).alias("v")).scalar()
    per = long.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "ret"))).alias("m"))
    ts = numbered(per, ["ts"]).withColumn("names", names)
    return ts.select("ts", "id", "n", "names", F.transform("names", lambda c: F.coalesce(F.try_element_at("m", c), lit(0))).alias("v"))


def dense_returns(long: DataFrame) -> DataFrame:
    """Every (ts, candidate) with zero where nothing traded, ts numbered."""
    wide = return_rows(long).withColumn("e", F.explode(F.arrays_zip(F.col("names").alias("candidate"), F.col("v").alias("ret"))))
    return wide.select("ts", "id", "n", "e.candidate", "e.ret")


def reality_check(long: DataFrame, reps: int = 1000) -> DataFrame:
    """Best candidate mean against the best centred bootstrap mean."""
    wide = return_rows(long)
    mean = wide.select(F.posexplode("v").alias("c", "ret")).groupBy("c").agg(F.avg("ret").alias("mu"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for batch in batches:
            v = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            rows = np.concatenate([np.ones((len(v), 1)), v], axis=1)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for b in blocks(len(ids)):
                part = weights(ids[b], reps).T @ rows[b]
                got = part if got is None else got + part
        if got is not None:
            each = got.shape[1] - 1
            cols = [np.repeat(np.arange(reps), each), np.tile(np.arange(each), reps), got[:, 1:].ravel(), np.repeat(got[:, 0], each)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["rep", "c", "s", "w"])

    sums = wide.select("id", "v").mapInArrow(run, "rep long, c long, s double, w double").groupBy("rep", "c").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    boot = sums.where("w > 0").join(mean, "c").select("rep", (F.col("s") / F.col("w") - F.col("mu")).alias("m"))
    best = boot.groupBy("rep").agg(F.max("m").alias("m"))
    seen = mean.agg(F.struct(F.max("mu").alias("s"), F.count(F.lit(1)).alias("k")).alias("v")).scalar()
    n = wide.agg(F.count(F.lit(1))).scalar()
    p = best.agg(F.avg(F.when(F.round("m", 12) >= F.round(seen["s"], 12), lit(1)).otherwise(lit(0))).alias("p"))
    return p.select(seen["s"].alias("white_stat"), F.when(n < 8, lit(1)).otherwise(F.col("p")).alias("white_pvalue"), seen["k"].cast("double").alias("n_candidates"), n.cast("double").alias("white_n_obs"))


def time_slices(long: DataFrame, wanted: int = 8) -> DataFrame:
    """Mean per (time slice, candidate); the slices are near-equal runs of timestamps."""
    d = dense_returns(long)
    k = F.greatest(F.lit(4), F.least(F.lit(wanted), F.least(F.lit(12), F.floor(F.col("n") / 3)))).cast("long")
    size, more = F.greatest(F.floor(F.col("n") / k), F.lit(1)), F.col("n") % k
    edge = more * (size + 1)
    part = F.when(F.col("id") < edge, F.floor(F.col("id") / (size + 1))).otherwise(more + F.floor((F.col("id") - edge) / size))
    return d.withColumns({"slice": part.cast("long"), "k": k}).groupBy("slice", "k", "n", "candidate").agg(F.avg("ret").alias("perf"))


def half_splits(slices: DataFrame) -> DataFrame:
    """All ways to choose half of the slices, as bit masks.

    The number of slices is at most twelve, so there are at most 924.
    """
    k = slices.agg(F.max("k")).scalar()
    return slices.sparkSession.range(4096).withColumn("k", k).where(F.expr("id < shiftleft(1, cast(k as int)) AND bit_count(id) = floor(k / 2)")).select(F.col("id").alias("combo"))


def overfit_trials(long: DataFrame, wanted: int = 8) -> DataFrame:
    """Per split: in-sample winner, its out-of-sample rank and the logit."""
    sl = time_slices(long, wanted)
    combos = half_splits(sl)
    # every split sees every slice: attach the (at most 924) splits as an array scalar
    all_ = combos.agg(F.array_sort(F.collect_list("combo")).alias("v")).scalar()
    x = sl.withColumn("combo", F.explode(all_))
    inside = F.expr("shiftright(combo, cast(slice as int)) % 2") == 1
    perf = x.groupBy("combo", "candidate").agg(F.round(F.avg(F.when(inside, F.col("perf"))), 12).alias("is_perf"), F.round(F.avg(F.when(~inside, F.col("perf"))), 12).alias("oos_perf"))
    w_is = W.partitionBy("combo").orderBy(F.col("is_perf").desc(), "candidate")
    w_oos = W.partitionBy("combo").orderBy(F.col("oos_perf").desc(), "candidate")
    ranked = perf.withColumns({"is_rank": F.row_number().over(w_is), "oos_rank": F.row_number().over(w_oos), "m": F.count(F.lit(1)).over(W.partitionBy("combo"))})
    win = ranked.where(F.col("is_rank") == 1)
    share = F.least(F.greatest(F.col("oos_rank") / (F.col("m") + 1.0), lit(1e-4)), lit(1.0 - 1e-4))
    return win.select("combo", F.col("m").cast("double").alias("n_configs"), F.col("candidate").alias("chosen_config"), F.col("is_rank").cast("double").alias("chosen_is_rank"), F.col("oos_rank").cast("double").alias("chosen_oos_rank"), F.log(share / F.greatest(1.0 - share, lit(1e-4))).alias("lambda"))


def overfit_probability(long: DataFrame, wanted: int = 8) -> DataFrame:
    """Share of splits whose in-sample winner lands in the worse half; missing when the data is too small."""
    size = long.agg(F.struct(F.countDistinct("ts").alias("n"), F.countDistinct("candidate").alias("c")).alias("v")).scalar()
    t = overfit_trials(long, wanted)
    row = t.agg(F.avg(F.when(F.col("lambda") > 0, lit(1)).otherwise(lit(0))).alias("p"), F.count(F.lit(1)).cast("double").alias("k"), F.percentile("lambda", 0.5).alias("med"))
    ok = (size["n"] >= 24) & (size["c"] >= 2)
    return row.select(
        F.when(ok, F.col("p")).alias("pbo"),
        F.when(ok, F.col("k")).otherwise(lit(0)).alias("pbo_trials"),
        F.when(ok, F.col("med")).alias("pbo_median_logit"),
        size["n"].cast("double").alias("pbo_n_obs"),
        size["c"].cast("double").alias("pbo_n_candidates"),
        F.when(ok, lit(1)).otherwise(lit(0)).alias("pbo_computable"),
        F.when(ok, "").otherwise("insufficient_matrix").alias("pbo_reason"),
    )


def shuffle_null(df: DataFrame, tie: Sequence[str], reps: int = 500, group: str = "market_id", x: str = "edge_raw", y: str = "trade_return") -> DataFrame:
    """Rank correlation of y and x against x reshuffled inside each group.

    A replicate pairs the k-th row of a group with the row at hashed position
    k, so only (row, replicate) keys are joined.
    """
    from marketlab.operators.ranking import average_rank

    base = df.select(*dict.fromkeys([*tie, group]), F.round(number(x, 0.0), 9).alias("_x"), F.round(number(y, 0.0), 9).alias("_y"))
    ranked = average_rank(average_rank(base, "_x", "rx"), "_y", "ry")
    pos = numbered(ranked, [group, *[t for t in tie if t != group]])
    # places by row are the same in every replicate
    by_row = replicate(pos.select("id", group, "ry").withColumn("k", F.row_number().over(W.partitionBy(group).orderBy("id"))), reps).select("rep", group, "k", "ry")
    drawn = replicate(pos.select("id", group, "rx"), reps).withColumn("h", draw(F.col("id"), F.col("rep")))
    by_hash = drawn.withColumn("k", F.row_number().over(W.partitionBy("rep", group).orderBy("h", "id"))).select("rep", group, "k", "rx")
    corr = by_row.join(by_hash, ["rep", group, "k"]).groupBy("rep").agg(correlation("rx", "ry").alias("c"))
    seen = ranked.agg(F.struct(correlation("rx", "ry").alias("c"), F.count(F.lit(1)).alias("n")).alias("v")).scalar()
    p = corr.where(F.col("c").isNotNull()).agg(F.avg(F.when(F.round(F.abs("c"), 12) >= F.round(F.abs(seen["c"]), 12), lit(1)).otherwise(lit(0))).alias("p"))
    return p.select(F.when((seen["n"] < 20) | seen["c"].isNull(), lit(1)).otherwise(F.coalesce("p", lit(1))).alias("null_shuffle_pvalue"), seen["c"].alias("observed"))
