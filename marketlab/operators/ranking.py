"""Exact ranks, equal-count bins and quantiles over groups of any size.

A window without partition keys (or with one dominant key) would put a whole
table in one task. Here rows are range partitioned by (keys, order), numbered
locally, written once to reliable storage, and shifted by the per-partition
offsets. No task ever holds more than its range slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlab.session import materialise

_SLOT_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def rank_rows(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), rank: str = "rn", total: str = "n_rows") -> DataFrame:
    """Add the 1-based position inside the group and the group size.

    ``order`` must be a total order for a repeatable result.
    """
    sort = [F.col(k).asc() for k in keys] + list(order)
    slots = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_slot", F.monotonically_increasing_id())
    slots = materialise(slots)
    part = F.shiftright("_slot", _SLOT_BITS)
    slots = slots.withColumn("_part", part).withColumn("_pos", F.col("_slot") - F.shiftleft(part, _SLOT_BITS))
    # one row per (group, partition): groups + partitions rows in total
    per = slots.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).withColumn(total, F.sum("_cnt").over(W.partitionBy(*keys)))
    if keys:
        right = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_rpart"), "_first", "_before", total)
        cond = slots["_part"] == right["_rpart"]
        for k in keys:
            cond = cond & slots[k].eqNullSafe(right[f"_k_{k}"])
        joined = slots.join(right, cond)
    else:
        # one row per range partition, so the broadcast is bounded by the partition count
        right = per.select(F.col("_part").alias("_rpart"), "_first", "_before", total)
        joined = slots.join(F.broadcast(right), slots["_part"] == right["_rpart"])
    out = joined.withColumn(rank, F.col("_pos") - F.col("_first") + F.col("_before") + 1)
    return out.select(*df.columns, rank, total)


def equal_count_bin(rank: Column, total: Column, bins: int) -> Column:
    """Bin number 0..bins-1 of a 1-based rank, cut at evenly spaced quantiles of the ranks."""
    up = F.ceil((rank - 1) * F.lit(bins) / F.greatest(total - 1, F.lit(1))).cast("long")
    return F.greatest(F.lit(0).cast("long"), up - 1)


def bin_rows(df: DataFrame, value: str | Column, bins: int, tie: Sequence[str], out: str = "bin", keys: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins over first-come ranks; ``tie`` makes the order total."""
    v = F.col(value) if isinstance(value, str) else value
    ranked = rank_rows(df.withColumn("_v", F.round(v, 9)), [F.col("_v").asc(), *[F.col(t).asc() for t in tie]], keys, "_rn", "_n")
    return ranked.withColumn(out, equal_count_bin(F.col("_rn"), F.col("_n"), bins)).drop("_v", "_rn", "_n")


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles: rows (keys, field, q, value).

    All wanted columns share one range shuffle of distinct values and their
    counts; missing values are ignored.
    """
    cols = list(wanted)
    long = (
        df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_s"))
        .select(*keys, "_s.field", "_s.value")
        .where(F.col("value").isNotNull())
    )
    grp = [*keys, "field"]
    # one row per value, so a value that fills a third of the table is one row of its slice
    counts = long.groupBy(*grp, "value").agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(counts, [F.col("value").asc()], {"_upto": F.col("_c")}, grp, {"_upto": "_n"})
    probs = F.create_map(*[x for c in cols for x in (F.lit(c), F.array(*[F.lit(float(q)) for q in wanted[c]]))])
    pos = (F.col("_n") - 1) * F.col("q")
    low = F.floor(pos + F.lit(1e-12)) + 1
    holds = lambda place: (F.col("_upto") - F.col("_c") < place) & (place <= F.col("_upto"))
    # keep only the one or two values around each target position
    return (
        ranked.withColumn("q", F.explode(probs[F.col("field")]))
        .where(holds(low) | holds(low + 1))
        .groupBy(*grp, "q")
        .agg(
            F.max(F.when(holds(low), F.col("value"))).alias("_lo"),
            F.max(F.when(holds(low + 1), F.col("value"))).alias("_hi"),
            F.first(pos - (low - 1)).alias("_w"),
        )
        .select(*grp, "q", (F.col("_lo") + F.greatest(F.col("_w"), F.lit(0.0)) * (F.coalesce("_hi", "_lo") - F.col("_lo"))).alias("value"))
    )


def quantile_row(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row with a named column per quantile: ``{"q1": ("vol", 0.33)}``."""
    fields: dict[str, list[float]] = {}
    for c, q in wanted.values():
        fields.setdefault(c, []).append(q)
    long = quantiles(df, fields)
    return long.agg(*[F.max(F.when((F.col("field") == c) & (F.abs(F.col("q") - q) < 1e-12), F.col("value"))).alias(name) for name, (c, q) in wanted.items()])


def quantile_groups(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """As :func:`quantile_row`, one row per key."""
    fields: dict[str, list[float]] = {}
    for c, q in wanted.values():
        fields.setdefault(c, []).append(q)
    long = quantiles(df, fields, keys)
    return long.groupBy(*keys).agg(
        *[F.max(F.when((F.col("field") == c) & (F.abs(F.col("q") - q) < 1e-12), F.col("value"))).alias(name) for name, (c, q) in wanted.items()]
    )


def average_rank(df: DataFrame, value: str, out: str = "avg_rank", keys: Sequence[str] = ()) -> DataFrame:
    """Tie-averaged rank of ``value``; equal values share the mean position.

    Ties are aggregated to one row per value first, so a hot value is one row.
    Rows meet their rank by value, so they are written once: a sum of doubles
    that is taken again may end in another digit and would find no rank.
    """
    df = materialise(df)
    values = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    ordered = prefix_sums(values, [F.col(value).asc()], {"_upto": F.col("_ties")}, keys)
    ranks = ordered.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_rv"), (F.col("_upto") - (F.col("_ties") - 1) / F.lit(2.0)).alias(out))
    cond = df[value].eqNullSafe(F.col("_rv"))
    for k in keys:
        cond = cond & df[k].eqNullSafe(F.col(f"_k_{k}"))
    return df.join(ranks, cond).select(*df.columns, out)


def prefix_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], keys: Sequence[str] = (), totals: Mapping[str, str] | None = None) -> DataFrame:
    """Inclusive running sums along ``order`` without a single-task window.

    ``totals`` names columns for group totals, by the sum they belong to.
    """
    totals = totals or {}
    sort = [F.col(k).asc() for k in keys] + list(order)
    slots = materialise(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_slot", F.monotonically_increasing_id()))
    slots = slots.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    inside = W.partitionBy(*keys, "_part").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    local = slots.withColumns({f"_l_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    per = slots.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_rpart"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(W.partitionBy(*keys)).alias(name) for n, name in totals.items()],
    )
    cond = local["_part"] == per["_rpart"]
    for k in keys:
        cond = cond & local[k].eqNullSafe(per[f"_k_{k}"])
    return local.join(per, cond).select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums], *totals.values())


def value_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins cut at value quantiles, right-closed, with equal edges merged.

    Unlike :func:`bin_rows` equal values always share a bin.
    """
    probs = [i / bins for i in range(bins + 1)]
    cuts = quantile_row(df.select(value), {f"q{i}": (value, p) for i, p in enumerate(probs)})
    edges = cuts.select(F.array_sort(F.array_distinct(F.array(*[F.round(f"q{i}", 12) for i in range(bins + 1)]))).alias("v")).scalar()
    x = df.withColumn("_edges", edges)
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    return x.withColumn(out, F.size(F.filter(inner, lambda e: e < F.round(F.col(value), 12))).cast("long")).drop("_edges")


def carry_forward(df: DataFrame, order: Sequence[Column], value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Latest non-null value at or before each row, for groups of any size.

    Values are carried inside range slices; the last value of earlier slices
    of the same group fills the gap at the start of a slice.
    """
    sort = [F.col(k).asc() for k in keys] + list(order)
    slots = materialise(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_slot", F.monotonically_increasing_id()))
    slots = slots.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    inside = W.partitionBy(*keys, "_part").orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    local = slots.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    per = slots.groupBy(*keys, "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_slot"))).alias("_last"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_rpart"), F.last("_last", ignorenulls=True).over(earlier).alias("_far"))
    cond = local["_part"] == per["_rpart"]
    for k in keys:
        cond = cond & local[k].eqNullSafe(per[f"_k_{k}"])
    return local.join(per, cond).select(*df.columns, F.coalesce("_near", "_far").alias(out))
