"""Top-k, keep-first and keep-last operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by a max aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], top: int) -> DataFrame:
    """Best row per key, then the best ``top`` keys overall."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct((-F.col(score)).alias("_neg"), *[F.col(c) for c in tie])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return best.orderBy(F.col(score).desc(), *keys).limit(top)


def newest_first(df: DataFrame, ts: str, tie: Sequence[str], top: int) -> DataFrame:
    """Newest rows, missing times last."""
    return df.orderBy(F.col(ts).desc_nulls_last(), *tie).limit(top)


def latest_slice(df: DataFrame, key: str, score: Column, tie: Sequence[str], top: int) -> DataFrame:
    """Rows of the newest timestamp, the best ``top`` per key."""
    now = df.where(F.col("ts") == df.agg(F.max("ts")).scalar())
    w = W.partitionBy(key).orderBy(score.desc(), *tie)
    return now.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).drop("_rn")
