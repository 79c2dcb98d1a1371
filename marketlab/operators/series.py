"""Row windows over series of any length.

Every series is cut into chunks of equal length along one total order (time,
then a hash of the row, so that quotes of one instant keep their places). A
chunk carries the neighbouring rows its windows reach, so lags, rolling frames
and leads see what they would see in the whole series, whatever the length of
a chunk; a series shorter than a chunk is one chunk without neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from marketlab.operators.ranking import rank_rows

CHUNK_ROWS = 100_000  # rows of one key that a window task sorts at once


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def split_series(df: DataFrame, key: str | Sequence[str], order: str, before: int, after: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Rows with their place ``_rn``, chunk ``_chunk`` and ``_halo`` (true for neighbours of a chunk).

    Chunks are at least as long as the reach, so one neighbour supplies it.
    """
    size = max(size, before, after, 1)
    pos = F.col("_rn") - 1
    chunk, off = F.floor(pos / size), pos % size
    copy = lambda c, halo: F.struct(c.cast("long").alias("c"), F.lit(halo).alias("h"))
    later = F.when((off >= size - before) & (pos + (size - off) < F.col("_n")), copy(chunk + 1, True))
    copies = F.array_compact(F.array(copy(chunk, False), later, F.when((off < after) & (chunk > 0), copy(chunk - 1, True))))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    cut = rank_rows(df, [F.col(order).asc(), tie.asc()], _names(key), "_rn", "_n").withColumn("_s", F.explode(copies))
    return cut.withColumns({"_chunk": F.col("_s.c"), "_halo": F.col("_s.h")}).drop("_s", "_n")


def series_window(df: DataFrame, key: str | Sequence[str], order: str) -> W:
    """Window inside a chunk along its places, or inside a key of a frame that was not split."""
    if "_chunk" in df.columns:
        return W.partitionBy(*_names(key), "_chunk").orderBy("_rn")
    return W.partitionBy(*_names(key)).orderBy(order)


def whole_series(df: DataFrame) -> DataFrame:
    """Drop neighbour rows and the marks of chunks."""
    return df.where(~F.col("_halo")).drop("_chunk", "_halo", "_rn") if "_halo" in df.columns else df
