"""Ingest jobs: landed payloads into warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlab.operators.returns import lagged_returns
from marketlab.session import materialise
from marketlab.sources import landing as L
from marketlab.sources.warehouse import Warehouse


def snapshot_job(w: Warehouse, market_raw: DataFrame, book_raw: DataFrame, seen: Column) -> None:
    """Markets, outcomes and books, then returns of the tokens that moved."""
    w.upsert("markets", L.markets(market_raw, seen))
    outcomes = w.upsert("market_outcomes", L.outcomes(market_raw))
    fresh = materialise(L.books(book_raw, outcomes.select("token_id", "market_id")))
    snaps = w.upsert("orderbook_snapshots", fresh)
    refresh_returns(w, snaps, fresh)


def refresh_returns(w: Warehouse, snapshots: DataFrame, fresh: DataFrame, lags: tuple[int, ...] = (1, 6, 24)) -> None:
    """Returns of the tokens in ``fresh`` from their first new quote on.

    Earlier returns do not change; of the history only the quotes the longest
    lag reaches back to are kept, cut per token inside each map task.
    """
    since = fresh.where(F.col("mid").isNotNull()).groupBy("token_id").agg(F.min("snapshot_ts").alias("_since"))
    s = snapshots.where(F.col("mid").isNotNull()).select("token_id", "snapshot_ts", "mid").join(since, "token_id")
    back = F.row_number().over(W.partitionBy("token_id").orderBy(F.col("snapshot_ts").desc()))
    past = s.where(F.col("snapshot_ts") < F.col("_since")).withColumn("_back", back).where(F.col("_back") <= max(lags)).drop("_back")
    s = materialise(past.unionByName(s.where(F.col("snapshot_ts") >= F.col("_since"))))
    new = lagged_returns(s, lags).join(since, "token_id").where(F.col("ts") >= F.col("_since")).drop("_since")
    w.upsert("returns", new)


def resolution_job(w: Warehouse, market_raw: DataFrame, seen: Column) -> None:
    """Closed markets with their inferred winners."""
    w.upsert("markets", L.markets(market_raw, seen))
    w.upsert("market_outcomes", L.outcomes(market_raw))
    res, winners = L.inferred_resolutions(market_raw)
    w.upsert("resolutions", res)
    w.upsert("market_outcomes", winners)


def trade_job(w: Warehouse, raw: DataFrame) -> None:
    """Trades with their market ids from the market table."""
    w.upsert("trades", L.remap_trades(L.trades(raw), w.read("markets").select("condition_id", "market_id")))


def holder_job(w: Warehouse, raw: DataFrame, seen: Column | None = None) -> None:
    w.upsert("holders", L.holders(raw, w.read("market_outcomes").select("token_id", "market_id"), seen))


def backfill_job(w: Warehouse, market_raw: DataFrame, seen: Column) -> None:
    """Resolved markets: resolutions, outcomes and the joined table."""
    resolution_job(w, market_raw, seen)
    w.upsert("resolved_markets", L.resolved_markets(L.markets(market_raw, seen), w.read("resolutions"), seen))
