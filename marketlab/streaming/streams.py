"""Structured Streaming jobs; each has a batch twin in the operators.

All take a streaming frame with an event time of type ``timestamp`` and
return a streaming frame or start a sink. State is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlab.functions.columns import flag, lit
from marketlab.sources.warehouse import Warehouse, exists


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_batch: int = 100) -> DataFrame:
    """File stream of the event tables in a folder, with a zoned event time.

    ``files_per_batch`` bounds a micro-batch, and with it the rows per key.
    """
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def first_per_key(events: DataFrame, ts: str, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """One row per key inside the watermark: repeated snapshots are dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling_flow(trades: DataFrame, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes", token: str = "token_id", amount: str = "notional", side: str = "side") -> DataFrame:
    """Traded amount per token and window, split by side; late rows are dropped."""
    part = lambda s: F.sum(F.when(F.upper(side) == s, F.col(amount)).otherwise(lit(0)))
    g = trades.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), token)
    return g.agg(F.sum(amount).alias("trade_notional"), F.count(F.lit(1)).alias("trade_count"), part("BUY").alias("buy_notional"), part("SELL").alias("sell_notional")).select(F.col("w.start").alias("hr"), token, "trade_notional", "trade_count", "buy_notional", "sell_notional")


def sliding_legs(books: DataFrame, ts: str = "ts", width: str = "24 hours", slide: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Leg presence per market and sliding window; the share is taken per batch by :func:`coverage`.

    Two chained aggregations: rows meet in panes of one slide, and only closed
    panes (one row per market and pane) are spread over the windows they lie in.
    ``width`` is a multiple of ``slide``.
    """
    both = lambda y, n: (F.max(y).alias("y"), F.max(n).alias("n"))
    yes, no = flag(F.col("outcome_label") == "yes"), flag(F.col("outcome_label") == "no")
    panes = books.withWatermark(ts, delay).groupBy(F.window(ts, slide).alias("pane"), "market_id").agg(*both(yes, no))
    g = panes.groupBy(F.window(F.window_time("pane"), width, slide).alias("w"), "market_id").agg(*both("y", "n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "market_id", "y", "n")


def coverage(legs: DataFrame) -> DataFrame:
    """Second aggregation of :func:`sliding_legs`, for ``foreachBatch``."""
    return legs.groupBy("start", "end").agg(F.avg(flag((F.col("y") == 1) & (F.col("n") == 1))).alias("both_legs_coverage"), F.count(F.lit(1)).alias("markets"))


def sessions(trades: DataFrame, ts: str = "ts", gap: str = "2 hours", delay: str = "10 minutes", wallet: str = "trader", amount: str = "notional") -> DataFrame:
    """Activity sessions per wallet, closed after a gap."""
    g = trades.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), wallet)
    return g.agg(F.count(F.lit(1)).alias("trades"), F.sum(amount).alias("total_notional")).select(wallet, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "trades", "total_notional")


def _running(keep: pd.Timedelta) -> Callable:
    """Last quote of one token kept as state; each batch is put in time order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values("ts", kind="stable")
        last_ts, last = state.get if state.exists else (None, None)
        # quotes older than the state arrive too late and are dropped
        if last_ts is not None:
            rows = rows[rows["ts"] > last_ts]
        if len(rows):
            before, when = rows["mid"].shift(1), rows["ts"].shift(1)
            if last_ts is not None:
                before.iloc[0], when.iloc[0] = last, last_ts
            # a quote as old as that may have left the state already: it never counts
            ret = (rows["mid"] / before - 1.0).where((before > 0) & (rows["ts"] - when <= keep))
            state.update((rows["ts"].iloc[-1].to_pydatetime(), float(rows["mid"].iloc[-1])))
            end = int(rows["ms"].iloc[-1]) + keep // pd.Timedelta(milliseconds=1)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs()) + 1)
            yield pd.DataFrame({"token_id": key[0], "ts": rows["ts"], "mid": rows["mid"], "ret_1": ret})
        elif state.exists:
            end = int(pd.Timestamp(last_ts).value // 1_000_000) + keep // pd.Timedelta(milliseconds=1)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs()) + 1)

    return step


def running_returns(quotes: DataFrame, keep: str = "3 days", delay: str = "1 hour") -> DataFrame:
    """Return of each quote against the token's previous one, one state row per token.

    The return is null without a quote in the last ``keep``. State of a token is
    removed once the watermark is that far past its last quote, so state is
    bounded by the tokens of ``keep``; what has left it is no longer needed, and
    results do not depend on when it left.
    """
    rows = quotes.withWatermark("ts", delay).select("token_id", "ts", "mid", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("token_id").applyInPandasWithState(_running(pd.Timedelta(keep)), "token_id long, ts timestamp, mid double, ret_1 double", "ts timestamp, mid double", "append", GroupStateTimeout.EventTimeTimeout)


def split_late(stream: DataFrame, out: str, state: str, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> None:
    """Write all rows to ``out``/rows with a flag ``late``, so that late rows are kept and counted.

    A row is late if its window of ``width`` had ended ``delay`` before the
    newest event of the batches before its own. That newest event is written
    per batch beside the rows; a batch that runs again overwrites what it wrote
    and reads the marks of earlier batches only. A null time is never late.
    """
    spark = stream.sparkSession
    marks = "high long, epoch long"

    def batch(df: DataFrame, epoch: int) -> None:
        seen = None
        if epoch and exists(spark, f"{out}/marks"):
            seen = spark.read.schema(marks).parquet(f"{out}/marks").where(F.col("epoch") < epoch).agg(F.max("high")).first()[0]
        closed = F.timestamp_micros(F.lit(seen).cast("long")) - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.window(ts, width)["end"] <= closed, F.lit(False))
        at = f"{out}/rows/epoch={epoch}"
        # the window expression drops null times
        timed = df.where(F.col(ts).isNotNull()).withColumn("late", late)
        timed.unionByName(df.where(F.col(ts).isNull()).withColumn("late", F.lit(False))).write.mode("overwrite").parquet(at)
        spark.read.schema(df.schema).parquet(at).agg(F.unix_micros(F.max(ts)).alias("high")).write.mode("overwrite").parquet(f"{out}/marks/epoch={epoch}")

    each_batch(stream, batch, state)


def drain(stream: DataFrame, out: str, state: str, mode: str = "append") -> DataFrame:
    """Process everything available into Parquet and read it back."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    q = stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def upsert_sink(stream: DataFrame, warehouse: Warehouse, table: str, state: str, order: Sequence[str] = ()) -> None:
    """Keyed upsert of every micro-batch; a batch that runs again is written once, also in tables without a key."""
    each_batch(stream, lambda df, epoch: (warehouse.upsert(table, df, order, batch=f"{state}#{epoch}"), None)[1], state)
