"""Domain tables derived from the driver's Parquet tables.

``Lake`` maps the TPC-H-like tables onto the shapes of the market warehouse,
whole tables and whole texts, so that every operator can run on real volume.
``VIEWS`` states the same views as SQL for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from marketlab.functions.columns import float_ratio
from marketlab.session import materialise


def _stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


class Lake:
    """The views of one folder. Snapshots and the tables made of them are written once.

    Later joins then know how small markets, outcomes and resolutions are before
    they start, so trades and snapshots are not shuffled to meet them.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def snapshots(self) -> DataFrame:
        """Order-book snapshots: one row per day and token, from ``events``."""
        e = self.table("events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("snapshot_ts"), "user_id", "event_type", "value")
        side = lambda *kinds: F.round(F.sum(F.when(F.col("event_type").isin(*kinds), F.col("value")).otherwise(F.lit(0.0))), 6)
        b = (
            e.groupBy("snapshot_ts", F.col("user_id").alias("token_id"))
            .agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"), side("purchase", "click").alias("bid_depth"), side("view", "signup").alias("ask_depth"))
            .withColumn("m", F.round(F.col("v") / (F.col("v") + 50.0), 12))
            .withColumn("hs", F.lit(4e-3) * (1 + F.col("n") % 3))
        )
        b = b.select(
            "snapshot_ts",
            F.floor(F.col("token_id") / 2).cast("long").alias("market_id"),
            "token_id",
            F.when(F.col("bid_depth") > 0, F.col("m") - F.col("hs")).alias("best_bid"),
            F.when(F.col("ask_depth") > 0, F.col("m") + F.col("hs")).alias("best_ask"),
            F.col("m").alias("mid"),
            (2 * F.col("hs")).alias("spread"),
            (float_ratio(2 * F.col("hs"), F.col("m")) * 10000).alias("spread_bps"),
            "bid_depth",
            "ask_depth",
            F.least("bid_depth", "ask_depth").alias("liquidity_score"),
        )
        return materialise(b)

    @cached_property
    def outcomes(self) -> DataFrame:
        t = self.table("events").select(F.col("user_id").alias("token_id")).distinct()
        t = t.select(
            F.floor(F.col("token_id") / 2).cast("long").alias("market_id"),
            "token_id",
            (F.col("token_id") % 2).cast("int").alias("outcome_index"),
            F.when(F.col("token_id") % 2 == 0, "Yes").otherwise("No").alias("outcome_label"),
        )
        return materialise(t)

    @cached_property
    def markets(self) -> DataFrame:
        m = self.outcomes.select("market_id").distinct()
        day = lambda base, n: _stamp(base) + F.make_dt_interval(days=n.cast("int"))
        i = F.col("market_id")
        m = m.select(
            "market_id",
            F.when(i % 11 != 10, F.concat(F.lit("e"), (i % 10).cast("string"))).alias("event_id"),
            F.when(i % 13 != 12, F.concat(F.lit("c"), (i % 5).cast("string"))).alias("category"),
            F.concat(F.lit("0x"), i.cast("string")).alias("condition_id"),
            day("2023-12-01 00:00:00", i % 20).alias("created_ts"),
            day("2024-02-05 00:00:00", i % 7).alias("end_ts"),
            F.when(i % 2 == 0, day("2024-02-01 00:00:00", i % 9)).alias("close_ts"),
            (i % 4 != 3).alias("active"),
        )
        return materialise(m)

    @cached_property
    def resolutions(self) -> DataFrame:
        i = F.col("market_id")
        r = self.markets.where(i % 3 == 0).select(
            "market_id",
            _stamp("2024-01-31 00:00:00").alias("resolved_ts"),
            (2 * i + F.floor(i / 3).cast("long") % 2).alias("winner_token_id"),
        )
        return materialise(r)

    @cached_property
    def trades(self) -> DataFrame:
        """Trades from ``lineitem``; ids repeat, tokens match the snapshots."""
        k = self.table("events").agg(F.max("user_id") + 1).scalar()
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        price = unit / (unit + 1000.0)
        return (
            self.table("lineitem")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("size"), price.alias("price"))
            .withColumn("token_id", F.col("l_partkey") % k)
            .select(
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
                F.floor(F.col("token_id") / 2).cast("long").alias("market_id"),
                "token_id",
                F.col("l_suppkey").alias("trader"),
                F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
                "price",
                "size",
                (F.col("price") * F.col("size")).alias("notional"),
                (_stamp("2024-01-01 00:00:00") + F.make_dt_interval(hours=((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 720).cast("int"))).alias("trade_ts"),
            )
        )

    @cached_property
    def texts(self) -> DataFrame:
        """Market texts from ``documents``: first line as question, the rest as description."""
        t = F.col("text")
        return self.table("documents").select(
            F.col("doc_id").alias("market_id"),
            F.col("source").alias("event_id"),
            F.col("lang").alias("category"),
            F.regexp_extract(t, r"^([^\n]*)", 1).alias("question"),
            F.regexp_replace(t, r"^[^\n]*\n?", "").alias("description"),
            (F.col("doc_id") % 2 == 0).alias("active"),
        )

    @cached_property
    def labelled(self) -> DataFrame:
        """Snapshots with their outcome label."""
        lab = F.when(F.col("token_id") % 2 == 0, "Yes").otherwise("No")
        return self.snapshots.withColumn("outcome_label", lab)


VIEWS: dict[str, str] = {
    "snap": """
SELECT snapshot_ts, CAST(floor(token_id / 2) AS BIGINT) AS market_id, token_id,
       CASE WHEN bid_depth > 0 THEN m - hs END AS best_bid,
       CASE WHEN ask_depth > 0 THEN m + hs END AS best_ask,
       m AS mid, 2 * hs AS spread, 2 * hs / m * 10000 AS spread_bps,
       bid_depth, ask_depth, least(bid_depth, ask_depth) AS liquidity_score,
       CASE WHEN token_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS outcome_label
FROM (SELECT *, round(v / (v + 50), 12) AS m, 4e-3 * (1 + n % 3) AS hs FROM (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS snapshot_ts, user_id AS token_id,
         avg(value) AS v, count(*) AS n,
         round(sum(CASE WHEN event_type IN ('purchase', 'click') THEN value ELSE 0 END), 6) AS bid_depth,
         round(sum(CASE WHEN event_type IN ('view', 'signup') THEN value ELSE 0 END), 6) AS ask_depth
  FROM events GROUP BY 1, 2))""",
    "outc": """
SELECT CAST(floor(token_id / 2) AS BIGINT) AS market_id, token_id,
       CAST(token_id % 2 AS INTEGER) AS outcome_index,
       CASE WHEN token_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS outcome_label
FROM (SELECT DISTINCT user_id AS token_id FROM events)""",
    "mkt": """
SELECT market_id,
       CASE WHEN market_id % 11 <> 10 THEN 'e' || CAST(market_id % 10 AS VARCHAR) END AS event_id,
       CASE WHEN market_id % 13 <> 12 THEN 'c' || CAST(market_id % 5 AS VARCHAR) END AS category,
       '0x' || CAST(market_id AS VARCHAR) AS condition_id,
       TIMESTAMP '2023-12-01 00:00:00' + INTERVAL '1' DAY * CAST(market_id % 20 AS INT) AS created_ts,
       TIMESTAMP '2024-02-05 00:00:00' + INTERVAL '1' DAY * CAST(market_id % 7 AS INT) AS end_ts,
       CASE WHEN market_id % 2 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' DAY * CAST(market_id % 9 AS INT) END AS close_ts,
       market_id % 4 <> 3 AS active
FROM (SELECT DISTINCT CAST(floor(user_id / 2) AS BIGINT) AS market_id FROM events)""",
    "res": """
SELECT market_id, TIMESTAMP '2024-01-31 00:00:00' AS resolved_ts,
       2 * market_id + CAST(floor(market_id / 3) AS BIGINT) % 2 AS winner_token_id
FROM (SELECT DISTINCT CAST(floor(user_id / 2) AS BIGINT) AS market_id FROM events) WHERE market_id % 3 = 0""",
    "trd": """
SELECT trade_id, CAST(floor(token_id / 2) AS BIGINT) AS market_id, token_id, trader, side, price, size,
       price * size AS notional, trade_ts
FROM (SELECT l_orderkey * 10 + l_linenumber AS trade_id,
       l_partkey % (SELECT max(user_id) + 1 FROM events) AS token_id,
       l_suppkey AS trader,
       CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
       (l_extendedprice / l_quantity) / (l_extendedprice / l_quantity + 1000) AS price,
       l_quantity AS size,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST((l_orderkey * 7 + l_linenumber) % 720 AS INT) AS trade_ts
FROM lineitem)""",
    "txt": r"""
SELECT doc_id AS market_id, source AS event_id, lang AS category,
       regexp_extract(text, '^([^\n]*)', 1) AS question,
       regexp_replace(text, '^[^\n]*\n?', '') AS description,
       doc_id % 2 = 0 AS active
FROM documents""",
}
