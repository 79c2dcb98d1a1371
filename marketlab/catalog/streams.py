"""Stream queries over the event files, compared with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketlab.catalog.ingest import scratch
from marketlab.catalog.registry import query
from marketlab.sources.warehouse import Warehouse
from marketlab.streaming import streams as R


def fresh(lake, name: str) -> tuple[str, str]:
    base = scratch(lake, f"{name}-{uuid.uuid4().hex[:8]}")
    return f"{base}/out", f"{base}/state"


def trades(lake):
    """Events as trades: user is token and wallet, value the amount."""
    side = F.when(F.col("event_type") == "purchase", "BUY").when(F.col("event_type") == "click", "SELL").otherwise("NONE")
    return R.event_stream(lake.spark, lake.path).select("event_id", "ts", F.col("user_id").alias("token_id"), F.col("user_id").alias("trader"), side.alias("side"), F.col("value").alias("notional"))


_LAST = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("r1_deduplicated_stream", "SELECT count(DISTINCT (date_trunc('hour', ts), user_id)) AS n_keys, true AS one_row_per_key FROM events")
def r1(lake):
    s = R.event_stream(lake.spark, lake.path).withColumn("snapshot_ts", F.date_trunc("hour", "ts"))
    # the watermark spans the file, so every repeat meets its first copy
    d = R.first_per_key(s.select("snapshot_ts", "user_id", "value"), "snapshot_ts", ["snapshot_ts", "user_id"], "60 days")
    got = R.drain(d, *fresh(lake, "r1"))
    return got.agg(F.countDistinct("snapshot_ts", "user_id").alias("n_keys"), (F.count(F.lit(1)) == F.countDistinct("snapshot_ts", "user_id")).alias("one_row_per_key"))


@query("r2_hourly_flow", f"SELECT date_trunc('hour', ts) AS hr, user_id AS token_id, sum(value) AS trade_notional, count(*) AS trade_count, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS buy_notional, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS sell_notional FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_LAST} GROUP BY 1, 2", "", "trade_notional buy_notional sell_notional")
def r2(lake):
    return R.drain(R.tumbling_flow(trades(lake)), *fresh(lake, "r2"))


@query("r3_sliding_coverage", f"SELECT start, start + INTERVAL 24 HOUR AS \"end\", avg((y = 1 AND n = 1)::INT) AS both_legs_coverage, count(*) AS markets FROM (SELECT start, user_id // 2 AS m, max((user_id % 2 = 0)::INT) AS y, max((user_id % 2 = 1)::INT) AS n FROM (SELECT user_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start FROM events, (SELECT unnest(range(24)) AS k)) WHERE start + INTERVAL 24 HOUR <= {_LAST} GROUP BY 1, 2) GROUP BY 1", "", "both_legs_coverage")
def r3(lake):
    out, state = fresh(lake, "r3")
    b = R.event_stream(lake.spark, lake.path).select("ts", F.floor(F.col("user_id") / 2).cast("long").alias("market_id"), F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no").alias("outcome_label"))

    def batch(df, epoch):
        # a window closes in exactly one batch, so the batch file is final
        R.coverage(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    R.each_batch(R.sliding_legs(b), batch, state)
    return lake.spark.read.schema("start timestamp, end timestamp, both_legs_coverage double, markets long").parquet(out).drop("epoch")


@query("r4_wallet_sessions", f"SELECT trader, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS trades, sum(value) AS total_notional FROM (SELECT *, sum(brk) OVER (PARTITION BY trader ORDER BY ts, event_id) AS sid FROM (SELECT *, user_id AS trader, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY trader, sid HAVING max(ts) + INTERVAL 2 HOUR <= {_LAST}", "", "total_notional")
def r4(lake):
    return R.drain(R.sessions(trades(lake)), *fresh(lake, "r4"))


@query("r5_running_returns", "SELECT user_id AS token_id, ts, (value + 1.2345678::DOUBLE) / 1000 AS mid, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 3 DAY THEN (value + 1.2345678::DOUBLE) / lag(value + 1.2345678::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts) - 1 END AS ret_1 FROM events", "", "mid ret_1")
def r5(lake):
    q = R.event_stream(lake.spark, lake.path).select(F.col("user_id").alias("token_id"), "ts", ((F.col("value") + 1.2345678) / 1000).alias("mid"))
    return R.drain(R.running_returns(q, "3 days"), *fresh(lake, "r5"))


_ARRIVAL = "CAST(date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) // 7 AS BIGINT) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END"


@query("r2_late_rows", f"WITH a AS (SELECT ts, {_ARRIVAL} AS k FROM events), s AS (SELECT k, max(ts) AS high FROM a GROUP BY 1), m AS (SELECT k, max(high) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM s) SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (WHERE NOT late) AS accepted, count(*) FILTER (WHERE late) AS late FROM (SELECT ts, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark - INTERVAL 10 MINUTE, false) AS late FROM a JOIN m USING (k)) GROUP BY 1")
def r2_late(lake):
    """Events land week by week, each tenth a week late; every landing is one restart of the stream."""
    out, state = fresh(lake, "r2late")
    e = lake.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.floor(F.datediff("ts", e.agg(F.min(F.to_date("ts"))).scalar()) / 7)
    e = e.withColumn("k", week + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).select("event_id", "ts", "k")
    landed = f"{out}/landed"
    for k in sorted(r[0] for r in e.select("k").distinct().collect()):  # weeks of the history
        e.where(F.col("k") == k).select("event_id", "ts").write.mode("append").parquet(landed)
        R.split_late(lake.spark.readStream.schema("event_id long, ts timestamp").parquet(landed), out, state)
    got = lake.spark.read.schema("event_id long, ts timestamp, late boolean").parquet(f"{out}/rows")
    return got.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count_if(~F.col("late")).alias("accepted"), F.count_if("late").alias("late"))


@query("r6_upsert_sink", "SELECT token_id, ts, round(value, 6) AS ret_1h FROM (SELECT user_id::VARCHAR AS token_id, date_trunc('hour', ts) AS ts, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY value DESC) AS rn FROM events) WHERE rn = 1", "", "ret_1h")
def r6(lake):
    out, state = fresh(lake, "r6")
    w = Warehouse(lake.spark, out)
    s = R.event_stream(lake.spark, lake.path).select(F.col("user_id").cast("string").alias("token_id"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("ret_1h"))
    R.upsert_sink(s, w, "returns", state, ["ret_1h"])
    return w.read("returns").select("token_id", "ts", "ret_1h")
