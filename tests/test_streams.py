"""Streams over several batches: late rows, expiring state, panes, replayed batches."""

import datetime as dt
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlab.sources.warehouse import Warehouse
from marketlab.streaming import streams as R

START = dt.datetime(2024, 3, 1)
QUOTE = "token_id long, ts timestamp, mid double"


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def land(spark, folder, rows, schema):
    """One file, one micro-batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def quotes_from(spark, folder):
    return spark.readStream.schema(QUOTE).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def by_definition(rows, keep_hours):
    d = pd.DataFrame(rows, columns=["token_id", "ts", "mid"]).sort_values(["token_id", "ts"])
    last, when = d.groupby("token_id")["mid"].shift(1), d.groupby("token_id")["ts"].shift(1)
    ok = (last > 0) & (d["ts"] - when <= pd.Timedelta(hours=keep_hours))
    d["ret"] = (d["mid"] / last - 1).where(ok)
    return {(int(t), s.to_pydatetime()): None if r != r else round(r, 9) for t, s, r in zip(d["token_id"], d["ts"], d["ret"])}


def test_running_returns_over_batches_with_gaps(spark, base):
    batches = [
        [(1, at(0), 0.5), (1, at(1), 0.6), (2, at(0.5), 0.4), (3, at(1), 0.0)],
        [(1, at(2), 0.3), (3, at(3), 0.2)],
        [(3, at(60), 0.3), (3, at(61), 0.6)],
        [(1, at(80), 0.5), (2, at(80), 0.5), (1, at(80.5), 0.25), (3, at(61 + 24), 0.3), (3, at(61 + 48.001), 0.9)],
    ]
    for rows in batches:
        land(spark, f"{base}/in", rows, QUOTE)
        R.drain(R.running_returns(quotes_from(spark, f"{base}/in"), "24 hours"), f"{base}/out", f"{base}/state")
    got = spark.read.parquet(f"{base}/out").collect()
    assert {(r["token_id"], r["ts"]): None if r["ret_1"] is None else round(r["ret_1"], 9) for r in got} == by_definition(sum(batches, []), 24)


def test_running_returns_state_expires(spark, base):
    def run():
        s = R.running_returns(quotes_from(spark, f"{base}/in"), "24 hours")
        q = s.writeStream.format("noop").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    land(spark, f"{base}/in", [(k, at(0), 0.5) for k in range(40)], QUOTE)
    assert run() == 40
    land(spark, f"{base}/in", [(99, at(72), 0.5)], QUOTE)
    assert run() == 1


def test_late_rows_are_kept_and_counted(spark, base):
    schema = "ts timestamp, v long"
    batches = [
        [(at(0.5), 1), (at(10), 2), (None, 3)],
        [(at(0.7), 4), (at(8.9), 5), (at(9.2), 6), (at(9.9), 7), (None, 8), (at(30), 9)],  # windows ended by 09:50 are late
        [(at(20), 10), (at(29.5), 11), (at(20), 10)],
    ]
    for rows in batches:
        land(spark, f"{base}/in", rows, schema)
        R.split_late(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/state")
    got = spark.read.schema(f"{schema}, late boolean").parquet(f"{base}/out/rows").collect()
    assert sorted(r["v"] for r in got if r["late"]) == [4, 5, 10, 10]
    assert sorted(r["v"] for r in got if not r["late"]) == [1, 2, 3, 6, 7, 8, 9, 11]


def test_sliding_legs_from_panes(spark, base):
    rows = [(at(h), m, leg) for h, m, leg in [(0.2, 1, "yes"), (3.1, 1, "no"), (3.5, 1, "no"), (3.6, 2, "yes"), (26, 1, "yes"), (27.5, 2, "no"), (90, 9, "yes")]]
    schema = "ts timestamp, market_id long, outcome_label string"
    land(spark, f"{base}/in", rows, schema)
    s = R.sliding_legs(spark.readStream.schema(schema).parquet(f"{base}/in"))
    got = {(r["start"], r["market_id"]): (r["y"], r["n"]) for r in R.drain(s, f"{base}/out", f"{base}/state").collect()}
    want: dict = {}
    for ts, m, leg in rows:
        hour = ts.replace(minute=0, second=0, microsecond=0)
        for k in range(24):
            w = hour - dt.timedelta(hours=k)
            if w + dt.timedelta(hours=24) <= at(90) - dt.timedelta(minutes=10):
                y, n = want.get((w, m), (0, 0))
                want[(w, m)] = (max(y, int(leg == "yes")), max(n, int(leg == "no")))
    assert got == want


def test_replayed_batch_is_written_once(spark, base):
    w = Warehouse(spark, base)
    rows = spark.range(5).select(F.concat(F.lit("e"), "id").alias(w_column()))
    assert w.upsert("edge_results", rows, batch="s#0").count() == 5
    assert w.upsert("edge_results", rows, batch="s#0").count() == 5
    assert w.upsert("edge_results", rows, batch="s#1").count() == 10
    assert w.upsert("edge_results", rows).count() == 15  # without a name every write counts


def w_column() -> str:
    from marketlab.sources.schemas import TABLES

    return next(f.name for f in TABLES["edge_results"].fields if f.dataType.simpleString() == "string")


def test_half_finished_write_is_cleared(spark, base):
    w = Warehouse(spark, base)
    new = spark.createDataFrame([("t", START, 0.5)], "token_id string, ts timestamp, ret_1h double")
    w.upsert("returns", new)
    # the next version reached the folder but not the log
    half = w.read("returns").withColumns({"day": F.lit("2024-03-01"), "version": F.lit(2).cast("long")})
    half.write.mode("append").partitionBy("day", "version").parquet(w.path("returns"))
    assert w.read("returns").count() == 1
    got = w.upsert("returns", new.withColumn("ret_1h", F.lit(0.7))).collect()
    assert [r["ret_1h"] for r in got] == [0.7]


def test_retire_job_keeps_what_is_read(spark, base):
    import os

    from marketlab.plans.cli import main

    w = Warehouse(spark, base)
    for v in (0.1, 0.2, 0.3):
        w.upsert("returns", spark.createDataFrame([("t", START, v)], "token_id string, ts timestamp, ret_1h double"))
    w.upsert("edge_results", spark.range(3).select(F.col("id").cast("string").alias(w_column())))
    w.upsert("edge_results", spark.range(2).select(F.col("id").cast("string").alias(w_column())))
    main(["retire", "--warehouse", base])
    assert os.listdir(f"{base}/returns/day=2024-03-01") == ["version=3"]
    assert [r["ret_1h"] for r in w.read("returns").collect()] == [0.3]
    assert w.read("edge_results").count() == 5
