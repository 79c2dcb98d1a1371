"""Landed JSON files to warehouse rows, and upserts."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketlab.plans.ingest import backfill_job, snapshot_job, trade_job
from marketlab.sources import landing as L
from marketlab.sources.warehouse import Warehouse, read_csv, upsert

SEEN = "2024-03-01 00:00:00"
MARKETS = [
    {"id": 7, "title": "Fallback", "events": [{"id": 3}], "tags": ["a", {"label": "b"}], "outcomes": '["Yes","No"]', "clobTokenIds": '["y","n"]', "outcomePrices": '["0.99","0.01"]', "createdAt": 1700000000, "endDate": "2024-02-01T00:00:00Z", "closedTime": 1706745600000, "active": True, "conditionId": "0xa", "tokens": [{"token_id": "y", "winner": True}]},
    {"id": "8", "question": "Q?", "outcomes": ["Yes"], "clobTokenIds": ["z"], "outcomePrices": "broken", "closeDate": "nonsense", "conditionId": "0xb"},
]
BOOKS = [
    {"asset_id": "y", "snapshot_ts": 1704067200, "bids": [{"price": "0.40", "size": "5"}, {"price": "0.45", "size": "1"}, {"price": "x", "size": "1"}], "asks": [{"price": "0.55", "size": "2"}]},
    {"asset_id": "n", "snapshot_ts": 1704067200, "bids": [], "asks": [{"price": 0.6, "size": 3}]},
    {"asset_id": "z", "snapshot_ts": 1704067200, "bids": [], "asks": []},
]
TRADES = [
    {"id": "", "transactionHash": "h1", "conditionId": "0xa", "asset": "y", "side": "buy", "price": "0.5", "size": "4", "proxyWallet": "w", "timestamp": 1704067200, "requested_market": "7"},
    {"id": "t2", "conditionId": "0xzz", "asset": "y", "side": "SELL", "price": "bad", "size": "4", "requested_market": "7"},
    {"id": "t3", "conditionId": "0xzz", "asset": "y", "side": "SELL", "price": 0.4, "size": 1, "timestamp": 1704067200123, "requested_market": "7"},
]


@pytest.fixture()
def landed(spark, tmp_path):
    def write(name, records):
        p = tmp_path / f"{name}.json"
        p.write_text("\n".join(json.dumps(r) for r in records))
        return L.read_lines(spark, str(p))

    return {"markets": write("markets", MARKETS), "books": write("books", BOOKS), "trades": write("trades", TRADES)}


def test_market_and_outcome_rows(landed):
    m = {r["market_id"]: r for r in L.markets(landed["markets"], F.lit(SEEN)).collect()}
    assert m["7"]["question"] == "Fallback" and m["7"]["event_id"] == "3" and json.loads(m["7"]["tags"]) == ["a", "b"]
    assert m["7"]["created_ts"] == dt.datetime(2023, 11, 14, 22, 13, 20) and m["7"]["end_ts"] == dt.datetime(2024, 2, 1)
    assert m["8"]["close_ts"] is None and m["8"]["active"] is False and json.loads(m["7"]["raw_json"])["id"] == 7
    o = {(r["market_id"], r["token_id"]): r["winner"] for r in L.outcomes(landed["markets"]).collect()}
    assert o == {("7", "y"): True, ("7", "n"): False, ("8", "z"): False}


def test_inferred_resolution(landed):
    res, rows = L.inferred_resolutions(landed["markets"])
    r = res.collect()
    assert len(r) == 1 and r[0]["winner_token_id"] == "y" and r[0]["winner_label"] == "Yes" and r[0]["resolved_ts"] == dt.datetime(2024, 2, 1)
    assert rows.count() == 2


def test_books_and_trades(spark, landed):
    tm = spark.createDataFrame([("y", "7"), ("n", "7")], "token_id string, market_id string")
    b = {r["token_id"]: r for r in L.books(landed["books"], tm).collect()}
    assert set(b) == {"y", "n"}
    assert b["y"]["best_bid"] == 0.45 and b["y"]["bid_depth"] == 6 and b["y"]["mid"] == pytest.approx(0.5) and b["y"]["spread_bps"] == pytest.approx(2000)
    assert b["n"]["mid"] == 0.6 and b["n"]["spread"] == 0 and b["n"]["liquidity_score"] == 0
    t = {r["trade_id"]: r for r in L.remap_trades(L.trades(landed["trades"]), spark.createDataFrame([("0xa", "7")], "condition_id string, market_id string")).collect()}
    assert set(t) == {"h1", "t3"} and t["h1"]["side"] == "BUY" and t["t3"]["market_id"] == "7"
    assert t["t3"]["trade_ts"] == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)


def test_jobs_are_idempotent(spark, landed, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    for _ in range(2):
        snapshot_job(w, landed["markets"], landed["books"], F.lit(SEEN))
        trade_job(w, landed["trades"])
        backfill_job(w, landed["markets"], F.lit(SEEN))
    assert w.read("markets").count() == 2 and w.read("orderbook_snapshots").count() == 2 and w.read("trades").count() == 2
    assert w.read("resolved_markets").where("winner_token_id = 'y'").count() == 1
    assert w.read("market_outcomes").where("winner").count() == 1


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_missing_csv_is_empty(spark, tmp_path):
    assert read_csv(spark, str(tmp_path / "none"), "a int").count() == 0


def test_upsert_touches_only_its_days(spark, tmp_path):
    from marketlab.sources.warehouse import Warehouse

    t = lambda d, h: dt.datetime(2024, 3, d, h)
    cols = "token_id string, ts timestamp, ret_1h double"
    w = Warehouse(spark, str(tmp_path))
    w.upsert("returns", spark.createDataFrame([("a", t(1, 1), 0.1), ("a", t(2, 1), 0.2), ("a", t(2, 1), 0.3)], cols))
    before = w._live("returns")
    got = w.upsert("returns", spark.createDataFrame([("a", t(2, 1), 0.9), ("b", t(2, 5), 0.4)], cols))
    assert w._live("returns") == [("2024-03-01", 1), ("2024-03-02", 2)] != before
    assert sorted((r["token_id"], r["ret_1h"]) for r in got.collect()) == [("a", 0.1), ("a", 0.9), ("b", 0.4)]
    assert w.retire("returns") == 1 and w.retire("returns") >= 0
    assert w.read("returns").count() == 3
    assert w.read("trades").count() == 0


def test_repeated_key_is_settled_the_same_way(spark):
    from marketlab.sources.warehouse import upsert

    old = spark.createDataFrame([], "k long, v double")
    rows = [(1, 0.5), (1, 0.7), (1, 0.6), (2, 0.1)]
    got = [sorted(map(tuple, upsert(old, spark.createDataFrame(r, "k long, v double"), ["k"]).collect())) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 2


def test_broken_table_is_an_error(spark, tmp_path):
    import pytest

    from marketlab.sources.warehouse import Warehouse

    (tmp_path / "_log").mkdir()
    (tmp_path / "_log" / "returns").mkdir()
    (tmp_path / "_log" / "returns" / "part-0.parquet").write_text("no table")
    with pytest.raises(Exception):
        Warehouse(spark, str(tmp_path)).read("returns")


def test_trades_of_one_unknown_id_are_split(spark):
    """A condition id that a fifth of all trades carry must not end in one task when markets are too many to broadcast."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        i = F.col("id")
        t = spark.range(0, 200_000, 1, 8).select(F.concat(F.lit("h"), F.xxhash64(i).cast("string")).alias("trade_id"), F.when(i % 5 < 3, "0xunknown").otherwise(F.concat(F.lit("0x"), (i % 1000).cast("string"))).alias("market_id"), (i % 1000).cast("string").alias("requested_market"))
        m = spark.range(1000).select(F.concat(F.lit("0x"), F.col("id").cast("string")).alias("condition_id"), (F.col("id") + 5000).alias("market_id"))
        out = L.remap_trades(t, m)
        got = {r["market_id"] for r in out.collect()}
        assert got == {str(n) for n in range(1000) if n % 5 < 3} | {str(n + 5000) for n in range(1000) if n % 5 >= 3}
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
