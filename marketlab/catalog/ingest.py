"""Landing, upsert and sink queries over payloads derived from the driver tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from marketlab.catalog.registry import CTES, memo, query
from marketlab.catalog.scoring import edges_of, metrics_long
from marketlab.catalog.trading import signal_of, trades_of
from marketlab.functions.columns import lit
from marketlab.operators import summary as R
from marketlab.session import ensure_checkpoint_dir
from marketlab.sources import landing as L, warehouse as H
from marketlab.sources.schemas import KEYS, TABLES

SEEN = "2024-02-01 00:00:00"


def scratch(lake, name: str) -> str:
    """A folder for query output next to the reliable checkpoints."""
    ensure_checkpoint_dir(lake.spark)
    base = lake.spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{abs(hash(lake.path)) % 10**8}-{os.getpid()}"


def market_payloads(lake):
    """One JSON text per market: mixed id kinds, encoded lists, tag objects, epoch and ISO times."""
    i = F.col("market_id")
    yes, no = (2 * i).cast("string"), (2 * i + 1).cast("string")
    quote = lambda *xs: F.concat(F.lit('["'), F.concat_ws('","', *xs), F.lit('"]'))
    won = F.floor(i / 3) % 2
    prices = F.when(i % 3 != 0, quote(F.lit("0.6"), F.lit("0.4"))).when(won == 0, quote(F.lit("0.99"), F.lit("bad"))).otherwise(quote(F.lit("0.01"), F.lit("0.97")))
    tokens = F.array(*[F.struct(t.alias("token_id"), ((i % 3 == 0) & (won == k)).alias("winner"), F.lit(n).alias("outcome")) for k, (t, n) in enumerate(((yes, "Yes"), (no, "No")))])
    p = F.struct(
        F.when(i % 2 == 0, i.cast("string")).otherwise(i.cast("string")).alias("id"),
        F.when(F.col("event_id").isNotNull(), F.array(F.struct(F.col("event_id").alias("id")))).alias("events"),
        F.when(i % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("Will market "), i.cast("string"), F.lit(" win?"))).alias("question"),
        F.concat(F.lit("Title "), i.cast("string")).alias("title"),
        F.col("category"),
        F.array(F.struct(F.lit("sports").alias("label"))).alias("tags"),
        F.col("condition_id").alias("conditionId"),
        F.unix_seconds("created_ts").alias("createdAt"),
        F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("endDate"),
        (F.unix_seconds("close_ts") * 1000).alias("closeDate"),
        F.col("active"),
        quote(F.lit("Yes"), F.lit("No")).alias("outcomes"),
        quote(yes, no).alias("clobTokenIds"),
        prices.alias("outcomePrices"),
        tokens.alias("tokens"),
    )
    return lake.markets.select(F.to_json(p).alias("raw_json"))


@query(
    "s1_market_rows",
    "SELECT market_id::VARCHAR AS market_id, event_id, CASE WHEN market_id % 4 = 1 THEN 'Title ' || market_id::VARCHAR ELSE 'Will market ' || market_id::VARCHAR || ' win?' END AS question, category, '[\"sports\"]' AS tags, condition_id, created_ts, end_ts, close_ts, active, false AS closed, TIMESTAMP '2024-02-01' AS last_seen_ts FROM mkt",
    "mkt",
)
def s1(lake):
    return L.markets(market_payloads(lake), F.lit(SEEN)).select("market_id", "event_id", "question", "category", "tags", "condition_id", "created_ts", "end_ts", "close_ts", "active", "closed", "last_seen_ts")


@query("s2_outcome_rows", "SELECT o.market_id::VARCHAR AS market_id, o.token_id::VARCHAR AS token_id, o.outcome_index, o.outcome_label, coalesce(r.winner_token_id = o.token_id, false) AS winner FROM (SELECT market_id, 2 * market_id + k AS token_id, k::BIGINT AS outcome_index, CASE WHEN k = 0 THEN 'Yes' ELSE 'No' END AS outcome_label FROM mkt, (SELECT unnest([0, 1]) AS k)) o LEFT JOIN res r ON r.market_id = o.market_id", "mkt res")
def s2(lake):
    return L.outcomes(market_payloads(lake))


def book_payloads(lake):
    """Book records from raw events: one per day and user, every event a price level."""
    e = lake.table("events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "user_id", "event_id", "event_type", "value")
    px = F.col("value") / (F.col("value") + 50.0)
    level = F.struct(F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(px.cast("string")).alias("price"), (F.col("event_id") % 100 + 1).cast("string").alias("size"))
    side = lambda *k: F.collect_list(F.when(F.col("event_type").isin(*k), level))
    g = e.groupBy("d", "user_id").agg(side("purchase", "click").alias("bids"), side("view", "signup").alias("asks"))
    return g.select(F.to_json(F.struct(F.col("user_id").cast("string").alias("asset_id"), F.unix_seconds("d").alias("snapshot_ts"), "bids", "asks")).alias("raw_json"))


CTES["lev"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS d, user_id, value / (value + 50) AS p, (event_id % 100 + 1)::DOUBLE AS s, CASE WHEN event_type IN ('purchase', 'click') THEN 'b' WHEN event_type IN ('view', 'signup') THEN 'a' END AS side FROM events WHERE event_id % 17 <> 0"
CTES["levr"] = "SELECT *, row_number() OVER (PARTITION BY d, user_id, side ORDER BY CASE WHEN side = 'b' THEN -p ELSE p END, s) AS rn FROM lev WHERE side IS NOT NULL"
CTES["bk"] = "SELECT d, user_id, max(p) FILTER (WHERE side = 'b') AS bb, min(p) FILTER (WHERE side = 'a') AS ba FROM levr GROUP BY 1, 2"


@query("s3_book_rows", "SELECT d AS snapshot_ts, user_id::VARCHAR AS token_id, floor(user_id / 2)::BIGINT::VARCHAR AS market_id, bb AS best_bid, ba AS best_ask, CASE WHEN bb IS NOT NULL AND ba IS NOT NULL THEN (bb + ba) / 2 ELSE coalesce(bb, ba) END AS mid, CASE WHEN bb IS NOT NULL AND ba IS NOT NULL THEN ba - bb ELSE 0 END AS spread FROM bk", "bk", "best_bid best_ask mid spread")
def s3(lake):
    return L.books(book_payloads(lake), lake.outcomes).select("snapshot_ts", "token_id", "market_id", "best_bid", "best_ask", "mid", "spread")


CTES["bkd"] = "SELECT d, user_id, max(p) FILTER (WHERE side = 'b') AS bb, min(p) FILTER (WHERE side = 'a') AS ba, coalesce(sum(s) FILTER (WHERE side = 'b' AND rn <= 5), 0) AS bd, coalesce(sum(s) FILTER (WHERE side = 'a' AND rn <= 5), 0) AS ad FROM levr GROUP BY 1, 2"
CTES["bkm"] = "SELECT *, CASE WHEN bb IS NOT NULL AND ba IS NOT NULL THEN (bb + ba) / 2 ELSE coalesce(bb, ba) END AS m, CASE WHEN bb IS NOT NULL AND ba IS NOT NULL THEN ba - bb ELSE 0 END AS sp FROM bkd"


@query("s3_book_depth", "SELECT d AS snapshot_ts, user_id::VARCHAR AS token_id, bd AS bid_depth, ad AS ask_depth, CASE WHEN m <> 0 THEN sp / m * 10000 END AS spread_bps, least(coalesce(nullif(bb, 0), m) * bd, coalesce(nullif(ba, 0), m) * ad) AS liquidity_score FROM bkm", "bkm", "bid_depth ask_depth spread_bps liquidity_score")
def s3b(lake):
    return L.books(book_payloads(lake), lake.outcomes).select("snapshot_ts", "token_id", "bid_depth", "ask_depth", "spread_bps", "liquidity_score")


def trade_payloads(lake):
    """Trade records with the id chain, lower-case sides and some unreadable prices."""
    t = lake.trades
    i = F.col("trade_id")
    p = F.struct(
        F.when(i % 3 == 0, i.cast("string")).alias("id"),
        F.when(i % 3 == 1, i.cast("string")).alias("tradeID"),
        F.concat(F.lit("h"), i.cast("string")).alias("transactionHash"),
        F.when(F.col("market_id") % 5 == 0, "0xunknown").otherwise(F.concat(F.lit("0x"), F.col("market_id").cast("string"))).alias("conditionId"),
        F.col("token_id").cast("string").alias("asset"),
        F.lower("side").alias("side"),
        F.when(i % 101 == 0, "").otherwise(F.col("size").cast("string")).alias("size"),
        F.round("price", 6).cast("string").alias("price"),
        F.col("trader").cast("string").alias("proxyWallet"),
        F.unix_millis("trade_ts").alias("timestamp"),
        F.col("market_id").cast("string").alias("requested_market"),
    )
    return t.select(F.to_json(p).alias("raw_json"))


CTES["trp"] = "SELECT CASE WHEN trade_id % 3 = 2 THEN 'h' ELSE '' END || trade_id::VARCHAR AS trade_id, token_id::VARCHAR AS token_id, market_id::VARCHAR AS market_id, trader::VARCHAR AS trader, side, round(price, 6) AS price, size, round(price, 6) * size AS notional, trade_ts, 'h' || trade_id::VARCHAR AS tx_hash FROM trd WHERE trade_id % 101 <> 0"


@query("s4_trade_rows", "SELECT * EXCLUDE (market_id) FROM trp", "trp", "price size notional")
def s4(lake):
    return L.trades(trade_payloads(lake)).drop("raw_json", "requested_market", "market_id")


@query("s12_trade_remap", "SELECT trade_id, token_id, trader, trade_ts, market_id FROM trp", "trp")
def s12(lake):
    return L.remap_trades(L.trades(trade_payloads(lake)), lake.markets).select("trade_id", "token_id", "trader", "trade_ts", "market_id")


def holder_payloads(lake):
    """Pages of holder lists per token and day from the trades."""
    h = F.struct(F.when(F.col("trader") % 7 != 0, F.col("trader").cast("string")).alias("proxyWallet"), F.col("size").cast("string").alias("balance"), F.when(F.col("trade_id") % 2 == 0, "x").otherwise("0.5").alias("percent"))
    g = lake.trades.groupBy("token_id", F.date_trunc("day", "trade_ts").alias("d"), (F.col("trade_id") % 50).alias("page")).agg(F.collect_list(h).alias("holders"))
    return g.select(F.to_json(F.struct(F.col("token_id").cast("string").alias("token"), F.unix_seconds("d").alias("snapshot_ts"), "holders")).alias("raw_json"))


_HOLD = "SELECT date_trunc('day', trade_ts)::TIMESTAMP AS snapshot_ts, market_id::VARCHAR AS market_id, trader::VARCHAR AS wallet, token_id::VARCHAR AS outcome, size AS shares, CASE WHEN trade_id % 2 <> 0 THEN 0.5::DOUBLE END AS pct FROM trd WHERE trader % 7 <> 0"


@query("s5_holder_rows", _HOLD, "trd", "shares pct")
def s5(lake):
    return L.holders(holder_payloads(lake), lake.outcomes)


@query("s13_holder_ingest", f"SELECT snapshot_ts, market_id, wallet, outcome, count(*) AS n FROM ({_HOLD}) GROUP BY ALL", "trd")
def s13(lake):
    h = L.holders(holder_payloads(lake), lake.outcomes)
    return h.groupBy("snapshot_ts", "market_id", "wallet", "outcome").agg(F.count(F.lit(1)).alias("n"))


_RESQ = "SELECT market_id::VARCHAR AS market_id, winner_token_id::VARCHAR AS winner_token_id, (winner_token_id % 2)::BIGINT AS winner_outcome_index, CASE WHEN winner_token_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS winner_label FROM res"


@query("s6_explicit_resolutions", _RESQ, "res")
def s6(lake):
    return L.explicit_resolutions(market_payloads(lake))[0].select("market_id", "winner_token_id", "winner_outcome_index", "winner_label")


@query("s7_inferred_resolutions", _RESQ, "res")
def s7(lake):
    return L.inferred_resolutions(market_payloads(lake))[0].select("market_id", "winner_token_id", "winner_outcome_index", "winner_label")


@query("s7_inferred_winners", "SELECT r.market_id::VARCHAR AS market_id, (2 * r.market_id + k)::VARCHAR AS token_id, k::BIGINT AS outcome_index, 2 * r.market_id + k = r.winner_token_id AS winner FROM res r, (SELECT unnest([0, 1]) AS k)", "res")
def s7b(lake):
    return L.inferred_resolutions(market_payloads(lake))[1].select("market_id", "token_id", "outcome_index", "winner")


@query("s8_keyed_upsert", "SELECT trade_id, token_id, price, size FROM (SELECT *, row_number() OVER (PARTITION BY trade_id ORDER BY src DESC, trade_ts DESC, token_id DESC, price DESC, size DESC) AS rn FROM (SELECT *, (trader % 2)::INT AS src FROM trd)) WHERE rn = 1", "trd", "price size")
def s8(lake):
    t = lake.trades.select("trade_id", "token_id", "price", "size", "trade_ts", "trader")
    old, new = t.where("trader % 2 = 0").drop("trader"), t.where("trader % 2 = 1").drop("trader")
    return H.upsert(old, new, ["trade_id"], ["trade_ts", "token_id", "price", "size"]).drop("trade_ts")


def table_frames(lake):
    """A frame for each table of the warehouse, made from the driver tables by the library's own operators."""
    from marketlab.catalog.edges import links_of
    from marketlab.operators import linking
    from marketlab.operators.returns import lagged_returns

    snaps, payloads = lake.snapshots, market_payloads(lake)
    trades = trades_of(lake).where("threshold = 0.15 AND holding_period = 3")
    run = F.lit("run1").alias("run_id")
    curve = R.equity_curve(trades)
    return {
        "markets": lake.markets,
        "market_outcomes": lake.outcomes,
        "orderbook_snapshots": snaps,
        "price_history": snaps.where("mid IS NOT NULL").select("token_id", F.col("snapshot_ts").alias("ts"), "market_id", F.col("mid").alias("price")),
        "trades": lake.trades,
        "holders": L.holders(holder_payloads(lake), lake.outcomes),
        "resolutions": lake.resolutions,
        "resolved_markets": L.resolved_markets(L.markets(payloads, F.lit(SEEN)), L.inferred_resolutions(payloads)[0], F.lit(SEEN)),
        "market_links": links_of(lake),
        "outcome_links": linking.outcome_links(lake.outcomes),
        "market_sets": linking.market_sets(lake.texts.select("market_id", "event_id", "category", "question", "active")),
        "returns": lagged_returns(snaps),
        "edge_results": metrics_long(lake),
        "backtest_runs": curve.agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("equity").alias("total_pnl")).select(run, "start_ts", "end_ts", "total_pnl"),
        "backtest_timeseries": curve.select(run, "ts", "equity"),
        "backtest_trades": trades.select(run, "ts", "token_id", "market_id"),
    }


_CELL = "FROM {} WHERE threshold = 0.15 AND holding_period = 3"
_ROWS = {
    "markets": "FROM mkt",
    "market_outcomes": "FROM outc",
    "orderbook_snapshots": "FROM snap",
    "price_history": "FROM snap WHERE mid IS NOT NULL",
    "trades": "FROM trd",
    "holders": f"FROM ({_HOLD})",
    "resolutions": "FROM res",
    "resolved_markets": "FROM mkt",
    "market_links": "FROM links12",
    "outcome_links": "FROM outc y JOIN outc n ON n.market_id = y.market_id WHERE y.outcome_label = 'Yes' AND n.outcome_label = 'No'",
    "market_sets": "FROM mset",
    "returns": "FROM snap WHERE mid IS NOT NULL",
    "edge_results": "FROM melong",
    "backtest_runs": "FROM (SELECT 1)",
    "backtest_timeseries": _CELL.format("tr_eq"),
    "backtest_trades": _CELL.format("tr"),
}
_S9 = " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n_rows, {len(KEYS[name])}::BIGINT AS n_keys, {len(spec.fields)}::BIGINT AS n_columns {_ROWS[name]}" for name, spec in TABLES.items())


@query("s9_warehouse_schema", _S9, "mkt outc snap trd res links12 mset melong tr_eq tr")
def s9(lake):
    rows, frames = None, table_frames(lake)
    for name, spec in TABLES.items():
        df = frames[name]
        typed = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.fields])
        # the cast rows count, so that a value its column cannot hold fails the query
        full = F.count(F.struct(*[F.col(f.name) for f in spec.fields]))
        r = typed.agg(full.alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(KEYS[name])).alias("n_keys"), F.lit(len(spec.fields)).alias("n_columns"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


def snapshot_ingest(lake):
    from marketlab.plans.ingest import snapshot_job

    key = "_wh"
    if key not in lake.__dict__:
        w = H.Warehouse(lake.spark, scratch(lake, "warehouse"))
        snapshot_job(w, market_payloads(lake), book_payloads(lake), F.lit(SEEN))
        lake.__dict__[key] = w
    return lake.__dict__[key]


@query("s10_snapshot_ingest", "SELECT 'markets' AS name, count(*) AS n_rows FROM mkt UNION ALL SELECT 'market_outcomes', 2 * count(*) FROM mkt UNION ALL SELECT 'orderbook_snapshots', count(*) FROM bk UNION ALL SELECT 'returns', count(*) FROM bk", "mkt bk")
def s10(lake):
    w = snapshot_ingest(lake)
    rows = None
    for t in ("markets", "market_outcomes", "orderbook_snapshots", "returns"):
        r = w.read(t).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("name"), "n_rows")
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("s11_resolution_refresh", _RESQ, "res")
def s11(lake):
    from marketlab.plans.ingest import resolution_job

    w = H.Warehouse(lake.spark, scratch(lake, "resolutions"))
    resolution_job(w, market_payloads(lake), F.lit(SEEN))
    return w.read("resolutions").select("market_id", "winner_token_id", "winner_outcome_index", "winner_label")


@query("s14_resolved_backfill", "SELECT m.market_id::VARCHAR AS market_id, m.event_id, m.category, r.winner_token_id::VARCHAR AS winner_token_id, m.close_ts, TIMESTAMP '2024-02-01' AS last_backfill_ts FROM mkt m LEFT JOIN res r ON r.market_id = m.market_id", "mkt res")
def s14(lake):
    p = market_payloads(lake)
    return L.resolved_markets(L.markets(p, F.lit(SEEN)), L.inferred_resolutions(p)[0], F.lit(SEEN)).select("market_id", "event_id", "category", "winner_token_id", "close_ts", "last_backfill_ts")


@query("f9_timestamp_parsing", "SELECT event_id, date_trunc('second', ts) AS from_seconds, date_trunc('millisecond', ts) AS from_millis, ts AS from_nanos, date_trunc('second', ts) AS from_iso FROM events", "")
def f9(lake):
    e = lake.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = lambda c: c.cast("string")
    return e.select(
        "event_id",
        L.instant(s(F.unix_seconds("ts"))).alias("from_seconds"),
        L.instant(s(F.unix_millis("ts"))).alias("from_millis"),
        L.instant(s(F.unix_micros("ts") * 1000 + 7)).alias("from_nanos"),
        L.instant(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("from_iso"),
    )


@query("f10_json_lists", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n, CASE WHEN event_id % 3 = 0 THEN event_type END AS first_item FROM events", "")
def f10(lake):
    e = lake.table("events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('",5]'))).when(F.col("event_id") % 3 == 1, F.lit("[broken"))
    lst = L.text_list(raw)
    return e.select("event_id", F.size(lst).alias("n"), F.get(lst, 0).alias("first_item"))


@query("f15_object_to_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"event\":\"' || event_type || '\",\"k\":' || json_extract(props, '$.k')::VARCHAR || '}' AS meta_json FROM events", "")
def f15(lake):
    e = lake.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select("event_id", "k", F.to_json(F.struct(F.col("event_type").alias("event"), "k")).alias("meta_json"))


@query("s17_strategy_artifacts", "SELECT 'signals' AS name, count(*) AS n_rows FROM sig UNION ALL SELECT 'test_trades', count(*) FROM tr UNION ALL SELECT 'cost_decomposition', 1", "sig tr")
def s17(lake):
    root = scratch(lake, "artifacts")
    frames = {"signals": signal_of(lake), "test_trades": trades_of(lake), "cost_decomposition": R.cost_decomposition(trades_of(lake))}
    H.write_frames(frames, root, "momentum", csv=("cost_decomposition",))
    rows = None
    for n in frames:
        r = lake.spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows")
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("s18_run_reports", "SELECT (SELECT count(*) FROM edg) AS n_edges, (SELECT count(DISTINCT ts) FROM sig) AS n_unique_ts", "edg sig")
def s18(lake):
    root = scratch(lake, "run")
    summary = signal_of(lake).agg(F.countDistinct("ts").alias("n_unique_ts"))
    H.write_run({"edges": edges_of(lake)}, summary, root)
    back = lake.spark.read.schema("n_unique_ts long").json(f"{root}/run_summary")
    n = lake.spark.read.parquet(f"{root}/edges").agg(F.count(F.lit(1))).scalar()
    return back.select(n.alias("n_edges"), "n_unique_ts")


@query("s20_csv_scan", "SELECT category, n, notional FROM (SELECT coalesce(m.category, 'unknown') AS category, count(*) AS n, sum(t.size) AS notional FROM trd t LEFT JOIN mkt m ON m.market_id = t.market_id GROUP BY 1)", "trd mkt", "notional")
def s20(lake):
    root = scratch(lake, "csv")
    t = lake.trades.join(lake.markets.select("market_id", "category"), "market_id", "left")
    t.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("notional")).write.mode("overwrite").option("header", True).csv(root)
    got = H.read_csv(lake.spark, root, "category string, n long, notional double")
    return got.unionByName(H.read_csv(lake.spark, root + "-missing", "category string, n long, notional double"))


@query("s21_run_tables", "SELECT 'run1' AS run_id, count(*) AS n_points, max(equity) AS top_equity FROM tr_eq WHERE threshold = 0.15 AND holding_period = 3", "tr_eq", "top_equity")
def s21(lake):
    w = H.Warehouse(lake.spark, scratch(lake, "runs"))
    c = R.equity_curve(trades_of(lake).where("threshold = 0.15 AND holding_period = 3"))
    w.upsert("backtest_timeseries", c.select(F.lit("run1").alias("run_id"), "ts", "equity", F.lit(None).cast("double").alias("cash"), F.lit(None).cast("double").alias("gross_exposure"), F.lit(None).cast("double").alias("net_exposure")))
    got = w.upsert("backtest_timeseries", c.select(F.lit("run1").alias("run_id"), "ts", "equity"))
    return got.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_points"), F.max("equity").alias("top_equity"))
