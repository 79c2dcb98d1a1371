"""Warehouse tables and payload schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "t": T.TimestampType(), "b": T.BooleanType(), "i": T.IntegerType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


# the 16 tables of the warehouse: columns and kinds (s text, t time, b flag, i int, d number)
TABLES: dict[str, T.StructType] = {
    "markets": _table("market_id:s event_id:s slug:s question:s description:s category:s tags:s condition_id:s start_ts:t end_ts:t close_ts:t active:b closed:b archived:b accepting_orders:b created_ts:t updated_ts:t last_seen_ts:t raw_json:s"),
    "market_outcomes": _table("market_id:s token_id:s outcome_index:i outcome_label:s winner:b"),
    "orderbook_snapshots": _table("snapshot_ts:t market_id:s token_id:s best_bid:d best_ask:d mid:d spread:d spread_bps:d bid_depth:d ask_depth:d liquidity_score:d"),
    "price_history": _table("token_id:s ts:t market_id:s price:d"),
    "trades": _table("trade_id:s market_id:s token_id:s trader:s side:s price:d size:d notional:d trade_ts:t tx_hash:s raw_json:s"),
    "holders": _table("snapshot_ts:t market_id:s wallet:s outcome:s shares:d pct:d"),
    "resolutions": _table("market_id:s resolved_ts:t winner_token_id:s winner_outcome_index:i winner_label:s resolution_source:s raw_json:s"),
    "resolved_markets": _table("market_id:s event_id:s question:s category:s resolved_ts:t winner_token_id:s winner_label:s resolution_source:s close_ts:t last_backfill_ts:t raw_json:s"),
    "market_links": _table("link_id:s market_id_a:s market_id_b:s relation_type:s link_confidence:d heuristic_source:s created_ts:t updated_ts:t metadata_json:s"),
    "outcome_links": _table("market_id:s yes_token_id:s no_token_id:s link_source:s created_ts:t updated_ts:t metadata_json:s"),
    "market_sets": _table("set_id:s market_id:s outcome_label:s weight:d set_type:s link_confidence:d created_ts:t updated_ts:t metadata_json:s"),
    "returns": _table("token_id:s ts:t ret_1h:d ret_6h:d ret_24h:d"),
    "edge_results": _table("run_ts:t edge_name:s entity_id:s metric_name:s metric_value:d meta_json:s"),
    "backtest_runs": _table("run_id:s run_ts:t strategy_name:s start_ts:t end_ts:t total_pnl:d sharpe:d max_drawdown:d metadata_json:s"),
    "backtest_timeseries": _table("run_id:s ts:t equity:d cash:d gross_exposure:d net_exposure:d"),
    "backtest_trades": _table("run_id:s ts:t token_id:s market_id:s qty:d fill_price:d fee_paid:d slippage_paid:d notional:d side:s"),
}

# primary keys; tables without one are append-only
KEYS: dict[str, tuple[str, ...]] = {
    "markets": ("market_id",),
    "market_outcomes": ("market_id", "token_id"),
    "orderbook_snapshots": ("snapshot_ts", "token_id"),
    "price_history": ("token_id", "ts"),
    # fills of one transaction share its hash, so the id alone is not enough
    "trades": ("trade_id", "token_id", "trader", "trade_ts"),
    "holders": ("snapshot_ts", "market_id", "wallet", "outcome"),
    "resolutions": ("market_id",),
    "resolved_markets": ("market_id",),
    "market_links": ("link_id",),
    "outcome_links": ("market_id",),
    "market_sets": ("set_id", "market_id"),
    "returns": ("token_id", "ts"),
    "edge_results": (),
    "backtest_runs": ("run_id",),
    "backtest_timeseries": ("run_id", "ts"),
    "backtest_trades": (),
}

# the column whose day partitions a table
DAY_OF = {"orderbook_snapshots": "snapshot_ts", "price_history": "ts", "trades": "trade_ts", "holders": "snapshot_ts", "returns": "ts"}

# payloads; fields that arrive in several shapes are read as raw JSON text
_TOKEN = "struct<token_id:string,tokenId:string,id:string,winner:boolean,outcome:string>"
MARKET_PAYLOAD = (
    "id string, events array<struct<id:string>>, slug string, question string, title string, description string, category string, tags string, conditionId string, "
    "startDate string, endDate string, closeDate string, closedTime string, createdAt string, updatedAt string, end_date_iso string, active boolean, closed boolean, archived boolean, acceptingOrders boolean, "
    f"outcomes string, clobTokenIds string, outcomePrices string, tokens array<{_TOKEN}>, resolutionSource string, resolve_source string"
)
BOOK_PAYLOAD = "asset_id string, token_id string, market string, snapshot_ts string, bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>"
TRADE_PAYLOAD = "id string, tradeID string, transactionHash string, market string, conditionId string, asset string, tokenId string, token_id string, side string, price string, size string, proxyWallet string, maker string, user string, timestamp string, lastUpdate string, requested_market string"
HOLDER_PAYLOAD = "token string, asset string, snapshot_ts string, holders array<struct<proxyWallet:string,wallet:string,shares:string,balance:string,percent:string,outcome:string>>"
