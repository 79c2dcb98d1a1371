"""Landed JSON to warehouse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlab.functions.columns import lit, number
from marketlab.session import materialise
from marketlab.sources import schemas as S


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines landing files as raw text, one record per row."""
    return spark.read.text(path).withColumnRenamed("value", "raw_json")


def parse(raw: DataFrame, schema: str) -> DataFrame:
    """Typed fields next to the untouched record text."""
    kept = [c for c in raw.columns if c != "raw_json"]
    return raw.select(*kept, F.from_json("raw_json", schema).alias("_p"), "raw_json").select(*kept, "_p.*", "raw_json")


def text(*names: str) -> Column:
    """First non-empty of several text fields."""
    return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])


def instant(x: Column | str) -> Column:
    """Seconds, milliseconds, nanoseconds by magnitude, or ISO text; floored to microseconds."""
    c = F.col(x) if isinstance(x, str) else x
    n = c.try_cast("double")
    big = c.try_cast("decimal(38,0)")
    micros = F.when(n < 1e11, F.floor(n * 1e6)).when(n < 1e14, F.floor(n * 1e3)).otherwise(F.floor(big / F.lit(1000)))
    return F.when(n.isNotNull(), F.timestamp_micros(micros.cast("long"))).otherwise(c.try_cast("timestamp"))


def text_list(x: Column | str) -> Column:
    """A list or a JSON-encoded list as an array of texts; anything else is empty."""
    c = F.col(x) if isinstance(x, str) else x
    once = F.from_json(c, "array<string>")
    return F.coalesce(F.filter(once, lambda v: F.lit(True)), F.array().cast("array<string>"))


def markets(raw: DataFrame, seen: Column) -> DataFrame:
    """Market rows from market payloads."""
    p = parse(raw, S.MARKET_PAYLOAD)
    tag = lambda x: F.coalesce(F.get_json_object(x, "$.label"), x)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return p.select(
        F.col("id").alias("market_id"),
        F.get(F.col("events"), 0)["id"].alias("event_id"),
        "slug",
        text("question", "title").alias("question"),
        "description",
        "category",
        F.to_json(F.transform(text_list("tags"), tag)).alias("tags"),
        F.col("conditionId").alias("condition_id"),
        instant("startDate").alias("start_ts"),
        instant("endDate").alias("end_ts"),
        instant("closeDate").alias("close_ts"),
        yes("active").alias("active"),
        yes("closed").alias("closed"),
        yes("archived").alias("archived"),
        yes("acceptingOrders").alias("accepting_orders"),
        instant("createdAt").alias("created_ts"),
        instant("updatedAt").alias("updated_ts"),
        seen.cast("timestamp").alias("last_seen_ts"),
        "raw_json",
    )


def _token_key(t: Column) -> Column:
    pick = lambda c: F.when(t[c] != "", t[c])
    return F.coalesce(pick("token_id"), pick("tokenId"), pick("id"))


def outcomes(raw: DataFrame) -> DataFrame:
    """Outcome rows: labels zipped with token ids, winners looked up by token."""
    p = parse(raw, S.MARKET_PAYLOAD)
    known = F.filter(F.coalesce("tokens", F.array().cast(f"array<{S._TOKEN}>")), lambda t: _token_key(t).isNotNull())
    # the last entry of a repeated token wins
    last = F.aggregate(known, F.create_map().cast("map<string,boolean>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != _token_key(t)), F.create_map(_token_key(t), F.coalesce(t["winner"], F.lit(False)))))
    z = p.select(F.col("id").alias("market_id"), last.alias("_w"), F.posexplode(F.arrays_zip(text_list("outcomes").alias("label"), text_list("clobTokenIds").alias("token"))).alias("outcome_index", "z"))
    z = z.where(F.col("z.token").isNotNull())
    return z.select("market_id", F.col("z.token").alias("token_id"), "outcome_index", F.col("z.label").alias("outcome_label"), F.coalesce(F.try_element_at("_w", F.col("z.token")), F.lit(False)).alias("winner"))


def _side(levels: str, best_first: str) -> tuple[Column, Column]:
    """Best price and top-five depth of one book side, small levels first at one price; unreadable levels are dropped."""
    ls = F.transform(F.coalesce(levels, F.array().cast("array<struct<price:string,size:string>>")), lambda x: F.struct(x["price"].try_cast("double").alias("p"), x["size"].try_cast("double").alias("s")))
    ok = F.filter(ls, lambda x: x["p"].isNotNull() & x["s"].isNotNull())
    sign = -1.0 if best_first == "high" else 1.0
    ordered = F.array_sort(ok, lambda a, b: F.when(a["p"] * sign < b["p"] * sign, -1).when(a["p"] * sign > b["p"] * sign, 1).when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0))
    depth = F.aggregate(F.slice(ordered, 1, 5), lit(0), lambda acc, x: acc + x["s"])
    return F.get(ordered, 0)["p"], depth


def books(raw: DataFrame, token_market: DataFrame, seen: Column | None = None) -> DataFrame:
    """Order-book rows with the market of each token."""
    p = parse(raw, S.BOOK_PAYLOAD)
    bid, bid_depth = _side("bids", "high")
    ask, ask_depth = _side("asks", "low")
    at = seen.cast("timestamp") if seen is not None else instant("snapshot_ts")
    b = p.select(text("asset_id", "token_id", "market").alias("token_id"), at.alias("snapshot_ts"), bid.alias("best_bid"), bid_depth.alias("bid_depth"), ask.alias("best_ask"), ask_depth.alias("ask_depth"))
    b = b.where(F.col("token_id").isNotNull() & (F.col("best_bid").isNotNull() | F.col("best_ask").isNotNull()))
    two = F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()
    b = b.withColumns({"mid": F.when(two, 0.5 * (F.col("best_bid") + F.col("best_ask"))).otherwise(F.coalesce("best_bid", "best_ask")), "spread": F.when(two, F.col("best_ask") - F.col("best_bid")).otherwise(lit(0))})
    priced = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col("mid"))
    b = b.withColumns({"spread_bps": F.when(F.col("mid") != 0, F.try_divide(F.col("spread"), F.col("mid")) * 10000.0), "liquidity_score": F.least(priced("best_bid") * F.col("bid_depth"), priced("best_ask") * F.col("ask_depth"))})
    m = token_market.select(F.col("token_id").cast("string").alias("token_id"), F.col("market_id").cast("string").alias("market_id"))
    return b.join(m, "token_id", "left").select([f.name for f in S.TABLES["orderbook_snapshots"].fields])


def trades(raw: DataFrame) -> DataFrame:
    """Trade rows; records without a readable price or size are dropped."""
    p = parse(raw, S.TRADE_PAYLOAD)
    t = p.select(
        F.coalesce(text("id", "tradeID", "transactionHash"), F.lit("")).alias("trade_id"),
        text("market", "conditionId").alias("market_id"),
        text("asset", "tokenId", "token_id").alias("token_id"),
        text("proxyWallet", "maker", "user").alias("trader"),
        F.upper(F.coalesce("side", F.lit(""))).alias("side"),
        F.col("price").try_cast("double").alias("price"),
        F.col("size").try_cast("double").alias("size"),
        instant(text("timestamp", "lastUpdate")).alias("trade_ts"),
        F.col("transactionHash").alias("tx_hash"),
        "requested_market",
        "raw_json",
    ).where(F.col("price").isNotNull() & F.col("size").isNotNull())
    return t.withColumn("notional", F.col("price") * F.col("size")).select("trade_id", "market_id", "token_id", "trader", "side", "price", "size", "notional", "trade_ts", "tx_hash", "raw_json", "requested_market")


def remap_trades(t: DataFrame, condition_market: DataFrame) -> DataFrame:
    """Condition ids to market ids; unknown ones fall back to the requested market."""
    m = condition_market.where(F.col("condition_id").isNotNull()).select(F.col("condition_id").alias("_c"), F.col("market_id").cast("string").alias("_m")).dropDuplicates(["_c"])
    # many trades share one unknown id: markets of known size are broadcast, and beside a plain scan a skewed join can be split
    m = materialise(m)
    j = t.join(m, t["market_id"] == m["_c"], "left")
    return j.withColumn("market_id", F.coalesce("_m", "requested_market")).drop("_c", "_m", "requested_market")


def holders(raw: DataFrame, token_market: DataFrame, seen: Column | None = None) -> DataFrame:
    """Holder rows from nested lists; rows without a wallet are dropped."""
    p = parse(raw, S.HOLDER_PAYLOAD)
    at = seen.cast("timestamp") if seen is not None else instant("snapshot_ts")
    h = p.select(F.coalesce(text("token", "asset"), F.lit("")).alias("token_id"), at.alias("snapshot_ts"), F.explode("holders").alias("h"))
    pick = lambda c: F.when(F.col(f"h.{c}") != "", F.col(f"h.{c}"))
    h = h.select("token_id", "snapshot_ts", F.coalesce(pick("proxyWallet"), pick("wallet")).alias("wallet"), F.coalesce(pick("outcome"), F.col("token_id")).alias("outcome"), number(F.coalesce(pick("shares"), pick("balance"))).alias("shares"), number(F.col("h.percent")).alias("pct"))
    m = token_market.select(F.col("token_id").cast("string").alias("token_id"), F.col("market_id").cast("string").alias("market_id"))
    return h.where(F.col("wallet").isNotNull()).join(m, "token_id", "left").select("snapshot_ts", "market_id", "wallet", "outcome", "shares", "pct")


def explicit_resolutions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolutions by the first flagged winner token, and all token rows."""
    p = parse(raw, S.MARKET_PAYLOAD)
    t = p.select(F.col("id").alias("market_id"), F.coalesce(text("end_date_iso", "closeDate")).alias("at"), F.col("resolve_source").alias("resolution_source"), "raw_json", F.posexplode("tokens").alias("outcome_index", "t"))
    t = t.withColumns({"token_id": _token_key(F.col("t")), "winner": F.coalesce(F.col("t.winner"), F.lit(False)), "outcome_label": F.col("t.outcome")})
    won = t.where("winner").groupBy("market_id").agg(F.min_by(F.struct("at", "token_id", "outcome_index", "outcome_label", "resolution_source", "raw_json"), "outcome_index").alias("r"))
    res = won.select("market_id", instant(F.col("r.at")).alias("resolved_ts"), F.col("r.token_id").alias("winner_token_id"), F.col("r.outcome_index").alias("winner_outcome_index"), F.col("r.outcome_label").alias("winner_label"), F.col("r.resolution_source").alias("resolution_source"), F.col("r.raw_json").alias("raw_json"))
    return res, t.where(F.col("token_id").isNotNull()).select("market_id", "token_id", "outcome_index", "outcome_label", "winner")


def inferred_resolutions(raw: DataFrame, floor: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Resolutions by the largest final price when it is nearly one."""
    p = parse(raw, S.MARKET_PAYLOAD)
    p = p.withColumns({"_o": text_list("outcomes"), "_t": text_list("clobTokenIds"), "_p": F.transform(text_list("outcomePrices"), lambda x: x.try_cast("double"))})
    p = p.where((F.size("_o") > 0) & (F.size("_t") > 0))
    ranked = F.filter(F.transform("_p", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))), lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]))
    p = p.withColumn("_b", F.array_max(ranked)).where((F.col("_b.v") >= floor) & (F.col("_b.v") < float("inf")))
    p = p.withColumn("_i", -F.col("_b.i")).withColumn("winner_token_id", F.get(F.col("_t"), F.col("_i"))).where(F.col("winner_token_id").isNotNull())
    res = p.select(F.col("id").alias("market_id"), instant(text("closedTime", "updatedAt", "endDate")).alias("resolved_ts"), "winner_token_id", F.col("_i").alias("winner_outcome_index"), F.get(F.col("_o"), F.col("_i")).alias("winner_label"), F.col("resolutionSource").alias("resolution_source"), "raw_json")
    rows = p.select(F.col("id").alias("market_id"), "_i", "_o", F.posexplode("_t").alias("outcome_index", "token_id"))
    return res, rows.select("market_id", "token_id", "outcome_index", F.get(F.col("_o"), F.col("outcome_index")).alias("outcome_label"), (F.col("outcome_index") == F.col("_i")).alias("winner"))


def resolved_markets(market_rows: DataFrame, resolutions: DataFrame, seen: Column) -> DataFrame:
    """Market rows with their resolution, in the layout of the resolved-market table."""
    r = resolutions.select("market_id", "resolved_ts", "winner_token_id", "winner_label", "resolution_source")
    return market_rows.join(r, "market_id", "left").select("market_id", "event_id", "question", "category", "resolved_ts", "winner_token_id", "winner_label", "resolution_source", "close_ts", seen.cast("timestamp").alias("last_backfill_ts"), "raw_json")
