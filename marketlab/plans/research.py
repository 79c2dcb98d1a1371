"""Research runs over warehouse-shaped tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from marketlab.functions.columns import lit
from marketlab.functions.tails import two_sided
from marketlab.operators import linking as L, pairs as X, panel as P, portfolio as PF, quality as Q, reports as RP, scoring as S, signals as SG, studies as E, summary as R
from marketlab.operators.series import series_window, split_series, whole_series
from marketlab.plans.strategy import registry, report_row, run_by_name
from marketlab.session import materialise


@dataclass
class Tables:
    """The inputs of a research run."""

    snapshots: DataFrame
    markets: DataFrame
    outcomes: DataFrame
    resolutions: DataFrame
    trades: DataFrame


@dataclass(frozen=True)
class MinData:
    min_ts: int = 500
    min_markets: int = 200
    min_snapshots: int = 50_000
    min_coverage: float = 0.80
    min_test_trades: int = 300
    min_fold_trades: int = 50
    enforce: bool = True
    live_rows: int = 200  # quotes in the live report


def inputs_of(t: Tables, unit: str = "hour") -> dict[str, DataFrame]:
    """Shared strategy inputs, each written once."""
    panel = P.yes_panel(P.build_panel(t.snapshots, t.markets, t.outcomes, t.resolutions, t.trades, unit), t.outcomes)
    texts = [c for c in ("question", "description") if c in t.markets.columns]
    panel = panel.drop(*texts).join(t.markets.select("market_id", *texts), "market_id", "left")
    return {"panel": materialise(panel), "whale_flow": materialise(E.wallet_flow(t.trades, t.resolutions, 0.90, unit)), "pair_books": materialise(X.pair_books(t.snapshots, t.outcomes, t.markets, t.resolutions))}


def cross_pairs(t: Tables, latest: DataFrame) -> DataFrame:
    """Spread and stationarity of every pair of markets with related questions, copies of a question included."""
    pairs = materialise(L.related_questions(latest).select("market_a", "market_b").distinct())
    ids = pairs.select(F.explode(F.array("market_a", "market_b")).alias("market_id")).distinct()
    hist = E.yes_probability_panel(t.snapshots, t.outcomes, ids)
    root = E.unit_root_stat(pairs, hist).withColumn("stationary_p", two_sided(F.col("unit_root_t"), F.col("n").cast("double") - 2)).select("market_a", "market_b", "unit_root_t", "stationary_p")
    return E.pair_spreads(pairs, hist).join(root, ["market_a", "market_b"], "left")


def first_run(t: Tables) -> dict[str, DataFrame]:
    """Five edge studies, their roll-up and scores, and the marked momentum book."""
    latest = E.latest_yes_probabilities(t.snapshots, t.outcomes, t.markets)
    frames: dict[str, DataFrame] = {}
    pre = materialise(E.pre_resolution_frame(t.snapshots, t.trades, t.markets, t.resolutions))
    mom = materialise(E.momentum_frame(t.snapshots, t.markets))
    dof = F.col("n").cast("double") - 2
    liq = E.regression(pre.withColumn("x", -F.log1p("liquidity_score")), "x", "abs_error").withColumn("p_value", two_sided(F.col("t_stat"), dof))
    trend = materialise(E.momentum_summary(mom).withColumn("p_value", two_sided(F.col("t_stat"), dof)))
    if "question" in pre.columns:
        amb = materialise(E.ambiguity_frame(pre))
        rules = E.rule_summary(amb).withColumn("p_value", two_sided(F.col("t_stat"), dof))
        frames["ambiguity_buckets"] = E.ambiguity_buckets(amb)
        frames["resolution_candidates"] = E.unresolved_candidates(t.markets, t.snapshots, t.outcomes, t.resolutions)
    else:
        rules = pre.sparkSession.createDataFrame([], "spearman double, p_value double")
    wallets = E.whale_flags(E.resolved_trades(t.trades, t.markets, t.resolutions), E.wallet_stats(t.trades))
    whales = E.welch(wallets.where("is_early"), "alpha_per_share", "is_whale", True, False).withColumn("p_value", two_sided(F.col("t_stat"), F.col("dof")))
    cross = t.snapshots.sparkSession.createDataFrame([], "market_a long, market_b long, spread_zscore double, stationary_p double")
    if "question" in latest.columns:
        cross = cross_pairs(t, latest)
    frames["edge_summary"] = materialise(RP.edge_roll_up(cross, rules, liq, trend, whales))
    frames["edge_scores"] = S.score_edges(frames["edge_summary"])
    frames["metric_rows"] = S.metric_rows(frames["edge_summary"], "edge_name", F.current_timestamp(), ["p_value", "capacity_usd", "stability", "mean_return"])
    frames["cross_market_pairs"] = cross
    frames["liquidity_buckets"] = E.bucket_errors(pre, "liquidity_score", 5, ("market_id", "token_id"), "liq_bucket")
    sign = F.when(trend.select("slope").scalar() > 0, lit(1)).otherwise(lit(-1))
    sig = SG.cross_section_z(mom.withColumnRenamed("snapshot_ts", "ts"), sign=sign).select("ts", "token_id", "signal")
    # target weight of each signal as the traded quantity, marked at mids; at a price of zero nothing is traded
    target = F.col("signal") * 0.05 * PF.CAPITAL / F.col("mid")
    fills = sig.join(t.snapshots.select(F.col("snapshot_ts").alias("ts"), "token_id", "mid").where("mid > 0"), ["ts", "token_id"]).withColumn("q", target)
    fills = split_series(fills, "token_id", "ts", 1)
    fills = whole_series(fills.withColumn("qty", F.col("q") - F.coalesce(F.lag("q").over(series_window(fills, "token_id", "ts")), lit(0))))
    book, by_cat = PF.mark_to_market(fills, E.price_frame(t.snapshots, t.markets))
    frames["book_timeseries"] = R.equity_curve(book, "price_pnl")
    frames["book_pnl_by_category"] = by_cat
    return frames


def full_run(t: Tables, unit: str = "hour", strategies: list[str] | None = None, limits: MinData = MinData(), **kw) -> dict[str, DataFrame]:
    """Sanity, gates, scanners, strategies, scores, readiness, portfolios."""
    out: dict[str, DataFrame] = {}
    scan = P.scan_snapshots(t.snapshots)
    out["orderbook_missingness"] = Q.book_missingness(scan)
    out["orderbook_distribution"] = Q.book_distribution(scan)
    x = inputs_of(t, unit)
    panel = x["panel"]
    out["panel_sanity"] = Q.panel_sanity(panel, out["orderbook_missingness"])
    out["panel_audit"], out["field_missingness"], out["pinned_markets"] = Q.audit_summary(panel), Q.field_missingness(panel), Q.pinned_markets(panel)
    out["outcome_links"] = L.outcome_links(t.outcomes)
    if "question" in t.markets.columns:
        out["market_links"] = L.similar_titles(t.markets)
        out["market_sets"] = L.market_sets(L.linked_markets(t.markets, out["outcome_links"]))
    pairs = X.pair_presence(X.side_by_side(X.outcome_books(t.snapshots, t.outcomes, 72)))
    out["pair_quality"] = materialise(Q.pair_quality(pairs, limits.min_coverage))
    if limits.enforce and out["pair_quality"].agg(F.min("passed")).first()[0] == 0 and out["pair_quality"].where("level = 'aggregate' AND passed = 0").take(1):
        out["insufficient_data_report"] = out["pair_quality"].where("level = 'aggregate'")
        return out
    books = X.latest_books(t.snapshots, t.outcomes)
    parity, sums = X.complement_parity(books), X.outcome_sums(books)
    out["complement_parity"], out["outcome_sums"], out["parity_summary"] = parity, sums, X.parity_summary(parity, sums)
    quotes = SG.quote_scores(panel).orderBy(F.col("expected_net_return").desc(), "ts", "token_id").limit(limits.live_rows)
    out["live_quotes"] = quotes
    pre = materialise(Q.integrity(panel, limits.min_ts, limits.min_markets, limits.min_snapshots))
    out["integrity_pre"] = pre
    if limits.enforce and pre.agg(F.min("passed")).first()[0] == 0:
        out["insufficient_data_report"] = pre
        return out
    reports, folds, series = None, None, None
    for name in strategies or list(registry()):
        b = run_by_name(name, x, **kw)
        out.update({f"{name}/{k}": v for k, v in b.items()})
        if "tuned_params" not in b:
            continue
        row = materialise(report_row(name, b))
        reports = row if reports is None else reports.unionByName(row, allowMissingColumns=True)
        f = b["walkforward_folds"].withColumn("strategy", F.lit(name))
        folds = f if folds is None else folds.unionByName(f)
        tp = b["tuned_params"].first()
        mine = b["test_trades"].where((F.col("threshold") == lit(tp["threshold"])) & (F.col("holding_period") == tp["holding_period"]))
        r = PF.strategy_returns(mine, F.lit(name))
        series = r if series is None else series.unionByName(r)
    if reports is None:
        return out
    out["strategy_report"] = reports = materialise(reports)
    post = materialise(Q.integrity(panel, limits.min_ts, limits.min_markets, limits.min_snapshots, reports, folds, limits.min_test_trades, limits.min_fold_trades))
    out["integrity_post"] = post
    if limits.enforce and post.agg(F.min("passed")).first()[0] == 0:
        out["insufficient_data_report"] = post
        return out
    out["edge_scores"] = S.score_edges(S.score_input(reports))
    out["readiness_report"] = S.readiness(reports, panel.agg(F.countDistinct("ts")).scalar(), limits.min_ts, limits.min_test_trades)
    out["live_opportunities"] = S.live_rows({"consistency_arb": (parity, {"direction": "PAIR_HEDGE", "traded_side": "BASKET", "required_notional": 250.0}), "microstructure_mm": (quotes, {"direction": "MARKET_MAKE", "traded_side": "BOTH", "required_notional": F.col("quoted_notional")})})
    series = materialise(series)
    names = sorted(r["strategy"] for r in reports.select("strategy").collect())
    wide = materialise(PF.aligned(series, names))
    caps = {r["strategy"]: float(r["capacity_usd"] or 0.0) for r in reports.select("strategy", "capacity_usd").collect()}
    out["strategy_correlation"] = PF.covariance(wide, names, 1e-6)
    out["portfolio_weights"] = weights = materialise(PF.choose_weights(wide, names, caps=caps))
    ts = PF.portfolio_series(series, weights)
    out["portfolio_timeseries"], out["portfolio_summary"] = ts, PF.portfolio_summary(ts, weights)
    return out
