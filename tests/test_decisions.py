"""Gates, scores and validation decisions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlab.functions import tails as T
from marketlab.operators import pairs as X, quality as Q, linking as L, resample as B, scoring as S, validate as V

#: A strategy just inside every limit, and per criterion a value just outside it.
INSIDE = {
    "strategy": "edge_case", "ci_low": 2e-6, "ci_high": 0.03, "walkforward_mean_expectancy": 3e-6, "walkforward_valid_folds": 5.0, "test_mean_return": 4e-6,
    "n_test_trades": 640.0, "n_walkforward_trades": 900.0, "pessimistic_avg_expected_ev": 0.0, "pbo": 0.49, "top_market_profit_share": 0.39,
    "ev_monotonic_pass": 1.0, "ev_spearman": 0.21, "ev_model_valid": 1.0, "stability_score": 0.8, "ttest_pvalue": 0.2, "permutation_pvalue": 0.3,
}
OUTSIDE = [
    ("ci_lower_bound_positive", {"ci_low": -2e-6}),
    ("walkforward_mean_positive", {"walkforward_mean_expectancy": 0.0}),
    ("walkforward_valid_folds_min", {"walkforward_valid_folds": 2.0}),
    ("test_mean_return_positive", {"test_mean_return": -1e-9}),
    ("test_trade_count_minimum", {"n_test_trades": 199.0}),
    ("pessimistic_execution_ev_nonnegative", {"pessimistic_avg_expected_ev": -1e-9}),
    ("pbo_below_threshold", {"pbo": 0.51}),
    ("market_profit_concentration", {"top_market_profit_share": 0.41}),
    ("ev_deciles_monotonic", {"ev_spearman": 0.19}),
    ("ev_deciles_monotonic", {"ev_monotonic_pass": 0.0}),
]


def test_each_limit_decides_alone(spark):
    rows = [INSIDE] + [{**INSIDE, **change, "strategy": f"{i}"} for i, (_, change) in enumerate(OUTSIDE)]
    got = {}
    for r in S.deployment_gate(spark.createDataFrame(pd.DataFrame(rows))).collect():
        got.setdefault(r["strategy"], {})[r["criterion"]] = r
    assert all(r["passed"] for r in got["edge_case"].values()) and got["edge_case"]["deployment_decision"]["notes"] == "GO"
    for i, (name, _) in enumerate(OUTSIDE):
        own = got[str(i)]
        failed = {c for c, r in own.items() if not r["passed"]}
        assert failed == {name, "summary", "deployment_decision"}
        assert own["deployment_decision"]["decision"] == "FAIL"
    s = got["edge_case"]["summary"]
    assert (s["n_test_trades"], s["advanced_pbo"], s["top_market_profit_share"]) == (640.0, 0.49, 0.39)
    assert got["edge_case"]["ci_lower_bound_positive"]["n_test_trades"] == 0  # metrics stand in the summary row only


def test_unknown_overfitting_does_not_block(spark):
    unknown = spark.createDataFrame(pd.DataFrame([INSIDE])).withColumn("pbo", F.lit(None).cast("double"))
    for d in (unknown, unknown.drop("pbo")):
        g = {r["criterion"]: r for r in S.deployment_gate(d).collect()}
        assert g["pbo_below_threshold"]["passed"] and g["summary"]["decision"] == "PASS" and g["summary"]["advanced_pbo"] is None


def candidates(spark, returns, start=dt.datetime(2021, 3, 1)):
    rows = [(start + dt.timedelta(days=i), name, x) for name, xs in returns.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "ts timestamp, candidate string, ret double")


def test_a_dominant_candidate_is_not_overfit(spark):
    """One candidate beats the others on every day, so the best of any half is the best of the other."""
    wave = [math.sin(i) / 100 for i in range(64)]
    m = candidates(spark, {"top": [x + 0.05 for x in wave], "mid": [x + 0.01 for x in wave], "low": [x - 0.04 for x in wave]})
    r = B.overfit_probability(m, 4).first()
    assert r["pbo"] == 0.0 and r["pbo_computable"] == 1 and r["pbo_trials"] == math.comb(4, 2)
    assert B.overfit_trials(m, 4).count() == math.comb(4, 2)


def test_luck_of_one_half_is_overfit(spark):
    """Each candidate wins in one quarter and loses in the others: the best of a half is among the worst outside it."""
    n = 16
    lucky = {f"c{q}": [(0.03 if i // n == q else -0.01) + (i % 3) / 1000 for i in range(4 * n)] for q in range(4)}
    r = B.overfit_probability(candidates(spark, lucky), 4).first()
    assert r["pbo"] > 0.5


def test_too_few_rows_give_no_probability(spark):
    r = B.overfit_probability(candidates(spark, {"p": [0.2, -0.1, 0.3], "q": [0.0, 0.1, 0.0]})).first()
    assert r["pbo_computable"] == 0 and r["pbo"] is None


def test_small_p_value_of_a_loss_earns_nothing(spark):
    cols = "edge_name string, mean_return double, t_stat double, p_value double, n_obs double, ci_low double, capacity_usd double, stability double"
    rows = [("sure_loss", -0.02, -6.0, 1e-6, 150.0, -0.03, 9e4, 0.95), ("likely_gain", 0.002, 3.0, 0.004, 150.0, 0.0004, 8e3, 0.6), ("nothing", 0.0, 0.0, 1.0, 150.0, -0.01, 8e3, 0.6)]
    s = {r["edge_name"]: r for r in S.score_edges(spark.createDataFrame(rows, cols)).collect()}
    assert s["sure_loss"]["significance_score"] == 0 == s["nothing"]["significance_score"]
    assert s["likely_gain"]["p_value_pos"] == pytest.approx(T.student_upper(3.0, 149), abs=1e-9)
    assert s["likely_gain"]["edge_score_pro"] == max(r["edge_score_pro"] for r in s.values())


def test_tails():
    assert T.student_upper(0.0, 5) == pytest.approx(0.5)
    assert T.student_upper(2.570582, 5) == pytest.approx(0.025, abs=1e-6)
    assert T.student_upper(-1.0, 1) == pytest.approx(0.75, abs=1e-9)
    assert T.normal_upper(1.959964) == pytest.approx(0.025, abs=1e-6)
    assert T.student_upper(1.5, 1e7) == pytest.approx(T.normal_upper(1.5), abs=1e-6)


def test_draws_are_even(spark):
    n = 400
    df = spark.range(n).select(F.col("id"))
    per = B.replicate(df, 300).groupBy("rep").agg(F.avg(B.pick(F.col("id"), F.col("rep"), F.lit(n))).alias("p")).toPandas()
    m = B.signs(np.arange(n), 300).mean(0)
    assert abs(m.mean()) < 0.02 and m.std() == pytest.approx(1 / math.sqrt(n), rel=0.2)
    assert per["p"].mean() == pytest.approx((n - 1) / 2, rel=0.02) and per["p"].std() == pytest.approx(n / math.sqrt(12 * n), rel=0.2)


def test_weights_are_poisson():
    w = B.weights(np.arange(500), 400)
    for k, p in enumerate((0.3679, 0.3679, 0.1839, 0.0613, 0.0153)):
        assert (w == k).mean() == pytest.approx(p, abs=0.004)
    assert w.mean() == pytest.approx(1, abs=0.01) and np.corrcoef(w[0::2].ravel(), w[1::2].ravel())[0, 1] == pytest.approx(0, abs=0.02)


def test_numpy_draws_equal_spark_draws(spark):
    got = B.replicate(spark.range(7).select("id"), 50).select("id", "rep", B.draw(F.col("id"), F.col("rep")).alias("d")).toPandas().pivot(index="id", columns="rep", values="d")
    assert (got.to_numpy() == B.hashed(np.arange(7), np.arange(50))).all()


def test_path_drawdown_over_slices(spark, monkeypatch):
    """States of slices joined in order equal the whole path, total losses included."""
    monkeypatch.setattr(B, "BLOCK", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, 37)
    x[[5, 30]] = -1.5
    for values in (x, np.delete(x, [5, 30]), np.full(9, -0.1)):
        ids = rng.permutation(len(values))
        reps, cut = 6, len(values) // 3
        parts = [B.path_states(ids[a:b], values[a:b], reps) for a, b in ((0, cut), (cut, cut + 1), (cut + 1, len(values)))]
        rows = [(k, r, *[float(s[f][r]) for f in ("prod", "top", "low", "floor")]) for k, s in enumerate(parts) for r in range(reps)]
        d = spark.createDataFrame(rows, "slice long, rep long, prod double, top double, low double, floor double")
        got = {r["rep"]: r["d"] for r in d.groupBy("rep").agg(B.path_fall().alias("d")).collect()}
        w = B.weights(ids, reps)
        for rep in range(reps):
            drawn = w[:, rep] > 0  # a row drawn k times moves the path once, by its k-th power
            eq = np.cumprod(np.maximum(values[drawn] + 1, 0) ** w[drawn, rep])
            peak = np.maximum.accumulate(eq) if len(eq) else eq
            want = min([0.0, *[e / p - 1 if p > 0 else -1.0 for e, p in zip(eq, peak)]])
            assert got[rep] == pytest.approx(want, abs=1e-9)
        whole = B.path_states(ids, values, reps)
        assert np.allclose(whole["c"], w.sum(0)) and np.allclose(whole["s"], values @ w)


def test_pair_coverage_counts_markets_with_both_books(spark):
    """Three of five markets quote both outcomes at the instant; a market without a NO token has no link."""
    at = dt.datetime(2022, 8, 9, 6)
    legs = [(m, s) for m in "abcde" for s in ("Yes", "No") if (m, s) != ("e", "No")]
    outs = spark.createDataFrame([(m, m + s[0], i % 2, s) for i, (m, s) in enumerate(legs)], "market_id string, token_id string, outcome_index int, outcome_label string")
    quoted = [x for x in legs if x != ("d", "No")]
    snaps = spark.createDataFrame([(at, m, m + s[0], 0.20 + i / 50, 0.23 + i / 50) for i, (m, s) in enumerate(quoted)], "snapshot_ts timestamp, market_id string, token_id string, best_bid double, best_ask double")
    snaps = snaps.withColumns({"mid": (F.col("best_bid") + F.col("best_ask")) / 2, "spread": F.lit(0.03), "spread_bps": F.lit(900.0), "bid_depth": F.lit(70.0), "ask_depth": F.lit(40.0)})
    assert sorted(r["market_id"] for r in L.outcome_links(outs).collect()) == list("abcd")
    agg = Q.pair_quality(X.pair_presence(X.side_by_side(X.outcome_books(snaps, outs, 72)))).where("metric = 'both_legs_coverage'").first()
    assert agg["value"] == pytest.approx(0.6)


def test_fold_plan_has_embargo(spark):
    df = spark.range(40).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    plan = V.fold_plan(df, V.WalkConfig(n_folds=3, min_train_periods=4, test_periods=6, embargo_periods=2)).collect()
    assert len(plan) == 3
    for p in plan:
        assert (p["test_start"] - p["train_end"]).total_seconds() == 3 * 3600


def test_return_importance_grows_the_default_forest(monkeypatch):
    """The registered query gives no count of trees of its own."""
    import inspect

    from marketlab.catalog import scoring
    from marketlab.operators import models as M

    sig, seen = inspect.signature(M.return_importance), {}

    def record(*args, **kw):
        bound = sig.bind(*args, **kw)
        bound.apply_defaults()
        seen.update(bound.arguments)

    monkeypatch.setattr(scoring, "chosen_of", lambda lake: None)
    monkeypatch.setattr(scoring.M, "return_importance", record)
    scoring.m8(None)
    assert seen["trees"] == sig.parameters["trees"].default
