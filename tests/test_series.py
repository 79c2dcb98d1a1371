"""Cutting a long series into chunks must not change any window result."""

import datetime as dt

import numpy as np
import pandas as pd

from marketlab.operators import panel as P, series as S


def _frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for tok, n in ((1, 400), (2, 30), (3, 1)):
        for i in range(n):
            rows.append((tok, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), float(rng.uniform(0.2, 0.8)), 0.01, 100.0, 50.0, 120.0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["token_id", "ts", "mid", "spread", "bid_depth", "ask_depth", "spread_bps"]))


def _features(df):
    out = P.forward_targets(P.momentum_decay(P.dynamic_features(df)))
    return S.whole_series(out).toPandas().sort_values(["token_id", "ts"]).reset_index(drop=True)


def test_chunked_windows_equal_plain_windows(spark):
    df = _frame(spark)
    plain = _features(df)
    cut = S.split_series(df, "token_id", "ts", P.HISTORY + 4, 12, size=64)
    assert "_chunk" in cut.columns
    got = _features(cut)[plain.columns]
    assert len(got) == len(plain)
    for c in plain.columns:
        if c not in ("ts",):
            assert np.allclose(got[c].astype(float), plain[c].astype(float), equal_nan=True, atol=1e-12), c


def test_one_chunk_has_no_neighbours(spark):
    cut = S.split_series(_frame(spark), "token_id", "ts", 10)
    assert cut.where("_halo or _chunk > 0").count() == 0 and cut.count() == 431


def test_lags_of_equal_instants(spark):
    """Quotes of one instant keep one order, however short the chunks are."""
    from marketlab.operators.returns import lagged_returns, timed_returns

    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, t(0), 0.2), (1, t(1), 0.4), (1, t(1), 0.5), (1, t(2), 0.25), (1, t(3), 0.5), (2, t(0), 0.5), (2, t(9), None)]
    df = spark.createDataFrame(rows, "token_id long, snapshot_ts timestamp, mid double")
    got = [sorted((r["token_id"], r["ts"], r["ret_1h"], r["ret_2h"]) for r in lagged_returns(df, (1, 2), size=n).collect() if r["ret_1h"] is not None) for n in (1, 2, 3, 100)]
    assert len(got[0]) == 4 and all(g == got[0] for g in got)
    # the first quote after the instant follows one of its two quotes, the one after that the other
    assert sorted(x for _, ts, x, _ in got[0] if ts == t(3)) == [1.0]
    timed = timed_returns(df, (1,))
    assert timed.count() == 6
    assert sorted(r["ret_1h"] for r in timed.collect() if r["ret_1h"] is not None) == [-0.5, 1.0, 1.0, 1.5]


def test_exponential_mean_matches_pandas(spark):
    df = _frame(spark)
    got = _features(df)
    vel = got["velocity_1"].fillna(0.0)
    grp = vel.groupby(got["token_id"])
    fast = grp.transform(lambda s: s.ewm(span=3, min_periods=2).mean())
    slow = grp.transform(lambda s: s.ewm(span=12, min_periods=4).mean())
    assert np.allclose(got["momentum_decay"], (fast - slow).fillna(0.0), atol=1e-9)


def test_clock_returns_equal_a_search(spark):
    from marketlab.operators.returns import timed_returns

    df = _frame(spark).withColumnRenamed("ts", "snapshot_ts")
    quotes = df.toPandas()
    got = timed_returns(df, (1, 3)).toPandas()
    assert len(got) == 431
    by = {k: g.sort_values("snapshot_ts") for k, g in quotes.groupby("token_id")}
    for r in got.sample(60, random_state=1).itertuples():
        own = by[r.token_id]
        now = own[own.snapshot_ts == r.ts].mid.iloc[0]
        for h, x in ((1, r.ret_1h), (3, r.ret_3h)):
            old = own[own.snapshot_ts <= r.ts - pd.Timedelta(hours=h)]
            want = now / old.mid.iloc[-1] - 1 if len(old) else None
            assert (pd.isna(x) and want is None) or abs(x - want) < 1e-12
