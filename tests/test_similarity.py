"""Similarity joins against brute force, with a hot group of copies."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlab.operators import linking as L, similarity as M

WORDS = "rain sun wind snow heat cold storm cloud win lose rise fall june july vote seat".split()


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(120):
        if i % 3 == 0:
            toks = ["rain", "sun", "vote", "june"]  # a third are copies of one text
        else:
            toks = list(rng.choice(WORDS, size=rng.integers(3, 8), replace=False))
        rows.append((i, "e1" if i % 5 else "e2", toks))
    return rows


def test_jaccard_join_is_exact(spark, docs):
    df = spark.createDataFrame(docs, "id long, block string, toks array<string>")
    sets = M.fold_sets(df, "block", "toks", "id").cache()
    pairs = {tuple(sorted((r["l"], r["r"]))): r["jaccard"] for r in M.jaccard_join(sets, sets, "block", 0.4, ordered_pairs=True).collect()}
    rows = sets.collect()
    want = {}
    for a, b in itertools.combinations(rows, 2):
        if a["block"] != b["block"]:
            continue
        x, y = set(a["tokens"]), set(b["tokens"])
        j = len(x & y) / len(x | y)
        if j >= 0.4 - 1e-12:
            want[tuple(sorted((a["set_id"], b["set_id"])))] = j
    assert pairs.keys() == want.keys()
    assert all(abs(pairs[k] - want[k]) < 1e-12 for k in want)
    # the copies fold to one row per block
    assert sum(r["members"] for r in rows) == len(docs)


def test_cosine_pairs_are_exact(spark, docs):
    df = spark.createDataFrame([(i, b, " ".join(t)) for i, b, t in docs], "id long, block string, text string")
    v = M.tfidf_vectors(df, "block", "id", F.split("text", " "))
    got = {(r["l"], r["r"]): r["similarity"] for r in M.cosine_pairs(v, "block", 0.72).collect()}
    want = {}
    for blk in ("e1", "e2"):
        part = [(i, t) for i, b, t in docs if b == blk]
        df_ = {}
        for _, t in part:
            for w in set(t):
                df_[w] = df_.get(w, 0) + 1
        vec = {}
        for i, t in part:
            w = {x: t.count(x) * (math.log((1 + len(part)) / (1 + df_[x])) + 1) for x in set(t)}
            n = math.sqrt(sum(x * x for x in w.values()))
            vec[i] = {k: x / n for k, x in w.items()}
        for a, b in itertools.combinations(sorted(vec), 2):
            s = sum(x * vec[b].get(k, 0.0) for k, x in vec[a].items())
            if s >= 0.72 - 1e-9:
                want[(a, b)] = s
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_that_share_one_rare_word_are_not_compared(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, "e", ["rare"] * 6 + list(rng.choice(words, 12, replace=False))) for i in range(120)]
    rows += [(200 + i, "e", rows[i][2] + ["end"]) for i in range(3)]
    v = M.tfidf_vectors(spark.createDataFrame(rows, "id long, block string, toks array<string>"), "block", "id", F.col("toks")).cache()
    doc = {r["sid"]: r["doc"] for r in v.collect()}
    met = {tuple(sorted((doc[r["l"]], doc[r["r"]]))) for r in M._met(v, 0.72).collect()}
    found = {(r["l"], r["r"]) for r in M.cosine_pairs(v, "block", 0.72).collect()}
    vec = {r["doc"]: dict(zip(r["no"], r["w"])) for r in v.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(vec), 2) if sum(x * vec[b].get(k, 0.0) for k, x in vec[a].items()) >= 0.72}
    assert found == want and want >= {(0, 200), (1, 201), (2, 202)}
    assert found <= met and len(met) < len(found) + 120  # 7503 pairs share the word


def test_representative_and_all_pairs(spark, monkeypatch):
    # copies, a text of the same words, one without words, one market in two events, one without id
    texts = ["rain falls in june"] * 5 + ["June: rain falls in"] * 2 + ["snow storm wins the seat"] * 3 + ["?"] * 2
    rows = [(i, "e", t) for i, t in enumerate(texts)] + [(20, "e", "heat wave"), (20, "f", "cold wave"), (21, "e", "heat wave"), (None, "e", "rain"), (22, None, "rain"), (23, "e", None)]
    df = spark.createDataFrame(rows, "market_id long, event_id string, question string")
    rain, snow = range(7), range(7, 10)
    every = {*itertools.combinations(rain, 2), *itertools.combinations(snow, 2)}
    for size in (2000, 2):  # as one slice and as many
        monkeypatch.setattr(L, "SALT_SIZE", size)
        got = [(r["market_a"], r["market_b"], round(r["similarity"], 9)) for r in L.related_questions(df).collect()]
        assert len(got) == len(set(got)) and {(a, b, 1.0) for a, b in every} == {g for g in got if g[0] < 20}
        one = [(r["market_a"], r["market_b"]) for r in L.representative_questions(df).collect() if r["market_a"] < 20]
        assert sorted(one) == sorted([(0, 5), *[(0, i) for i in range(1, 5)], (5, 6), (7, 8), (7, 9)])


def test_salted_index_gives_the_same_pairs(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "id long, block string, toks array<string>")
    sets = M.fold_sets(df, "block", "toks", "id").cache()
    key = lambda d: sorted((r["l"], r["r"]) for r in d.collect())
    plain = key(M.jaccard_join(sets, sets, "block", 0.3, ordered_pairs=True))
    monkeypatch.setattr(M, "SALT_SIZE", 3)
    assert key(M.jaccard_join(sets, sets, "block", 0.3, ordered_pairs=True)) == plain


def test_pairs_of_two_sides_are_settled_where_they_meet(spark, docs):
    # sets of both sides with words of their own, and columns that pairs keep
    rows = docs + [(1000, "e1", ["only", "here"]), (1001, "e1", ["only", "here"]), (1002, None, ["rain", "sun"]), (1003, None, ["rain", "sun"])]
    df = spark.createDataFrame(rows, "id long, block string, toks array<string>")
    a = M.fold_sets(df.where("id % 2 = 0"), "block", "toks", "id").cache()
    b = M.fold_sets(df.where("id % 2 = 1"), "block", "toks", "id", {"total": F.sum("id")}).cache()
    p = M.jaccard_join(a, b, "block", 0.25, carry=("members", "total"))
    want = {}
    for x, y in itertools.product(a.collect(), b.collect()):
        s, t = set(x["tokens"]), set(y["tokens"])
        if x["block"] is not None and x["block"] == y["block"] and len(s & t) / len(s | t) >= 0.25 - 1e-12:
            want[(x["set_id"], y["set_id"])] = (round(len(s & t) / len(s | t), 9), y["members"], y["total"])
    got = [((r["l"], r["r"]), (round(r["jaccard"], 9), r["members"], r["total"])) for r in p.collect()]
    assert len(got) == len(want) and dict(got) == want
    # no candidate travels: neither to be made distinct nor to fetch the words of its sets
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l#" not in plan and "hashpartitioning(r#" not in plan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_titles_against_brute_force(spark):
    titles = ["Will rain fall in june 2024", "Will rain fall in july 2024", "Will snow fall in june 2024", "Who wins the vote", "Who wins the seat vote", "will  RAIN fall in june 2024", "Who wins the séat vote"]
    rows = [(str(i), "e1", "c", t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "market_id string, event_id string, category string, question string")
    got = {(r["market_id_a"], r["market_id_b"]): r["link_confidence"] for r in L.similar_titles(df).collect()}
    norm = [" ".join(t.lower().split()).replace("é", "?") for t in titles]
    toks = [set(t.replace("?", " ").split()) for t in norm]
    want = {}
    for a, b in [*itertools.combinations((0, 1, 2, 3, 4, 6), 2), (0, 5)]:  # the sixth hangs on the first
        jac = len(toks[a] & toks[b]) / len(toks[a] | toks[b])
        if jac >= 0.55:
            sim = 1 - distance(norm[a], norm[b]) / max(len(norm[a]), len(norm[b]))
            want[(str(a), str(b))] = 0.6 * sim + 0.4 * jac
    assert got.keys() == want.keys() and len(want) >= 5
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("name", ["a60_inequality_violation", "m10_unit_root"])
def test_copies_meet_in_their_books(spark, tmp_path, name):
    import glob
    import os

    import duckdb

    import __spark_entry__ as entry
    from tests.conftest import DATA
    from tools.check import table

    con, path = duckdb.connect(), str(tmp_path)
    for f in glob.glob(f"{DATA}/*.parquet"):
        os.symlink(f, f"{path}/{os.path.basename(f)}")
    os.unlink(f"{path}/documents.parquet")
    # three texts of one source, each many times
    con.execute(f"COPY (SELECT i::BIGINT AS doc_id, CASE i % 3 WHEN 0 THEN 'rain in june' WHEN 1 THEN 'rain in june, again' ELSE 'snow' END || chr(10) || 'rest' AS text, 'en' AS lang, 'src' AS source, 9::BIGINT AS n_chars FROM range(40) t(i)) TO '{path}/documents.parquet'")
    for f in glob.glob(f"{path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, path)
    cur = con.execute(entry.oracle_sql()[name])
    got, want = table(df.columns, [tuple(r) for r in df.collect()]), table([d[0] for d in cur.description], cur.fetchall())
    assert got == want
    k = con.execute("SELECT max(user_id // 2) + 1 FROM events").fetchone()[0]
    every = {tuple(sorted((a % k, b % k))) for a, b in itertools.combinations(range(40), 2) if a % k != b % k and (a % 3 == 2) == (b % 3 == 2)}
    assert {(r["market_a"], r["market_b"]) for r in df.collect()} == every


def test_first_run_pairs_all_copies(spark):
    from marketlab.plans.research import Tables, cross_pairs

    latest = spark.createDataFrame([(i, "e", "will rain fall in june") for i in range(4)], "market_id long, event_id string, question string")
    outcomes = spark.createDataFrame([(i, 2 * i, 0, "Yes") for i in range(4)], "market_id long, token_id long, outcome_index int, outcome_label string")
    snaps = spark.range(48).selectExpr("id % 4 AS market_id", "2 * (id % 4) AS token_id", "timestamp'2024-01-01' + make_dt_interval(CAST(id DIV 4 AS INT)) AS snapshot_ts", "(id * 37 % 23) / 30.0D AS mid")
    got = cross_pairs(Tables(snaps, latest, outcomes, None, None), latest).collect()
    assert sorted((r["market_a"], r["market_b"], r["n_obs"]) for r in got) == [(a, b, 12) for a, b in itertools.combinations(range(4), 2)]
