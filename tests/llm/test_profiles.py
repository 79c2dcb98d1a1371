"""SimHash groups, source divergence and whitening against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlab.llm import covering, divergence, whitening
from tests.llm import brute
from tests.llm.test_operators import LONG, docs, got, none, rows, same, texts  # noqa: F401


def plain_groups(rows):
    fp = [brute.simhash(t) for _, t in rows]
    low = brute.lowest_linked([i for i, _ in rows], lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    return [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fp, low)]


def test_simhash(docs, none, rows):
    out = covering.near_duplicates(docs).withColumn("fingerprint", covering.hex_digits(F.col("fp")))
    same(out, ["doc_id", "fingerprint", "component_id"], plain_groups(texts(rows)))
    assert covering.near_duplicates(none).count() == 0


def test_simhash_of_pieces():
    for text in (b"", b" \n", LONG[:200_000].encode(), b"x" * 3000 + b" y z " + b"w" * 5000, b"a b", b"A b C"):
        for size in (7, 1000):
            whole = list(covering.pieces(text, size))
            assert b"".join(whole) == text and all(p[-1:] in b" \n" or p is whole[-1] for p in whole if p)
    assert covering.fingerprint(LONG.encode()) == brute.simhash(LONG)


@pytest.mark.parametrize("repeat", [1, 2])
def test_masks_cover_all_pairs(repeat):
    masks = covering.covering_masks(2, repeat)
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    assert all(30 <= m.bit_count() <= 58 for m in masks)


def test_links_of_a_ball(spark):
    """A dense family around one word, chains, and words three bits apart."""
    rng = np.random.default_rng(5)
    words = {0, 2**64 - 1}
    for base in rng.integers(0, 2**63, 4).tolist():
        for _ in range(60):
            words.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 4)))))
    words = sorted(words)
    v = spark.createDataFrame([(covering.signed(w),) for w in words], "fp long")
    want = brute.lowest_linked(list(range(len(words))), lambda i, j: (words[i] ^ words[j]).bit_count() <= 2)
    place = {covering.signed(w): k for k, w in enumerate(words)}
    for repeat in (1, 2):
        pairs = [(place[r["a"]], place[r["b"]]) for r in covering.links(v, repeat).collect()]
        assert all((words[a] ^ words[b]).bit_count() <= 2 for a, b in pairs)
        met = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
        assert brute.lowest_linked(list(range(len(words))), lambda i, j: (i, j) in met) == want


def test_pairs_of_a_large_bucket_are_not_listed(spark):
    """All 2 ** 12 words over 12 bits: links grow with the words, not with their pairs."""
    counts = []
    for bits in (9, 10, 11):
        v = spark.range(1 << bits).select(F.col("id").alias("fp"))
        counts.append(covering.links(v).count())
    assert counts[1] < 2.4 * counts[0] and counts[2] < 2.4 * counts[1]


COLS = ["lang", "source", "part", "item", "value", "rank"]


def test_divergence(docs, none, rows):
    same(divergence.audit(docs), COLS, brute.divergence([(t, la, s) for _, t, la, s in rows]))
    assert divergence.audit(none).count() == 0


def test_divergence_of_odd_terms(spark, monkeypatch):
    """Long terms, capitals beyond ASCII, shared prefixes, silent groups, small blocks and tiles."""
    r = [("Ärger ÄRGER xx" + "y" * 700, "de", "a"), ("ärger Äpfel xx" + "y" * 700, "de", "b"), ("xx" + "y" * 700 + " äpf", "de", "c"), ("äpf äpf1äpf-xx", "de", "c"), ("abc abd abe", "en", "a"), ("abc abf", "en", None), ("123 456", "en", "z"), (None, None, None), ("same", "fr", "s"), ("same", "fr", "s"), ("same", "fr", "t")]
    d = spark.createDataFrame(r, "text string, lang string, source string").withColumn("value", F.lit(1))
    want = brute.divergence(r)
    same(divergence.audit(d), COLS, want)
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 2)
    monkeypatch.setattr(divergence, "TILE", 1)
    same(divergence.audit(d), COLS, want)
    same(divergence.audit(d, least=1, top=2), COLS, brute.divergence(r, 1, 2))


def test_refinement_drops_rare_prefixes(spark):
    r = [(f"common{i % 2} rare{i}word", "en", "s") for i in range(40)]
    d = spark.createDataFrame(r, "text string, lang string, source string").withColumn("_l", F.xxhash64("lang")).repartition(3)
    local = divergence.local_counts(d)
    terms = divergence.below(local.where("level = 0"), divergence.refine(local, 3))
    assert {x["term"] for x in terms.select("term").distinct().collect()} >= {"common"}
    rare = divergence.below(local.where("level = 8"), divergence.refine(local, 41)).count()
    assert rare == 0


def test_chance_is_exact(spark):
    r = [(0, 1, 1), (10**13 + 7, 10**15 + 3, 10**9 + 9), (0, 0, 7), (5, 17, 3)]
    d = spark.createDataFrame(r, "c long, n long, v long").select("c", "n", "v", divergence.chance("c", "n", "v").alias("p"))
    assert all(x["p"] == 1 + 10**9 * (x["c"] + 1) // (x["n"] + x["v"]) for x in d.collect())


def plain_whitening(vectors, k=4):
    x = np.array([np.floor(np.array(v, np.float64) * 256) for v in vectors]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, c = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, c = e[::-1][:k], c[:, ::-1][:, :k]
    return x, n, s, e, ((x - s / n) @ c) / np.sqrt(e), e / np.trace(np.cov(fit.T.astype(float), bias=True))


def test_whitening(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(300, 7)) * [9, 7, 5, 3, 1, 1, 0.1] + 400).astype(np.float32).astype(float)
    v[100:200] = v[0]
    r = [(i, [float(e) for e in row], "a") for i, row in enumerate(v)]
    bad = [(900, None, "a"), (901, [1.0] * 6 + [None], "a"), (902, [float("nan")] * 7, "a"), (903, [float("inf")] + [0.0] * 6, "a"), (904, [1.0, 2.0], "a"), (905, [], "a")]
    d = spark.createDataFrame(r + [(None, r[3][1], "a")] + bad, "vec_id long, embedding array<float>, n string").repartition(6)
    out = whitening.whiten(d).collect()
    assert len(out) == 4 * 301 and {x["vec_id"] for x in out} == {*range(300), None}
    x, n, s, e, w, part = plain_whitening(v)
    assert all(o["identity_error"] < 1e-9 and o["n"] == n for o in out)
    sign = {}
    for o in out:
        i, c = 3 if o["vec_id"] is None else o["vec_id"], o["component"] - 1
        assert o["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
        assert abs(o["explained"] - part[c]) < 1e-9 and abs(o["eigenvalue"] / e[c] - 1) < 1e-9
        sign.setdefault(c, 1 if o["whitened"] * w[i, c] > 0 else -1)
        assert abs(o["whitened"] - sign[c] * w[i, c]) < 1e-6


def test_whitening_edges(spark):
    t = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], t)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], t)).count() == 0  # one distinct vector
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [4.0, 8.0, 0.0])], t)).collect()
    assert {x["component"] for x in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [1.0]), (3, [2.0])], t)).collect()
    assert len(huge) == 3 and all(x["deviation"] is None for x in huge)


def test_factor_and_rotations():
    rng = np.random.default_rng(4)
    for d, r in ((1, 1), (6, 6), (9, 4), (40, 40)):
        b = rng.normal(size=(d, r)) * np.logspace(0, -6, r)
        a = b @ b.T
        f = whitening.pivoted_cholesky(a)
        assert np.abs(f @ f.T - a).max() < 1e-13 * a.max()
        g = whitening.jacobi_columns(f)
        norms = np.sort((g * g).sum(0))[::-1]
        assert np.allclose(norms[: min(r, 3)], np.linalg.eigvalsh(a)[::-1][: min(r, 3)], rtol=1e-10)
        u = g / np.sqrt((g * g).sum(0))
        assert np.abs(u.T @ u - np.eye(u.shape[1])).max() < 1e-10
