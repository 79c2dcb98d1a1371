"""Stages against plain definitions, each on what its predecessor kept."""

import corpus_pipeline as P
from marketlab.llm import quality
from marketlab.session import materialise
from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_operators import targets


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    steps = {"": docs}
    last = docs
    for name, stage in P.STAGES:
        steps[name] = last = materialise(stage(spark, last, DATA))
        assert last.columns == (names if name != "sharding" else [*names, "shard"])
    rows = {k: [(r["doc_id"], r["text"], r["source"]) for r in v.collect()] for k, v in steps.items()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert sorted(x[0] for x in rows["quality"]) == sorted(i for i, s in scores.items() if s >= P.CUT)
    assert sorted(x[0] for x in rows["near_dedup"]) == sorted(d for d, _, _, k in brute.near([x[:2] for x in rows["quality"]]) if k)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(x[0] for x in rows["decontamination"]) == sorted(d[0] for d in brute.leaks([x[:2] for x in rows["near_dedup"]], items) if not d[-1])
    count = lambda t: len(brute.BLANK.findall(t or ""))
    sizes, taken, largest = {}, {}, {}
    for _, t, s in rows["decontamination"]:
        sizes[s] = sizes.get(s, 0) + count(t)
        largest[s] = max(largest.get(s, 0), count(t))
    for _, t, s in rows["mixing"]:
        taken[s] = taken.get(s, 0) + count(t)
    for s, t in targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= largest[s] / 2 + 1e-6
    assert len(rows["sharding"]) == len(rows["mixing"])
    assert P.run(spark, DATA).count() == len(rows["sharding"])


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = materialise(stage(spark, docs, DATA))
    assert docs.count() == 0
