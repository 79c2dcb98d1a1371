"""Pairs of related questions meet a date mark, not the texts."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketlab.operators import linking as L
from tests.conftest import DATA


def test_no_text_is_joined_to_pairs(spark):
    df = entry.queries()["f6_relation_type"](spark, DATA)
    node, joined = [df._jdf.queryExecution().optimizedPlan()], []
    while node:
        x = node.pop()
        if x.nodeName() == "Join":
            joined.append(x.schema().toDDL())
        kids = x.children()
        node += [kids.apply(i) for i in range(kids.size())]
    assert joined and not any("STRING" in s for s in joined)


def test_kind_is_type(spark):
    rows = [("will it rain on jan 5", "will it snow on 2024-01-02", 0.75), ("will it rain on jan 5", "will it snow", 0.75), ("rain", "snow", 0.9), (None, "on may 3", 0.9)]
    df = spark.createDataFrame(rows, "a string, b string, sim double")
    none, zero = F.lit(""), F.lit(0.0)
    both = df.select(L.relation_type(none, none, F.col("a"), F.col("b"), F.col("sim"), zero).alias("x"), L.relation_kind(F.lit(False), L.has_date("a") & L.has_date("b"), F.col("sim"), zero).alias("y")).collect()
    assert [r.x for r in both] == [r.y for r in both] == ["time_window_consistency_candidate", "weak_related", "fuzzy_related", "fuzzy_related"]
