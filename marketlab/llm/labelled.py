"""Bounded labelled samples for the trained operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlab.llm.common import held_out


def training_ids(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of either label outside the held-out fold, in hash order: (_id, _y)."""
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("_y"))
    pick = lambda y: lab.where(F.col("_y") == y).orderBy(F.xxhash64(F.col("_id"), F.lit(label)), "_id").limit(per_class)
    return pick(0).unionByName(pick(1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, _y) of the sample; the id list has at most 2 * per_class rows."""
    ids = training_ids(labels, label, per_class)
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).drop("_id")
