"""Corpus pipeline: documents to a mixed, sharded training set.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written and
read again as the docs of the next one. All columns of documents pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlab.llm import decontaminate, mixing, neardup, quality, sharding
from marketlab.llm.common import read_table
from marketlab.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
CUT = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """Whole rows in one column beside what an operator reads, so that names cannot clash."""
    return docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    weight, bias = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(_packed(docs), weight, bias, ("_row",)).where(F.col("score") >= CUT).select("_row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.decontaminate(_packed(docs), read_table(spark, sf_dir, "benchmark"), keep=("_row",))
    return found.where("n_hit = 0").select("_row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; a document is there as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard."""
    return sharding.with_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained classifier and sketches cannot be said in SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
