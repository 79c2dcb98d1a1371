"""Registered queries of this subpackage; ``ORACLES`` holds the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlab.llm import covering, decontaminate, divergence, html_text, mixing, neardup, quality, rules, secrets, sharding, substrings, toxicity, whitening
from marketlab.llm.common import read_table
from marketlab.llm.oracle_sql import ORACLES

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}


def query(fn: Run) -> Run:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard_documents(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix_documents(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "finish")


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets.scan(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_entropy")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule", "n_lines", "n_marks")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", "predicted")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", "predicted")


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return d.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue")


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = covering.near_duplicates(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", covering.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
