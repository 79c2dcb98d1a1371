"""Shards by vector bin packing.

Equal texts form a group with a size vector (bytes, tokens, rows). Groups are
placed, largest first, on the shard where the dot product of the group's
vector with the residual capacity is highest. Only a bounded number of items
is placed that way: groups above ``1 / (shards * grain)`` of any total (at most
``3 * shards * grain`` of them), and ``bundles`` hash bundles of all smaller
groups. A group larger than half a shard is dealt out in pieces by row, since
no placement of it whole can balance. Rows meet their shard through a join
with that bounded plan.

Defined results: a null text is the empty group with size 1; equal rows share
a group; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from marketlab.llm.mixing import word_count
from marketlab.operators.ranking import rank_rows
from marketlab.session import materialise

def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each size vector, largest first, by dot product with the residual capacity."""
    total = np.maximum(vectors.sum(0), 1.0)
    share = vectors / total
    room = np.full((shards, vectors.shape[1]), 1.0 / shards)
    out = np.zeros(len(vectors), np.int64)
    for i in np.argsort(-share.max(1), kind="stable"):
        s = int(np.argmax(room @ share[i]))
        out[i] = s
        room[s] -= share[i]
    return out


def measured(docs: DataFrame, bundles: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), word_count(text).alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"), _group(text).alias("group"))
    return d.withColumn("_bundle", F.pmod("group", F.lit(bundles)).cast("int"))


def _group(text: Column) -> Column:
    return F.xxhash64(text, F.lit(3))


def _piece(row: Column, pieces: Column) -> Column:
    return F.pmod(F.xxhash64(row, F.lit(11)), pieces).cast("int")


class Plan:
    """Shards of large groups (by piece) and of hash bundles; of bounded size."""

    def __init__(self, d: DataFrame, shards: int, grain: int, bundles: int) -> None:
        self.spark, self.bundles = d.sparkSession, bundles
        self.large: dict[int, list[int]] = {}
        self.small = [0] * bundles
        groups = d.groupBy("group", "_bundle").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        whole = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).first()
        if not whole["n"]:
            return
        total = np.array([whole["b"], max(whole["t"], 1), whole["n"]], float)
        limit = float(shards * grain)
        big = (F.col("b") * limit > total[0]) | (F.col("t") * limit > total[1]) | (F.col("n") * limit > total[2])
        groups = materialise(groups.withColumn("_big", big))
        # both lists are bounded by construction: 3 * shards * grain groups, `bundles` bundles
        large = groups.where("_big").select("group", "b", "t", "n").orderBy("group").collect()
        small = groups.where("not _big").groupBy("_bundle").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).orderBy("_bundle").collect()
        slots, vectors = [], []
        for g in large:
            v = np.array([g["b"], g["t"], g["n"]], float)
            most = float((v / total).max()) * shards
            pieces = 1 if most <= 0.5 else int(np.ceil(most * 8))
            self.large[g["group"]] = [0] * pieces
            if pieces == 1:
                slots.append((self.large[g["group"]], 0))
                vectors.append(v)
        # groups over half a shard (fewer than 6 * shards) weigh what their pieces hold
        dealt = {g: len(p) for g, p in self.large.items() if len(p) > 1}
        if dealt:
            n = self.spark.createDataFrame(list(dealt.items()), "_g long, _n int")
            parts = d.join(F.broadcast(n), F.col("group") == F.col("_g")).withColumn("_p", _piece(F.col("doc_id"), F.col("_n")))
            for r in parts.groupBy("group", "_p").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("group", "_p").collect():
                slots.append((self.large[r["group"]], r["_p"]))
                vectors.append(np.array([r["b"], r["t"], r["n"]], float))
        for s in small:
            slots.append((self.small, s["_bundle"]))
            vectors.append(np.array([s["b"], s["t"], s["n"]], float))
        for (where, i), s in zip(slots, place(np.array(vectors), shards).tolist()):
            where[i] = s

    def attach(self, d: DataFrame, row: Column, out: str) -> DataFrame:
        """Add the shard of each row of ``d(group, _bundle, ...)``; ``row`` deals out the pieces of a large group."""
        rows = self.spark.createDataFrame(list(self.large.items()), T.StructType([T.StructField("_g", T.LongType()), T.StructField("_at", T.ArrayType(T.IntegerType()))]))
        bundle = F.from_json(F.lit("[" + ",".join(map(str, self.small)) + "]"), T.ArrayType(T.IntegerType()))
        # at most 3 * shards * grain rows
        j = d.join(F.broadcast(rows), F.col("group") == F.col("_g"), "left")
        piece = F.get("_at", _piece(row, F.size("_at")))
        return j.withColumn(out, F.when(F.col("_g").isNotNull(), piece).otherwise(F.get(bundle, F.col("_bundle")))).drop("_g", "_at")


def shard_documents(docs: DataFrame, shards: int = 16, grain: int = 32, bundles: int = 8192) -> DataFrame:
    """One row per document: doc_id, size, tokens, text_crc32, group, shard, slot."""
    d = materialise(measured(docs, bundles))
    j = materialise(Plan(d, shards, grain, bundles).attach(d, F.col("doc_id"), "shard").drop("_bundle"))
    ranked = rank_rows(j, [F.xxhash64("doc_id").asc(), F.col("doc_id").asc(), F.col("group").asc()], ["shard"], "_rn", "_n")
    return ranked.select("doc_id", "size", "tokens", "text_crc32", "group", "shard", (F.col("_rn") - 1).cast("long").alias("slot"))


def with_shards(docs: DataFrame, shards: int = 16, grain: int = 32, bundles: int = 8192) -> DataFrame:
    """The rows of ``docs`` and their shard; texts stay where they are."""
    plan = Plan(materialise(measured(docs, bundles)), shards, grain, bundles)
    group = _group(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_d"), group.alias("group")).withColumn("_bundle", F.pmod("group", F.lit(bundles)).cast("int"))
    return plan.attach(rows, F.col("_d"), "_shard").select("_row.*", F.col("_shard").alias("shard"))
