"""Mixing sources to target weights by weighted fair queueing.

Every document is a packet of its source's queue, in shuffled order; a source may
be repeated ``epochs`` times, each epoch the same order again. A packet's virtual
time is the number of source tokens served when half of it is through, divided by
the source's weight (half, so that a source misses its share by half a document
at most, not by a whole one). Packets of all sources are sorted by that time over
range slices, their sizes are summed along this order and the mix is cut where
the sum reaches the total budget. A source whose queue is empty has no later
packets, so the others share what it leaves. Cumulative sums use range slices
with offsets: no source, however large, is ordered in one task.

Targets are reported for each source: they follow from one prefix sum over the
sources and are what the queues converge to; they take no part in the cut.

Defined results: a null text has size 0 and takes nothing; a null source is a
source of its own, last in order; equal rows are separate packets; an empty
table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.operators.ranking import prefix_sums, rank_rows
from marketlab.session import materialise

WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of blank-separated words; null counts none."""
    one = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    return F.coalesce(F.when(F.length(one) > 0, F.length(one) - F.length(F.translate(one, " ", "")) + 1), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Rows (source, source_size, weight, target, place) from per-source sizes.

    The queue of a source is served until time ``epochs * size / weight``.
    Sources sorted by that time form prefixes of emptied queues; the cut time
    is where the rest, served in proportion to weight, uses up the budget.
    """
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_rn") - 1) % n + 1).cast("int"))
    ranked = rank_rows(materialise(sizes), [F.col("source").asc_nulls_last()], (), "_rn", "_n").drop("_n").withColumn("weight", w)
    ranked = ranked.withColumn("_cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("_dry", F.col("_cap") / F.col("weight"))
    run = prefix_sums(materialise(ranked), [F.col("_dry").asc(), F.col("_rn").asc()], {"_used": F.col("_cap"), "_gone": F.col("weight")})
    whole = run.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_w"))
    t = run.crossJoin(F.broadcast(whole))  # one row
    left = F.lit(float(share)) * F.col("_all")
    # the budget is spent before this source runs dry, if it and all later ones were still served
    served = F.col("_used") - F.col("_cap") + F.col("_dry") * (F.col("_w") - F.col("_gone") + F.col("weight"))
    at = (left - (F.col("_used") - F.col("_cap"))) / (F.col("_w") - F.col("_gone") + F.col("weight"))
    cut = t.agg(F.min(F.when(served >= left, F.struct(F.col("_dry").alias("d"), F.col("_rn").alias("r"), at.alias("at"))))["at"].alias("_cut"), F.max("_dry").alias("_last"))
    out = ranked.crossJoin(F.broadcast(cut.select(F.coalesce("_cut", "_last").alias("_cut"))))
    return out.select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("weight") * F.col("_cut")).alias("target"), F.col("_rn").alias("place"))


def _order(seed: int) -> Column:
    """Place of a document in its source's shuffled queue."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, _order, size, source_size, target, finish, copies, taken.

    ``finish`` is the virtual time at which the document's first copy is served whole.
    """
    d = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("_order")))
    targets = materialise(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs))
    queue = prefix_sums(d, [F.col("_order").asc(), F.col("doc_id").asc(), F.col("size").asc()], {"_upto": F.col("size")}, ["source"])
    t = targets.select(F.col("source").alias("_s"), "source_size", "weight", "target", "place")
    q = materialise(queue.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    time = lambda e: (F.col("_upto") - F.col("size") / F.lit(2.0) + F.lit(float(e)) * F.col("source_size")) / F.col("weight")
    packet = lambda e: F.struct(time(e).alias("t"), "place", "_upto", "_order", "doc_id", F.lit(e).alias("e"))
    budget = F.lit(float(share)) * d.agg(F.sum("size").alias("n")).select("n").scalar()
    packets = q.where("size > 0").select("size", F.explode(F.array(*[packet(e) for e in range(epochs)])).alias("p"))
    sorted_ = prefix_sums(packets, [F.col("p").asc()], {"_run": F.col("size")})
    last = sorted_.where(F.col("_run") - F.col("size") / F.lit(2.0) <= budget).agg(F.max("p").alias("_last"))
    q = q.crossJoin(F.broadcast(last))  # one row
    copies = sum((F.when((F.col("size") > 0) & (packet(e) <= F.col("_last")), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    return q.select("doc_id", "source", "_order", "size", "source_size", "target", (F.col("_upto") / F.col("weight")).alias("finish"), copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` in the mix, repeated as often as they are taken.

    A queue is served in order, so what is taken in an epoch ends at one place
    per source; rows are compared with that place and no text is shuffled.
    Rows equal in id and text share their place.
    """
    m = mix_documents(docs, weights, share, epochs, seed)
    place = lambda: F.struct(F.col("_order").alias("o"), F.col("doc_id").alias("d"))
    ends = materialise(m.groupBy("source").agg(*[F.max(F.when(F.col("copies") > e, place())).alias(f"_e{e}") for e in range(epochs)]))
    ends = ends.withColumnRenamed("source", "_s")
    rows = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"), F.struct(_order(seed).alias("o"), F.col("doc_id").alias("d")).alias("_place"))
    j = rows.join(ends, F.col("_source").eqNullSafe(F.col("_s")))
    copies = sum((F.when((F.col("_size") > 0) & (F.col("_place") <= F.col(f"_e{e}")), 1).otherwise(0) for e in range(epochs)), F.lit(0))
    return j.withColumn("_copies", copies).where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
