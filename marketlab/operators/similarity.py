"""Exact similarity joins inside blocks, without comparing all pairs.

Equal token sets are folded to one row first. Sets are then indexed by their
rarest words only: two sets can reach the threshold only if they share a word
of both prefixes. Words that many sets share are salted, so one block or one
group of near copies is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketlab.functions.columns import lit
from marketlab.operators.ranking import rank_rows
from marketlab.session import materialise

SALT_SIZE = 2000  # index rows of one word per task slice


def set_key(block: str | Column, tokens: str | Column) -> Column:
    """Id of a token set inside a block."""
    b = F.col(block) if isinstance(block, str) else block
    return F.md5(F.concat_ws("\x1f", b.cast("string"), F.array_join(F.array_sort(F.array_distinct(tokens)), "\x1e")))


def fold_sets(df: DataFrame, block: str, tokens: str, member: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (block, token set): id, tokens, smallest member, member count."""
    t = df.where(F.size(tokens) > 0).withColumn("_toks", F.array_sort(F.array_distinct(tokens)))
    t = t.withColumn("set_id", set_key(block, "_toks"))
    aggs = [F.first(block).alias(block), F.first("_toks").alias("tokens"), F.min(member).alias("first_member"), F.count(F.lit(1)).alias("members")]
    return t.groupBy("set_id").agg(*aggs, *[c.alias(n) for n, c in (extra or {}).items()])


def _numbered(sets: DataFrame, block: str, least: int) -> DataFrame:
    """Words of each set as numbers in rising order, rarest in its block first, with a bit signature.

    Words of different blocks have different numbers; a null block meets nothing.
    A word of fewer than ``least`` sets has no slice and is not indexed.
    """
    rows = sets.where(F.col(block).isNotNull()).select("set_id", block, F.explode("tokens").alias("token"))
    freq = rows.groupBy(block, "token").agg(F.count(F.lit(1)).alias("freq"))
    number = rank_rows(freq, [F.col("freq").asc(), F.col(block).asc(), F.col("token").asc()], (), "_no", "_all")
    slices = F.when(F.col("freq") >= least, F.ceil(F.col("freq") / SALT_SIZE)).otherwise(F.lit(0)).cast("int")
    number = number.select(block, "token", F.struct(F.col("_no").cast("int").alias("token"), slices.alias("slices")).alias("_e"))
    ranked = rows.join(number, [block, "token"]).groupBy("set_id").agg(F.array_sort(F.collect_list("_e")).alias("words")).withColumn("ids", F.col("words.token"))
    bits = lambda k: F.aggregate(F.filter("ids", lambda x: F.pmod(x, F.lit(256)).between(64 * k, 64 * k + 63)), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)))))
    return ranked.select("set_id", "words", "ids", *[bits(k).alias(f"sig{k}") for k in range(4)])


def jaccard_join(left: DataFrame, right: DataFrame, block: str, threshold: float, ordered_pairs: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of folded sets in a block with Jaccard at or above the threshold: l, r, jaccard.

    With ``ordered_pairs`` both sides are the same frame and only l < r is kept.
    ``carry`` names columns of ``right`` that pairs keep. An index row carries
    its whole set, so that a pair is settled where it meets, at its first shared
    word, and nothing of a pair that fails is shuffled.
    """
    everything = left if ordered_pairs else left.select("set_id", block, "tokens").unionByName(right.select("set_id", block, "tokens")).dropDuplicates(["set_id"])
    # a word of one set meets nothing, unless the set is on both sides
    numbered = materialise(_numbered(everything, block, 2 if ordered_pairs else 1))
    size = F.size("ids")
    prefix = size - F.ceil(F.round(size * threshold, 9)).cast("int") + 1
    sig = [f"sig{k}" for k in range(4)]

    def side(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
        own = numbered.join(df.select("set_id", *keep), "set_id")
        own = own.select(F.col("set_id").alias(name), F.col("ids").alias(f"i_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in sig], *keep, F.posexplode(F.slice("words", F.lit(1), prefix)).alias(f"p_{name}", "w"))
        return own.where("w.slices > 0").withColumns({"token": F.col("w.token"), "slices": F.col("w.slices")}).drop("w")

    probe = side(left, "l").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    index = side(right, "r", carry).withColumn("salt", F.pmod(F.xxhash64("r"), F.col("slices")).cast("int")).drop("slices")
    met = probe.join(index, ["token", "salt"])
    n_l, n_r = F.size("i_l"), F.size("i_r")
    least = threshold / (1.0 + threshold) * (n_l + n_r) - 1e-9  # words shared at the threshold
    # from the first shared word on, the shorter rest bounds the intersection
    may = F.least(n_l - F.col("p_l"), n_r - F.col("p_r")) >= least
    if ordered_pairs:
        may = may & (F.col("l") < F.col("r"))
    # a bit that differs is a word of one set alone
    apart = sum((F.bit_count(F.col(f"{c}_l").bitwiseXOR(F.col(f"{c}_r"))) for c in sig[1:]), F.bit_count(F.col("sig0_l").bitwiseXOR(F.col("sig0_r"))))
    both = F.array_intersect("i_l", "i_r")  # in the order of words, rarest first
    out = met.where(may & (apart <= n_l + n_r - 2 * least) & (F.size(both) >= least) & (both[0] == F.col("token")))
    out = out.withColumn("jaccard", F.size(both) / (n_l + n_r - F.size(both)).cast("double"))
    return out.where(F.col("jaccard") >= threshold - 1e-12).select("l", "r", "jaccard", *carry)


def tfidf_vectors(docs: DataFrame, block: str, doc: str, words: Column, stop_words: tuple[str, ...] = (), copies: str | None = None, rows: str | None = None) -> DataFrame:
    """Unit-length tf-idf vectors, document frequencies taken inside the block: sid, doc, block, no, freq, w.

    ``docs`` has one row per (block, document). ``copies`` and ``rows`` name the
    documents a row stands for and the rows they came from, one each if not
    given. A vector is three arrays, rarest token first: the number of the
    token, which tokens of other blocks do not share, the vectors that hold it,
    and its weight. ``sid`` numbers the vectors.
    """
    one = lambda c: (F.col(c) if c else F.lit(1)).cast("long")
    w = F.filter(words, lambda x: ~x.isin(*stop_words)) if stop_words else words
    bags = docs.select(F.col(doc).alias("doc"), block, one(copies).alias("_copies"), F.array_sort(w).alias("_bag")).where(F.size("_bag") > 0)
    bags = bags.withColumn("_kinds", F.array_distinct("_bag")).withColumn("_at", F.transform("_kinds", lambda x: F.array_position("_bag", x)))
    tf = F.transform("_kinds", lambda x, i: F.struct(x.alias("token"), (F.coalesce(F.get("_at", i + 1), F.size("_bag") + 1) - F.get("_at", i)).alias("tf")))
    rows_of = materialise(bags.select("doc", block, "_copies", F.explode(tf).alias("e")).select("doc", block, "_copies", "e.token", "e.tf"))
    n = docs.groupBy(block).agg(F.sum(one(rows)).alias("n_docs"))
    df = rows_of.groupBy(block, "token").agg(F.sum("_copies").alias("df"), F.count(F.lit(1)).alias("freq"))
    number = rank_rows(df, [F.col("df").asc(), F.col(block).asc(), F.col("token").asc()], (), "_no", "_all").join(materialise(n), block)
    number = number.select(block, "token", F.col("_no").cast("int").alias("no"), "freq", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    entry = F.struct("no", F.col("freq").cast("int").alias("freq"), (F.col("tf") * F.col("idf")).alias("w"))
    v = rows_of.where(F.col("doc").isNotNull()).join(number, [block, "token"]).groupBy("doc", block).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    v = materialise(v.select("doc", block, F.col("e.no").alias("no"), F.col("e.freq").alias("freq"), F.col("e.w").alias("w"), F.monotonically_increasing_id().alias("sid")))
    square = F.aggregate("w", lit(0), lambda a, x: a + x * x)
    # the length of a document of several blocks counts all of them
    several = materialise(v.groupBy("doc").agg(F.count(F.lit(1)).alias("_k"), F.sum(square).alias("_all")).where("_k > 1").drop("_k"))
    norm = F.sqrt(F.coalesce("_all", square))
    return v.join(several, "doc", "left").withColumn("_norm", norm).select("sid", "doc", block, "no", "freq", F.transform("w", lambda x: x / F.col("_norm")).alias("w"))


SKETCH = 64  # buckets of a sketch, eight to a long


def _index_rows(threshold: float):
    """Index rows of vectors, for mapInArrow: the tokens from which the threshold is reachable.

    A row has upper bounds of the weight of its token and of what follows it:
    its length, and the length of the part in each bucket of token numbers, in
    255ths, eight buckets to a long.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        up = lambda x: np.nextafter(x.astype(np.float32), np.float32(np.inf))

        def rows(sid, no, freq, w, first, size):
            # vectors of like length are padded to one matrix
            cell = first[:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)
            there = np.arange(size.max()) < size[:, None]
            sq = np.where(there, w[cell] ** 2, 0.0)
            onward = lambda x: np.cumsum(x[:, ::-1], axis=1)[:, ::-1]
            rest = onward(sq)
            at = there & (freq[cell] > 1) & (rest >= threshold * threshold - 1e-9)
            if not at.any():
                return None
            tail = np.sqrt(np.maximum(rest[at] - sq[at], 0.0) + 1e-12)
            bucket, sketch = no[cell] % SKETCH, np.empty((int(at.sum()), SKETCH), np.uint8)
            for b in range(SKETCH):
                mine = np.where(bucket == b, sq, 0.0)
                left = onward(mine)[at] - mine[at]
                sketch[:, b] = np.where(left > 1e-15, np.minimum(np.ceil(np.sqrt(np.maximum(left, 0.0)) * 255 + 1e-6), 255), 0)
            packed = sketch.view("<i8")
            owner = np.broadcast_to(sid[:, None], at.shape)[at]
            return [owner, no[cell][at], freq[cell][at], up(w[cell][at]), up(tail), *(np.ascontiguousarray(packed[:, k]) for k in range(SKETCH // 8))]

        names = ["sid", "no", "freq", "w", "tail", *(f"s{k}" for k in range(SKETCH // 8))]
        for b in batches:
            size = pc.list_value_length(b.column("no")).to_numpy(zero_copy_only=False).astype(np.int64)
            sid, first = b.column("sid").to_numpy(), np.cumsum(size) - size
            no, freq, w = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("no", "freq", "w"))
            order, lo = np.argsort(size, kind="stable"), 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= 200_000:
                    hi += 1
                mine = order[lo:hi]
                found = rows(sid[mine], no, freq, w, first[mine], size[mine])
                if found is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)
                lo = hi

    return run


def _bounded(least: float):
    """Met pairs whose token and sketches can reach ``least``, for mapInArrow."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            sketch = lambda s: np.stack([b.column(f"s{k}_{s}").to_numpy() for k in range(SKETCH // 8)], axis=1).view(np.uint8).astype(np.int32)
            bound = b.column("here").to_numpy() + (sketch("l") * sketch("r")).sum(axis=1) / 255.0**2
            yield b.select(["l", "r"]).filter(pa.array(bound >= least))

    return run


def _products(threshold: float):
    """Pairs whose vectors have a product at the threshold, for mapInArrow."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def side(b, s):
            n = pc.list_value_length(b.column(f"no_{s}")).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows, dtype=np.int64), n)
            no, w = (b.column(f"{c}_{s}").flatten().to_numpy(zero_copy_only=False) for c in ("no", "w"))
            return row, (row << 32) | no, w

        for whole in batches:
            # long vectors: few pairs at a time
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                (row, key, w), (_, other, x) = side(b, "l"), side(b, "r")
                at = np.minimum(np.searchsorted(other, key), len(other) - 1)
                dot = np.bincount(row, np.where(other[at] == key, w * x[at], 0.0), b.num_rows)
                keep = pa.array(dot >= threshold - 1e-9)
                cols = [b.column(i) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(dot)], names=[*b.schema.names[:3], "similarity"]).filter(keep)

    return run


def _met(vectors: DataFrame, threshold: float) -> DataFrame:
    """Distinct (l, r) numbers of vectors that share an index token from which the threshold is reachable, hot tokens salted."""
    parts = [f"s{k}" for k in range(SKETCH // 8)]
    schema = "sid long, no int, freq int, w float, tail float, " + ", ".join(f"{c} long" for c in parts)
    index = materialise(vectors.select("sid", "no", "freq", "w").mapInArrow(_index_rows(threshold), schema))
    slices = F.ceil(F.col("freq") / SALT_SIZE).cast("int")
    side = lambda s, salt: index.select(F.col("sid").alias(s), "no", salt.alias("salt"), *[F.col(c).alias(f"{c}_{s}") for c in ("w", "tail", *parts)])
    met = side("l", F.explode(F.sequence(F.lit(0), slices - 1))).join(side("r", F.pmod(F.xxhash64("sid"), slices).cast("int")), ["no", "salt"])
    here, least = F.col("w_l").cast("double") * F.col("w_r"), threshold - 1e-6
    met = met.where((F.col("l") < F.col("r")) & (here + F.col("tail_l").cast("double") * F.col("tail_r") >= least))
    return met.select("l", "r", here.alias("here"), *[f"{c}_{s}" for s in ("l", "r") for c in parts]).mapInArrow(_bounded(least), "l long, r long").distinct()


def cosine_pairs(vectors: DataFrame, block: str, threshold: float) -> DataFrame:
    """Pairs of a block with cosine at or above the threshold: block, l, r, similarity.

    A vector is indexed by its rarest tokens until the rest is shorter than the
    threshold; a qualifying pair meets on a token of both prefixes. Where a pair
    meets for the first time the product is that of the token and of what
    follows it, which sketches bound bucket by bucket, so that few others are
    compared in full.
    """
    met = _met(vectors, threshold)
    whole = lambda s, *cols: vectors.select(F.col("sid").alias(s), F.col("doc").alias(f"doc_{s}"), F.col("no").alias(f"no_{s}"), F.col("w").alias(f"w_{s}"), *cols)
    j = met.join(whole("l"), "l").join(whole("r", block), "r")
    kept = j.select(block, "doc_l", "doc_r").schema.add("similarity", "double")
    j = j.select(block, "doc_l", "doc_r", "no_l", "w_l", "no_r", "w_r").mapInArrow(_products(threshold), kept)
    return j.select(block, F.least("doc_l", "doc_r").alias("l"), F.greatest("doc_l", "doc_r").alias("r"), "similarity")
