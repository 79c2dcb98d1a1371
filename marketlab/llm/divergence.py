"""Source divergence audit: word profiles of sources against each other and their language.

Kept terms by iceberg prefix refinement: a term is kept if ``least`` documents of
its language hold it, and no document holds a term without its byte prefixes. One
scan of the texts leaves, per task, the document counts of prefixes of 2, 4, 8,
16, ... bytes and of complete terms. Levels are then read in turn: prefixes of the
next length count only below prefixes that reached ``least`` documents one level
up, and complete terms only below such a prefix of their longest proper length.
What is rare is dropped by a hash of a few bytes and its text is never shuffled.
Survivors enter the tasks as a bit set of fixed size; two prefixes that share a
bit live one level longer, and the last step counts complete terms exactly.

Profiles: probabilities are whole numbers in units of 1e-9 with one added count
per kept term. Term rows compare a source with its language. Pair rows sum over
all kept terms; they are computed in blocks of terms (and tiles of sources), in
which each source's probabilities are one row of a matrix, so that no list of
pairs per term exists. A block is bounded by a number of cells.

Defined results: null text, lang and source read as ''. Repeated rows are
documents of their own. Every (lang, source) that occurs has pair rows, with value
0 where the language keeps no term. Empty tables give no rows; further columns are
ignored. Terms, prefixes and blocks are named by 64-bit hashes inside a task or
block; terms meet across tasks as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from marketlab.llm.common import _CODES, classes, forget, mix, powers, row_blocks, stored, utf8, word_spans

LEAST = 3
UNIT = 1_000_000_000
TOP = 200
FIRST_LEVEL = 2
FILTER_BITS = 1 << 23
BLOCK_CELLS = 32_000
TILE = 512
_TEXTS = 4 << 20
_HELD = 1 << 20
LETTERS = classes(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_KEYS = ["docs", "count"]


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, letters folded."""
    first = np.cumsum(sizes) - sizes
    k = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    codes = LETTERS[data[np.repeat(starts, sizes) + k]]
    return mix(np.add.reduceat(_CODES[codes] * powers(int(sizes.max()) + 1)[k], first) + sizes.astype(np.uint64))


def prefix_names(hashes: np.ndarray, lang: np.ndarray, level: int) -> np.ndarray:
    return mix(hashes ^ mix(lang + np.uint64(level)))


def summed(parts: list[pa.Table], by: list[str], sums: list[str]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(by).aggregate([(c, "sum") for c in sums])
    return t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select([*by, *sums])


def block_counts(data: np.ndarray, offs: np.ndarray, group: np.ndarray, lang: np.ndarray) -> tuple[pa.Table, pa.Table] | None:
    """Term rows (group, term, parent, docs, count) and prefix rows (level, name, parent, docs) of some documents.

    ``group`` numbers the (lang, source) of a document, ``lang`` hashes its language.
    """
    found = list(word_spans(data, offs, LETTERS))
    if not found:
        return None
    rows, starts, ends, h = (np.concatenate(x) for x in zip(*found))
    _, at, term = np.unique(h, return_index=True, return_inverse=True)
    starts, sizes = starts[at], (ends - starts)[at]
    u = len(at)
    pair, times = np.unique(rows.astype(np.int64) * u + term, return_counts=True)
    row, term = pair // u, pair % u
    levels, parent, k = [], np.zeros(len(pair), np.uint64), FIRST_LEVEL
    while True:
        long = np.flatnonzero(sizes > k)
        if not long.size:
            break
        prefix = np.zeros(u, np.uint64)
        prefix[long] = span_hashes(data, starts[long], np.full(long.size, k))
        on = np.flatnonzero(sizes[term] > k)
        name = prefix_names(prefix[term[on]], lang[row[on]], k)
        # one row per (document, prefix), then documents per prefix
        order = np.lexsort((name, row[on]))
        r, n = row[on][order], name[order]
        new = np.ones(len(n), bool)
        new[1:] = (r[1:] != r[:-1]) | (n[1:] != n[:-1])
        ids, first, docs = np.unique(n[new], return_index=True, return_counts=True)
        up = parent[on][order][new][first]
        levels.append(pa.table({"level": pa.array(np.full(len(ids), k), pa.int32()), "name": ids.view(np.int64), "parent": up.view(np.int64), "docs": docs}))
        parent[on] = name
        k *= 2
    key, first, inv = np.unique(group[row].astype(np.int64) * u + term, return_index=True, return_inverse=True)
    raw = data.tobytes() if u > 1000 else data
    words = [bytes(raw[a : a + s]).lower().decode() for a, s in zip(starts.tolist(), sizes.tolist())]
    terms = pa.table(
        {
            "group": key // u,
            "term": pa.array(words, pa.string()).take(pa.array(key % u)),
            "parent": parent[first].view(np.int64),
            "docs": np.bincount(inv),
            "count": np.bincount(inv, times).astype(np.int64),
        }
    )
    return terms, pa.concat_tables(levels) if levels else None


def local_counts(docs: DataFrame) -> DataFrame:
    """Per task: term rows (level 0) and prefix rows of all documents in one frame."""
    schema = "level int, name long, parent long, lang string, source string, term string, docs long, count long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, prefixes, groups = [], [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            listed = list(groups)
            if terms:
                t = summed(terms, ["group", "term", "parent"], _KEYS)
                g = t["group"].combine_chunks()
                pick = lambda i: pa.array([x[i] for x in listed], pa.string()).take(g)
                n = len(t)
                t = pa.table([pa.array(np.zeros(n), pa.int32()), pa.array(np.zeros(n), pa.int64()), t["parent"], pick(0), pick(1), t["term"], t["docs"], t["count"]], names=names)
                yield from t.to_batches(1 << 16)
            if prefixes:
                p = summed(prefixes, ["level", "name", "parent"], ["docs"])
                none = pa.nulls(len(p), pa.string())
                p = pa.table([p["level"], p["name"], p["parent"], none, none, none, p["docs"], pa.array(np.zeros(len(p)), pa.int64())], names=names)
                yield from p.to_batches(1 << 16)
            terms.clear()
            prefixes.clear()

        for batch in batches:
            data, offs = utf8(batch.column("text"))
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            group = np.array([groups.setdefault(p, len(groups)) for p in pairs], np.int64)
            lang = batch.column("_l").to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in row_blocks(offs, _TEXTS):
                made = block_counts(data, offs[a : b + 1], group[a:b], lang[a:b])
                if made:
                    terms.append(made[0])
                    prefixes += [made[1]] if made[1] is not None else []
                if sum(map(len, terms)) + sum(map(len, prefixes)) > _HELD:
                    terms[:] = [summed(terms, ["group", "term", "parent"], _KEYS)]
                    prefixes[:] = [summed(prefixes, ["level", "name", "parent"], ["docs"])] if prefixes else []
                    if len(terms[0]) > _HELD // 2:
                        yield from flush()
        yield from flush()

    return docs.mapInArrow(run, schema)


def below(rows: DataFrame, alive: np.ndarray) -> DataFrame:
    """Rows whose parent prefix is alive, or that have none (parent 0)."""
    shared = rows.sparkSession.sparkContext.broadcast(alive)  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            p = batch.column("parent").to_numpy(zero_copy_only=False)
            at = p & (FILTER_BITS - 1)
            yield batch.filter(pa.array((p == 0) | ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)))

    return rows.mapInArrow(run, rows.schema)


def refine(local: DataFrame, least: int) -> np.ndarray:
    """Bit set of the prefixes of all levels that ``least`` documents hold."""
    alive = np.zeros(FILTER_BITS // 64, np.uint64)
    deepest = local.agg(F.max("level")).first()[0] or 0
    level = FIRST_LEVEL
    while level <= deepest:
        rows = local.where(F.col("level") == level).select("name", "parent", "docs")
        rows = below(rows, alive) if level > FIRST_LEVEL else rows
        stay = rows.groupBy("name").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        at = F.col("name").bitwiseAND(F.lit(FILTER_BITS - 1))
        words = stay.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(name & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        if words.empty:
            break
        alive[words["w"].to_numpy(np.int64)] |= words["b"].to_numpy(np.int64).view(np.uint64)
        level *= 2
    return alive


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, count, lang_count, first) of kept terms; ``first`` marks one row per (lang, term)."""
    local = stored(local_counts(docs))
    terms = below(local.where("level = 0").select("parent", "lang", "source", "term", "docs", "count"), refine(local, least))
    sums = terms.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("count"))
    of = W.partitionBy("lang", "term")
    c = sums.withColumns({"_df": F.sum("docs").over(of), "lang_count": F.sum("count").over(of), "first": F.min("source").over(of) == F.col("source")})
    out = stored(c.where(F.col("_df") >= least).select("lang", "source", "term", "count", "lang_count", "first"))
    forget(local)
    return out


def chance(count, total, kinds):
    """1 + floor(1e9 (count + 1) / (total + kinds)), exact for any counts."""
    whole = lambda c: F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)")
    top, below_ = F.lit(UNIT).cast("decimal(10,0)") * (whole(count) + 1), whole(total) + whole(kinds)
    return (F.floor((top - F.pmod(top, below_)) / below_)).cast("long") + 1


def pair_values(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, a, b, value) for sources numbered ``idx`` in each language: sums over all kept terms, a against b.

    ``sources`` holds lang, source, idx, n (counted terms), v (kept terms), blocks and tiles of its language.
    """
    tile = F.expr(f"idx div {TILE}")
    placed = lambda d: d.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles")))).withColumns({"ta": F.least(tile, "_o"), "tb": F.greatest(tile, "_o")})
    key = F.xxhash64("term")
    # joined by (lang, source) with a table of one row per source; no row moves by language alone
    have = counts.join(sources.select("lang", "source", "idx", "n", "v", "blocks", "tiles"), ["lang", "source"])
    have = have.select("lang", "idx", "tiles", "first", key.alias("t"), F.pmod(key, "blocks").alias("block"), chance("count", "n", "v").alias("p"))
    kinds = have.where("first").groupBy("lang", "block").agg(F.count(F.lit(1)).alias("kinds"))
    have = placed(have.withColumn("kinds", F.lit(0).cast("long")))
    none = sources.where("v > 0").select("lang", "idx", "tiles", F.lit(None).cast("long").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chance(F.lit(0), "n", "v").alias("p"))
    none = none.join(kinds, ["lang", "block"], "left").na.fill(0, ["kinds"])
    cols = ["lang", "block", "ta", "tb", "idx", "t", "p", "kinds"]
    rows = have.select(cols).unionByName(placed(none).select(cols))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        base, rest = pdf[pdf["t"].isna()].sort_values("idx"), pdf[pdf["t"].notna()]
        idx = base["idx"].to_numpy(np.int64)
        names, term = np.unique(rest["t"].to_numpy(np.int64), return_inverse=True)
        row, p = np.searchsorted(idx, rest["idx"].to_numpy(np.int64)), rest["p"].to_numpy(np.int64)
        order = np.argsort(term, kind="stable")
        row, p, term = row[order], p[order], term[order]
        total = np.zeros((len(idx), len(idx)), np.int64)
        step = max(1, (1 << 20) // max(len(idx), 1))
        zero = base["p"].to_numpy(np.int64)
        for a in range(0, len(names), step):
            lo, hi = np.searchsorted(term, [a, a + step])
            m = np.repeat(zero[:, None], min(step, len(names) - a), 1)
            m[row[lo:hi], term[lo:hi] - a] = p[lo:hi]
            for i in range(len(idx)):
                d = m[i] - m
                total[i] += (d * d // m).sum(1)
        # terms of the block that none of these sources holds
        absent = int(base["kinds"].iloc[0]) - len(names)
        d = zero[:, None] - zero[None, :]
        total += absent * (d * d // zero[None, :])
        i, j = np.nonzero(~np.eye(len(idx), dtype=bool))
        # a pair inside one tile belongs to the group of that tile with itself
        tile_of = idx // TILE
        own = np.minimum(tile_of[i], tile_of[j]), np.maximum(tile_of[i], tile_of[j])
        mine = (own[0] == key[2]) & (own[1] == key[3])
        return pd.DataFrame({"lang": key[0], "a": idx[i[mine]], "b": idx[j[mine]], "value": total[i[mine], j[mine]]})

    part = rows.groupBy("lang", "block", "ta", "tb").applyInPandas(run, "lang string, a long, b long, value long")
    return part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = docs.select(text("text"), text("lang"), text("source"))
    counts = kept_counts(d.withColumn("_l", F.xxhash64("lang")), least)
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = counts.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum(F.col("first").cast("long")).alias("v"), (F.expr(f"count(1) div {BLOCK_CELLS}") + 1).alias("blocks"))
    sources = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    sources = sources.na.fill(0, ["n", "lang_n", "v", "blocks"]).withColumn("tiles", F.expr(f"(count(1) over (partition by lang) - 1) div {TILE}")).withColumn("idx", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1)
    sources = stored(sources)
    f = F.expr("((p - q) * (p - q)) div q")
    t = counts.join(sources.select("lang", "source", "n", "lang_n", "v"), ["lang", "source"])
    t = t.select("lang", "source", F.col("term").alias("item"), chance("count", "n", "v").alias("p"), chance("lang_count", "lang_n", "v").alias("q")).where("p > q")
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = t.select("lang", "source", F.lit("term").alias("part"), "item", f.alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    other = sources.select("lang", F.col("source").alias("item"), F.col("idx").alias("b"))
    pairs = sources.select("lang", "source", F.col("idx").alias("a")).join(other, "lang").where("a <> b").join(pair_values(counts, sources), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
