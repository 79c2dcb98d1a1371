"""MinHash near-duplicates by fast similarity sketching.

Sketch: in round r every shingle is hashed to a bin and a value; a bin keeps
the smallest (round, value). The first ``COORDS`` rounds choose bins at random,
the next ``COORDS`` rounds address bin 0, 1, ... in turn, so every coordinate
is filled at the latest then, and the share of equal coordinates of two
sketches concentrates around the Jaccard similarity as for independent
minima. Rounds stop when a row's bins are full, after a few for usual texts.

Candidates share a band of ``ROWS`` coordinates. Equal sets are folded first. In
each bucket, every set is tested against a hub: the set that shares buckets with
the most others (of a text and its variants that is the text). Only connected
groups are asked for, so sets that both link to the hub are done. Two sets where
one does not link to its hub can link only if they share a change to it (an
addition or an omission): with none in common, J(u, v) <= J(u, hub). In further
rounds the sets that share a change are therefore tested against one of
themselves, and go on together only with those that share a further change
(``linked`` has the argument). The rarest changes decide who meets, and a group is
dropped once its sets are known to be connected. A round emits one pair per set
and group, never the pairs of a group, and no link is lost. All tests compare the
full shingle sets, so a link is never false; a pair at the threshold is missed
with probability ``(1 - 0.75^ROWS)^BANDS`` (3e-7).

Defined results: null, empty and blank texts have the empty set and link to
nothing; texts below five words are one shingle; equal texts link; null ids
take part and a component's id is its smallest id that is not null; repeated
rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from marketlab.llm.common import BLANK_WORDS, components, forget, mix, row_blocks, stored, text_key, utf8, word_spans

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 4, 40
COORDS = ROWS * BANDS
SMALL = 8  # sets of a group that are tested with each other at once, at most 3.5 pairs per set
BLOCK = 2 << 20
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SEED = mix(np.arange(2 * COORDS, dtype=np.uint64) + np.uint64(0xABCDEF))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows, concatenated and sorted inside a row, and their offsets."""
    rows, words = [], []
    for r, _, _, h in word_spans(data, offs, BLANK_WORDS):
        rows.append(r)
        words.append(h)
    n = len(offs) - 1
    counts = np.bincount(np.concatenate(rows), minlength=n) if rows else np.zeros(n, np.int64)
    w = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    roll = np.zeros(w.size, np.uint64)
    for j in range(SHINGLE):
        roll[: max(w.size - j, 0)] += w[j:] * _STEP[j]
    roll = mix(roll)
    sets = []
    for e, c in zip(ends.tolist(), counts.tolist()):
        if c >= SHINGLE:
            sets.append(np.unique(roll[e - c : e - SHINGLE + 1]))
        elif c:
            whole = np.array([c], np.uint64)
            for k in range(e - c, e):
                whole = mix(whole * _STEP[0] + w[k : k + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    sizes = np.array([s.size for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def sketch(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, COORDS) sketches; rows of empty sets keep the largest value."""
    n = len(offs) - 1
    out = np.full(n * COORDS, np.iinfo(np.uint64).max, np.uint64)
    row = np.repeat(np.arange(n), np.diff(offs))
    x = values
    for r in range(2 * COORDS):
        h = mix(x ^ _SEED[r])
        at = ((h >> np.uint64(48)) * np.uint64(COORDS) >> np.uint64(16)).astype(np.int64) if r < COORDS else np.int64(r - COORDS)
        np.minimum.at(out, row * COORDS + at, (np.uint64(r) << np.uint64(48)) | (h & np.uint64((1 << 48) - 1)))
        short = (out.reshape(n, COORDS) == np.iinfo(np.uint64).max).any(1)
        more = short[row]
        if not more.any():
            break
        if not more.all():
            row, x = row[more], x[more]
    return out.reshape(n, COORDS)


def sketch_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, _t, n, rid, bands) of every document; rid names its shingle set."""
    d = docs.select("doc_id", text_key(F.col("text")).alias("_t"), "text")
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, _t long, n long, rid long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for a, b in row_blocks(offs, BLOCK):
                values, vo = shingle_sets(data, offs[a : b + 1])
                sk = sketch(values, vo)
                size = np.diff(vo)
                total = np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(1)))])[vo]).astype(np.uint64)
                name = mix(total + size.astype(np.uint64))
                cells = sk.reshape(b - a, BANDS, ROWS)
                band = np.zeros((b - a, BANDS), np.uint64)
                for j in range(ROWS):
                    band = mix(band + cells[:, :, j] * _STEP[j] + np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("_t").slice(a, b - a),
                        pa.array(size, pa.int64()),
                        pa.array(name.view(np.int64), pa.int64()),
                        pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "_t", "n", "rid", "bands"],
                )

    return d.mapInArrow(run, schema)


def full_sets(texts: DataFrame) -> DataFrame:
    """(rid, s) with the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for a, b in row_blocks(offs, BLOCK):
                values, vo = shingle_sets(data, offs[a : b + 1])
                lists = pa.ListArray.from_arrays(pa.array(vo, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(a, b - a), lists], names=["rid", "s"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, s array<long>")


def changes(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, n, d, link, diff): set a of n shingles, the d shingles in which it differs from hub b, and whether they link."""
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("_sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("_sb")), "b")
    both = both.withColumns({"n": F.size("_sa"), "diff": F.concat(F.array_except("_sa", "_sb"), F.array_except("_sb", "_sa"))})
    common = (F.col("n") + F.size("_sb") - F.size("diff")) / 2
    return both.select("a", "b", "n", F.size("diff").alias("d"), (100 * common >= percent * (common + F.size("diff"))).alias("link"), "diff")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, link) from the full sets."""
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("_sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("_sb")), "b")
    both = both.withColumn("_i", F.size(F.array_intersect("_sa", "_sb")))
    return both.select("a", "b", (100 * F.col("_i") >= percent * (F.size("_sa") + F.size("_sb") - F.col("_i"))).alias("link"))


def regroup(paths: DataFrame, seen: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Next paths (path, b, y, a): sets that share a change to b which not all of their path share, with their tester y;
    and the pairs (a, y) of groups of at most ``SMALL`` sets, which are tested at once.

    ``paths`` holds (path, b, a, link, top, c): sets a with component c as known,
    and whether they link to the tester of the path; ``top`` is that tester.
    ``seen`` holds the changes of a to b. Two sets u, v that link differ by at most
    r (n_u + n_v) shingles, r = (100 - percent) / (100 + percent). So d_u - r n_u <=
    d_v + r n_v, and they have (z_u + z_v) / 2 changes in common, z = d - r n, and
    d_u - r (n_u + n_v): they meet in one of the rarest changes of both (prefix
    filter). Two sets that are not linked to the tester (kind U) need more in
    common than one with a linked set (kind L). z and hi are in units of
    1 / (100 + percent).
    """
    up, down = 100 + percent, 100 - percent
    rows = paths.join(seen.select("a", "b", "n", "d", "diff"), ["a", "b"]).withColumns({"z": up * F.col("d") - down * F.col("n"), "hi": up * F.col("d") + down * F.col("n")})
    mine = lambda c: F.when(~F.col("top"), F.col(c))
    held, free = ~F.col("top") & F.col("link"), ~F.col("top") & ~F.col("link")
    doubt = [F.count_if(free).alias("_nu"), F.count_if(held).alias("_nl"), F.min(mine("c")).alias("_c1"), F.max(mine("c")).alias("_c2")]
    reach = [F.min(F.when(free, F.col("z"))).alias("_zu"), F.min(F.when(held, F.col("z"))).alias("_zl"), F.max(F.when(held, F.col("hi"))).alias("_hl"), F.max(mine("n")).alias("_nm")]
    # without a tester in ``seen`` it is b itself, which has no change to b
    whole = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_size"), F.max("top").alias("_has"), *reach, *doubt).where("_nu > 0 and _c1 <> _c2").drop("_c1", "_c2", "_nl")
    able = F.col("top") | (F.col("link") & (F.col("hi") >= F.col("_zu"))) | (~F.col("link") & ((F.col("_nu") > 1) | (F.col("z") <= F.col("_hl"))))
    rows = stored(rows.join(whole.drop("_size", "_has"), "path").where(able).drop("_nu", "hi"))
    size = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_size"), F.max("top").alias("_has"))
    each = rows.join(size, "path").select("path", "b", "a", "link", "top", "c", "n", "d", "z", "_zu", "_zl", "_nm", "_size", "_has", F.explode("diff").alias("g"))
    # the sets of one path that hold one change are counted where they lie sorted; no table of counts is joined
    of, own = W.partitionBy("path", "g"), W.partitionBy("path", "a")
    names = ("_nu", "_nl", "_c1", "_c2")
    met = each.withColumns({"_m": F.count(F.lit(1)).over(of), **{k: e.over(of) for k, e in zip(names, (F.count_if(free), F.count_if(held), F.min(mine("c")), F.max(mine("c"))))}})
    met = met.withColumn("_core", F.col("_has") & (F.col("_m") == F.col("_size"))).withColumn("_k0", F.count_if("_core").over(own))
    kinds = F.filter(F.array(F.when(F.col("_nu") > 1, F.lit("U")), F.when(F.col("_nl") > 0, F.lit("L"))), lambda k: k.isNotNull())
    met = met.where("not top and not _core and _m > 1 and _nu > 0 and _c1 <> _c2").withColumn("kind", F.explode(kinds)).where("kind = 'L' or not link")
    kind = W.partitionBy("path", "kind", "a")
    met = met.withColumns({"_k": F.count(F.lit(1)).over(kind), "_r": F.row_number().over(kind.orderBy("_m", "g"))})
    least = F.when((F.col("kind") == "U") | F.col("link"), F.col("_zu")).otherwise(F.col("_zl"))
    other = F.least(F.col("_nm"), F.floor(100 * F.col("n") / F.lit(percent)))
    need = F.greatest(F.ceil((F.col("z") + least) / F.lit(2 * up)), F.ceil((up * F.col("d") - down * (F.col("n") + other)) / F.lit(up))) - F.col("_k0")
    cells = stored(met.where(F.col("_r") <= F.col("_k") - F.greatest(F.lit(1), need) + 1).select("path", "kind", "g", "b", "a", "link", "top", "c", "z"))
    key = ["path", "kind", "g"]
    groups = cells.groupBy(*key, "b").agg(F.count(F.lit(1)).alias("_m"), F.min_by("a", F.struct("z", "a")).alias("y"), F.bit_xor(F.xxhash64("a")).alias("_who"), *doubt)
    # the shingles around one changed word have the same sets: one of them is enough
    once = groups.where("_nu > 0 and _c1 <> _c2").groupBy("b", "y", "_m", "_who").agg(F.min(F.struct(*key)).alias("_k")).select("y", "_m", "_k.*")
    once = stored(once)
    out = stored(cells.join(once.where(F.col("_m") > SMALL), key).select(F.xxhash64(*key).alias("path"), "b", "y", "a", "c"))
    few = cells.join(once.where(F.col("_m") <= SMALL).select(*key), key)
    pair = few.alias("l").join(few.alias("r"), key).where("l.a > r.a and l.c <> r.c and not (l.link and r.link)")
    direct = stored(pair.select(F.col("l.a").alias("a"), F.col("r.a").alias("y")).distinct())
    for frame in (rows, cells, once):
        forget(frame)
    return out, direct


def linked(members: DataFrame, sets: DataFrame, percent: int = PERCENT, max_rounds: int = 1000) -> tuple[DataFrame, list[int]]:
    """Component (node, root) of every set of the buckets ``members(key, rid, w)``, and the pairs tested per round.

    Round 0 tests each set against the hubs of its buckets. Later rounds test
    the sets of a path against one of them, y, whose changes to the hub are
    fewest (least z). If u and v link and share no change to the hub but those
    that all of their path share, u and v differ by z_u + z_v at most, and as
    z_y is no larger both link to y. So two sets can only have a link not known
    yet if they share a further change; the sets of a path that share one form
    a path of the next round. It is smaller by y and by all without that change,
    so a round emits at most one pair per set and path, and rounds end.
    """
    hubs = members.groupBy("key").agg(F.max_by("rid", F.struct("w", "rid")).alias("b"))
    seen = stored(changes(members.join(hubs, "key").where("rid <> b").select(F.col("rid").alias("a"), "b").distinct(), sets, percent))
    counts = [seen.count()]
    roots = stored(components(seen.where("link").select("a", "b")))
    known = lambda d: d.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_c")), "a", "left").withColumn("c", F.coalesce("_c", "a")).drop("_c")
    paths, used, done = known(seen.select(F.col("b").alias("path"), "b", "a", "link", F.lit(False).alias("top"))), [seen], None
    for _ in range(max_rounds):
        groups, direct = regroup(paths, seen, percent)
        used += [groups, direct]
        low, high = F.least("a", "y"), F.greatest("a", "y")
        tests = groups.where("a <> y").select("a", "y").unionByName(direct).select(high.alias("a"), low.alias("b")).distinct()
        tests = tests if done is None else tests.join(done.select("a", "b"), ["a", "b"], "left_anti")
        told = stored(verify(tests, sets, percent))
        used.append(told)
        counts.append(told.count())
        done = told if done is None else done.unionByName(told)
        if groups.isEmpty():
            break
        result = groups.select("path", "b", "y", "a", "c", high.alias("_u"), low.alias("_v")).join(done.select(F.col("a").alias("_u"), F.col("b").alias("_v"), "link"), ["_u", "_v"], "left")
        paths = result.select("path", "b", "a", F.coalesce("link", F.lit(True)).alias("link"), (F.col("a") == F.col("y")).alias("top"), "c")
    else:
        raise RuntimeError("groups did not settle")
    edges = done.where("link").select("a", "b")
    named = known(members.select(F.col("rid").alias("a")).distinct())
    # later links join components of round 0
    of = lambda v: known(edges.select(F.col(v).alias("a"), "_i")).select("_i", F.col("c").alias(v))
    edges = stored(edges.withColumn("_i", F.xxhash64("a", "b")).distinct())
    used.append(edges)
    later = components(of("a").join(of("b"), "_i").select("a", "b"))
    named = named.join(later, F.col("c") == F.col("node"), "left").select("a", F.coalesce("root", "c").alias("c"))
    named = stored(named.select(F.col("a").alias("node"), F.col("c").alias("root")))
    forget(roots)
    for frame in used:
        forget(frame)
    return named, counts


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, _t (text key), n_shingles, root (names the group, null for empty sets), component_id, kept."""
    sk = stored(sketch_rows(docs))
    full = sk.where("n > 0")
    cells = full.select("rid", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.min("rid").alias("_near"), F.max("rid").alias("_far"), F.count(F.lit(1)).alias("size")).where("_near <> _far").select("key", "size")
    members = stored(cells.join(shared, "key").distinct())  # (key, rid, size) of buckets with more than one set
    central = members.groupBy("rid").agg(F.sum("size").alias("w"))
    members = stored(members.join(central, "rid").select("key", "rid", "w"))
    # texts of all sets that need a test, one document per set
    wanted = members.select("rid").distinct()
    keys = full.join(wanted, "rid").groupBy("rid").agg(F.min(F.struct("doc_id", "_t")).alias("k")).select("rid", F.col("k.doc_id").alias("_d"), F.col("k._t").alias("_k"))
    own = docs.select("doc_id", "text").withColumn("_t", text_key(F.col("text")))
    sets = stored(full_sets(own.join(keys, own["doc_id"].eqNullSafe(keys["_d"]) & (own["_t"] == keys["_k"])).select("rid", "text")))
    roots, _ = linked(members, sets, percent)
    named = full.groupBy("rid").agg(F.min("doc_id").alias("low")).join(roots, F.col("rid") == F.col("node"), "left").select("rid", "low", F.coalesce("root", "rid").alias("root"))
    named = stored(named)
    for frame in (members, sets):
        forget(frame)
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = named.join(low, "root").select(F.col("rid").alias("_r"), "root", "component_id")
    out = sk.join(label, (F.col("rid") == F.col("_r")) & (F.col("n") > 0), "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_t", F.col("n").alias("n_shingles"), "root", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of smallest id, empty texts all.

    Among repeated rows of that id one stays.
    """
    found = near_duplicates(docs, percent)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    best = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_t")).alias("k")).select("k.*")
    best = best.select(name(F.col("doc_id")).alias("_a"), F.col("z").alias("_z"), "_t")
    rows = docs.select(F.struct("*").alias("_row"), name(F.col("doc_id")).alias("_a"), F.col("doc_id").isNull().alias("_z"), text_key(F.col("text")).alias("_t"), (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) > 0).alias("_full"))
    stay = rows.where("_full").join(best, ["_a", "_z", "_t"]).dropDuplicates(["_a", "_z", "_t"]).select("_row.*")
    return stay.unionByName(rows.where("not _full").select("_row.*"))
