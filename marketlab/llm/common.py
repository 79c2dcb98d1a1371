"""Shared pieces: table access, row keys, vectorised UTF-8 scanning, components.

Row rule of the whole subpackage: an operator reads only the columns it names,
so extra or clashing columns never matter. A row is identified by
``(id, hash of its text)``; repeated rows share a key and get equal results,
null ids and null texts are ordinary values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlab.session import materialise

CHUNK = 1 << 20  # bytes scanned at once; bounds the memory of a task, not its input
SPACES = b" \t\n\x0b\x0c\r"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """Second half of a row key."""
    return F.xxhash64(text)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for ids whose crc32 (of the id as text) is a multiple of ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """Bit finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> np.uint64:
    return mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    kind, step = (np.int64, 8) if wide else (np.int32, 4)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], kind, count=len(column) + 1, offset=column.offset * step).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def classes(separators: bytes, fold: bool = True) -> np.ndarray:
    """Byte table: 0 for separators, else the byte (plus one, A-Z folded)."""
    t = np.arange(256, dtype=np.uint16) + 1
    if fold:
        t[65:91] = t[97:123]
    t[list(separators)] = 0
    return t


BLANK_WORDS = classes(SPACES)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = mix(np.arange(258, dtype=np.uint64) + np.uint64(0x51ED2701)) | np.uint64(1)
_POW = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POW
    if _POW.size < n:
        p = np.full(max(n, 64, 2 * _POW.size), _BASE, np.uint64)
        p[0] = 1
        _POW = np.multiply.accumulate(p)
    return _POW


def _cut(data: np.ndarray, offs: np.ndarray, pos: int, cls: np.ndarray) -> int:
    """End of the next chunk: a row end, or a separator inside a long row."""
    stop, end = pos + CHUNK, int(offs[-1])
    if stop >= end:
        return end
    row = int(np.searchsorted(offs, stop, "right")) - 1
    if offs[row] > pos:
        return int(offs[row])
    last = int(offs[row + 1])
    gaps = np.flatnonzero(cls[data[pos:stop]] == 0)
    if gaps.size:
        return pos + int(gaps[-1]) + 1
    while stop < last:  # one word longer than a chunk
        gaps = np.flatnonzero(cls[data[stop : min(stop + CHUNK, last)]] == 0)
        if gaps.size:
            return stop + int(gaps[0]) + 1
        stop += CHUNK
    return last


def word_spans(data: np.ndarray, offs: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: row, start, end (absolute bytes) and 64-bit hash of each word."""
    pos, end = int(offs[0]), int(offs[-1])
    while pos < end:
        stop = _cut(data, offs, pos, cls)
        codes = cls[data[pos:stop]]
        w = codes != 0
        edge = np.zeros(w.size + 1, bool)
        a, b = np.searchsorted(offs, [pos, stop], "left")
        edge[offs[a : b + 1][(offs[a : b + 1] >= pos) & (offs[a : b + 1] <= stop)] - pos] = True
        edge[0] = edge[-1] = True
        before, after = np.empty_like(w), np.empty_like(w)
        before[0], after[-1] = False, False
        before[1:], after[:-1] = w[:-1], w[1:]
        starts = np.flatnonzero(w & (edge[:-1] | ~before))
        ends = np.flatnonzero(w & (edge[1:] | ~after)) + 1
        if starts.size:
            lens = ends - starts
            first = np.cumsum(lens) - lens
            inside = codes[w]
            k = np.arange(inside.size) - np.repeat(first, lens)
            h = np.add.reduceat(_CODES[inside] * powers(int(lens.max()) + 1)[k], first)
            h = mix(h + lens.astype(np.uint64))
            rows = np.searchsorted(offs, pos + starts, "right") - 1
            yield rows, pos + starts, pos + ends, h
        pos = stop


def word_hashes(column: pa.Array, cls: np.ndarray = BLANK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and the word offsets of its rows."""
    data, offs = utf8(column)
    rows, hashes = [], []
    for r, _, _, h in word_spans(data, offs, cls):
        rows.append(r)
        hashes.append(h)
    n = len(offs) - 1
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    counts = np.bincount(np.concatenate(rows), minlength=n)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)])


def row_blocks(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about ``limit`` (one long row is its own run)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; its shuffle files go when it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialise(df)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def forget(df: DataFrame) -> None:
    """Delete a stored frame that no later step reads."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps on undirected edges; every
    round is a shuffle by node and is written to reliable storage. Hot nodes
    keep their neighbours as rows, never as one list.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, e = e, stored(small.where("a <> b").distinct())
        forget(last)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if (now["n"], now["s"]) == mark:
            break
        mark = (now["n"], now["s"])
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
