"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: the XXH64 hashes of all 3-word shingles, repeats included, vote on
64 bits; a bit is 1 if it is set in over half of them.

Tables: every bit position gets ``repeat`` codes of ``radius * repeat + 1`` bits;
a table is a nonzero code v, and its mask keeps the positions with a code of odd
inner product with v. Codes of at most ``radius`` differing positions span less
than the whole code space, so some v is orthogonal to all of them: its mask
leaves those positions out and the two fingerprints meet in that table. There are
no false negatives and no chance is involved. Radius 2 has 7 masks of about 37
bits; ``repeat`` 2 has 31 masks of about 48 bits, for more fingerprints than
buckets of 37 bits can tell apart.

Links inside a bucket: the pairs of a bucket are never listed. Fingerprints
within radius 2 have a midpoint, one bit from either, and all that share one are
within radius 2 of each other. Every fingerprint that meets another one in a
table therefore flips each bit left out by the masks of those tables, once, and
whoever lands on the same word is linked to the smallest there: at most 65 words
per fingerprint and 65 fingerprints per word, however large the bucket.

Defined results: null, empty and blank texts have fingerprint zero, which links
like any other; texts of one or two words are one shingle; equal texts share a
fingerprint; null ids take part, and a component's id is its smallest id that is
not null (null if there is none); repeated rows give repeated results; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from marketlab.llm.common import CHUNK, components, forget, mix, stored

SHINGLE = 3
SEED = 42
RADIUS = 2
_GAP = re.compile(rb"[\t-\r ]")


def pieces(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end at white space."""
    pos = 0
    while len(text) - pos > size:
        last = max(text.rfind(c, pos, pos + size) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
        if last < 0:
            gap = _GAP.search(text, pos + size)
            last = gap.start() if gap else len(text) - 1
        yield text[pos : last + 1]
        pos = last + 1
    if pos < len(text):
        yield text[pos:]


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of a text; it is read in pieces, so its length bounds nothing but time."""
    ones, n, words = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def vote(hashes: list[int]) -> None:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add(ones, bits.sum(0, dtype=np.int64), out=ones)

    for piece in pieces(text):
        words += piece.lower().split()
        if len(words) >= SHINGLE:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
            vote([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())])
            n += len(starts)
            words = words[1 - SHINGLE :]
    if not n and words:
        vote([digest(b" ".join(words), SEED)])
        n = 1
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64)) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; fp is the fingerprint as a signed long."""
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int = RADIUS, repeat: int = 1, bits: int = 64) -> list[int]:
    """Masks of the tables; any ``radius`` positions are left out together by one of them."""
    width = radius * repeat + 1
    nonzero = (1 << width) - 1
    order = np.argsort(mix(np.arange(bits, dtype=np.uint64)))  # neighbouring bits get unrelated codes
    codes = np.empty((bits, repeat), np.int64)
    for j in range(repeat):
        codes[np.roll(order, 11 * j), j] = (np.arange(bits) * (2 * j + 1)) % nonzero + 1
    odd = lambda v: np.array([any(int(c & v).bit_count() & 1 for c in row) for row in codes])
    return [sum(1 << int(i) for i in np.flatnonzero(odd(v))) for v in range(1, nonzero + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(values: DataFrame, repeat: int = 1) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``values(fp)`` as all pairs within radius 2 would."""
    table = lambda v, m: F.struct(F.lit(v).alias("t"), F.lit(signed(m)).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k"))
    cells = values.select("fp", F.explode(F.array(*[table(v, m) for v, m in enumerate(covering_masks(RADIUS, repeat))])).alias("c")).select("fp", "c.*")
    met = cells.groupBy("t", "k").agg(F.min("fp").alias("_a"), F.max("fp").alias("_b")).where("_a <> _b").select("t", "k")
    free = cells.join(met, ["t", "k"]).groupBy("fp").agg(F.bit_or(F.bitwise_not("m")).alias("free"))
    flips: Column = F.expr("concat(array(fp), transform(filter(sequence(0, 63), b -> getbit(free, b) = 1), b -> fp ^ shiftleft(1L, b)))")
    near = free.select("fp", F.explode(flips).alias("z")).groupBy("z").agg(F.sort_array(F.collect_set("fp")).alias("s")).where(F.size("s") > 1)
    return near.select(F.explode(F.slice("s", 2, 64)).alias("a"), F.get("s", F.lit(0)).alias("b")).distinct()


def near_duplicates(docs: DataFrame, repeat: int = 1) -> DataFrame:
    """One row per document: doc_id, fp (long), root (names the group), component_id."""
    fps = stored(fingerprints(docs))
    values = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(values.select("fp"), repeat))
    named = values.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = stored(named)
    forget(values)
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = named.select("fp", "root").join(low, "root")
    return fps.join(label, "fp").select("doc_id", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
