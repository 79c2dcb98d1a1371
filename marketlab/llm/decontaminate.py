"""Benchmark decontamination with an FM-index per training shard.

Windows of benchmark items are searched in the whole training text. A shard is
a run of document rows inside a task; its words are numbered by the benchmark
vocabulary, and runs of vocabulary words long enough to hold a window form the
indexed text (a word outside the vocabulary ends every match, so nothing else
can occur). The index is the Burrows-Wheeler transform of that text with a
wavelet matrix for ranks and sampled suffix positions: all windows are searched
backwards at once, occurrences are located by walking to the next sample, and
overlapping occurrences merge into removal spans.

The benchmark is read in blocks of bounded size; every block is a narrow pass
over the documents that adds to the spans of the pass before, so neither table
is shuffled.

Defined results: null or empty documents have no words and no spans; null or
wordless items have no window; repeated items each count; an empty benchmark
leaves every document clean. Repeated document rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marketlab.llm.common import classes, row_blocks, utf8, word_spans

WINDOW = 10
BLOCK_BYTES = 4 << 20  # benchmark text held by a task at once
SHARD_BYTES = 8 << 20  # training text indexed at once
SAMPLE = 16
#: Words are digits, a-z (A-Z folded) and everything outside ASCII.
WORDS = classes(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))


class Patterns:
    """Distinct windows of some items as columns of vocabulary numbers (1-based)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        words = []
        for _, text in items:
            data, offs = utf8(pa.array([text], pa.string()))
            words.append(np.concatenate([h for *_, h in word_spans(data, offs, WORDS)] or [np.zeros(0, np.uint64)]))
        self.vocab = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        found: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.owners: list[list[int]] = []
        self.names = [name for name, _ in items]
        for i, w in enumerate(words):
            ids = np.searchsorted(self.vocab, w).astype(np.int32) + 1
            m = min(window, ids.size)
            for a in range(ids.size - m + 1) if m else ():
                key = ids[a : a + m].tobytes()
                k = found.setdefault(key, len(found))
                if k == len(self.codes):
                    self.codes.append(ids[a : a + m])
                    self.owners.append([])
                if i not in self.owners[k][-1:]:
                    self.owners[k].append(i)
        self.lengths = np.array([c.size for c in self.codes], np.int64)
        self.shortest = int(self.lengths.min()) if self.codes else 0


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; zeros end a suffix and are ordered by position."""
    n = text.size
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + zeros.size
    rank[zeros] = np.arange(zeros.size)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        tied = np.zeros(n, bool)
        same = new[1:] == new[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = order[tied]  # only suffixes that are not unique yet are sorted again
        later = np.minimum(at + step, n - 1)
        pair = rank[at] * n + rank[later]
        slots = np.flatnonzero(tied)
        sub = np.argsort(pair, kind="stable")
        order[slots] = at[sub]
        # ranks become positions of the first equal pair
        p = pair[sub]
        head = np.concatenate([[True], p[1:] != p[:-1]])
        base = slots[np.maximum.accumulate(np.where(head, np.arange(p.size), 0))]
        full = np.empty(n, np.int64)
        full[order] = np.arange(n)
        full[at[sub]] = base
        rank = full
        step *= 2


class FMIndex:
    """Backward search over one shard."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        self.n = text.size
        order = suffix_order(text)
        last = text[order - 1]  # the text starts with a zero, so order 0 wraps to the final zero
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        bits = max(1, int(sigma).bit_length())
        self.levels = []
        cur = last.copy()
        for b in range(bits - 1, -1, -1):
            one = (cur >> b) & 1
            ones = np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32)
            zeros = int(self.n - ones[-1])
            self.levels.append((b, ones, zeros))
            cur = np.concatenate([cur[one == 0], cur[one == 1]])
        self.last = last
        # every SAMPLE-th position and every position after a zero is sampled: a walk never leaves its run
        sampled = (order % SAMPLE == 0) | (last == 0)
        self.sampled = sampled
        self.where = np.where(sampled, order, -1)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before row ``i``."""
        lo = np.zeros_like(i)
        hi = i.copy()
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def search(self, codes: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of all patterns."""
        lo, hi = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        live = np.arange(len(codes))
        longest = int(lengths.max())
        table = np.zeros((len(codes), longest), np.int64)
        for k, c in enumerate(codes):
            table[k, : c.size] = c[::-1]
        for j in range(longest):
            live = live[(lengths[live] > j) & (hi[live] > lo[live])]
            if not live.size:
                break
            s = table[live, j]
            lo[live], hi[live] = self.first[s] + self.rank(s, lo[live]), self.first[s] + self.rank(s, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, walked = rows.copy(), np.zeros(rows.size, np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while todo.size:
            r = at[todo]
            s = self.last[r].astype(np.int64)
            at[todo] = self.first[s] + self.rank(s, r)
            walked[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.where[at] + walked


def search_shard(data: np.ndarray, offs: np.ndarray, pat: Patterns) -> tuple[np.ndarray, list[tuple[int, int, int, int]], dict[int, set[int]]]:
    """Words per row, merged hit spans (row, first word, end word, words), items per row."""
    n = len(offs) - 1
    rows, codes = [], []
    for r, _, _, h in word_spans(data, offs, WORDS):
        rows.append(r)
        if pat.vocab.size:
            k = np.minimum(np.searchsorted(pat.vocab, h), pat.vocab.size - 1)
            codes.append(np.where(pat.vocab[k] == h, k + 1, 0).astype(np.int32))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    counts = np.bincount(row, minlength=n)
    if not codes or not pat.codes:
        return counts, [], {}
    code = np.concatenate(codes)
    first = np.cumsum(counts) - counts
    # runs of vocabulary words inside one row
    known = code > 0
    start = np.flatnonzero(known & np.concatenate([[True], ~known[:-1] | (row[1:] != row[:-1])]))
    end = np.flatnonzero(known & np.concatenate([~known[1:] | (row[1:] != row[:-1]), [True]])) + 1
    keep = end - start >= pat.shortest
    start, end = start[keep], end[keep]
    if not start.size:
        return counts, [], {}
    lens = end - start
    # text: 0 run 0 run ... 0
    base = np.cumsum(lens + 1) - lens
    text = np.zeros(int(lens.sum() + lens.size + 1), np.int32)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    text[np.repeat(base, lens) + inner] = code[np.repeat(start, lens) + inner]
    index = FMIndex(text, int(pat.vocab.size))
    lo, hi = index.search(pat.codes, pat.lengths)
    hit = np.flatnonzero(hi > lo)
    if not hit.size:
        return counts, [], {}
    size = (hi - lo)[hit]
    which = np.repeat(hit, size)
    at = index.locate(np.repeat(lo[hit], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    run = np.searchsorted(base, at, "right") - 1
    word = start[run] + at - base[run]
    where = row[word]
    items: dict[int, set[int]] = {}
    for r, k in set(zip(where.tolist(), which.tolist())):
        items.setdefault(r, set()).update(pat.owners[k])
    order = np.lexsort((word, where))
    a, r = word[order], where[order]
    b = a + pat.lengths[which[order]]
    # windows of one row sorted by start: a span ends where the running end is passed
    reach = np.maximum.accumulate(b)
    fresh = np.concatenate([[True], (a[1:] > reach[:-1]) | (r[1:] != r[:-1])])
    heads = np.flatnonzero(fresh)
    tails = np.concatenate([heads[1:], [a.size]]) - 1
    spans = [(int(r[h]), int(a[h] - first[r[h]]), int(reach[t] - first[r[h]])) for h, t in zip(heads, tails)]
    return counts, spans, items


def find_passages(docs: DataFrame, items: list[tuple[str, str | None]], window: int) -> DataFrame:
    """Add n_words, spans (word positions) and item names found to every row; merges with earlier passes."""
    names = list(docs.columns)
    if "_spans" not in names:
        docs = docs.withColumns({"_n": F.lit(0).cast("long"), "_spans": F.array().cast("array<struct<a:long,b:long>>"), "_items": F.array().cast("array<string>")})
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat = Patterns(items, window)
        for batch in batches:
            data, offs = utf8(batch.column("_text"))
            n_words = np.zeros(batch.num_rows, np.int64)
            spans = [[(s["a"], s["b"]) for s in x] if x else [] for x in batch.column("_spans").to_pylist()]
            names_ = [list(x) if x else [] for x in batch.column("_items").to_pylist()]
            for a, b in row_blocks(offs, SHARD_BYTES):
                counts, new, found = search_shard(data, offs[a : b + 1], pat)
                n_words[a:b] = counts
                for r, s, e in new:
                    spans[a + r].append((s, e))
                for r, ks in found.items():
                    names_[a + r].extend(pat.names[k] for k in ks)
            cols = []
            for f in batch.schema:
                if f.name == "_n":
                    cols.append(pa.array(n_words, pa.int64()))
                elif f.name == "_spans":
                    cols.append(pa.array([[{"a": x, "b": y} for x, y in join_spans(s)] for s in spans], f.type))
                elif f.name == "_items":
                    cols.append(pa.array(names_, f.type))
                else:
                    cols.append(batch.column(f.name))
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """Items as (id, text) in blocks of about ``limit`` bytes, read one block at a time."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // limit))
    for p in range(parts):
        rows = b.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p).orderBy("item", "text").collect()
        yield [(r["item"], r["text"]) for r in rows]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: the kept columns, text, n_words, spans (a, b in words), items, n_hit."""
    d = docs.select(*keep, F.col("text").alias("_text"))
    for block in benchmark_blocks(benchmark, block_bytes):
        d = find_passages(d, block, window)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return d.select(*keep, F.col("_text").alias("text"), F.col("_n").alias("n_words"), F.col("_spans").alias("spans"), F.array_sort(F.array_distinct("_items")).alias("items"), hit.alias("n_hit"))
