"""Exact removal of repeated substrings by ranks of thinned suffix positions.

The rounds of prefix doubling at growing offsets are replaced here by ranks of two
fixed lengths: pairs at every byte, sorted once a round, would take several times
the input of disk. What is left of the method is sorting (position, rank) pairs,
dropping what is unique, and ending at the threshold.

Every string of ``SPAN`` bytes names one of its positions, the one whose next
``K`` bytes have the smallest hash, so equal strings name equal positions (a
synchronising set; about one position in 65 is named). Ranks are 64-bit names of
prefixes:

1. Spark sorts the named positions by the rank of their first ``K`` bytes and,
   beyond it, by the rank of the whole range of strings that name them. A rank
   of ``K`` bytes that occurs once is unique, and with it every string that
   holds this position; only the rest goes on. A rank of the range that occurs
   again is past the threshold: the range is covered.
2. What is left are positions whose range also holds text found once: borders
   of repeated text. Positions of one rank, one for each different range, meet
   with the bytes around them (at most ``SPAN + 127``), and the common string
   around the position decides: from ``SPAN`` bytes on it is repeated. Ranks with
   more than ``GROUP`` such ranges must not meet in one task; there, every start that one of them asks for gets a pair of ranks that name its
   ``SPAN`` bytes in two bases (128 bits), and pairs that occur again are past the
   threshold.

A removed byte is in a covered range or a repeated string; overlapping ones
merge. Pairs at every byte from the start would sort the input several times
over; the synchronising set keeps the result and sorts a few hundredths. Equal
ranks cut by a border of the sorted slices are taken as "may occur again" in
step 1 and settled in step 2, so nothing depends on where slices end.

Defined results: a null text is empty; texts below ``SPAN`` bytes lose nothing;
strings never cross rows; a repeated row counts as a second place, and equal
rows get equal results; null ids take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marketlab.llm.common import CHUNK, forget, mix, row_blocks, stored, text_key, utf8

SPAN, OFFSETS = 200, 128
SEGMENT = 16  # offsets that are named together; a power of two
GROUP = 64  # ranges of one rank that are compared with one another directly
K = SPAN - OFFSETS + 1
_BITS = np.uint64(22)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x1234567))
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if which not in _TABLES or _TABLES[which][0].size < n:
        both = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(max(n, CHUNK + 4 * SPAN), b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _TABLES[which] = tuple(both)
    return _TABLES[which]


class Names:
    """64-bit names of substrings of one piece of text."""

    def __init__(self, piece: np.ndarray, which: int) -> None:
        up, self.down = _powers(which, piece.size + 1)
        self.sums = np.zeros(piece.size + 1, np.uint64)
        np.cumsum(_BYTES[piece] * up[: piece.size], out=self.sums[1:])

    def at(self, start: np.ndarray | slice, size: int) -> np.ndarray:
        if isinstance(start, slice):
            a, b = start.start, start.stop
            return mix((self.sums[a + size : b + size] - self.sums[a:b]) * self.down[a:b])
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])


def pieces(offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, from byte, to byte); a long row comes in pieces that share SPAN - 1 bytes."""
    for a, b in row_blocks(offs, CHUNK):
        lo, hi = int(offs[a]), int(offs[b])
        if hi - lo <= CHUNK or b - a > 1:
            yield a, b, lo, hi
        else:
            for s in range(lo, max(hi - SPAN + 1, lo + 1), CHUNK):
                yield a, b, s, min(s + CHUNK + SPAN - 1, hi)


def named_positions(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position in the row, packed offsets, rank at K, rank of the range) of named positions.

    ``near`` and ``far`` are the least and largest offset back to a start that
    names the position.
    """
    for a, b, lo, hi in pieces(offs):
        m = hi - lo
        if m < SPAN:
            continue
        names = Names(data[lo:hi], 0)
        h = names.at(slice(0, m - K + 1), K)
        key = (h & ~((np.uint64(1) << _BITS) - np.uint64(1))) | np.arange(h.size, dtype=np.uint64)
        step = 1
        while step < OFFSETS:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        named = (key & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
        begin = np.maximum(offs[a:b], lo) - lo
        end = np.minimum(offs[a + 1 : b + 1], hi) - lo
        ok = end - begin >= SPAN
        mark = np.zeros(m + 1, np.int32)
        np.add.at(mark, begin[ok], 1)
        np.add.at(mark, end[ok] - SPAN + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[: named.size]) > 0)
        if not starts.size:
            continue
        at = named[starts]
        fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
        head = np.flatnonzero(fresh)
        tail = np.concatenate([head[1:], [starts.size]]) - 1
        p = at[head]
        row = np.searchsorted(offs, lo + starts[head], "right") - 1
        near, far = p - starts[tail], p - starts[head]
        pack = near | (far << 7)
        # the range p - far .. p - near + SPAN; its name also tells where it starts
        first, size = starts[head], starts[tail] - starts[head] + SPAN
        whole = mix((names.sums[first + size] - names.sums[first]) * names.down[first] + pack.astype(np.uint64))
        yield row, lo + p - offs[row], pack, h[p].view(np.int64), whole.view(np.int64)


def positions(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, _t, p, pack, rank, whole) of all named positions."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for row, p, pack, rank, whole in named_positions(data, offs):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("_t").take(take), pa.array(p, pa.int32()), pa.array(pack, pa.int32()), pa.array(rank), pa.array(whole)],
                    names=["doc_id", "_t", "p", "pack", "rank", "whole"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, _t long, p int, pack int, rank long, whole long")


def ranked_again(everything: DataFrame) -> DataFrame:
    """Positions whose rank may occur again, from one global sort: adds ``cover`` and ``first`` (of its range)."""
    order = ["rank", "whole", "_t", "p"]
    slices = everything.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = everything.schema["doc_id"].dataType.simpleString()

    def flags(t: pa.Table, open_start: bool, open_end: bool, skip: int, hold: int) -> pa.RecordBatch:
        rank, whole = t.column("rank").to_numpy(), t.column("whole").to_numpy()
        r, w = rank[1:] == rank[:-1], (rank[1:] == rank[:-1]) & (whole[1:] == whole[:-1])
        again = np.concatenate([[open_start], r]) | np.concatenate([r, [open_end]])
        cover = np.concatenate([[False], w]) | np.concatenate([w, [False]])
        first = ~np.concatenate([[False], w])
        keep = again.copy()
        keep[:skip] = False
        if hold:
            keep[-hold:] = False
        out = t.append_column("cover", pa.array(cover)).append_column("first", pa.array(first)).drop_columns(["whole"])
        return out.filter(pa.array(keep)).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the two last rows of a batch are seen again with the next one: the first only as a neighbour
        rest, start = None, True
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            if t.num_rows < 3:
                rest = t
                continue
            yield from flags(t, start, False, 0 if start else 1, 1).to_batches()
            rest, start = t.slice(t.num_rows - 2), False
        if rest is not None and rest.num_rows:
            yield from flags(rest, start, True, 0 if start else 1, 0).to_batches()

    return slices.mapInArrow(run, f"doc_id {kind}, _t long, p int, pack int, rank long, cover boolean, first boolean")


def borders(again: DataFrame) -> DataFrame:
    """Per row of documents: covered runs (rank null, from lo to hi) and positions left to compare.

    The latter carry the offsets lo..hi of strings that hold no unique position;
    ``asks`` marks those not covered.
    """
    order = ["doc_id", "_t", "p", "pack"]
    d = again.repartition("doc_id", "_t").sortWithinPartitions(*order)
    kind = again.schema["doc_id"].dataType.simpleString()
    far_off = np.int64(1) << np.int64(40)

    def work(t: pa.Table) -> pa.RecordBatch:
        ids, keys = t.column("doc_id"), t.column("_t").to_numpy()
        code = ids.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(False)
        p, pack = t.column("p").to_numpy().astype(np.int64), t.column("pack").to_numpy().astype(np.int64)
        near, far = pack & 127, pack >> 7
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (code[1:] != code[:-1])])
        doc = np.cumsum(new) - 1
        cover, first = t.column("cover").to_numpy(), t.column("first").to_numpy()
        # covered runs
        c = np.flatnonzero(cover)
        a, b, cd = p[c] - far[c], p[c] - near[c] + SPAN, doc[c]
        reach = np.maximum.accumulate(cd * far_off + b) if c.size else b
        head = np.flatnonzero(np.concatenate([[True], (cd * far_off + a)[1:] > reach[:-1]])) if c.size else c
        tail = np.concatenate([head[1:], [c.size]])[: head.size] - 1
        ra, rb, rd = a[head], reach[tail] - cd[tail] * far_off, cd[head]
        # strings left to compare
        lo, hi = near, far
        left = first | ~cover
        asks = ~cover
        if head.size:  # strings inside a covered run answer and need not ask
            run = np.searchsorted(rd * far_off + ra, doc * far_off + p - hi, "right") - 1
            safe = np.maximum(run, 0)
            inside = (run >= 0) & (rd[safe] == doc) & (p - lo + SPAN <= rb[safe])
            asks &= ~inside
        left = np.flatnonzero(left)
        rows = np.concatenate([c[head], left])
        none = np.zeros(head.size, bool)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(rows)).combine_chunks(),
                pa.array(keys[rows]),
                pa.array(np.concatenate([ra, p[left]]), pa.int32()),
                pa.array(np.concatenate([ra, lo[left]]), pa.int32()),
                pa.array(np.concatenate([rb, hi[left]]), pa.int32()),
                pa.array(t.column("rank").to_numpy()[rows], pa.int64(), mask=np.concatenate([~none, np.zeros(left.size, bool)])),
                pa.array(np.concatenate([none, asks[left]])),
            ],
            names=["doc_id", "_t", "p", "lo", "hi", "rank", "asks"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the document that may go on in the next batch
        for batch in batches:
            t = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            keys = t.column("_t").to_numpy()
            cut = np.flatnonzero(keys[1:] != keys[:-1])
            if not cut.size:
                held = [t]
                continue
            at = int(cut[-1]) + 1
            yield work(t.slice(0, at))
            held = [t.slice(at)]
        if held and held[0].num_rows:
            yield work(held[0])

    return d.mapInArrow(run, f"doc_id {kind}, _t long, p int, lo int, hi int, rank long, asks boolean")


def _bits(lo: Column, hi: Column, word: int) -> Column:
    """Bits lo..hi of an offset set, in the given 64-bit word."""
    a, b = F.greatest(lo - 64 * word, F.lit(0)).cast("int"), F.least(hi - 64 * word, F.lit(63)).cast("int")
    d = F.call_function("shiftleft", F.lit(-1).cast("long"), F.least(a, F.lit(63))).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - F.greatest(b, F.lit(0))))
    return F.when(a <= b, d).otherwise(F.lit(0).cast("long"))


def surroundings(rows: DataFrame) -> DataFrame:
    """One row per asked position with the bytes around it: left reversed, right from the position on."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            raw = memoryview(np.ascontiguousarray(data))
            asked = batch.column("asked")
            first = np.asarray(asked.offsets).astype(np.int64)
            part = asked.values.slice(first[0], first[-1] - first[0])
            owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
            at = part.field("p").to_numpy(False).astype(np.int64) + offs[owner]
            lo, hi = np.maximum(at - OFFSETS + 1, offs[owner]), np.minimum(at + SPAN, offs[owner + 1])
            left = [bytes(raw[x:y])[::-1] for x, y in zip(lo.tolist(), at.tolist())]
            right = [bytes(raw[x:y]) for x, y in zip(at.tolist(), hi.tolist())]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_t").take(take), *(part.field(c) for c in ("p", "lo", "hi", "rank", "a0", "a1", "c")), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                names=["doc_id", "_t", "p", "lo", "hi", "rank", "a0", "a1", "c", "left", "right"],
            )

    return rows.select("doc_id", "_t", "text", "asked").mapInArrow(run, f"doc_id {kind}, _t long, p int, lo int, hi int, rank long, a0 long, a1 long, c long, left binary, right binary")


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of bytes as a matrix; what a row lacks is filled with numbers no other row has."""
    data, offs = utf8(column)
    n = len(offs) - 1
    out = np.repeat(256 + np.arange(n, dtype=np.int32), width).reshape(n, width)
    size = np.diff(offs)
    inside = np.arange(int(size.sum())) - np.repeat(offs[:-1] - offs[0], size)
    out[np.repeat(np.arange(n), size), inside] = data[offs[0] : offs[-1]]
    return out


def common_strings(rows: DataFrame) -> DataFrame:
    """(doc_id, _t, a, b): strings of SPAN bytes and more shared by positions of one rank."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    d = rows.repartition("rank").sortWithinPartitions("rank")

    def equal(x: np.ndarray) -> np.ndarray:
        other = x[:, :, None, :] != x[:, None, :, :]
        return np.where(other.any(-1), other.argmax(-1), x.shape[-1])

    def work(t: pa.Table) -> pa.RecordBatch:
        rank, keys, p = t.column("rank").to_numpy(), t.column("_t").to_numpy(), t.column("p").to_numpy().astype(np.int64)
        left, right = padded(t.column("left").combine_chunks(), OFFSETS - 1), padded(t.column("right").combine_chunks(), SPAN)
        head = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        size = np.diff(np.concatenate([head, [rank.size]]))
        at, l_, r_ = [], [], []
        for c in np.unique(size[size > 1]).tolist():
            groups = head[size == c]
            step = max(1, (1 << 24) // (c * c * SPAN))
            for i in range(0, groups.size, step):
                rows_ = groups[i : i + step, None] + np.arange(c)
                lc, rc = equal(left[rows_]), equal(right[rows_])
                # a place is not its own other place, nor is its entry from the next piece of a long row
                own = (keys[rows_][:, :, None] == keys[rows_][:, None, :]) & (p[rows_][:, :, None] == p[rows_][:, None, :])
                lc[own] = -SPAN
                g, x, y = np.nonzero(lc + rc >= SPAN)
                at.append(rows_[g, x])
                l_.append(lc[g, x, y])
                r_.append(rc[g, x, y])
        at, l_, r_ = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (at, l_, r_))
        pairs = np.unique(np.stack([at, p[at] - l_, p[at] + r_], 1), axis=0) if at.size else np.zeros((0, 3), np.int64)
        take = pa.array(pairs[:, 0])
        return pa.RecordBatch.from_arrays([t.column("doc_id").take(take).combine_chunks(), t.column("_t").take(take).combine_chunks(), pa.array(pairs[:, 1], pa.int32()), pa.array(pairs[:, 2], pa.int32())], names=["doc_id", "_t", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of the rank that may go on, GROUP at most
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            rank = t.column("rank").to_numpy()
            cut = np.flatnonzero(rank[1:] != rank[:-1])
            at = int(cut[-1]) + 1 if cut.size else 0
            if at:
                yield work(t.slice(0, at))
            rest = t.slice(at)
        if rest is not None and rest.num_rows:
            yield work(rest)

    return d.mapInArrow(run, f"doc_id {kind}, _t long, a int, b int")


def border_segments(rows: DataFrame) -> DataFrame:
    """Asked starts of positions in segments of ``SEGMENT`` offsets: what goes on is settled start by start.

    All strings of a segment share its ``core`` (c1, c2). ``text`` is the union of those
    of the row, from ``a`` on; where the row holds the whole segment, (u1, u2) name it.
    ``starts`` marks the asked ones, the lowest bit for the start at ``a``.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                t = batch.slice(i, 2048)
                p, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("p", "lo", "hi"))
                m = [t.column(f"a{k}").to_numpy().view(np.uint64) for k in (0, 1)]
                left = np.array([len(x.as_py()) for x in t.column("left")])
                texts = [x.as_py()[::-1] + y.as_py() for x, y in zip(t.column("left"), t.column("right"))]
                raw = b"".join(texts)
                piece = np.frombuffer(raw, np.uint8)
                size = np.array([len(x) for x in texts])
                zero = np.cumsum(size) - size + left
                names = [Names(piece, k) for k in (0, 1)]
                for low in range(0, OFFSETS, SEGMENT):
                    high = low + SEGMENT - 1
                    first, last = np.maximum(lo, low), np.minimum(hi, high)
                    # bit k: the start k bytes after the first one of the row's part
                    asked = (m[low >> 6] >> np.uint64(low & 63)) & np.uint64((1 << SEGMENT) - 1)
                    starts = np.zeros(p.size, np.int64)
                    for o in range(low, high + 1):
                        hit = ((asked >> np.uint64(o - low)) & np.uint64(1)).astype(bool) & (first <= o) & (o <= last)
                        starts[hit] |= np.int64(1) << (last[hit] - o)
                    row = np.flatnonzero(starts)
                    if not row.size:
                        continue
                    z, f, e = zero[row], first[row], last[row]
                    core = [n.at(z - low, SPAN - SEGMENT + 1).view(np.int64) for n in names]
                    full = (f == low) & (e == high)
                    union = [np.zeros(row.size, np.int64) for _ in names]
                    for u, n in zip(union, names):
                        u[full] = n.at(z[full] - high, SPAN + SEGMENT - 1).view(np.int64)
                    text = [raw[x:y] for x, y in zip((z - e).tolist(), (z - f + SPAN).tolist())]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [t.column("doc_id").take(take), t.column("_t").take(take), pa.array(p[row] - e, pa.int32()), pa.array(np.full(row.size, low), pa.int32()), pa.array(starts[row])]
                        + [pa.array(c) for c in core]
                        + [pa.array(u, mask=~full) for u in union]
                        + [pa.array(text, pa.binary())],
                        names=["doc_id", "_t", "a", "low", "starts", "c1", "c2", "u1", "u2", "text"],
                    )

    return rows.mapInArrow(run, f"doc_id {kind}, _t long, a int, low int, starts long, c1 long, c2 long, u1 long, u2 long, text binary")


def border_ranks(rows: DataFrame) -> DataFrame:
    """(doc_id, _t, a, w1, w2): pairs of ranks of the asked strings of segments."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                t = batch.slice(i, 2048)
                data, offs = utf8(t.column("text"))
                data, offs = data[offs[0] : offs[-1]], offs - offs[0]
                a, starts = t.column("a").to_numpy().astype(np.int64), t.column("starts").to_numpy()
                row, step = np.nonzero((starts[:, None] >> np.arange(SEGMENT)) & 1)
                if not row.size:
                    continue
                zero = offs[row] + step
                w1, w2 = (Names(data, k).at(zero, SPAN).view(np.int64) for k in (0, 1))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([t.column("doc_id").take(take), t.column("_t").take(take), pa.array(a[row] + step, pa.int32()), pa.array(w1), pa.array(w2)], names=["doc_id", "_t", "a", "w1", "w2"])

    return rows.mapInArrow(run, f"doc_id {kind}, _t long, a int, w1 long, w2 long")


def border_strings(around: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(doc_id, _t, a, b): repeated strings at positions of ranks too large to compare directly.

    Frames stored on the way are added to ``made``.

    A segment whose union occurs again is repeated as a whole, and one row of
    them answers for all; a core that occurs once is unique. Only the segments
    between, where repeated text ends, are taken start by start.
    """
    segments = stored(border_segments(around))
    whole = numbered_again(segments.where(F.col("u1").isNotNull()), ["u1", "u2"], made)
    runs = whole.where("_again").select("doc_id", "_t", "a", (F.col("a") + SPAN + SEGMENT - 1).alias("b"))
    open_ = whole.where("_first").drop("_again", "_first").unionByName(segments.where(F.col("u1").isNull()))
    again = numbered_again(open_.drop("u1", "u2"), ["low", "c1", "c2"], made).where("_again")
    pairs = stored(border_ranks(again.select("doc_id", "_t", "a", "starts", "text")))
    made += [segments, pairs]
    starts = repeated_pairs(pairs).select("doc_id", "_t", "a", (F.col("a") + SPAN).alias("b"))
    return runs.unionByName(starts)


def numbered_again(rows: DataFrame, keys: list[str], made: list[DataFrame], slices: int = 64) -> DataFrame:
    """``rows`` with ``_again``, whether their keys occur again, and ``_first``, true for one row of equal keys.

    As in :func:`repeated_pairs`, keys are counted in slices first.
    """
    own = W.partitionBy(*keys, "_s")
    p = rows.withColumn("_s", F.pmod(F.xxhash64("_t", "a"), F.lit(slices)))
    p = stored(p.withColumns({"_c": F.count(F.lit(1)).over(own), "_r": F.row_number().over(own.orderBy("_t", "a"))}))
    made.append(p)
    all_ = W.partitionBy(*keys)
    heads = p.where("_r = 1").withColumns({"_m": F.count(F.lit(1)).over(all_), "_q": F.row_number().over(all_.orderBy("_s"))})
    heads = heads.withColumns({"_again": (F.col("_c") > 1) | (F.col("_m") > 1), "_first": F.col("_q") == 1})
    rest = p.where("_r > 1").withColumns({"_again": F.lit(True), "_first": F.lit(False)})
    return heads.select(*rows.columns, "_again", "_first").unionByName(rest.select(*rows.columns, "_again", "_first"))


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Union of the intervals [a, b) as sorted runs."""
    if not a.size:
        return []
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    head = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    tail = np.concatenate([head[1:], [a.size]]) - 1
    return list(zip(a[head].tolist(), reach[tail].tolist()))


def repeated_pairs(pairs: DataFrame, slices: int = 64) -> DataFrame:
    """Rows of ``pairs`` whose (w1, w2) occurs again.

    A pair is counted in slices first, so that a hot one is spread; rows alone
    in their slice then meet one row of every other slice.
    """
    own = W.partitionBy("w1", "w2", "_s")
    p = pairs.withColumn("_s", F.pmod(F.xxhash64("_t", "a"), F.lit(slices)))
    p = stored(p.withColumns({"_c": F.count(F.lit(1)).over(own), "_r": F.row_number().over(own.orderBy("_t", "a"))}))
    ones = p.where("_r = 1").withColumn("_m", F.count(F.lit(1)).over(W.partitionBy("w1", "w2")))
    return p.where("_c > 1").select(*pairs.columns).unionByName(ones.where("_c = 1 and _m > 1").select(*pairs.columns))


def repeated_spans(d: DataFrame) -> DataFrame:
    """(_d, _k, spans): intervals of repeated bytes of each row of ``d(doc_id, _t, text)`` that has any."""
    everything = stored(positions(d))
    again = stored(ranked_again(everything))
    forget(everything)
    left = stored(borders(again))
    forget(again)
    open_ = left.where(F.col("rank").isNotNull())
    own = [_bits(F.col("lo"), F.col("hi"), i) for i in (0, 1)]
    asked = open_.groupBy("rank").agg(*[F.bit_or(F.when(F.col("asks"), m).otherwise(F.lit(0).cast("long"))).alias(f"a{i}") for i, m in enumerate(own)], F.count(F.lit(1)).alias("c")).where("c > 1 and (a0 <> 0 or a1 <> 0)")
    members = open_.join(asked, "rank").select("doc_id", "_t", F.struct("p", "lo", "hi", "rank", "a0", "a1", "c").alias("x"))
    # at most one entry per named position of the row
    lists = members.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_k")).agg(F.collect_list("x").alias("asked"))
    around = stored(surroundings(d.join(lists, d["doc_id"].eqNullSafe(lists["_d"]) & (d["_t"] == lists["_k"]))))
    few = common_strings(around.where(F.col("c") <= GROUP).drop("a0", "a1", "c", "lo", "hi"))
    made = [around, left]
    many = border_strings(around.where(F.col("c") > GROUP), made)
    found = few.unionByName(many).select("doc_id", "_t", F.struct("a", "b").alias("x"))
    covered = left.where(F.col("rank").isNull()).select("doc_id", "_t", F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")).alias("x"))
    spans = stored(found.unionByName(covered).groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_k")).agg(F.collect_set("x").alias("spans")))
    for df in made:
        forget(df)
    return spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept (bytes)."""
    d = docs.select("doc_id", text_key(F.col("text")).alias("_t"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    s = repeated_spans(d)
    full = d.join(s, d["doc_id"].eqNullSafe(s["_d"]) & (d["_t"] == s["_k"]), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            raw = memoryview(np.ascontiguousarray(data))
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for i, s in enumerate(batch.column("spans")):
                lo, hi = int(offs[i]), int(offs[i + 1])
                spans = merged(*(s.values.field(c).to_numpy(False).astype(np.int64) for c in "ab")) if s.is_valid else []
                at, parts = lo, []
                for x, y in spans:
                    parts.append(raw[at : lo + x])
                    at = lo + y
                parts.append(raw[at:hi])
                kept = b"".join(parts)
                out["n_bytes"].append(hi - lo)
                out["n_removed"].append(hi - lo - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["spans"].append([{"a": x, "b": y} for x, y in spans])
                out["kept"].append(kept)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(out[k], t) for k, t in zip(out, kinds)]], names=["doc_id", *out])

    return full.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>, kept binary")
