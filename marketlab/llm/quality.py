"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: words,
character 3- to 5-grams inside words (with their borders), and neighbouring
word pairs, where a word followed by itself is one feature of its own. A
softmax layer reads the average. Vectors and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows
(``per_class`` of each label); the sample is counted into features inside
Spark, so only sparse counts reach the driver.

For scoring, vectors and softmax difference fold into one number per feature,
and every whole text is scored in a narrow pass.

Defined results: null, empty and blank texts have no features and score by the
bias alone; without labels of both classes the score is the share of label 1
(or a half). Equal texts score equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marketlab.llm.common import CHUNK, SPACES, classes, held_out, mix, row_blocks, utf8, word_spans
from marketlab.llm.labelled import training_rows

BITS = 16
PER_CLASS = 1000
DIM = 16
STEPS, BATCH = 800, 8  # gradient steps of as many rows, half of either label
RATE = 2.0
CASED = classes(SPACES, fold=False)
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
REPEAT = 0  # bucket of a word that follows itself


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (row, bucket), one entry per feature occurrence.

    Long rows are read in overlapping chunks; an n-gram belongs to the chunk
    in which it starts. ``n`` bytes of context follow each chunk.
    """
    shift = np.uint64(64 - bits)
    for a, b in row_blocks(offs, CHUNK):
        for lo in range(int(offs[a]), max(int(offs[b]), int(offs[a]) + 1), CHUNK):
            own = min(CHUNK, int(offs[b]) - lo)
            if own <= 0:
                continue
            stop = min(lo + own + 8, int(offs[b]))
            code = CASED[data[lo:stop]].astype(np.uint64)
            edge = np.searchsorted(offs[a : b + 1], np.arange(lo, stop), "right") - 1 + a  # row of each byte
            blank = code == 0
            gaps = np.concatenate([[0], np.cumsum(blank)])
            for n in (3, 4, 5):
                m = min(own, code.size - n + 1)
                if m <= 0:
                    continue
                h = code[:m] * _SALT[0]
                for j in range(1, n):
                    h = h + code[j : j + m] * _SALT[j]
                inside = gaps[n - 1 : n - 1 + m] - gaps[1 : 1 + m]
                ok = (inside == 0) & (edge[:m] == edge[n - 1 : n - 1 + m])
                yield edge[:m][ok], (mix(h[ok] + np.uint64(n)) >> shift).astype(np.int64)

    last_row, last = -1, np.uint64(0)
    for row, _, _, h in word_spans(data, offs, CASED):
        yield row, (mix(h) >> shift).astype(np.int64)
        before = np.concatenate([[last], h[:-1]])
        same_row = row == np.concatenate([[last_row], row[:-1]])
        pair = np.where(before == h, np.int64(REPEAT), (mix(before * _SALT[5] + h) >> shift).astype(np.int64))
        yield row[same_row], pair[same_row]
        last_row, last = row[-1], h[-1]


def count_features(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(_y, idx, n): sparse feature counts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            ys = batch.column("_y").to_pylist()
            for i in range(batch.num_rows):
                got = [k for _, k in features(data, offs[i : i + 2], bits)]
                k, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([ys[i]], pa.int32()), pa.array([k.astype(np.int32)], pa.list_(pa.int32())), pa.array([n.astype(np.int32)], pa.list_(pa.int32()))], names=["_y", "idx", "n"])

    return rows.select("text", "_y").mapInArrow(run, "_y int, idx array<int>, n array<int>")


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weight per feature, bias) of the log odds of label 1, folded from vectors and softmax layer."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    y = np.array([s[0] for s in samples])
    of = [np.flatnonzero((y == v) & np.array([s[1].size > 0 for s in samples])) for v in (0, 1)]
    queues = [np.concatenate([rng.permutation(x) for _ in range(-(-steps * BATCH // 2 // max(x.size, 1)))] or [x]) if x.size else x for x in of]
    for step in range(steps):
        lr = rate * (1 - step / steps)
        pick = np.concatenate([q[step * BATCH // 2 : (step + 1) * BATCH // 2] for q in queues])
        if not pick.size:
            break
        idx = np.concatenate([samples[k][1] for k in pick])
        share = np.concatenate([c / c.sum() for c in (samples[k][2].astype(np.float32) for k in pick)])
        cuts = np.cumsum([0] + [samples[k][1].size for k in pick])[:-1]
        mean = np.add.reduceat(vec[idx] * share[:, None], cuts, axis=0)
        z = mean @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(pick.size), y[pick]] -= 1.0
        p /= pick.size
        back = p @ out.T
        out -= lr * (mean.T @ p)
        bias -= 0.1 * lr * p.sum(0)
        lens = np.diff(np.concatenate([cuts, [idx.size]]))
        np.add.at(vec, idx, -lr * pick.size * share[:, None] * np.repeat(back, lens, axis=0))
    w = vec @ (out[:, 1] - out[:, 0])
    return w.astype(np.float64), float(bias[1] - bias[0])


def training_samples(rows: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of each row, in an order that only its content decides.

    The arrays are views of the table, and rows are compared two at a time, so
    the driver holds the sample once.
    """
    lists = lambda name: [x.values.to_numpy(False) for chunk in rows.column(name).chunks for x in chunk]

    def compare(a: tuple, b: tuple) -> int:
        for key in (lambda s: (s[0], s[1].size), lambda s: s[1].tobytes(), lambda s: s[2].astype(np.float32).tobytes()):
            x, y = key(a), key(b)
            if x != y:
                return -1 if x < y else 1
        return 0

    return sorted(zip(rows.column("_y").to_pylist(), lists("idx"), lists("n")), key=cmp_to_key(compare))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, bits: int = BITS) -> tuple[np.ndarray, float]:
    samples = training_samples(count_features(training_rows(docs, labels, label, per_class), bits).toArrow())
    kinds = {s[0] for s in samples}
    if len(kinds) < 2:
        share = 0.5 if not kinds else 0.999 if 1 in kinds else 0.001
        return np.zeros(1 << bits), float(np.log(share / (1 - share)))
    return train(samples, bits)


def score(docs: DataFrame, weight: np.ndarray, bias: float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``score`` of every row."""
    bits = int(weight.size).bit_length() - 1
    d = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*[f for f in d.schema.fields if f.name != "_text"], T.StructField("score", T.DoubleType())])
    # one number per feature: 2^bits values, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((weight, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            data, offs = utf8(batch.column("_text"))
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for row, k in features(data, offs, bits):
                if row.size:
                    lo, hi = int(row[0]), int(row[-1]) + 1  # rows are sorted inside a chunk
                    total[lo:hi] += np.bincount(row - lo, w[k], hi - lo)
                    n[lo:hi] += np.bincount(row - lo, minlength=hi - lo)
            z = total / np.maximum(n, 1) + b
            cols = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], names=schema.names)

    return d.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, label: str = "quality", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, held_out, score and predicted of every document."""
    weight, bias = fit(docs, labels, label)
    d = score(docs, weight, bias, keep)
    return d.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= cut).cast("int")})
