"""Toxicity: a counterfactually regularised linear classifier.

Features are the distinct words of a text and their beginnings (5 to 8 bytes),
hashed. On a bounded labelled sample, features seen in enough documents and
tied to the label are kept; a logistic model is fitted on them. For every
sampled text with identity terms, copies with each term swapped for the next
two of its group are made, and the squared change of the log odds between a
text and its copies is added to the loss, so that a neutral mention of a group
does not move the score.

Defined results: null, empty and blank texts score by the bias; without labels
of both classes the score is constant. Equal texts score equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from marketlab.llm.common import classes, held_out, mix, powers, utf8, word_spans
from marketlab.llm.labelled import training_rows

BITS = 18
PER_CLASS = 3000
LAMBDA = 1.0
MIN_DOCS = 4
MIN_CHI = 15.0
STARTS = (5, 6, 7, 8)
WORDS = classes(bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
#: Identity terms by group, fixed values; a term is swapped inside its group.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("woman", "man", "girl", "boy", "transgender", "nonbinary"),
    ("women", "men", "girls", "boys"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrant", "native", "refugee", "citizen"),
    ("old", "young", "elderly", "teenage"),
    ("deaf", "blind", "disabled", "paralyzed"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("femme", "homme"), ("femmes", "hommes"), ("frau", "mann"), ("frauen", "männer"),
)
NEXT = {w: (g[(i + 1) % len(g)], g[(i + 2) % len(g)]) for g in GROUPS for i, w in enumerate(g)}


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (row, bucket) for words and word beginnings."""
    shift = np.uint64(64 - bits)
    pw = powers(max(STARTS) + 1)
    for row, start, end, h in word_spans(data, offs, WORDS):
        yield row, (mix(h) >> shift).astype(np.int64)
        size = end - start
        for k in STARTS:
            long = np.flatnonzero(size > k)
            if long.size:
                p = np.zeros(long.size, np.uint64)
                for j in range(k):
                    p += mix(WORDS[data[start[long] + j]].astype(np.uint64) + np.uint64(77)) * pw[j]
                yield row[long], (mix(p + np.uint64(k)) >> shift).astype(np.int64)


def distinct(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, bucket) pairs of a batch."""
    keys = [np.unique((row << np.int64(bits)) | k) for row, k in features(data, offs, bits)]
    k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return k >> np.int64(bits), k & np.int64((1 << bits) - 1)


def swapped(text: str) -> list[str]:
    """Copies of a text with its identity terms exchanged, or none."""
    parts, hit = [], False
    for w in text.split(" "):
        core = w.strip(".,;:!?\"'()").lower()
        parts.append((w, NEXT.get(core)))
        hit = hit or core in NEXT
    return [" ".join(n[k] if n else w for w, n in parts) for k in (0, 1)] if hit else []


def sample_features(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(_y, of, idx): features of sampled texts (of = null) and of their swapped copies (of = the text's key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, key, t in zip(*(batch.column(c).to_pylist() for c in ("_y", "key", "text"))):
                texts = [t or "", *swapped(t or "")]
                data, offs = utf8(pa.array(texts, pa.string()))
                row, k = distinct(data, offs, bits)
                idx = [k[row == i].astype(np.int32) for i in range(len(texts))]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([y] * n, pa.int32()), pa.array([key] * n, pa.int64()), pa.array([i > 0 for i in range(n)], pa.bool_()), pa.array(idx, pa.list_(pa.int32()))], names=["_y", "key", "copy", "idx"])

    return rows.select("_y", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, "_y int, key long, copy boolean, idx array<int>")


def fit_sparse(texts: list[tuple[int, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], bits: int = BITS, lam: float = LAMBDA, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights over all buckets (mostly zero) and bias, by gradient descent with momentum on the kept features."""
    y = np.array([t[0] for t in texts], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    pos = np.bincount(np.concatenate([i for v, i in texts if v] or [np.zeros(0, np.int64)]), minlength=1 << bits)
    neg = np.bincount(np.concatenate([i for v, i in texts if not v] or [np.zeros(0, np.int64)]), minlength=1 << bits)
    a, b, c, d = pos, neg, n1 - pos, n0 - neg
    chi = len(y) * (a * d - b * c) ** 2.0 / np.maximum((a + b) * (c + d) * n1 * n0, 1.0)
    kept = np.flatnonzero((a + b >= MIN_DOCS) & (chi >= MIN_CHI))
    slot = np.full(1 << bits, -1)
    slot[kept] = np.arange(kept.size)

    def sparse(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r = np.repeat(np.arange(len(lists)), [x.size for x in lists])
        s = slot[np.concatenate(lists)] if lists else np.zeros(0, np.int64)
        return r[s >= 0], s[s >= 0]

    rows, cols = sparse([i for _, i in texts])
    # what a text and its swapped copy share cancels
    prow, pcol = sparse([np.setdiff1d(x, z) for x, z in pairs])
    qrow, qcol = sparse([np.setdiff1d(z, x) for x, z in pairs])
    w, bias, v, vb = np.zeros(kept.size), 0.0, np.zeros(kept.size), 0.0
    n, m = len(y), max(len(pairs), 1)
    # steps below the bound of the curvature (by traces), at which momentum is stable
    curve = 0.25 * (cols.size / n + 1) + ridge / n + 2 * lam * (pcol.size + qcol.size) / m
    rate = min(0.5, 1.9 / curve)
    for _ in range(rounds):
        z = np.bincount(rows, w[cols], n) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
        grad = np.bincount(cols, g[rows], kept.size) / n + ridge * w / n
        if pairs:
            # change of the log odds under a swap, squared
            change = np.bincount(prow, w[pcol], len(pairs)) - np.bincount(qrow, w[qcol], len(pairs))
            grad += 2 * lam / m * (np.bincount(pcol, change[prow], kept.size) - np.bincount(qcol, change[qrow], kept.size))
        v, vb = 0.9 * v - rate * grad, 0.9 * vb - rate * g.mean()
        w, bias = w + v, bias + vb
    full = np.zeros(1 << bits)
    full[kept] = w
    return full, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, bits: int = BITS, lam: float = LAMBDA) -> tuple[np.ndarray, float]:
    got = sample_features(training_rows(docs, labels, label, per_class), bits).toArrow()
    rows = sorted(zip(got.column("_y").to_pylist(), got.column("key").to_pylist(), got.column("copy").to_pylist(), (x.values.to_numpy(False).astype(np.int64) for x in got.column("idx"))), key=lambda r: (r[0], r[1], r[2], r[3].tobytes()))
    own = {k: i for _, k, c, i in rows if not c}
    texts = [(y, i) for y, _, c, i in rows if not c]
    pairs = [(own[k], i) for _, k, c, i in rows if c and k in own]
    kinds = {y for y, _ in texts}
    if len(kinds) < 2:
        share = 0.5 if not kinds else 0.999 if 1 in kinds else 0.001
        return np.zeros(1 << bits), float(np.log(share / (1 - share)))
    return fit_sparse(texts, pairs, bits, lam)


def score(docs: DataFrame, weight: np.ndarray, bias: float, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``score`` of every row."""
    bits = int(weight.size).bit_length() - 1
    d = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*[f for f in d.schema.fields if f.name != "_text"], T.StructField("score", T.DoubleType())])
    # the weights have 2^bits values, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((weight, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        live = w != 0
        for batch in batches:
            data, offs = utf8(batch.column("_text"))
            seen = []
            for row, k in features(data, offs, bits):
                ok = live[k]  # features without weight need no counting
                seen.append((row[ok] << np.int64(bits)) | k[ok])
            key = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            z = np.bincount(key >> np.int64(bits), w[key & np.int64((1 << bits) - 1)], batch.num_rows) + b
            cols = [batch.column(f.name) for f in schema.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())], names=schema.names)

    return d.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.5, label: str = "toxic", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, held_out, score and predicted of every document."""
    weight, bias = fit(docs, labels, label)
    d = score(docs, weight, bias, keep)
    return d.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= cut).cast("int")})
