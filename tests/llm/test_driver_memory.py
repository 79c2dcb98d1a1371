"""What reaches the driver is held there once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from marketlab.llm import quality


def test_training_sample_is_not_copied():
    rng = np.random.default_rng(3)
    idx = [np.unique(rng.integers(0, 1 << 16, int(k))).astype(np.int32) for k in [*rng.integers(1, 9, 300), *[4000] * 200]]
    idx += idx[:40]
    y = rng.integers(0, 2, len(idx)).tolist()
    n = [rng.integers(1, 700, x.size).astype(np.int32) for x in idx]
    table = pa.table({"_y": pa.array(y, pa.int32()), "idx": pa.array(idx, pa.list_(pa.int32())), "n": pa.array(n, pa.list_(pa.int32()))})
    tracemalloc.start()
    got = quality.training_samples(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.5 * table.nbytes
    # the order of plain sorting by label, length and bytes
    want = sorted(zip(y, idx, n), key=lambda s: (s[0], s[1].size, s[1].astype(np.int64).tobytes(), s[2].astype(np.float32).tobytes()))
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(got, want, strict=True))
