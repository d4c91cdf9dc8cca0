"""Integer codebooks against plain loops over all rows and entries."""

import hashlib
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = [(i, [int(np.clip(np.floor(1024 * np.float64(c)), -(1 << 24), 1 << 24)) for c in v], y) for i, v, y in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 4))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    x = np.array([v + [0] * (4 * width - len(v)) for _, v, _ in kept], dtype=object)
    e = np.array([v + [0] * (4 * width - len(v)) for _, v, _ in first], dtype=object)
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        a, b = x[:, p * width:(p + 1) * width], e[:, p * width:(p + 1) * width].copy()
        for r in range(5):
            d = ((a[:, None, :] - b[None]) ** 2).sum(2)
            best = [min(range(len(b)), key=lambda k: (row[k], k)) for row in d]
            for k in range(len(b)) if r < 4 else ():
                of = [i for i, w in enumerate(best) if w == k]
                if of:
                    b[k] = [sum(a[i][c] for i in of) // len(of) for c in range(width)]
        codes = [c + f"{w:02x}" for c, w in zip(codes, best)]
        errors = [s + d[i][w] for i, (s, w) in enumerate(zip(errors, best))]
        books.append(b)
    digest = hashlib.sha256(",".join(str(c) for b in books for r in b for c in r).encode()).hexdigest()
    total = {}
    for (_, _, y), s in zip(kept, errors):
        total[y] = total.get(y, 0) + s
    return sorted(((i, c, s, total[y], digest) for (i, _, y), c, s in zip(kept, codes, errors)), key=repr)


def found(df):
    return sorted((tuple(r) for r in V.encode(df).collect()), key=repr)


@pytest.mark.parametrize("size", [1.0, 200.0])
def test_codes_and_codebooks(spark, size):
    """In doubles and, with large components, in 64-bit integers."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 12)), np.repeat(rng.normal(size=(1, 12)), 150, axis=0), rng.normal(size=(1, 12)) + 0.01 * rng.normal(size=(90, 12))]) * size
    ids = rng.permutation(len(x)).tolist()
    rows = [(i, v.tolist(), int(y) if y else None) for i, v, y in zip(ids, x, rng.integers(0, 4, len(x)))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 0.001], 1), (1, [0.5, -0.25, 0.001], 1), (1, [0.5, 0.25], 1), (None, [0.1] * 5, None), (2, [], None), (3, None, 1), (4, [nan], 2),
            (5, [inf], 2), (6, [None], 2), (7, [1e300, -1e300, 17e3, 1.0], 3), (8, [-0.0] * 4, 3), (9, [1.0] * 5, 3)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert found(d) == brute(rows)
    assert found(d.withColumns({c: F.lit("mine") for c in ("id", "v", "part", "entry", "digest", "error", "code", "copies")})) == found(d)
    assert found(d.limit(0)) == [] and found(d.where("vec_id in (3, 4)")) == []
    assert V.encode(d).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_hilbert_keys_visit_every_cell_once_by_unit_steps():
    for dims, bits in ((1, 3), (2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = V.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert all(np.abs(a - b).sum() == 1 for a, b in pairwise(walk))


def test_shortlists_hold_the_nearest_entry():
    rng = np.random.default_rng(5)
    entries = rng.integers(-500, 500, (64, 6))
    for spread in (5, 60, 900):
        x = rng.integers(-400, 400, (1, 6)) + rng.integers(-spread, spread + 1, (40, 6))
        near, far = V.box_bounds(x.min(0)[None], x.max(0)[None], entries)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (near[0] <= d.min(0)).all() and (far[0] >= d.max(0)).all()
        short = np.flatnonzero(near[0] <= far[0].min())
        assert set(d.argmin(1)) <= set(short)
        best, least = V.assign(x, entries[short])
        assert (short[best] == d.argmin(1)).all() and (least == d.min(1)).all()
        assert (V.assign(x << 20, entries << 20)[1] == d.min(1) << 40).all()
