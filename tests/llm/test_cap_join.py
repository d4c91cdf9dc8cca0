"""The cosine join against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import cap_join

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, cosine):
    """(vec_id, n_links, component_id, kept) sorted."""
    fit = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, low = {k: set() for k in fit}, {k: rows[k][0] for k in fit}
    unit = {k: np.array(rows[k][1]) / np.max(np.abs(rows[k][1])) for k in fit}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    for dims in {len(v) for v in unit.values()}:
        of = [k for k in fit if len(unit[k]) == dims]
        x = np.array([unit[k] for k in of])
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                links[of[a]].add(of[b])
    changed = True
    while changed:
        changed = False
        for k in fit:
            best = min([low[k]] + [low[j] for j in links[k]])
            if best < low[k]:
                low[k], changed = best, True
    out = [(i, len(links.get(k, ())), low.get(k, i), low.get(k, i) == i) for k, (i, _) in enumerate(rows)]
    return sorted(out, key=repr)


def found(df, cosine=0.9):
    return sorted((tuple(r) for r in cap_join.linked(df, cosine).collect()), key=repr)


@pytest.fixture(scope="module")
def mixed():
    """Spread vectors, tight and loose groups, chains of groups, copies and scaled copies; shuffled ids."""
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(600, 24))]
    for size, noise in ((150, 0.02), (80, 0.06), (60, 0.09), (40, 0.12)):
        x.append(rng.normal(size=(1, 24)) + noise * rng.normal(size=(size, 24)) * np.sqrt(2))
    a, b = rng.normal(size=(2, 24))
    x.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, 1.5, 30)]))
    x.append(np.repeat(x[0][:1], 70, axis=0))
    x.append(x[0][1:11] * 37.5)
    x = np.vstack(x)
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]


@pytest.mark.parametrize("block_rows,entry_cost", [(2_048, 2_000), (16, 2_000), (2_048, 20)])
def test_links_and_components(spark, mixed, monkeypatch, block_rows, entry_cost):
    """Also with hot filters cut into blocks, and with enough filters that no cap holds all rows."""
    monkeypatch.setattr(cap_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(cap_join, "ENTRY_COST", entry_cost)
    got, want = found(spark.createDataFrame(mixed, SCHEMA)), brute(mixed, 0.9)
    if entry_cost == 2_000:
        assert got == want
    else:
        assert len(cap_join.ProductCode(24, len(mixed), 0.9).codes) > 1
        assert sum(r[1] for r in got) >= 0.98 * sum(r[1] for r in want)
        assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_share_of_pairs_at_the_limit(monkeypatch):
    """Pairs at exactly the cosine, other ones than those the code was tried on, meet in a filter."""
    monkeypatch.setattr(cap_join, "ENTRY_COST", 200)
    rng = np.random.default_rng(8)
    for dims, n in ((8, 5_000), (64, 20_000), (64, 10 ** 7)):
        code = cap_join.ProductCode(dims, n, 0.9)
        a = cap_join._unit(rng.normal(size=(2_000, dims)))
        b = rng.normal(size=a.shape)
        b = cap_join._unit(b - (a * b).sum(1, keepdims=True) * a)
        total = code.size * len(code.codes)
        rows = [np.unique(np.intersect1d(*(r * total + f for r, f, _ in (code.decode(a), code.decode(cap_join._unit(c * a + np.sqrt(1 - c * c) * b))))) // total)
                for c in (0.9, 0.97)]
        assert len(rows[0]) >= 0.96 * len(a) and len(rows[1]) >= 0.995 * len(a)


def test_list_decoding_finds_all_directions(monkeypatch):
    monkeypatch.setattr(cap_join, "ENTRY_COST", 20)
    code = cap_join.ProductCode(12, 3_000, 0.9)
    x = cap_join._unit(np.random.default_rng(1).normal(size=(50, 12)))
    rows, filters, _ = code.decode(x)
    want = set()
    for k, (rotation, words) in enumerate(code.codes):
        y = x @ rotation
        for f in range(code.size):
            picks, rest = [], f
            for _ in words:
                picks.append(rest % code.words)
                rest //= code.words
            direction = np.concatenate([w[p] for w, p in zip(words, reversed(picks))])
            want |= {(int(r), k * code.size + f) for r in np.flatnonzero(y @ direction >= code.limit)}
    got = set(zip(rows.tolist(), filters.tolist()))
    assert want <= got and len(got) <= len(want) + len(x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [1.0, 0.0]), (2, [0.0, 5.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (None, [1.0, 0.0]), (None, None), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (11, [1e300, 1e299]), (12, [-3.0]), (13, [-4.0]), (14, [4.0]),
            (2, [1.0, 0.0]), (-5, [0.0, 1.0]), (15, [1.0] * 3000), (16, [1.0] * 3000)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert found(d) == brute(rows, 0.9)
    clashing = d.withColumns({c: F.lit("mine") for c in ("id", "v", "key", "ball", "n", "f", "block", "root", "digest", "kept", "label")})
    assert found(clashing) == found(d)
    assert found(d.limit(0)) == []
    assert found(d.where("vec_id = 3")) == [(3, 0, 3, True)]


def test_given_vectors(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    assert found(d, 0.45) == brute([(r[0], [float(c) for c in r[1]]) for r in d.collect()], 0.45)
