import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import neighbours, rebalance
from pulsegrid.plans import models


def brute(left, right, k, skip):
    out = {}
    for by, i, v in left:
        d = sorted((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for b, j, w in right if b == by and not (skip and i == j))
        out[i] = d[:k]
    return out


def cloud(seed, n, copies=0, clusters=4, groups=2, dim=6, start=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=5, size=(clusters, dim))
    rows = [(int(rng.integers(groups)), start + i, [float(x) for x in centres[i % clusters] + rng.normal(size=dim)]) for i in range(n)]
    rows += [(0, start + n + i, rows[0][2]) for i in range(copies)]  # many copies of one vector
    return rows


SCHEMA = "by int, id long, vec array<double>"


@pytest.mark.parametrize("skip", [False, True])
def test_equals_brute_force(spark, monkeypatch, skip):
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 20)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = cloud(1, 150, copies=70)
    other = rows if skip else cloud(2, 120, copies=30, start=1000)
    got = neighbours.nearest_neighbours(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA), 4, skip).collect()
    want = brute(rows, other, 4, skip)
    found = {}
    for r in got:
        found.setdefault(r["id"], []).append((r["rank"], r["dist2"], r["neighbour"]))
    assert set(found) == set(want)
    for i, near in want.items():
        mine = sorted(found[i])
        assert [x[2] for x in mine] == [j for _, j in near]
        assert [x[1] for x in mine] == pytest.approx([d for d, _ in near], abs=1e-9)


@pytest.mark.parametrize("n", [300, 1200])
def test_rows_are_sent_a_bounded_number_of_times(spark, monkeypatch, n):
    monkeypatch.setattr(neighbours, "ROWS_PER_PIVOT", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "GROUPS", 4)
    sent, dealt = [], neighbours._dealt

    def counted(*args):
        out = dealt(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "_dealt", counted)
    rows = cloud(5, n, clusters=1, groups=1, dim=12)
    df = spark.createDataFrame(rows, SCHEMA)
    assert neighbours.nearest_neighbours(df, df, 2, True).count() == 2 * n
    assert len(sent) == 2 and max(sent) <= 7 * n


@pytest.mark.parametrize("scale, shift", [(1.0, 1e6), (1e-12, 0.0), (1e25, 0.0)])
def test_any_scale_equals_brute_force(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(neighbours, "HITS", 50)
    rows = [(b, i, [shift + scale * x for x in v]) for b, i, v in cloud(3, 90)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, rows, 3, True)
    for r in neighbours.nearest_neighbours(df, df, 3, True).collect():
        assert r["neighbour"] == want[r["id"]][r["rank"] - 1][1]


def labelled(spark, sizes, dim=4):
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for c, n in sizes.items():
        for _ in range(n):
            rows.append((i, c, [float(x) for x in rng.normal(loc=c, size=dim)]))
            i += 1
    return spark.createDataFrame(rows, "beat_id long, y int, vec array<double>"), rows


def test_interpolation_fills_classes_inside_their_hull(spark):
    df, rows = labelled(spark, {0: 40, 1: 12, 3: 5})
    out = rebalance.interpolate_minority(df, 303).collect()
    sizes = {}
    for r in out:
        sizes[r["y"]] = sizes.get(r["y"], 0) + 1
    assert sizes == {0: 40, 1: 40, 3: 40}
    own = {c: np.array([v for _, y, v in rows if y == c]) for c in (1, 3)}
    for r in out:
        if r["synthetic"]:
            assert (np.array(r["vec"]) >= own[r["y"]].min(0) - 1e-9).all()
            assert (np.array(r["vec"]) <= own[r["y"]].max(0) + 1e-9).all()
    again = rebalance.interpolate_minority(df.repartition(5), 303).collect()
    assert sorted(map(tuple, ((r["id"], *r["vec"]) for r in out))) == sorted(map(tuple, ((r["id"], *r["vec"]) for r in again)))


def test_interpolation_is_skipped_for_single_row_classes(spark):
    df, _ = labelled(spark, {0: 10, 2: 1})
    assert rebalance.interpolate_minority(df, 1).count() == 11


def test_link_removal_equals_brute_force(spark):
    df, rows = labelled(spark, {0: 60, 1: 50}, dim=2)
    near = {}
    for i, _, v in rows:
        near[i] = min((float(((np.array(v) - np.array(w)) ** 2).sum()), j) for j, _, w in rows if j != i)[1]
    y = {i: c for i, c, _ in rows}
    want = {(i, j) for i, j in near.items() if i < j and near[j] == i and y[i] != y[j]}
    got = {(r["a"], r["b"]) for r in rebalance.link_pairs(df, "y", "beat_id").collect()}
    assert got == want and want
    left = rebalance.drop_links(df, "y", "beat_id").count()
    assert left == len(rows) - 2 * len(want)


def test_inverse_frequency_balances(spark):
    df, _ = labelled(spark, {0: 900, 1: 60, 2: 40})
    out = rebalance.inverse_frequency(df, 3).groupBy("y").count().collect()
    sizes = {r["y"]: r["count"] for r in out}
    assert sum(sizes.values()) == 1000 and all(260 < n < 410 for n in sizes.values())


def test_jitter_mask(spark):
    rows = [(i, [1.0] * 64, [2.0] * 64) for i in range(400)]
    df = spark.createDataFrame(rows, "beat_id long, b0 array<double>, b1 array<double>")
    out = rebalance.jitter_mask(df, 5, 1).collect()
    noise = np.array([v - 1.0 for r in out for v in r["b0"] if v != 0.0])
    assert abs(noise.mean()) < 1e-3 and noise.std() == pytest.approx(0.01, rel=0.1)
    spans = [[i for i, v in enumerate(r["b0"]) if v == 0.0] for r in out]
    masked = [s for s in spans if s]
    assert 60 < len(masked) < 140
    assert all(8 <= len(s) <= 24 and s[-1] - s[0] == len(s) - 1 for s in masked)
    assert all([i for i, v in enumerate(r["b1"]) if v == 0.0] == s for r, s in zip(out, spans))


def test_vote_shares(spark):
    df, _ = labelled(spark, {0: 30, 1: 30})
    out = models.knn_vote(df, df.where("beat_id < 5"), 7).collect()
    assert len(out) == 5 and all(sum(r["p"]) == pytest.approx(1.0) for r in out)
    assert {round(v * 7) for r in out for v in r["p"]} <= set(range(8))
    assert df.select(F.max("y")).first()[0] == 1


def test_copies_of_a_tiny_class_are_split(spark, monkeypatch):
    monkeypatch.setattr(rebalance, "PIECE", 20)
    df, _ = labelled(spark, {0: 600, 1: 1})
    out = rebalance.inverse_frequency(df, 3)
    sizes = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert sum(sizes.values()) == 601 and 250 < sizes[1] < 350
    assert out.where("y = 1").select("copy").distinct().count() == sizes[1]
