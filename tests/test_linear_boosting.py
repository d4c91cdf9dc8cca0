"""Linear models and boosting of many runs against single fits and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import boosting, linear, models
from pulsegrid.session import spread, unioned_lists

SCHEMA = "run int, seed int, beat_id long, y int, features array<double>"


def rows_of(sizes=(150, 220, 90), width=5):
    rng, out = np.random.default_rng(1), []
    for r, n in enumerate(sizes):
        y = rng.choice(5 - r, n)  # run 1 lacks a class, run 2 two of them
        x = rng.normal(size=(5, width))[y] * 0.8 + rng.normal(size=(n, width)) * (1 + np.arange(width))
        x[:, -1] = 3.0
        out += [(r, 7, 1000 * r + i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))]
    return out


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(5).cache()


def arrays(run):
    rows = [r for r in rows_of() if r[0] == run]
    return np.array([r[4] for r in rows]), np.array([r[3] for r in rows])


def scaled(x):
    sd = x.std(0)
    return np.hstack([(x - x.mean(0)) / np.where(sd > 0, sd, 1), np.ones((len(x), 1))])


@pytest.mark.parametrize("kind", sorted(linear.KINDS))
def test_all_runs_equal_single_fits_and_are_optimal(runs, kind):
    together = {m[0]: m for m in linear.fit(runs, ["run"], kind)}
    assert sorted(together) == [(0,), (1,), (2,)]
    for r in range(3):
        alone = linear.fit(runs.where(F.col("run") == r).coalesce(1), ["run"], kind)[0]
        w = together[r,][4]
        assert np.abs(w - alone[4]).max() < 1e-6
        x, y = arrays(r)
        z, classes = scaled(x), np.unique(y)
        assert together[r,][1].tolist() == classes.tolist()
        hit = (y[:, None] == classes).astype(float)
        if kind == "softmax":
            p = linear._softmax(z @ w.T)
            gradient = (p - hit).T @ z + np.hstack([w[:, :-1], np.zeros((len(w), 1))])
        else:
            sign = 2 * hit - 1
            gradient = (-2 * sign * np.maximum(0, 1 - sign * (z @ w.T))).T @ z + w
        assert np.abs(gradient).max() < 1e-5


def test_jobs_do_not_depend_on_runs(spark, runs):
    def jobs_of(df):
        spark.sparkContext.setJobGroup("count-me", "linear")
        linear.fit(df, ["run"], "softmax")
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("count-me"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", "")
        return n

    one = runs.where("run = 0")
    many = one.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(11))))
    first = jobs_of(one)
    assert jobs_of(many) - first <= first + 2


@pytest.mark.parametrize("kind", sorted(linear.KINDS))
def test_linear_rows(spark, runs, kind):
    extra = spark.createDataFrame([(0, 7, 901, 1, None), (9, 7, 902, 1, [0.0] * 5), (0, 7, 903, None, [0.0] * 5)], SCHEMA)
    models = linear.fit(runs.unionByName(extra.where("run = 0")), ["run"], kind)
    got = {(r.run, r.beat_id): r.p for r in linear.predict(models, runs.unionByName(extra), ["run"], kind).collect()}
    assert len(got) == 463 and got[0, 901] is None and got[9, 902] is None and sum(got[0, 903]) == pytest.approx(1)
    assert got[2, 2000][3:] == [0.0, 0.0] and sum(got[2, 2000]) == pytest.approx(1)
    assert linear.fit(runs.limit(0), ["run"], kind) == []


def test_boosting_loss_falls_and_rows_are_kept(spark, runs):
    grown = boosting.grow(runs, ["run"], size=0.1)
    losses = {r["run"]: r["losses"] for r in grown.select("run", "losses").collect()}
    assert all(b[0] < a[0] for v in losses.values() for a, b in zip(v, v[1:]))
    extra = spark.createDataFrame([(0, 7, 901, 1, None), (9, 7, 902, 1, [0.0] * 5)], SCHEMA)
    got = {(r.run, r.beat_id): r.p for r in boosting.score(grown.cache(), runs.unionByName(extra), ["run"]).collect()}
    assert len(got) == 462 and got[0, 901] is None and got[9, 902] is None
    assert all(sum(p) == pytest.approx(1) for k, p in got.items() if k[1] not in (901, 902))
    again = boosting.grow(runs.repartition(3, "y"), ["run"], size=0.1)
    assert {r["run"]: r["value"] for r in again.collect()} == {r["run"]: r["value"] for r in grown.collect()}


def test_boosting_stops_on_the_held_out_rows():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 3, 400)  # nothing to learn
    classes, start, edges, grown, losses = boosting.boost(x, y, np.arange(400) % 10 == 0)
    assert boosting.PATIENCE <= len(grown) < 60
    assert boosting.boost(x, np.full(400, 2), np.zeros(400, bool))[0].tolist() == [2]


def test_split_and_subtraction_against_all_cuts():
    rng = np.random.default_rng(3)
    x, g = np.round(rng.normal(size=(200, 4)), 1), rng.normal(size=200)
    h = rng.uniform(0.05, 0.25, 200)
    edges = boosting.edges_of(x)
    codes, bins = boosting.codes_of(x, edges), max(len(e) for e in edges) + 1
    cells = codes + np.arange(4) * bins
    whole = boosting._histogram(cells, 4 * bins, g, h, np.arange(200))
    gain, f, b = boosting.best_split(whole, bins)
    want = 0.0
    for j in range(4):
        for cut in edges[j]:
            left = x[:, j] <= cut
            if min(left.sum(), 200 - left.sum()) >= boosting.MIN_ROWS:
                parts = [(g[m].sum() ** 2) / (h[m].sum() + boosting.PENALTY) for m in (left, ~left, left | ~left)]
                want = max(want, parts[0] + parts[1] - parts[2])
    assert gain == pytest.approx(want)
    small = np.flatnonzero(codes[:, f] <= b)
    rest = np.flatnonzero(codes[:, f] > b)
    part = boosting._histogram(cells, 4 * bins, g, h, small)
    assert np.allclose(whole - part, boosting._histogram(cells, 4 * bins, g, h, rest))
    feature, cut, left, right, value = boosting.grow_tree(codes, g, h, bins)
    assert (feature < 0).sum() <= boosting.LEAVES and feature[0] == f and cut[0] == b
    at = boosting._values((feature, cut, left, right, np.arange(len(value)).astype(float)), codes).astype(int)
    for leaf in np.unique(at):
        mine = at == leaf
        assert mine.sum() >= boosting.MIN_ROWS
        assert value[leaf] == pytest.approx(-boosting.RATE * g[mine].sum() / (h[mine].sum() + boosting.PENALTY))


def test_no_null_lists_meet_the_models(spark, runs):
    model = spark.createDataFrame([(0, [1.0], ["a"], "t")], "run int, cut array<double>, names array<string>, text string")
    both = unioned_lists(model, runs.select("run", "beat_id"))
    lists = both.where("beat_id is not null").select("cut", "names", "text").distinct().collect()
    assert [tuple(r) for r in lists] == [([], [], None)] and both.count() == 461


def test_perceptron_rows_are_dealt_by_their_number(spark, runs, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "spread", lambda df, *columns: seen.append(spread(df, *columns, rows=50)) or seen[-1])
    one = runs.where("run = 0").coalesce(1)
    got = models.fit_predict("perceptron", one, one, ["run", "seed"], size=0.02)
    assert [df.rdd.getNumPartitions() for df in seen] == [3] and got.count() == 150
    assert all(sum(r.p) == pytest.approx(1) for r in got.collect())
    again = models.fit_predict("perceptron", one.repartition(4), one, ["run", "seed"], size=0.02)
    assert {r.beat_id: r.p for r in again.collect()} == {r.beat_id: r.p for r in got.collect()}
    assert spread(one, "beat_id").rdd.getNumPartitions() == 1  # few rows stay as they are


def test_boosting_sees_every_row(spark, runs, monkeypatch):
    want = {r["run"]: r["value"] for r in boosting.grow(runs, ["run"], size=0.02).collect()}
    monkeypatch.setattr(boosting, "FIT_ROWS", 50, raising=False)
    assert {r["run"]: r["value"] for r in boosting.grow(runs, ["run"], size=0.02).collect()} == want


def test_held_out_rows_are_drawn_by_all_ids(spark, runs):
    """By the first id alone, all rows of a dataset or none of them are held out, and the loss on them is not watched."""
    losses = boosting.grow(runs.withColumn("dataset", F.lit("A")), ["run"], ["dataset", "beat_id"], size=0.02).select("losses").collect()
    assert all(after > 0 for r in losses for _, after in r["losses"])


def test_histogram_by_feature_equals_the_one_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    x, g, h = rng.normal(size=(300, 5)), rng.normal(size=300), rng.uniform(0.05, 0.25, 300)
    codes = boosting.codes_of(x, boosting.edges_of(x))
    want = boosting.grow_tree(codes, g, h, 255)
    monkeypatch.setattr(boosting, "CELLS", 10)
    assert all((a == b).all() for a, b in zip(boosting.grow_tree(codes, g, h, 255), want))
