"""Hot-key paths must equal the plain window plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import intervals, ordered
from pulsegrid.operators.quantiles import grouped_quantiles
from pulsegrid.operators.ranking import take_lowest


@pytest.fixture(scope="module")
def ann(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for record, n in (("hot", 400), ("b", 60), ("one", 1), ("two", 2)):
        at = 0
        for _ in range(n):
            at += rng.choice([0, 1, 3, 50, 4000])  # ties, bursts and long gaps
            rows.append((record, i, at, "N"))
            i += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "record string, ann_idx long, sample long, symbol string")


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("max_rows", [7, 50, 150])
def test_interval_context_with_cut_keys(ann, max_rows):
    plain = intervals.interval_context(ann, 360.0)
    cut = intervals.interval_context(ann, 360.0, max_rows=max_rows)
    assert as_set(plain) == as_set(cut)


def test_intervals_by_hand(spark):
    samples = [0, 100, 250, 260, 600, 900, 1000]
    df = spark.createDataFrame([("r", i, s, "N") for i, s in enumerate(samples)],
                               "record string, ann_idx long, sample long, symbol string")
    rows = sorted(intervals.interval_context(df, 100.0).collect(), key=lambda r: r["ann_idx"])
    d = np.diff(samples) / 100.0
    glob = float(np.median(d))
    for i, r in enumerate(rows):
        lo, hi = max(0, i - 5), min(len(samples) - 1, i + 5)
        local = float(np.median(np.diff(samples[lo:hi + 1]) / 100.0))
        assert r["pre"] == pytest.approx(d[i - 1] if i else glob)
        assert r["post"] == pytest.approx(d[i] if i < len(d) else glob)
        assert (r["local"], r["global"]) == (pytest.approx(local), pytest.approx(glob))


def test_single_annotation_has_unit_interval(ann):
    row = intervals.interval_context(ann, 360.0).where("record = 'one'").first()
    assert (row["pre"], row["post"], row["local"], row["global"]) == (1.0, 1.0, 1.0, 1.0)


@pytest.mark.parametrize("max_rows", [5, 60])
def test_row_index_with_cut_keys(ann, max_rows):
    plain = ordered.row_index(ann, ["record"], "sample", "ann_idx")
    cut = ordered.row_index(ann, ["record"], "sample", "ann_idx", max_rows=max_rows)
    cols = ["record", "ann_idx", "idx"]
    assert as_set(plain.select(*cols)) == as_set(cut.select(*cols))


@pytest.mark.parametrize("values", ["ties", "spread", "constant"])
def test_quantiles_of_a_big_group(spark, values):
    rng = np.random.default_rng(3)
    n = 5000
    v = {"ties": rng.integers(0, 9, n).astype(float), "spread": rng.normal(size=n), "constant": np.ones(n)}[values]
    rows = [("hot", float(x)) for x in v] + [("small", float(x)) for x in v[:11]] + [("small", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.975, 1.0], max_rows=100).collect()}
    for k, x in (("hot", v), ("small", v[:11])):
        assert got[k]["n"] == len(x)
        assert got[k]["q"] == pytest.approx(list(np.quantile(x, [0.0, 0.25, 0.5, 0.975, 1.0])), abs=1e-12)


@pytest.mark.parametrize("quota", [0, 1, 37, 3000, 9999])
def test_take_lowest_equals_sorting(spark, quota):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") < 2500, 0).otherwise(1))
    q = spark.createDataFrame([(0, quota), (1, min(quota, 5))], "k int, quota long")
    got = take_lowest(df, ["k"], q, 7, "id").where("selected").groupBy("k").count()
    sizes = {r["k"]: r["count"] for r in got.collect()}
    assert sizes.get(0, 0) == min(quota, 2500) and sizes.get(1, 0) == min(quota, 5)
    import hashlib
    order = sorted(range(2500), key=lambda i: (int(hashlib.md5(f"7|{i}".encode()).hexdigest()[:8], 16), i))
    picked = {r["id"] for r in take_lowest(df, ["k"], q, 7, "id").where("selected and k = 0").collect()}
    assert picked == set(order[:quota])
