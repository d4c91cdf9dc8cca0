import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import probability as P
from pulsegrid.functions import waveform
from pulsegrid.operators import calibration, metrics, reshape


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_argmax_ties_go_to_the_lowest_class(spark):
    assert one(spark, A.argmax(arr(.2, .4, .4, 0, 0))) == 1
    assert one(spark, A.argmax(P.align(F.create_map(F.lit(0), F.lit(0.0))))) == 0


def test_align_fills_and_makes_uniform(spark):
    assert one(spark, P.align(F.create_map(F.lit(0), F.lit(0.0)))) == pytest.approx([.2] * 5)
    got = one(spark, P.align(F.create_map(F.lit(1), F.lit(3.0), F.lit(4), F.lit(1.0))))
    assert got == pytest.approx([0, .75, 0, 0, .25], abs=1e-9)


def test_scores(spark):
    two = one(spark, P.align_scores(P.binary_scores(F.lit(2.0), 0, 1)))
    assert two[0] == pytest.approx(np.exp(-2) / (np.exp(-2) + np.exp(2))) and two[2:] == [0, 0, 0]
    hard = one(spark, P.near_one_hot(F.lit(3)))
    assert hard[3] > 0.99 and sum(hard) == pytest.approx(1.0)


def test_power_one_only_normalises(spark):
    p = arr(2, 1, 1, 0, 0)
    assert one(spark, P.power_calibrate(p, 1.0)) == one(spark, P.normalise(p))
    assert one(spark, P.power_calibrate(p, F.lit(1.0))) == one(spark, P.normalise(p))
    got = one(spark, P.power_calibrate(p, 0.5))
    want = np.sqrt(np.clip([2, 1, 1, 0, 0], 1e-12, None) / 4)
    assert got == pytest.approx(list(want / want.sum()), rel=1e-6)


def test_boundary_push_is_zero_without_eta(spark):
    lb, le = P.safe_log(arr(.5, .3, .1, .05, .05)), P.safe_log(arr(.1, .6, .1, .1, .1))
    zero = arr(0, 0, 0, 0, 0)
    assert one(spark, P.boundary_scores(lb, le, zero, 0.5, 0.0, 0.0)) == pytest.approx(one(spark, P.fuse_logs(lb, le, 0.5)))


def test_series_helpers(spark):
    x = np.sin(np.arange(40) / 3.0) + np.arange(40) / 7.0
    col = arr(*x)
    padded = np.concatenate([[x[0]] * 12, x, [x[-1]] * 12])
    assert one(spark, A.moving_average(col)) == pytest.approx([padded[i:i + 25].mean() for i in range(40)])
    assert one(spark, A.resample(col, 17)) == pytest.approx(list(np.interp(np.linspace(0, 39, 17), np.arange(40), x)))
    assert one(spark, A.resample(arr(4.0), 3)) == [4.0, 4.0, 4.0]
    assert one(spark, A.diff(col)) == pytest.approx(list(np.diff(x)))
    assert one(spark, A.instance_norm(col)) == pytest.approx(list((x - x.mean()) / (x.std(ddof=1) + 1e-5)))
    assert len(one(spark, A.patches(col, 16, 8))) == 4 and one(spark, A.patches(arr(1, 2), 16, 8)) == []
    assert one(spark, A.average_pool(arr(1, 3, 5, 7, 9))) == [2.0, 6.0]


def test_batched_features_equal_builtin_features(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=12)], [float(v) for v in rng.normal(size=234)],
             [float(v) for v in rng.normal(size=234)]) for i in range(5)]
    df = spark.createDataFrame(rows, "beat_id long, rr array<double>, b0 array<double>, b1 array<double>")
    a = {r["beat_id"]: r["x"] for r in waveform.base_features(df).collect()}
    b = {r["beat_id"]: r["x"] for r in waveform.base_features(df, batched=False).collect()}
    assert len(a[0]) == 330
    for i in a:
        assert a[i] == pytest.approx(b[i], rel=1e-9, abs=1e-9)
    c = df.withColumn("s", waveform.resample_batch(80)("b0")).first()
    assert c["s"] == pytest.approx(list(np.interp(np.linspace(0, 233, 80), np.arange(234), c["b0"])))


def test_absent_class_scores_zero_and_counts_in_the_mean(spark):
    df = spark.createDataFrame([(0, 0)] * 6 + [(1, 1)] * 4 + [(2, 0)], "y int, pred int")
    r = metrics.metric_row(metrics.confusion_counts(df, []), []).first()
    assert r["F1_Q"] == pytest.approx(0, abs=1e-9) and r["support_Q"] == 0
    assert r["macro_f1_5"] == pytest.approx((2 * 6 / 13 + 1.0) / 5)
    assert r["accuracy"] == pytest.approx(10 / 11)


def test_bins_at_the_edges(spark):
    rows = [(1.0,), (0.2,), (0.0,), (0.999999,), (1 / 15,), (14 / 15,)]
    got = [r["b"] for r in spark.createDataFrame(rows, "c double").select(calibration.bin_of(F.col("c")).alias("b")).collect()]
    edges = np.linspace(0, 1, 16)
    want = [min(int(np.searchsorted(edges, c, side="right")), 15) for (c,) in rows]
    assert got == want and got[0] == 15 and got[1] == 4


def test_empty_bins_are_nan(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 0.0])], "y int, p array<double>")
    bins = calibration.reliability_bins(calibration.binned_scores(df, []), []).orderBy("bin").collect()
    assert len(bins) == 15 and bins[0]["n"] == 0 and np.isnan(bins[0]["accuracy"]) and bins[14]["n"] == 1


def test_json_edge_cases(spark):
    text = '[{"decoder":"a","val_macro_f1_4":0.5},{"alpha":0.2}]'
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, validation_table string")
    rows = reshape.candidate_rows(df, ["k"]).collect()
    assert [(r["k"], r["alpha"], r["decoder"]) for r in rows] == [(1, None, "a"), (1, 0.2, None)]
    keys = spark.createDataFrame([("a|b|1|raw",), ("a|b",), ("a|b|1|raw|x",)], "key string")
    assert reshape.split_key(keys, "key", ["d", "m", "s", "g"]).count() == 1
