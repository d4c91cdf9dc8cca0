"""Statistics, outliers, selection rules and table round trips."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import reshape, statistics, summary
from pulsegrid.operators.ranking import keep_last
from pulsegrid.plans import decoders, models, runs, selection
from pulsegrid.schema import RUN_DETAIL
from pulsegrid.sources import recordings, tables


def test_t_p_values_match_tables():
    # Two-sided 5 % and 1 % points of Student t.
    for df, t5, t1 in ((1, 12.7062, 63.6567), (5, 2.5706, 4.0321), (30, 2.0423, 2.7500), (59, 2.0010, 2.6618)):
        assert statistics.t_two_sided(t5, df) == pytest.approx(0.05, abs=2e-5)
        assert statistics.t_two_sided(-t1, df) == pytest.approx(0.01, abs=2e-5)
    assert statistics.t_two_sided(0.0, 7) == 1.0


def gains(spark, matrix):
    rows = [(f"d{i}", f"m{j:02d}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "dataset string, method string, gain double")


def test_variance_components(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=(3, 20)) * 0.01 + rng.normal(size=20) * 0.05 + np.array([[0.1], [0.2], [0.0]])
    r = statistics.variance_components(gains(spark, y)).first()
    ms_m = 3 * ((y.mean(0) - y.mean()) ** 2).sum() / 19
    resid = y - y.mean(0) - y.mean(1)[:, None] + y.mean()
    ms_r = (resid ** 2).sum() / 38
    assert r["method_var"] == pytest.approx((ms_m - ms_r) / 3) and r["residual_var"] == pytest.approx(ms_r)
    assert r["mean_gain"] == pytest.approx(y.mean()) and 0 <= r["p_mean_gain"] <= 1
    assert r["effective_n"] == pytest.approx(60 / (1 + 2 * r["icc_method"]))


def test_negative_method_variance_is_set_to_zero(spark):
    y = np.array([[0.1, -0.1, 0.1, -0.1], [-0.1, 0.1, -0.1, 0.1], [0.02, 0.01, -0.02, 0.0]])
    r = statistics.variance_components(gains(spark, y)).first()
    assert r["method_var"] == 0 and r["icc_method"] == 0 and r["design_effect"] == 1
    total = ((y - y.mean(1)[:, None]) ** 2).sum()
    assert r["residual_var"] == pytest.approx(total / (3 * 3))


def dense_reml(rows, ratio):
    """-2 log restricted likelihood with the whole covariance matrix, profile over the residual variance."""
    y = np.array([g for _, _, g in rows])
    x, z = (np.array([[float(r[k] == v) for v in sorted({q[k] for q in rows})] for r in rows]) for k in (0, 1))
    v = np.eye(len(y)) + ratio * z @ z.T
    inner = x.T @ np.linalg.solve(v, x)
    beta = np.linalg.solve(inner, x.T @ np.linalg.solve(v, y))
    residual = (y - x @ beta) @ np.linalg.solve(v, y - x @ beta) / (len(y) - x.shape[1])
    value = (len(y) - x.shape[1]) * np.log(residual) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(inner)[1]
    return value, beta, np.linalg.inv(inner) * residual, residual


def test_unbalanced_variance_components(spark):
    """Missing cells, two gains in one cell and a null gain."""
    rng = np.random.default_rng(6)
    y = rng.normal(size=(3, 9)) * 0.03 + rng.normal(size=9) * 0.05 + np.array([[0.1], [0.2], [0.0]])
    rows = [(f"d{i}", f"m{j}", float(y[i, j])) for i in range(3) for j in range(9) if (i + 2 * j) % 5] + [("d0", "m3", 0.17), ("d2", "m1", 0.01)]
    r = statistics.variance_components(spark.createDataFrame([*rows, ("d9", "m9", None)], "dataset string, method string, gain double")).first()
    ratio = r["method_var"] / r["residual_var"]
    value, beta, cov, residual = dense_reml(rows, ratio)
    assert ratio > 0 and all(value <= dense_reml(rows, ratio * f)[0] + 1e-9 for f in (0, 0.5, 0.9, 0.99, 1.01, 1.1, 2, 10))
    assert r["residual_var"] == pytest.approx(residual) and r["mean_gain"] == pytest.approx(beta.mean())
    assert r["se_mean_gain"] == pytest.approx(np.sqrt(np.full(3, 1 / 3) @ cov @ np.full(3, 1 / 3)))
    assert r["reference_dataset_gain"] == pytest.approx(beta[0]) and r["se_intercept"] == pytest.approx(np.sqrt(cov[0, 0]))
    assert (r["n_obs"], r["n_datasets"], r["n_methods"]) == (len(rows), 3, 9)


def test_likelihood_equals_the_closed_form_where_balanced():
    rng = np.random.default_rng(4)
    for spread in (0.05, 0.0001):
        y = rng.normal(size=(3, 12)) * 0.02 + rng.normal(size=12) * spread
        cells = pd.DataFrame([(f"d{i}", f"m{j:02d}", 1, y[i, j], y[i, j] ** 2) for i in range(3) for j in range(12)], columns=["dataset", "method", "n", "s", "ss"])
        got = statistics._reml(cells).iloc[0]
        ms_m = 3 * ((y.mean(0) - y.mean()) ** 2).sum() / 11
        ms_r = ((y - y.mean(0) - y.mean(1)[:, None] + y.mean()) ** 2).sum() / 22
        if ms_m >= ms_r:
            assert got["method_var"] == pytest.approx((ms_m - ms_r) / 3, rel=1e-5) and got["residual_var"] == pytest.approx(ms_r, rel=1e-6)
        else:
            assert got["method_var"] == 0 and got["residual_var"] == pytest.approx(((y - y.mean(1)[:, None]) ** 2).sum() / 33)


def test_bootstrap_is_size_weighted(spark):
    g = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 0.0), ("b", "n", 0.0), ("b", "o", 0.0)], "dataset string, method string, gain double")
    r = statistics.cluster_bootstrap(g, "dataset", 4000).first()
    assert r["n_clusters"] == 2 and r["boot_mean"] == pytest.approx(0.25 + 0.5 * 0.25, abs=0.02)
    assert (r["ci_low"], r["ci_high"]) == (0.0, 1.0) and r["frac_positive"] == pytest.approx(0.75, abs=0.03)


@pytest.mark.parametrize("kind", sorted(selection.MULTIPLIERS))
def test_swept_grid_equals_prediction_at_every_point(kind):
    rng = np.random.default_rng(11)
    x = np.round(rng.dirichlet(np.ones(5), 300), 2)
    x[:20] = 0.2
    x[20:40, 3] = 0.0
    x[40:60] = [0.0, 0.0, 0.0, 0.25, 0.5]  # F meets Q exactly at a multiplier of 2
    x[60:70] = 0.0
    y = rng.integers(0, 5, 300)
    table = np.array([(*p, 1.0) for p in selection.multiplier_points(kind)])
    want = selection.predicted_cells(lambda v: np.stack([(v * m).argmax(axis=1) for m in table], axis=1))(y, x)
    assert (selection.swept_cells(y, x, [np.array(v, float) for v in selection.MULTIPLIERS[kind]]) == want).all()


def flags(spark, values, **kw):
    rows = [("d", None, "m", s, float(v)) for s, v in values]
    df = spark.createDataFrame(rows, "dataset string, family string, method string, seed int, macro_f1_4 double")
    return {r["seed"]: r for r in summary.outlier_flags(df, ["dataset", "family", "method"], **kw).collect()}


def test_outlier_rule(spark):
    got = flags(spark, [(1, .50), (2, .51), (3, .52), (4, .53), (5, .90)])
    assert [s for s, r in got.items() if not r["kept"]] == [5]
    assert got[5]["reason"] == "macro_f1_4_iqr_outlier" and got[5]["n_seeds_after"] == 4
    two = flags(spark, [(1, .1), (2, .9)])
    assert all(r["kept"] for r in two.values()) and two[1]["n_seeds_after"] == 2


def test_guard_keeps_the_rows_nearest_the_median(spark):
    # With a higher minimum the guard fires: six of seven stay, 9.0 is nearer than -9.0.
    got = flags(spark, [(1, .5), (2, .4), (3, .5), (4, .6), (5, .5), (6, 9.0), (7, -9.0)], min_keep=6)
    assert [s for s, r in got.items() if not r["kept"]] == [7]
    assert got[7]["reason"] == "macro_f1_4_iqr_outlier;minimum_retained_guard" and got[7]["n_seeds_after"] == 6
    # Equal distances to the median: the smaller seed stays.
    tie = flags(spark, [(1, .5), (4, 8.5), (2, -7.5), (3, .5), (5, .5), (6, .5), (7, .5)], min_keep=6)
    assert [s for s, r in tie.items() if not r["kept"]] == [4]


def test_nan_is_left_out_and_null_keys_stay(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, 3.0), (None, 1, 5.0)], "k string, seed int, v double")
    got = {r["k"]: r for r in summary.group_summary(df, ["k"], ["v"]).collect()}
    assert got["a"]["v_mean"] == 2.0 and got["a"]["v_std"] == 1.0 and got["a"]["n_seeds"] == 3
    assert got[None]["v_mean"] == 5.0 and got[None]["v_std"] == 0.0 and got["a"]["seeds"] == "1 2 3"


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 30)], "k string, ord int, v int")
    assert {r["k"]: r["v"] for r in keep_last(df, ["k"], "ord").collect()} == {"a": 20, "b": 30}


def test_risk_guard_rules(spark):
    def choose(best, arg, dataset="SVDB"):
        rows = [(dataset, 0, "evidence_argmax", *arg, 0.1, 0.1), (dataset, 1, "s_recovery", *best, 0.2, 0.2)]
        df = spark.createDataFrame(rows, "dataset string, cand int, decoder string, macro_f1_4 double, accuracy double, F1_S double, F1_F double, support_F long, key1 double, key2 double")
        return selection.guarded_decoder(df, ["dataset"], "dataset").first()

    base = (.60, .900, .50, .30, 50)
    assert choose((.62, .899, .50, .35, 50), base)["decoder"] == "s_recovery"
    assert choose((.61, .899, .50, .35, 50), base)["rejected"]
    assert choose((.62, .895, .50, .35, 50), base)["rejected"]
    assert choose((.62, .899, .41, .35, 50), base)["rejected"]
    assert choose((.62, .899, .50, .35, 9), base)["rejected"]
    assert choose((.62, .899, .50, .30, 9), base)["decoder"] == "s_recovery"
    assert choose((.61, .899, .50, .35, 50), base, "MIT-BIH")["decoder"] == "clinical_default"


def test_decoder_caps(spark):
    fit = spark.createDataFrame([(0,)] * 1000 + [(2,)] * 10, "y int")
    got = {r["decoder"]: r["multiplier"] for r in decoders.decoder_table(fit).collect()}
    assert got["evidence_argmax"] == [1.0] * 5
    assert got["clinical_default"] == pytest.approx([0.85, 2.60, max(100 ** -0.02, .9), 2.20, 1.0])
    assert got["stable_prior"][3] == pytest.approx(min(1000 ** 0.2, 4.0))


def test_file_discovery_and_audit(spark, tmp_path):
    for name in ("100.hea", "100.dat", "100.atr", "101.hea", "101.atr", "x.txt"):
        (tmp_path / name).write_bytes(b"x")
    recs = recordings.discover_records(spark, str(tmp_path))
    assert [r["record"] for r in recs.collect()] == ["100", "101"]
    missing = recordings.missing_files(recs, recordings.list_files(spark, str(tmp_path)))
    assert [tuple(r) for r in missing.collect()] == [("101", "dat")]


def test_materialised_table(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build(v):
        def run():
            built.append(v)
            return spark.createDataFrame([("a", 1, v), ("b", 1, v)], "dataset string, part int, v int")
        return run

    assert tables.load_or_build(spark, path, build(1), ("dataset", "part")).count() == 2
    again = tables.load_or_build(spark, path, build(2), ("dataset", "part"), "dataset = 'a'")
    assert built == [1] and [r["v"] for r in again.collect()] == [1]
    part = spark.createDataFrame([("a", 1, 9)], "dataset string, part int, v int")
    tables.replace_partitions(part, path, ("dataset", "part"))
    assert {r["dataset"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 9, "b": 1}
    assert tables.load_or_build(spark, path, build(3), ("dataset", "part"), force=True).count() == 2 and built == [1, 3]
    tables.append(part, path, ("dataset", "part"))
    assert spark.read.parquet(path).count() == 3


def test_detail_csv_keeps_json_columns(spark, tmp_path):
    row = {f.name: None for f in RUN_DETAIL.fields}
    row.update(dataset="SVDB", seed=303, train_counts='{"N":3,"S":1}', validation_table='[{"decoder":"a, \\"b\\"","alpha":0.5}]', accuracy=0.5)
    df = spark.createDataFrame([tuple(row[f.name] for f in RUN_DETAIL.fields)], RUN_DETAIL)
    tables.write_csv(df, str(tmp_path / "d"))
    back = tables.read_detail_csv(spark, str(tmp_path / "d")).first()
    assert back["train_counts"] == row["train_counts"] and back["validation_table"] == row["validation_table"] and back["accuracy"] == 0.5
    counts = reshape.counts_long(df, ["dataset"], {"Train": "train_counts"}).collect()
    assert {(r["class"], r["count"]) for r in counts} == {("N", 3), ("S", 1)}


def test_upsert_and_priority(spark):
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", None), ("c", 4)], "k string, v int")
    assert sorted(tuple(r) for r in tables.upsert(cur, new, ["k"]).collect()) == [("a", 1), ("b", None), ("c", 4)]
    assert sorted(tuple(r) for r in tables.read_first([new, cur], ["k"]).collect()) == [("a", 1), ("b", None), ("c", 4)]


def test_checked_write_is_one_job_and_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100, numPartitions=3).withColumn("g", F.col("id") % 4)
    rules = {"rows": (F.count(F.lit(1)), lambda v: v == 100), "lowest": (F.min("id"), lambda v: v is not None and v >= 0)}
    spark.sparkContext.setJobGroup("checked", "write")
    assert tables.checked_write(df, path, rules, ["g"]) == {"rows": 100, "lowest": 0}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("checked")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "")
    with pytest.raises(tables.BrokenContract, match="rows is 99; lowest is -1"):
        tables.checked_write(df.where("id > 1").union(spark.sql("select -1L, 0L")), path, rules)
    assert spark.read.parquet(path).count() == 100 and [p.name for p in tmp_path.iterdir()] == ["t"]
    tables.checked_write(df.select((F.col("id") * 2).alias("id")), path, rules)
    assert spark.read.parquet(path).agg(F.max("id")).first()[0] == 198 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_aligned_union(spark):
    a = spark.createDataFrame([("a", 1, 2.0)], "k string, v int, w double")
    b = spark.createDataFrame([("b", 7, "x")], "k string, v int, extra string")
    out = tables.aligned_union(a, b)
    assert out.columns == ["k", "v", "w"] and out.where("k = 'b'").first()["w"] is None


def test_full_run_resumes_and_stores_evidence(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(360):
        y = [0, 0, 1, 2, 3, 1, 0][i % 7]
        rows.append((i, "SVDB", f"r{i % 12}", y, [float(v) for v in rng.normal(y, 1, 8)], [float(v) for v in rng.normal(-y, 1, 8)]))
    df = spark.createDataFrame(rows, "beat_id long, dataset string, record string, y int, b0 array<double>, b1 array<double>")
    df = df.withColumn("x", F.concat("b0", "b1"))
    kw = dict(protocol="record", size=0.02, encoder={"trees": 5, "depth": 4}, store=str(tmp_path / "ev"))
    out = runs.full_run(df, ["SVDB"], ["logistic", "random_forest"], [303], **kw).collect()
    assert len(out) == 2 and all(0 <= r["accuracy"] <= 1 and r["train_size"] > 0 for r in out)
    assert spark.read.parquet(kw["store"]).select("profile").distinct().count() == 1
    done = spark.createDataFrame([("SVDB", "logistic", 303)], "dataset string, method string, seed int")
    rest = runs.full_run(df, ["SVDB"], ["logistic", "random_forest"], [303], done=done, **kw).collect()
    assert [r["method"] for r in rest] == ["random_forest"]
    a = [r for r in out if r["method"] == "random_forest"][0]
    assert (a["accuracy"], a["selected_decoder"]) == (rest[0]["accuracy"], rest[0]["selected_decoder"])


@pytest.mark.parametrize("name", models.BASELINES)
def test_baselines_give_probability_rows(spark, name):
    rng = np.random.default_rng(8)
    rows = [(i, i % 5, [float(v) for v in rng.normal(i % 5, 0.3, 4)]) for i in range(100)]
    df = spark.createDataFrame(rows, "beat_id long, y int, features array<double>")
    df = df.withColumn("seed", F.lit(303))
    out = models.fit_predict(name, df, df, ["seed"], size=0.02).collect()
    assert len(out) == 100 and all(sum(r["p"]) == pytest.approx(1.0) and len(r["p"]) == 5 for r in out)
