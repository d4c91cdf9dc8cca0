"""Rows in are rows out: many or null classes, null metrics, resumed grids, one store for two protocols."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import rebalance, reshape, splits, summary
from pulsegrid.operators.ranking import take_lowest
from pulsegrid.plans import boosting, forests, runs


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame([(i, i % 8 if i % 8 else None) for i in range(800)], "beat_id long, y int").cache()


def test_splits_keep_every_row(classes):
    for out in (splits.stratified_split(classes, 3), splits.stratified_split_all(classes, 3)):
        assert out.count() == 800 and out.where("role is null").count() == 0
        per = {r.y: r.n for r in out.where("role = 'val'").groupBy("y").agg(F.count("*").alias("n")).collect()}
        assert len(per) == 8 and len(set(per.values())) == 1


def test_tiny_classes_fall_back_to_the_whole_set(spark):
    d = spark.createDataFrame([(1, 0), (2, 0), (3, None)], "beat_id long, y int")
    out = splits.stratified_split(d, 3)
    assert out.count() == 3 and out.where("role = 'val'").count() == 1


def test_cap_keeps_null_classes(classes, spark):
    both = classes.union(spark.range(1000, 1300).selectExpr("id", "0"))
    assert splits.majority_cap(both, 3, cap=50).groupBy("y").count().count() == 9
    assert splits.majority_cap(both, 3, cap=50).count() == 850


def test_keys_without_quota_are_flagged_unselected(classes, spark):
    quotas = spark.createDataFrame([(None, 7), (2, 5)], "y int, quota long")
    out = take_lowest(classes, ["y"], quotas, 1, "beat_id")
    assert out.count() == 800
    assert {r.y: r.n for r in out.where("selected").groupBy("y").agg(F.count("*").alias("n")).collect()} == {None: 7, 2: 5}


def test_classes_outside_the_list_are_an_error(classes):
    with pytest.raises(ValueError, match="no class"):
        rebalance.inverse_frequency(classes, 3)


def test_outlier_rows_are_kept_or_removed(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 1.1, 1.2, 1.3, 9.0, None, float("nan")])] + [("b", i, None) for i in range(3)]
    flags = summary.outlier_flags(spark.createDataFrame(rows, "g string, seed int, macro_f1_4 double"), ["g"])
    got = flags.groupBy("kept").count().collect()
    assert sum(r["count"] for r in got) == 10 and all(r.kept is not None for r in got)
    assert [(r.g, r.seed) for r in flags.where("not kept").collect()] == [("a", 4)]


def _beats(spark):
    # two leads of four values, five classes, twelve records
    return spark.range(600).selectExpr(
        "id as beat_id", "'A' as dataset", "concat('r', id % 12) as record", "cast(id % 5 as int) as y",
        "transform(sequence(1, 4), k -> cast(sin(id * k) + id % 5 as float)) as b0",
        "transform(sequence(1, 4), k -> cast(cos(id * k) - id % 5 as float)) as b1").withColumn("x", F.concat("b0", "b1"))


SMALL = {"trees": 3, "depth": 3}


def test_store_keeps_protocols_apart(spark, tmp_path):
    rows = _beats(spark).cache()
    args = (rows, ["A"], ["logistic"], [1])
    runs.full_run(*args, protocol="record", store=str(tmp_path / "s"), size=0.02, encoder=SMALL).collect()
    stored = runs.full_run(*args, protocol="beat", store=str(tmp_path / "s"), size=0.02, encoder=SMALL).collect()
    plain = runs.full_run(*args, protocol="beat", size=0.02, encoder=SMALL).collect()
    assert [r.asDict() for r in stored] == [r.asDict() for r in plain]
    assert stored[0].val_size > 0 and stored[0].train_size + stored[0].val_size + stored[0].test_size == 600


def test_finished_grid_is_empty(spark):
    done = spark.createDataFrame([("A", "logistic", 1)], "dataset string, method string, seed int")
    out = runs.full_run(_beats(spark), ["A"], ["logistic"], [1], done=done)
    assert out.count() == 0 and {"macro_f1_4", "val_counts", "protocol"} <= set(out.columns)


def test_unmatched_probabilities_are_an_error(spark):
    a = spark.createDataFrame([("A", 1, "val", 1, [1.0])], "dataset string, seed int, role string, beat_id long, p_backbone array<double>")
    b = spark.createDataFrame([("A", 1, "test", 1, [1.0])], "dataset string, seed int, role string, beat_id long, p_evidence array<double>")
    with pytest.raises(ValueError, match="only one"):
        runs.met_probabilities(a, b)


def test_probability_store(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.createDataFrame([("val", 1, 0, [1.0])], "role string, beat_id long, y int, p array<double>")
    for _ in range(2):
        for protocol in ("record", "beat"):
            got = runs.stored_probabilities(build, spark, str(tmp_path / "p"), "A", "m", 1, protocol)
            assert got.count() == 1 and got.first()["protocol_id"] == protocol
    assert len(made) == 2


def test_baselines_are_evaluated_once(spark):
    rows = _beats(spark).withColumn("features", F.concat(F.col("b0").cast("array<double>"), F.col("b1").cast("array<double>"))).cache()
    targets = rows.withColumn("dataset", F.expr("if(beat_id % 2 = 0, 'B', 'C')"))
    first = runs.baseline_evaluation(rows, targets, ["logistic"], [1, 2], size=0.02)
    assert {(r.dataset, r.model, r.seed) for r in first.collect()} == {(d, "logistic", s) for d in "BC" for s in (1, 2)}
    rest = runs.baseline_evaluation(rows, targets, ["logistic"], [1, 2], done=first.where("not (dataset = 'C' and seed = 2)"), size=0.02)
    assert [(r.dataset, r.seed) for r in rest.collect()] == [("C", 2)]
    assert runs.baseline_evaluation(rows, targets, ["logistic"], [1, 2], done=first).count() == 0


def test_json_fields_of_any_keys(spark):
    docs = ['{"a": 1, "b": "2.5", "c": "x"}', '{"a": [1], "d": {"e": 1}, "f": null, "g": true, "h": -0.5}', "", None, "{", "[1, 2]", "7", "{}", '{"z": 1', '{"y": 3}{']
    d = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = {(r.id, r.field): (r.kind, r.number, r.text) for r in reshape.json_fields(d, ["id"], "doc").collect()}
    assert got == {
        (0, "a"): ("number", 1.0, None), (0, "b"): ("text", 2.5, "2.5"), (0, "c"): ("text", None, "x"), (1, "a"): ("array", None, None),
        (1, "d"): ("object", None, None), (1, "f"): ("null", None, None), (1, "g"): ("boolean", None, None), (1, "h"): ("number", -0.5, None),
        (9, "y"): ("number", 3.0, None)}


def test_bucketed_probabilities_meet_without_exchange(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i % 2, "val" if i % 5 else "test", i, [0.2] * 5) for i in range(2000)]
    back = spark.createDataFrame(rows, "dataset string, seed int, role string, beat_id long, p_backbone array<double>")
    evidence = back.withColumn("y", F.col("beat_id") % 5).withColumnRenamed("p_backbone", "p_evidence")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs.keep_bucketed(back, "kept_backbone", 8, str(tmp_path / "b"))
        runs.keep_bucketed(evidence, "kept_evidence", 8, str(tmp_path / "e"))
        stored = spark.table("kept_backbone"), spark.table("kept_evidence")
        plan = runs.paired_probabilities(*stored)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" in runs.paired_probabilities(back, evidence)._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, runs.met_probabilities(*stored).collect()))
        assert got == sorted(map(str, runs.met_probabilities(back, evidence).collect())) and len(got) == 2000
        with pytest.raises(ValueError, match="only one"):
            runs.met_probabilities(stored[0].where("beat_id <> 7"), stored[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for t in ("kept_backbone", "kept_evidence"):
            spark.sql(f"drop table if exists {t}")


def test_baselines_of_one_dataset_are_fitted_beyond_the_old_bounds(spark, monkeypatch):
    """The first id column is the dataset: drawn by it, all rows of a run or none were fitted, and runs without rows divided by zero."""
    monkeypatch.setattr(forests, "FIT_ROWS", 10)
    monkeypatch.setattr(boosting, "FIT_ROWS", 10, raising=False)
    rows = spark.createDataFrame([("ABC"[i % 3], i, i % 5, [float(i % 5), float(i % 7)]) for i in range(600)], "dataset string, beat_id long, y int, features array<double>")
    for name in ("boosting", "random_forest", "extra_trees"):
        got = runs.baseline_evaluation(rows.where("dataset = 'A'"), rows.where("dataset <> 'A'"), [name], [303, 1303], size=0.05).collect()
        assert len(got) == 4 and all(r["accuracy"] > 0.9 for r in got), name
