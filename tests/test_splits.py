import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import splits
from pulsegrid.schema import SEEDS


def beats(spark, sizes):
    rows, i = [], 0
    for record, counts in sizes.items():
        for c, n in enumerate(counts):
            for _ in range(n):
                rows.append((i, record, c))
                i += 1
    return spark.createDataFrame(rows, "beat_id long, record string, y int")


def roles(df):
    return {r["record"]: r["role"] for r in df.collect()}


@pytest.mark.parametrize("n, beat_val, all_val", [(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 1, 1)])
def test_small_classes(spark, n, beat_val, all_val):
    df = beats(spark, {"a": [40, n, 0, 0, 0]})
    a = splits.stratified_split(df, 303).where("y = 1 and role = 'val'").count()
    b = splits.stratified_split_all(df, 303).where("y = 1 and role = 'val'").count()
    assert (a, b) == (beat_val, all_val)


def test_fallback_when_no_class_can_be_split(spark):
    df = beats(spark, {"a": [2, 2, 2, 1, 0]})
    out = splits.stratified_split(df, 303)
    assert out.where("role = 'val'").count() == 1 and out.count() == 7


def test_dominant_record_stays_in_fit(spark):
    sizes = {f"r{i}": [30, 6, 8, 2, 0] for i in range(12)}
    sizes["big"] = [30, 2, 8, 90, 0]
    df = beats(spark, sizes)
    for seed in SEEDS:
        got = roles(splits.fit_val_records(df, seed))
        assert got["big"] == "fit" and len(got) == 13
        assert list(got.values()).count("val") == 2


def test_without_guard_the_most_minority_rows_win(spark):
    df = beats(spark, {f"r{i}": [40, 3 + i, 6, 3, 0] for i in range(8)})
    got = roles(splits.fit_val_records(df, 303, candidates=200))
    assert [r for r, role in got.items() if role == "val"] == ["r7"]


def test_impossible_splits_raise(spark):
    lone = beats(spark, {"a": [40, 40, 0, 0, 0], "b": [40, 0, 0, 0, 0], "c": [40, 0, 0, 0, 0]})
    with pytest.raises(RuntimeError):
        splits.fit_val_records(lone, 303, candidates=50)
    with pytest.raises(RuntimeError):
        splits.train_test_records(lone, 303, candidates=50)
    with pytest.raises(ValueError):
        splits.fit_val_records(beats(spark, {"a": [5, 0, 0, 0, 0]}), 303)


@pytest.mark.parametrize("seed", SEEDS)
def test_splits_are_disjoint_and_repeatable(spark, seed):
    df = beats(spark, {f"r{i}": [20, 5, 5, 4, i % 2] for i in range(20)})
    a, b = splits.fit_val_records(df, seed), splits.fit_val_records(df.repartition(7), seed)
    assert roles(a) == roles(b)
    parts = splits.train_test_records(df, seed)
    assert roles(parts) and sum(v == "train" for v in roles(parts).values()) == 13
    whole = splits.fit_val_split(df, seed).withColumn("dataset", F.lit("d")).withColumn("seed", F.lit(seed))
    row = splits.split_audit(whole).first()
    assert row["fit_val_record_overlap"] == 0 and row["audit_interpretation"] == splits.CLEAN
    assert row["fit_size"] + row["val_size"] == df.count()


def test_record_list_text_refuses_long_lists(spark):
    df = spark.createDataFrame([("d", 1, "fit", f"r{i}") for i in range(5)], "dataset string, seed int, role string, record string")
    recs = splits.split_records(df)
    assert splits.record_list_text(recs).first()["records_list"] == "r0;r1;r2;r3;r4"
    with pytest.raises(ValueError):
        splits.record_list_text(recs, limit=4)


def test_majority_cap(spark):
    df = beats(spark, {"a": [500, 7, 0, 3, 0]})
    out = splits.majority_cap(df, 1, 100).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in out} == {0: 100, 1: 7, 3: 3}
