"""Record- and row-level splits, majority cap, and the leakage audit."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.hashing import hash32
from pulsegrid.operators.groups import largest_group
from pulsegrid.operators.metrics import class_counts
from pulsegrid.operators.ranking import hash_bucket, take_lowest
from pulsegrid.schema import CLASS_NAMES, N_CLASSES, TRAIN_FRACTION, VAL_FRACTION
from pulsegrid.session import pin, small_side

MIN_SUPPORT = 30
GUARD_ROWS = 10
FIRST_BATCH = 64
CANDIDATE_BITS = 10  # candidates rank records, which are far fewer than rows

COUNTS = [f"count_{c}" for c in CLASS_NAMES]


def fixed_lists(beats: DataFrame, lists: DataFrame, record="record") -> DataFrame:
    """Keep listed records and take ``role`` from the list table (one row per record)."""
    return beats.join(small_side(lists.select(F.col("record").alias(record), "role")), record)


def record_counts(beats: DataFrame, record="record", y="y") -> DataFrame:
    """Class counts per record; the split searches work on this instead of on rows."""
    return class_counts(beats, [record], y)


def _half_even(x, fraction):
    return F.bround(F.lit(float(fraction)) * x).cast("long")


def _batches(n):
    done, size = 0, FIRST_BATCH
    while done < n:
        yield done, min(n, done + size)
        done, size = done + size, size * 4


def _drawn_counts(per_record, record, quota, seed, lo, hi):
    """Class counts of the drawn records for candidates lo..hi-1 (each a seeded draw)."""
    spark = per_record.sparkSession
    cands = spark.range(lo, hi).withColumnRenamed("id", "cand")
    rows = per_record.withColumn("cand", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))))
    drawn = take_lowest(rows, ["cand"], cands.withColumn("quota", F.lit(quota)), seed, ["cand", record], bits=CANDIDATE_BITS)
    return drawn.where("selected").groupBy("cand").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _draw(per_record, record, quota, seed, cand):
    spark = per_record.sparkSession
    one = spark.range(1).select(F.lit(cand).cast("long").alias("cand"), F.lit(quota).alias("quota"))
    rows = per_record.withColumn("cand", F.lit(cand).cast("long"))
    return take_lowest(rows, ["cand"], one, seed, ["cand", record], bits=CANDIDATE_BITS).select(record, "selected")


def _totals(per_record):
    row = per_record.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in COUNTS]).first()
    return int(row["n"]), [int(row[c] or 0) for c in COUNTS]


def train_test_records(beats: DataFrame, seed, record="record", y="y",
                       fraction=TRAIN_FRACTION, candidates=2000) -> DataFrame:
    """(record, role): first of the seeded candidates with classes 0-3 on both sides.

    A class counts if it has at least 20 rows. Candidates run in growing batches; the
    first admissible one ends the search, as every later one would lose to it.
    """
    per = pin(record_counts(beats, record, y))
    n, totals = _totals(per)
    quota = max(1, round(n * fraction))
    need = [c for c in range(4) if totals[c] >= 20]
    for lo, hi in _batches(candidates):
        got = _drawn_counts(per, record, quota, seed, lo, hi)
        ok = reduce(
            lambda a, b: a & b,
            [(F.col(COUNTS[c]) > 0) & (F.col(COUNTS[c]) < totals[c]) for c in need], F.lit(True))
        best = got.where(ok).agg(F.min("cand").alias("cand")).first()["cand"]
        if best is not None:
            return _draw(per, record, quota, seed, best).select(
                record, F.when(F.col("selected"), "train").otherwise("test").alias("role"))
    raise RuntimeError("no record-level split holds every needed class on both sides")


def fit_val_records(beats: DataFrame, seed, record="record", y="y",
                    fraction=VAL_FRACTION, candidates=3000) -> DataFrame:
    """(record, role): constrained record-level fit/validation split.

    Admissible: for each class of at least 30 rows the fit side keeps half or more and
    validation is not empty. Chosen: the first admissible candidate with ten or more F
    rows in validation, else the admissible one with most S+F rows (first on ties).
    """
    per = pin(record_counts(beats, record, y))
    n, totals = _totals(per)
    if n < 2:
        raise ValueError("a record-level split needs at least two records")
    quota = min(max(1, round(n * fraction)), n - 1)
    need = [c for c in range(N_CLASSES) if totals[c] >= MIN_SUPPORT]
    ok = reduce(
        lambda a, b: a & b,
        [(F.col(COUNTS[c]) * 2 <= totals[c]) & (F.col(COUNTS[c]) > 0) for c in need], F.lit(True))
    minority = F.col("count_S") + F.col("count_F")
    best = None
    for lo, hi in _batches(candidates):
        got = _drawn_counts(per, record, quota, seed, lo, hi).where(ok)
        row = got.agg(
            F.min(F.when(F.col("count_F") >= GUARD_ROWS, F.col("cand"))).alias("guarded"),
            F.max(F.struct(minority.alias("m"), (-F.col("cand")).alias("c"))).alias("fallback"),
        ).first()
        if row["guarded"] is not None:
            best = (None, row["guarded"])
            break
        if row["fallback"] is not None and (best is None or row["fallback"]["m"] > best[0]):
            best = (row["fallback"]["m"], -row["fallback"]["c"])
    if best is None:
        raise RuntimeError("no record-level validation split keeps every well-supported class in the fit side")
    return _draw(per, record, quota, seed, int(best[1])).select(
        record, F.when(F.col("selected"), "val").otherwise("fit").alias("role"))


def _by_quota(beats, quotas, key, seed, row_id):
    flagged = take_lowest(beats, [key], quotas, seed, row_id)
    return flagged.withColumn("role", F.when(F.col("selected"), "val").otherwise("fit")).drop("selected")


def stratified_split(beats: DataFrame, seed, y="y", row_id="beat_id", fraction=VAL_FRACTION) -> DataFrame:
    """Add ``role``: per class clip(round(fraction*n), 1, n-1) rows to validation.

    Classes of one or two rows stay in fit. If that leaves validation empty (no class has
    three rows), max(1, round(fraction*n)) rows of the whole set are drawn instead.
    """
    counts = beats.groupBy(F.col(y).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    if largest is not None and largest <= 2:
        quotas = beats.sparkSession.createDataFrame([(0, max(1, round(total * fraction)))], "_s int, quota long")
        return _by_quota(beats.withColumn("_s", F.lit(0)), quotas, "_s", seed, row_id).drop("_s")
    n = F.col("n")
    quota = F.when(n <= 2, F.lit(0)).otherwise(F.least(F.greatest(_half_even(n, fraction), F.lit(1)), n - 1))
    quotas = counts.select("_s", quota.cast("long").alias("quota"))
    return _by_quota(beats.withColumn("_s", F.col(y)), quotas, "_s", seed, row_id).drop("_s")


def stratified_split_all(beats: DataFrame, seed, y="y", row_id="beat_id", fraction=VAL_FRACTION) -> DataFrame:
    """Variant: a class of one row goes to validation, a class of two gives one row each."""
    n = F.col("n")
    quota = F.when(n == 1, F.lit(1)).otherwise(
        F.least(F.greatest(_half_even(n, fraction), F.lit(1)), n - 1))
    quotas = beats.groupBy(F.col(y).alias("_s")).agg(F.count(F.lit(1)).alias("n")).select(
        "_s", quota.cast("long").alias("quota"))
    return _by_quota(beats.withColumn("_s", F.col(y)), quotas, "_s", seed, row_id).drop("_s")


def majority_cap(beats: DataFrame, seed, cap=50_000, y="y", row_id="beat_id") -> DataFrame:
    """Sample class 0 down to ``cap`` rows without replacement; all other rows stay, null classes too."""
    spark = beats.sparkSession
    quotas = spark.range(1).select(F.lit(0).alias("_s"), F.lit(cap).cast("long").alias("quota"))
    major = beats.where(F.col(y) == 0).withColumn("_s", F.lit(0))
    kept = take_lowest(major, ["_s"], quotas, seed, row_id).where("selected").drop("_s", "selected")
    return beats.where(~F.col(y).eqNullSafe(F.lit(0))).unionByName(kept)


def fit_val_split(beats: DataFrame, seed, protocol="record", record="record", y="y", row_id="beat_id"):
    """Split under the ``record`` protocol (whole records held out) or the ``beat`` one."""
    if protocol == "record":
        return beats.join(fit_val_records(beats, seed, record, y), record)
    if protocol == "beat":
        return stratified_split(beats, seed, y, row_id)
    raise ValueError(f"unknown protocol {protocol!r}")


def training_pool(*parts: DataFrame) -> DataFrame:
    """Union of training pools by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


CLEAN = "No record leakage across fitting, validation and test"


def split_audit(assigned: DataFrame, keys=("dataset", "seed"), record="record", y="y") -> DataFrame:
    """Sizes, record counts, class counts and overlaps of the roles per key.

    Rows are first reduced to one row per record, so everything after is record-sized.
    """
    keys = list(keys)
    role = F.col("role")
    per = assigned.groupBy(*keys, record, "role").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum((F.col(y) == c).cast("int")).alias(f"_c{c}") for c in range(N_CLASSES)],
    )
    roles = ("fit", "val", "test")
    rec = per.groupBy(*keys, record).agg(
        *[F.max((role == r).cast("int")).alias(r) for r in roles],
        *[F.coalesce(F.sum(F.when(role == r, F.col("_n"))), F.lit(0)).alias(f"_{r}_n") for r in roles],
        *[F.coalesce(F.sum(F.when(role == r, F.col(f"_c{c}"))), F.lit(0)).alias(f"_{r}_{c}")
          for r in ("fit", "val") for c in range(N_CLASSES)],
    )

    def both(a, b):
        return F.sum(F.col(a) * F.col(b)).cast("long").alias(f"{a}_{b}_record_overlap")

    def counts(r):
        return F.to_json(F.struct(*[
            F.sum(f"_{r}_{c}").alias(n) for c, n in enumerate(CLASS_NAMES)])).alias(f"{r}_counts")

    out = rec.groupBy(*keys).agg(
        *[F.sum(r).cast("long").alias(f"{r}_records") for r in roles],
        *[F.sum(f"_{r}_n").cast("long").alias(f"{r}_size") for r in roles],
        both("fit", "val"), both("fit", "test"), both("val", "test"),
        counts("fit"), counts("val"),
    )
    problems = F.concat_ws(
        "; ",
        F.when(F.col("fit_val_record_overlap") != 0, "fitting and validation records overlap"),
        F.when(F.col("fit_test_record_overlap") != 0, "fitting and test records overlap"),
        F.when(F.col("val_test_record_overlap") != 0, "validation and test records overlap"),
    )
    return out.withColumn("audit_interpretation", F.when(problems == "", CLEAN).otherwise(problems))


def split_records(assigned: DataFrame, keys=("dataset", "seed"), record="record") -> DataFrame:
    """(keys, role, record), one row per record of a role: the record lists of the audit."""
    return assigned.select(*keys, "role", record).distinct()


def record_list_text(records: DataFrame, keys=("dataset", "seed"), record="record", limit=100_000) -> DataFrame:
    """The record lists as `;`-joined text; refuses lists too long for one value."""
    top = largest_group(records, [*keys, "role"])
    if top > limit:
        raise ValueError(f"a role holds {top} records; read split_records instead of one text value")
    names = F.sort_array(F.collect_list(F.col(record).cast("string")))
    return records.groupBy(*keys, "role").agg(F.array_join(names, ";").alias("records_list"))


def shared_records(a: DataFrame, b: DataFrame, record="record") -> DataFrame:
    return a.select(record).intersect(b.select(record))


def max_overlap(audit: DataFrame, columns) -> DataFrame:
    return audit.agg(F.max(F.greatest(*columns)).alias("max_overlap"))


def hash_rank(df: DataFrame, keys, seed, ids, name="rank"):
    """0-based rank per key in seeded hash order, without sorting a key in one task."""
    tied = df.withColumn("_h", hash32(seed, *[F.col(c) for c in ids])).withColumn(
        "_b", hash_bucket(F.col("_h")))
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = tied.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_off", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    w = Window.partitionBy(*keys, "_b").orderBy("_h", *ids)
    return (
        tied.withColumn("_r", F.row_number().over(w) - 1)
        .join(offs, [*keys, "_b"])
        .withColumn(name, (F.col("_r") + F.col("_off")).cast("long"))
        .drop("_r", "_off", "_b", "_h")
    )
