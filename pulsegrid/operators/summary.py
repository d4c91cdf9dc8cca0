"""Group summaries, roll-ups, outlier removal, run bookkeeping and comparison joins."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.groups import MAX_GROUP_ROWS
from pulsegrid.operators.quantiles import grouped_quantiles

ALL_DATASETS = "Overall"
ALL_METHODS = "All representatives"


def skip_nan(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c), c)


def mean_std(metrics, std=True):
    """avg and population std per metric, NaN left out."""
    out = []
    for m in metrics:
        value = f"nullif(cast(`{m}` as double), double('NaN'))"
        out.append(F.expr(f"avg({value}) as `{m}_mean`"))
        if std:
            out.append(F.expr(f"stddev_pop({value}) as `{m}_std`"))
    return out


def distinct_count(col) -> Column:
    """Distinct values of a parameter column (seeds); the set is small, so no second shuffle."""
    return F.size(F.collect_set(col)).cast("long")


def joined_values(col, sep=" ") -> Column:
    """Sorted distinct non-null values as text; the values are parameters, so the set is small."""
    return F.array_join(F.transform(F.sort_array(F.collect_set(col)), lambda v: v.cast("string")), sep)


def group_summary(df: DataFrame, keys, metrics, seed="seed", texts=(), firsts=(), order=None) -> DataFrame:
    """Mean and population std per metric, seed count and list, value lists, first values.

    NaN is skipped, null keys form a group of their own, no seed is counted twice.
    """
    aggs = [distinct_count(seed).alias("n_seeds"), joined_values(seed).alias("seeds")]
    aggs += [joined_values(c).alias(f"{c}_values") for c in texts]
    aggs += [F.min_by(c, order or seed).alias(c) for c in firsts]
    return df.groupBy(*keys).agg(*aggs, *mean_std(metrics))


def calibration_rollup(df: DataFrame, metrics) -> DataFrame:
    """(dataset, method), (method) and grand total in one grouping-sets pass.

    ``n_seeds`` counts distinct seeds at the leaf level and rows at the upper levels.
    """
    ds, me = F.col("dataset"), F.col("method")
    out = df.groupingSets([[ds, me], [me], []], ds, me).agg(
        F.grouping_id().alias("_g"),
        F.collect_set("seed").alias("_seeds"), F.count(F.lit(1)).alias("_rows"),
        *mean_std(metrics),
    )
    leaf = F.col("_g") == 0
    cols = [c for m in metrics for c in (f"{m}_mean", f"{m}_std")]
    return out.select(
        F.when(leaf, F.col("dataset")).otherwise(ALL_DATASETS).alias("dataset"),
        F.when(F.col("_g") == 3, F.lit(ALL_METHODS)).otherwise(F.col("method")).alias("method"),
        F.when(leaf, F.size("_seeds").cast("long")).otherwise(F.col("_rows")).alias("n_seeds"),
        F.when(
            leaf, F.array_join(F.transform(F.sort_array("_seeds"), lambda v: v.cast("string")), " ")
        ).otherwise("all").alias("seeds"),
        *cols,
    )


def cost_rollup(df: DataFrame) -> DataFrame:
    """(dataset, method, profile) and (profile) levels; std only for the macro score."""
    ds, me, pr = F.col("dataset"), F.col("method"), F.col("class_cost_profile")
    out = df.groupingSets([[ds, me, pr], [pr]], ds, me, pr).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_runs"),
        *mean_std(["macro_f1_4"]),
        *mean_std(["delta_macro_f1_4", "accuracy", "F1_S", "F1_F"], std=False),
    )
    leaf = F.col("_g") == 0
    return out.select(
        F.when(leaf, F.col("dataset")).otherwise(ALL_DATASETS).alias("dataset"),
        F.when(leaf, F.col("method")).otherwise(ALL_METHODS).alias("method"),
        "class_cost_profile", "n_runs", "macro_f1_4_mean", "macro_f1_4_std",
        "delta_macro_f1_4_mean", "accuracy_mean", "F1_S_mean", "F1_F_mean",
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Join on keys where null meets null; one copy of the keys stays."""
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def outlier_flags(df: DataFrame, keys, metric="macro_f1_4", seed="seed", min_keep=3,
                  max_rows=MAX_GROUP_ROWS) -> DataFrame:
    """Add quartiles, fences, ``kept`` and ``reason`` by the 1.5 x IQR rule per group.

    If fewer than ``min_keep`` rows survive, the rows nearest the median stay instead
    (smaller seed first). Only groups that small need a row number. A missing metric is outside
    no fence, so such rows are kept, and a group without any metric has no fences.
    """
    known = df.withColumn(metric, F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric)))
    q = grouped_quantiles(known, keys, metric, [0.25, 0.5, 0.75], max_rows=max_rows)
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    fences = q.select(
        *keys, q1.alias("q1"), F.get("q", F.lit(1)).alias("median"), q3.alias("q3"), (q3 - q1).alias("iqr"),
        (q1 - 1.5 * (q3 - q1)).alias("lower"), (q3 + 1.5 * (q3 - q1)).alias("upper"))
    rows = _null_safe_join(df, fences, keys, "left")
    beyond = (F.col(metric) < F.col("lower")) | (F.col(metric) > F.col("upper"))
    rows = rows.withColumn("_out", F.coalesce(beyond & ~F.isnan(F.col(metric).cast("double")), F.lit(False)))
    stats = rows.groupBy(*keys).agg(
        distinct_count(seed).alias("n_seeds_before"),
        F.sum((~F.col("_out")).cast("int")).alias("_kept"), F.count(F.lit(1)).alias("_n"),
    )
    rows = _null_safe_join(rows, stats, keys)
    guard = F.col("_kept") < min_keep
    w = Window.partitionBy(*keys).orderBy(F.abs(F.col(metric) - F.col("median")).asc_nulls_last(), seed)
    plain = rows.where(~guard).withColumn("kept", ~F.col("_out"))
    # A guarded group kept fewer than min_keep of its rows, so at most a handful are numbered
    # unless its fences exclude nearly everything, which the quartiles rule out.
    guarded = rows.where(guard).withColumn("kept", F.row_number().over(w) <= min_keep)
    both = plain.unionByName(guarded)
    reason = F.concat(
        F.lit(f"{metric}_iqr_outlier"),
        F.when(guard, ";minimum_retained_guard").otherwise(""),
        F.when(~F.col("_out"), ";removed_by_distance_to_median").otherwise(""),
    )
    kept_rows = F.when(guard, F.least(F.lit(min_keep), F.col("_n"))).otherwise(F.col("_kept"))
    return both.select(
        *df.columns, "q1", "median", "q3", "iqr", "lower", "upper", "n_seeds_before",
        kept_rows.cast("long").alias("n_seeds_after"), "kept",
        F.when(~F.col("kept"), reason).alias("reason"),
    )


def outlier_summary(flags: DataFrame, keys, metrics, seed="seed") -> DataFrame:
    """Summary of kept rows with retained and removed seed lists, in one aggregate."""
    kept = F.col("kept")
    aggs = []
    for m in metrics:
        aggs += [F.avg(F.when(kept, skip_nan(m))).alias(f"{m}_mean"),
                 F.stddev_pop(F.when(kept, skip_nan(m))).alias(f"{m}_std")]
    return flags.groupBy(*keys).agg(
        F.max("n_seeds_before").alias("n_seeds_before"),
        distinct_count(F.when(kept, F.col(seed))).alias("n_seeds_after"),
        joined_values(F.when(~kept, F.col(seed))).alias("removed_seeds"),
        joined_values(F.when(kept, F.col(seed))).alias("seeds_after"),
        *aggs,
    )


def robustness_join(full: DataFrame, filtered: DataFrame, keys, metrics) -> DataFrame:
    """Left join of full and outlier-free summaries with changes in percentage points."""
    right = filtered.select(
        *keys, "n_seeds_before", "n_seeds_after", "removed_seeds",
        *[F.col(f"{m}_mean").alias(f"no_outlier_{m}") for m in metrics],
    )
    left = full.select(*keys, *[F.col(f"{m}_mean").alias(f"full_{m}") for m in metrics])
    out = left.join(right, keys, "left")
    return out.select(
        "*",
        *[((F.col(f"no_outlier_{m}") - F.col(f"full_{m}")) * 100).alias(f"change_{m}") for m in metrics],
        (F.col("n_seeds_before") - F.col("n_seeds_after")).alias("removed_count"),
    )


def compare_summaries(before: DataFrame, after: DataFrame, keys, metric, by) -> DataFrame:
    """Inner join of two summaries; mean change per ``by`` value and overall (null key)."""
    pairs = before.select(*keys, F.col(metric).alias("_a")).join(
        after.select(*keys, F.col(metric).alias("_b")), keys)
    return pairs.rollup(by).agg(
        (F.avg("_a") * 100).alias("before"), (F.avg("_b") * 100).alias("after"),
        ((F.avg("_b") - F.avg("_a")) * 100).alias("change"),
    )


def pending_runs(grid: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Run-grid rows whose key is not finished."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def complete_groups(done: DataFrame, groups, seeds, seed="seed") -> DataFrame:
    """Per group: how many required seeds are missing and whether it is complete."""
    need = list(seeds)
    have = done.groupBy(*groups).agg(
        distinct_count(F.when(F.col(seed).isin(need), F.col(seed))).alias("_have"))
    return have.select(*groups, (F.lit(len(need)) - F.col("_have")).alias("missing"),
                       (F.col("_have") == len(need)).alias("complete"))


def best_summary(summary: DataFrame, keys, full_seeds: int, scenario="scenario",
                 focus_metric="macro_f1_3_nsv_mean", metric="macro_f1_4_mean") -> DataFrame:
    """Best configuration per key among full-seed rows, else among rows with most seeds."""
    size = Window.partitionBy(*keys)
    allowed = summary.withColumn("_most", F.max("n_seeds").over(size)).withColumn(
        "_full", F.max((F.col("n_seeds") == full_seeds).cast("int")).over(size)
    ).where(
        F.when(F.col("_full") == 1, F.col("n_seeds") == full_seeds).otherwise(
            F.col("n_seeds") == F.col("_most"))
    ).drop("_most", "_full")
    focus = F.col(scenario).contains("s_focus")
    named = allowed.withColumn(
        "selection_metric", F.when(focus, F.lit(focus_metric)).otherwise(F.lit(metric)))
    score = F.when(focus, F.col(focus_metric)).otherwise(F.col(metric))
    w = Window.partitionBy(*keys).orderBy(score.desc(), F.desc("accuracy_mean"), "config")
    return named.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def legacy_lookup(rows: DataFrame, tables: dict, rules) -> DataFrame:
    """Left join to the first hit of a lookup table chosen by rule.

    ``rules`` is a list of (condition, table name, key column expression, protocol text).
    The tables are unioned with their name, so it is one join whatever the number of rules.
    """
    parts = [t.select(F.lit(n).alias("_table"), F.col("lookup_key").alias("_key"), "ord",
                      "accuracy_mean", "macro_f1_4_mean") for n, t in tables.items()]
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    first = all_rows.groupBy("_table", "_key").agg(
        F.min_by(F.struct("accuracy_mean", "macro_f1_4_mean"), "ord").alias("_hit"))
    table, key, proto = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("")
    for cond, name, expr, text in reversed(rules):
        table = F.when(cond, F.lit(name)).otherwise(table)
        key = F.when(cond, expr).otherwise(key)
        proto = F.when(cond, F.lit(text)).otherwise(proto)
    tagged = rows.withColumn("_table", table).withColumn("_key", key).withColumn("_proto", proto)
    out = tagged.join(first, ["_table", "_key"], "left")
    return out.select(
        *rows.columns,
        F.col("_hit.accuracy_mean").alias("legacy_raw_accuracy_mean"),
        F.col("_hit.macro_f1_4_mean").alias("legacy_raw_macro_f1_4_mean"),
        F.when(F.col("_hit").isNotNull(), F.col("_proto")).otherwise("").alias("legacy_raw_protocol"),
    )
