"""Exact linear-interpolated quantiles per group, also for groups too big for one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.groups import MAX_GROUP_ROWS, largest_group
from pulsegrid.session import pin, small_side

ACCURACY = 100_000


def grouped_quantiles(df: DataFrame, keys, value, probs, name="q", max_rows=MAX_GROUP_ROWS):
    """One row per group: row count ``n`` of non-null values and array ``name``.

    Small groups use the built-in exact aggregate. For groups over ``max_rows`` a bounded
    sketch brackets each wanted rank, values in the brackets are counted, and the ranks
    are read from those counts; the sketch error is far inside the bracket.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if largest_group(rows, keys) <= max_rows:
        return _exact(rows, keys, probs, name)
    if not keys:
        return _bracketed(rows, keys, probs, name, max_rows)
    hot = small_side(pin(rows.groupBy(*keys).count().where(F.col("count") > max_rows).drop("count")))
    cold = rows.join(hot, keys, "left_anti")
    return _exact(cold, keys, probs, name).unionByName(
        _bracketed(rows.join(hot, keys, "left_semi"), keys, probs, name, max_rows))


def _exact(rows, keys, probs, name):
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias(name),
    )


def _bracketed(rows, keys, probs, name, max_rows):
    # At least three ranks on either side, as every group here has over max_rows rows.
    margin = max(5.0 / ACCURACY, 3.0 / max_rows)
    marks = sorted({max(p - margin, 0.0) for p in probs} | {min(p + margin, 1.0) for p in probs})
    spots = {m: i for i, m in enumerate(marks)}
    brackets = pin(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", marks, ACCURACY).alias("_marks"),
    ))
    spans = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            (F.lit(float(p)) * (F.col("n") - 1)).alias("pos"),
            (F.col("_min") if p - margin <= 0 else F.get("_marks", F.lit(spots[p - margin]))).alias("lo"),
            (F.col("_max") if p + margin >= 1 else F.get("_marks", F.lit(spots[p + margin]))).alias("hi"),
        )
        for i, p in enumerate(probs)
    ])
    side = brackets.select(*keys, "n", spans.alias("_spans"))
    located = rows.join(small_side(side), keys) if keys else rows.crossJoin(F.broadcast(side))
    part = (
        located.select(*keys, "_v", F.explode("_spans").alias("s"))
        .where(F.col("_v") <= F.col("s.hi"))
        .groupBy(*keys, F.col("s.i").alias("i"), F.col("s.pos").alias("pos"),
                 F.when(F.col("_v") >= F.col("s.lo"), F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    w = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first())
    ranked = part.withColumn("cum", F.sum("c").over(w)).where(F.col("_v").isNotNull())
    low, high = F.floor("pos"), F.ceil("pos")
    picked = ranked.groupBy(*keys, "i", "pos").agg(
        F.min(F.when(F.col("cum") > low, F.col("_v"))).alias("a"),
        F.min(F.when(F.col("cum") > high, F.col("_v"))).alias("b"),
        (F.min(F.col("cum") - F.col("c"))).alias("below"),
    )
    sound = picked.withColumn(
        "v",
        F.when(
            F.col("a").isNull() | F.col("b").isNull() | (F.col("below") > low),
            F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"),
        ).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - low)),
    )
    wide = sound.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_q{i}") for i in range(len(probs))]
    )
    sizes = brackets.select(*keys, "n")
    out = wide.join(sizes, keys) if keys else wide.crossJoin(F.broadcast(sizes))
    return out.select(*keys, "n", F.array(*[F.col(f"_q{i}") for i in range(len(probs))]).alias(name))


