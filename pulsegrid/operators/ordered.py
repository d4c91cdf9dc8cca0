"""Ordered per-key context that survives a key holding a large share of all rows.

A window over one key runs in one task. Where every key is small that is the right plan.
Where the largest key is over ``max_rows``, its rows are cut into equal-depth slices of
the order column, each slice gets the few rows before and after it as halo rows, and the
same window then runs over (key, slice).
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.groups import MAX_GROUP_ROWS, largest_group
from pulsegrid.session import pin, small_side

SLICE = "_slice"
OWN = "_own"


def sliced(df: DataFrame, keys, order, max_rows=MAX_GROUP_ROWS):
    """Add a slice number; returns (frame, window keys, whether any key was cut).

    Rows with equal order value always share a slice, so slices follow the order.
    """
    top = largest_group(df, keys)
    if top <= max_rows:
        return df.withColumn(SLICE, F.lit(0)), list(keys), False
    n_slices = min(math.ceil(top / max_rows), 4096)
    hot = small_side(pin(df.groupBy(*keys).count().where(F.col("count") > max_rows).drop("count")))
    points = [i / n_slices for i in range(1, n_slices)]
    cuts = (
        df.join(hot, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile_approx(order, points, max(10_000, 50 * n_slices)).alias("_cuts"))
        .withColumn("_cuts", F.array_distinct("_cuts"))
    )
    # Hot keys number at most rows / max_rows. The table is counted and broadcast if small;
    # beyond that it is a shuffle join whose hot partitions the adaptive skew split divides.
    out = df.join(small_side(pin(cuts), 50_000), keys, "left").withColumn(
        SLICE,
        F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order))), F.lit(0)),
    )
    return out.drop("_cuts"), [*keys, SLICE], True


def with_halo(df: DataFrame, keys, order, tiebreak, before, after, max_rows=MAX_GROUP_ROWS):
    """Frame whose windows over the returned keys see ``before``/``after`` neighbours.

    Rows with ``_own`` false are copies and must be dropped after the window.
    """
    frame, parts, cut = sliced(df, keys, order, max_rows)
    own = frame.withColumn(OWN, F.lit(True))
    if not cut:
        return own, parts
    up = Window.partitionBy(*parts).orderBy(order, tiebreak)
    down = Window.partitionBy(*parts).orderBy(F.desc(order), F.desc(tiebreak))
    edges = (
        frame.withColumn("_first", F.row_number().over(up))
        .withColumn("_last", F.row_number().over(down))
        .where((F.col("_first") <= after) | (F.col("_last") <= before))
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    sizes = (
        frame.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_rank", F.row_number().over(along))
        .withColumn("_cum", F.sum("_n").over(along))
    )
    home = sizes.select(*parts, F.col("_rank").alias("_r0"), F.col("_cum").alias("_c0"),
                        F.col("_n").alias("_n0"))
    goal = sizes.select(*keys, F.col(SLICE).alias("_goal"), F.col("_rank").alias("_r1"),
                        F.col("_cum").alias("_c1"), F.col("_n").alias("_n1"))
    reach = max(before, after)
    moved = (
        edges.join(home, parts)
        .withColumn("_r1", F.explode(F.sequence(F.col("_r0") - reach, F.col("_r0") + reach)))
        .join(goal, [*keys, "_r1"])
        .where(
            ((F.col("_r1") > F.col("_r0"))
             & (F.col("_last") + F.col("_c1") - F.col("_n1") - F.col("_c0") <= before))
            | ((F.col("_r1") < F.col("_r0"))
               & (F.col("_first") + F.col("_c0") - F.col("_n0") - F.col("_c1") <= after))
        )
        .withColumn(SLICE, F.col("_goal"))
        .withColumn(OWN, F.lit(False))
        .select(*own.columns)
    )
    return own.unionByName(moved), parts


def row_index(df: DataFrame, keys, order, tiebreak, name="idx", max_rows=MAX_GROUP_ROWS):
    """0-based position of every row within its key."""
    frame, parts, cut = sliced(df, keys, order, max_rows)
    w = Window.partitionBy(*parts).orderBy(order, tiebreak)
    local = frame.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    if not cut:
        return local.drop(SLICE)
    along = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frame.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(along), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(offsets, parts)
        .withColumn(name, F.col(name) + F.col("_off"))
        .drop("_off", SLICE)
    )
