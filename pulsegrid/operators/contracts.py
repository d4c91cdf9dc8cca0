"""Cardinality contracts as rows instead of exceptions."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _row(df, name, expected, actual, how="eq"):
    ok = F.col("actual") == F.col("expected") if how == "eq" else F.col("actual") >= F.col("expected")
    return df.select(
        F.lit(name).alias("check"), expected.cast("long").alias("expected"), actual.cast("long").alias("actual")
    ).withColumn("ok", ok)


def detail_contracts(detail: DataFrame, groups, rows, n_groups, seeds, seed="seed") -> DataFrame:
    """Row count, group count and groups with a wrong number of seeds."""
    per = detail.groupBy(*groups).agg(F.countDistinct(seed).alias("s"), F.count(F.lit(1)).alias("n"))
    stats = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"),
                    F.sum((F.col("s") != seeds).cast("int")).alias("bad"))
    checks = [("rows", rows, "n"), ("groups", n_groups, "g"), ("groups_with_wrong_seed_count", 0, "bad")]
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), F.lit(e).cast("long").alias("expected"),
                 F.coalesce(F.col(c), F.lit(0)).cast("long").alias("actual"))
        for n, e, c in checks])).alias("c")).select("c.*").withColumn("ok", F.col("expected") == F.col("actual"))


def outlier_contracts(detail: DataFrame, flags: DataFrame, groups, min_keep=3, seed="seed") -> DataFrame:
    """Kept + removed = input, every group keeps enough seeds, no key on both sides."""
    total = detail.agg(F.count(F.lit(1)).alias("expected"))
    sides = flags.agg(F.count(F.lit(1)).alias("actual"))
    conserve = _row(total.crossJoin(sides), "kept_plus_removed", F.col("expected"), F.col("actual"))
    kept = flags.where("kept").groupBy(*groups).agg(F.countDistinct(seed).alias("s"))
    retain = _row(kept.agg(F.min("s").alias("s")), "min_retained_seeds", F.lit(min_keep), F.col("s"), "ge")
    both = flags.groupBy(*groups, seed).agg(
        F.max(F.col("kept").cast("int")).alias("a"), F.max((~F.col("kept")).cast("int")).alias("b"))
    clash = _row(both.agg(F.sum(F.col("a") * F.col("b")).alias("x")), "keys_on_both_sides", F.lit(0), F.col("x"))
    return reduce(lambda p, q: p.unionByName(q), [conserve, retain, clash])
