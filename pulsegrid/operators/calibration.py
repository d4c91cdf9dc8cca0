"""Probability-quality measures and reliability bins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions import probability as P

BINS = 15


def bin_of(conf: Column, bins: int = BINS) -> Column:
    """1-based equal-width bin on edges k/bins; the last bin is closed on the right."""
    width = F.lit(1.0 / bins)
    guess = F.floor(conf * bins)
    low = F.when(conf < guess * width, guess - 1).otherwise(guess)
    exact = F.when(conf >= (low + 1) * width, low + 1).otherwise(low)
    return (F.least(F.greatest(exact, F.lit(0)), F.lit(bins - 1)) + 1).cast("int")


def binned_scores(df: DataFrame, keys, y="y", p="p", bins: int = BINS) -> DataFrame:
    """Per (key, bin): row count and sums of hits, confidence, Brier and log loss.

    Everything the calibration measures need in one map-side combined pass.
    """
    q = df.select(*keys, F.col(y).alias("_y"), P.normalise(F.col(p)).alias("_q"))
    conf = F.array_max("_q")
    brier = F.aggregate(
        F.transform("_q", lambda x, i: F.pow(x - F.when(i == F.col("_y"), 1.0).otherwise(0.0), 2.0)),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    loss = -F.log(F.least(F.greatest(F.get("_q", F.col("_y")), F.lit(1e-12)), F.lit(1.0)))
    scored = q.select(
        *keys, conf.alias("_conf"), (A.argmax(F.col("_q")) == F.col("_y")).cast("double").alias("_hit"),
        brier.alias("_brier"), loss.alias("_loss"),
    )
    return scored.groupBy(*keys, bin_of(F.col("_conf"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_hit").alias("hits"), F.sum("_conf").alias("conf"),
        F.sum("_brier").alias("brier"), F.sum("_loss").alias("loss"),
    )


def quality(binned: DataFrame, keys) -> DataFrame:
    """Brier, expected calibration error, log loss and accuracy per key."""
    n = F.sum("n")
    return binned.groupBy(*keys).agg(
        n.cast("long").alias("n"),
        (F.sum("brier") / n).alias("brier"),
        (F.sum(F.abs(F.col("hits") - F.col("conf"))) / n).alias("ece"),
        (F.sum("loss") / n).alias("nll"),
        (F.sum("hits") / n).alias("accuracy"),
    )


def reliability_bins(binned: DataFrame, keys, bins: int = BINS) -> DataFrame:
    """All bins per key; an empty bin has n = 0 and NaN measures."""
    packed = binned.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "hits", "conf")))).alias("_m")
    )
    rows = packed.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "_m")
    rows = rows.withColumn("_c", F.element_at("_m", F.col("bin")))
    nan = F.lit(float("nan"))
    acc = F.coalesce(F.col("_c.hits") / F.col("_c.n"), nan)
    conf = F.coalesce(F.col("_c.conf") / F.col("_c.n"), nan)
    return rows.select(
        *keys, "bin",
        ((F.col("bin") - 1) * F.lit(1.0 / bins)).alias("lo"),
        F.when(F.col("bin") == bins, F.lit(1.0)).otherwise(F.col("bin") * F.lit(1.0 / bins)).alias("hi"),
        F.coalesce("_c.n", F.lit(0)).alias("n"),
        acc.alias("accuracy"), conf.alias("confidence"), F.abs(acc - conf).alias("abs_gap"),
    )


def paired_quality(binned: DataFrame, keys, raw="raw", adapted="adapted") -> DataFrame:
    """raw_, adapted_ and delta_ columns of every measure; ``binned`` also has ``source``."""
    q = quality(binned, [*keys, "source"])
    names = ["brier", "ece", "nll", "accuracy"]
    wide = q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("source") == src, F.col(m))).alias(f"{tag}_{m}")
        for tag, src in (("raw", raw), ("adapted", adapted)) for m in names
    ])
    return wide.select(
        *wide.columns, *[(F.col(f"adapted_{m}") - F.col(f"raw_{m}")).alias(f"delta_{m}") for m in names]
    )


def pooled_bins(bins: DataFrame, keys, min_n: int = 1) -> DataFrame:
    """Count-weighted mean accuracy, confidence and gap over runs, bins below ``min_n`` left out."""
    ok = bins.where(
        (F.col("n") >= min_n) & ~F.isnan("accuracy") & F.col("accuracy").isNotNull()
    )
    w = F.sum("n")
    return ok.groupBy(*keys, "bin").agg(
        w.cast("long").alias("n"),
        (F.sum(F.col("confidence") * F.col("n")) / w).alias("confidence"),
        (F.sum(F.col("accuracy") * F.col("n")) / w).alias("accuracy"),
        (F.sum(F.col("abs_gap") * F.col("n")) / w).alias("abs_gap"),
    )


def calibration_gap(pooled: DataFrame, keys) -> DataFrame:
    """Count-weighted mean |accuracy - confidence| of pooled bins."""
    return pooled.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")) / F.sum("n")).alias("gap"),
        F.count(F.lit(1)).alias("bins"),
    )
