"""Interval features of an annotation stream (lag, lead, local and record medians)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.groups import MAX_GROUP_ROWS
from pulsegrid.operators.ordered import OWN, with_halo
from pulsegrid.operators.quantiles import grouped_quantiles
from pulsegrid.session import pin

EPS = 1e-8
REACH = 5

FEATURES = [
    "pre", "post", "pre_over_post", "post_over_pre", "abs_diff",
    "pre_over_local", "post_over_local", "pre_over_global", "post_over_global",
    "pre_dev_local", "post_dev_local", "local_over_global",
]


def interval_context(ann: DataFrame, fs, key="record", sample="sample", idx="ann_idx",
                     max_rows=MAX_GROUP_ROWS):
    """Add pre, post, local and record-level interval, in seconds, to every annotation.

    Every annotation counts here, so call it before any symbol is dropped.
    """
    fs = F.col(fs) if isinstance(fs, str) else F.lit(float(fs))
    frame, parts = with_halo(ann, [key], sample, idx, REACH, REACH, max_rows)
    w = Window.partitionBy(*parts).orderBy(sample, idx)
    step = F.col(sample) - F.lag(sample).over(w)
    timed = (
        frame.withColumn("_d", step / fs)
        .withColumn("_next", F.lead("_d").over(w))
        .withColumn("_local", F.percentile("_d", F.lit(0.5)).over(w.rowsBetween(1 - REACH, REACH)))
    )
    own = timed.where(OWN)
    if parts == [key]:
        whole = Window.partitionBy(key)
        own = own.withColumn("_global", F.median("_d").over(whole))
    else:
        steps = pin(own.select(key, "_d"))  # two narrow columns; the quantile passes read them again
        med = grouped_quantiles(steps, [key], "_d", [0.5], max_rows=max_rows)
        own = own.join(med.select(key, F.get("q", F.lit(0)).alias("_global")), [key], "left")
    glob = F.coalesce("_global", F.lit(1.0))
    return own.select(
        *ann.columns,
        F.coalesce("_d", glob).alias("pre"),
        F.coalesce("_next", glob).alias("post"),
        F.coalesce("_local", glob).alias("local"),
        glob.alias("global"),
    )


def interval_features(ctx: DataFrame) -> DataFrame:
    """The 12 interval features, named, from :func:`interval_context`."""
    pre, post, loc, glo = (F.col(c) for c in ("pre", "post", "local", "global"))

    def per(a, b):
        return a / (b + F.lit(EPS))

    exprs = [
        pre, post, per(pre, post), per(post, pre), F.abs(post - pre),
        per(pre, loc), per(post, loc), per(pre, glo), per(post, glo),
        per(pre - loc, loc), per(post - loc, loc), per(loc, glo),
    ]
    keep = [c for c in ctx.columns if c not in ("pre", "post", "local", "global")]
    return ctx.select(*keep, *[e.alias(n) for e, n in zip(exprs, FEATURES)])


def interval_array(df: DataFrame, name="rr") -> DataFrame:
    return df.withColumn(name, F.array(*FEATURES)).drop(*FEATURES)
