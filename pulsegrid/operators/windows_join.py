"""Signal windows around annotations: interval join on chunk keys, record z-score."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import arrays as A
from pulsegrid.functions.waveform import resample_batch
from pulsegrid.schema import BASE_RATE, POST_SAMPLES, PRE_SAMPLES
from pulsegrid.session import pin, small_side

PRE_SECONDS = PRE_SAMPLES / BASE_RATE
POST_SECONDS = POST_SAMPLES / BASE_RATE


def window_size(fs):
    """Samples before and after an event at rate ``fs``, rounded half to even."""
    return (F.bround(F.lit(PRE_SECONDS) * fs).cast("long"), F.bround(F.lit(POST_SECONDS) * fs).cast("long"))


def record_lengths(signals: DataFrame) -> DataFrame:
    return signals.groupBy("record").agg(
        F.max(F.col("start_idx") + F.size("values")).alias("length"), F.max("fs").alias("fs"))


def window_bounds(ann: DataFrame, lengths: DataFrame, pre=None, post=None) -> DataFrame:
    """Add ``lo``, ``hi`` and ``inside`` (the window lies within the recording)."""
    joined = ann.join(lengths, "record")
    rate_pre, rate_post = window_size(F.col("fs"))
    lo = F.col("sample") - (F.lit(pre) if pre is not None else rate_pre)
    hi = F.col("sample") + (F.lit(post) if post is not None else rate_post)
    return joined.withColumn("lo", lo).withColumn("hi", hi).withColumn(
        "inside", (F.col("lo") >= 0) & (F.col("hi") <= F.col("length")) & (F.col("hi") > F.col("lo"))
    ).drop("length")


def interval_join(windows: DataFrame, signals: DataFrame, chunk_len: int, key="beat_id") -> DataFrame:
    """(key, lead, samples): signal values lo <= index < hi of the same record, in order.

    Each window names the one to three chunks it touches and meets them by equality on
    (record, chunk): no nested loop, no per-sample rows, and a long recording is spread
    over as many join keys as it has chunks.
    """
    first = F.floor(F.col("lo") / chunk_len)
    last = F.floor((F.col("hi") - 1) / chunk_len)
    touched = windows.where("hi > lo").select(
        F.col(key), "record", "lo", "hi", F.explode(F.sequence(first, last)).alias("chunk"))
    sig = signals.select("record", "chunk", "lead", "start_idx", "values")
    met = touched.join(sig, ["record", "chunk"])
    a = F.greatest(F.col("lo"), F.col("start_idx"))
    b = F.least(F.col("hi"), F.col("start_idx") + F.size("values"))
    part = F.slice("values", (a - F.col("start_idx") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    pieces = met.select(key, "lead", "chunk", part.alias("part"))
    return pieces.groupBy(key, "lead").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda s: s["part"]))
        .alias("samples"))


def pair_leads(cut: DataFrame, key="beat_id") -> DataFrame:
    """Two window columns; a recording with one lead uses it twice."""
    wide = cut.groupBy(key).agg(
        F.max(F.when(F.col("lead") == 0, F.col("samples"))).alias("b0"),
        F.max(F.when(F.col("lead") == 1, F.col("samples"))).alias("_b1"))
    return wide.select(key, "b0", F.coalesce("_b1", "b0").alias("b1"))


def both_leads(signals: DataFrame) -> DataFrame:
    """One row per (record, chunk): ``_leads``, its (lead, start_idx, values)."""
    return signals.groupBy("record", "chunk").agg(F.collect_list(F.struct("lead", "start_idx", "values")).alias("_leads"))


def _cut(lead):
    """Samples lo <= index < hi of a lead in ``_leads``; null without that lead."""
    def part(e):
        a, b = F.greatest(F.col("lo"), e["start_idx"]), F.least(F.col("hi"), e["start_idx"] + F.size(e["values"]))
        return F.slice(e["values"], (a - e["start_idx"] + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    mine = F.filter("_leads", lambda e: e["lead"] == lead)
    return F.when(F.size(mine) > 0, F.flatten(F.sort_array(F.transform(mine, part))))


def beat_windows(ann, signals, chunk_len, pre=None, post=None, points=None, key="beat_id"):
    """Annotations inside their recording with windows ``b0``/``b1``, resampled to ``points``.

    A window within one chunk is cut where the annotation meets both leads of that chunk, and is not moved again. Only windows across chunks
    are put together by ``key``, and those of a key that comes more than once, whose pieces are joined as one.
    """
    bounds = window_bounds(ann, record_lengths(signals), pre, post).where("inside")
    leads = both_leads(signals)
    columns = [key, *(c for c in bounds.columns if c != key), "b0", "b1"]
    repeated = pin(ann.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key, F.lit(True).alias("_repeated")))
    first = F.floor(F.col("lo") / chunk_len)
    marked = bounds.where(F.col(key).isNotNull()).join(small_side(repeated), key, "left").withColumn(
        "_alone", F.col("_repeated").isNull() & (first == F.floor((F.col("hi") - 1) / chunk_len)))
    alone = marked.where("_alone").withColumn("chunk", first).join(leads, ["record", "chunk"])
    # a generator, so that the chunks end here: Spark would pull the cuts up into the Python resampling and queue whole chunks there
    alone = alone.select(*columns[:-2], F.inline(F.array(F.struct(_cut(0).alias("b0"), F.coalesce(_cut(1), _cut(0)).alias("b1")))))
    rest = marked.where("not _alone").select(*bounds.columns)
    parts = interval_join(rest, leads.select("record", "chunk", F.inline("_leads")), chunk_len, key)
    out = alone.unionByName(rest.join(pair_leads(parts, key), key).select(*columns))
    if points:  # last, so that the windows move at their own rate
        out = out.withColumns({b: resample_batch(points)(b) for b in ("b0", "b1")})
    return out


def record_zscore(signals: DataFrame, eps=1e-8) -> DataFrame:
    """Per record and lead (x - mean) / (population std + eps) over all chunks.

    Sums combine map-side; the statistics table joins back on (record, lead), where the
    adaptive skew split takes care of a recording that holds much of the data.
    """
    v = F.col("values").cast("array<double>")
    sums = signals.groupBy("record", "lead").agg(
        F.sum(A.total(v)).alias("_s"), F.sum(A.dot(v, v)).alias("_q"), F.sum(F.size("values")).alias("_n"))
    mean = F.col("_s") / F.col("_n")
    stats = sums.select(
        "record", "lead", mean.alias("_m"),
        F.sqrt(F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))).alias("_sd"))
    out = signals.join(stats, ["record", "lead"])
    z = F.transform(v, lambda x: (x - F.col("_m")) / (F.col("_sd") + F.lit(eps)))
    return out.withColumn("values", z).select(*signals.columns)
