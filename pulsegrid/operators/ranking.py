"""Seeded selection, top-k, best row, keep-last and fill rules."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.hashing import hash32
from pulsegrid.session import pin, small_side

HASH_BITS = 32
BUCKET_BITS = 16


def hash_bucket(h: Column, bits=BUCKET_BITS) -> Column:
    """Leading ``bits`` of a 32-bit hash."""
    return F.shiftright(h, HASH_BITS - bits).cast("int")


def take_lowest(df: DataFrame, keys, quotas: DataFrame, seed, ids, flag="selected", bits=BUCKET_BITS) -> DataFrame:
    """Flag, per key, the ``quota`` rows with the smallest (hash, id).

    A row number over the whole key would put the key in one task. Instead the hash is
    cut into 2**bits buckets, bucket counts tell in which bucket the quota ends, and only
    rows of that one bucket are numbered. All other rows are decided by a comparison and
    never shuffle. ``quotas`` has one row per key; a key without one selects nothing, and a
    null key is a key like any other, so every row comes back flagged.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    held = [f"_q{i}" for i in range(len(keys))]

    def meet(left, right, how):
        """Join on the keys where null meets null; ``right`` is small and its size is checked."""
        named = right.select(*[F.col(k).alias(h) for k, h in zip(keys, held)], *[c for c in right.columns if c not in keys])
        return left.join(small_side(named), [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, held)], how).drop(*held)

    tied = df.withColumn("_h", hash32(seed, *[F.col(c) for c in ids]))
    tied = tied.withColumn("_b", hash_bucket(F.col("_h"), bits))
    along = Window.partitionBy(*keys).orderBy("_b")
    counts = tied.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    edge = (
        meet(counts.withColumn("_cum", F.sum("_n").over(along)), quotas.select(*keys, "quota"), "inner")
        .groupBy(*keys, "quota")
        .agg(
            F.min(F.when(F.col("_cum") >= F.col("quota"), F.col("_b"))).alias("_edge"),
            F.max(F.when(F.col("_cum") < F.col("quota"), F.col("_cum"))).alias("_before"),
        )
        .select(
            *keys,
            F.when(F.col("quota") <= 0, F.lit(-1)).otherwise(
                F.coalesce("_edge", F.lit(1 << bits))
            ).alias("_edge"),
            (F.col("quota") - F.coalesce("_before", F.lit(0))).alias("_need"),
        )
    )
    decided = meet(tied, pin(edge), "left").withColumn("_edge", F.coalesce("_edge", F.lit(-1)))
    w = Window.partitionBy(*keys).orderBy("_h", *ids)
    clear = decided.where(F.col("_b") != F.col("_edge")).withColumn(flag, F.col("_b") < F.col("_edge"))
    at_edge = decided.where(F.col("_b") == F.col("_edge")).withColumn(
        flag, F.row_number().over(w) <= F.col("_need")
    )
    return clear.unionByName(at_edge).drop("_h", "_b", "_edge", "_need")


def top_k(df: DataFrame, keys, order, k: int, rank="rank") -> DataFrame:
    """First ``k`` rows per key in ``order``; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(df: DataFrame, keys, order, rank="rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w))


def best_row(df: DataFrame, keys, scores, tie: str, columns) -> DataFrame:
    """Row with the largest score tuple per key, lowest ``tie`` first.

    One hash aggregate with map-side combine, so a key of any size is fine.
    """
    body = F.struct(*columns)
    key = F.struct(*[s if isinstance(s, Column) else F.col(s) for s in scores], -F.col(tie))
    return df.groupBy(*keys).agg(F.max_by(body, key).alias("_best")).select(*keys, "_best.*")


def keep_last(df: DataFrame, keys, order: str) -> DataFrame:
    """Last row per key by ``order``, as an aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
        .select(*keys, "_last.*")
        .select(*df.columns)
    )


def first_by_priority(df: DataFrame, keys, prio: str) -> DataFrame:
    """Row with the smallest priority number per key (newest location wins)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(prio)).alias("_first"))
        .select(*keys, "_first.*")
        .select(*df.columns)
    )
