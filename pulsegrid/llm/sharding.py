"""Sampled splitters: range-partition records into shards of near equal size.

A size-weighted sample of keys gives quantile boundaries; every record goes to the range of
its key; ranges that turn out overfull are subdivided with splitters sampled inside them.
Exact positions follow from the totals of the ranges plus a running sum inside each range, so
the sample decides only how evenly the work is spread and never the result. The order is
(group key, id): equal texts lie side by side and stay in one shard, except for a group larger
than ``1 / (n_shards * GROUP_PARTS)`` of all bytes, which is cut where the boundary falls.

Defined results: a null text counts as the empty text (size 1). Null ids sort first. Repeated
rows each get a slot of their own. An empty table gives an empty result. Shards may be empty
when there are fewer records than shards. Extra columns are ignored.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import pin

#: A group of equal keys is kept whole up to this part of a shard.
GROUP_PARTS = 20
#: Wanted rows of a range, sampled rows for each range, and the overfull factor.
RANGE_ROWS, SAMPLE_PER_RANGE, OVERFULL = 50_000, 20, 2.0
#: About as many ranges at most, so that neither splitters nor the sample grow with the table; the sort of a range spills.
MAX_RANGES = 2_048


def _range_of(splitters) -> F.Column:
    """Binary search of (k, doc_id) in the sorted splitters: how many are at or below it."""
    if not splitters:
        return F.lit(0)
    rows = ", ".join(f"named_struct('k', '{k}', 'd', {'cast(null as bigint)' if d is None else f'{d}L'})"
                     for k, d in splitters)
    steps = max(1, math.ceil(math.log2(len(splitters) + 1)))
    mid = "((a.lo + a.hi) div 2)"
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0L, 'hi', {len(splitters)}L), (a, s) -> "
        f"if(a.lo >= a.hi, a, if(element_at(_split, cast({mid} + 1 as int)) <= named_struct('k', k, 'd', doc_id), "
        f"named_struct('lo', {mid} + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', {mid}))), a -> cast(a.lo as int))"
        .replace("_split", f"array({rows})"))


def _sample(rows: DataFrame, share: str, wanted: int):
    """Keys drawn with probability proportional to ``share``; at most ``4 * wanted`` reach the driver."""
    draw = "(xxhash64(k, doc_id) & 1048575) / 1048576.0"
    picked = rows.where(F.expr(f"{draw} < {wanted} * ({share})")).select("k", "doc_id").limit(4 * wanted)
    return sorted({(r[0], r[1]) for r in picked.collect()}, key=lambda x: (x[0], x[1] is not None, x[1] or 0))


def _splitters(rows: DataFrame, n_ranges: int, total: int):
    drawn = _sample(rows, f"size / {float(total)}D", SAMPLE_PER_RANGE * n_ranges)
    if len(drawn) <= n_ranges:
        return drawn
    return [drawn[i * len(drawn) // n_ranges] for i in range(1, n_ranges)]


def _ranges(rows: DataFrame, n: int, total: int, range_rows: int):
    """Splitters after subdivision, and the pinned rows with their range."""
    splitters = _splitters(rows, max(1, math.ceil(n / range_rows)), total) if n > range_rows else []
    for _ in range(8):
        dealt = rows.withColumn("r", _range_of(splitters))
        full = dealt.groupBy("r").count().where(F.col("count") > OVERFULL * range_rows).collect() if n > range_rows else []
        if not full:
            break
        ids = ", ".join(str(x["r"]) for x in full)
        most = sum(x["count"] for x in full)
        parts = sum(math.ceil(x["count"] / range_rows) for x in full)
        more = _sample(dealt.where(f"r in ({ids})"), f"1D / {most}", 4 * parts)
        grown = sorted({*splitters, *more}, key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        if len(grown) == len(splitters):
            break
        splitters = grown
    return dealt


def shard_by_size(docs: DataFrame, n_shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per record: doc_id, size, text_crc32, shard and gapless slot within the shard.

    Only (digest, id, size, checksum) is moved; texts are read once and stay where they are.
    """
    full = f"coalesce(`{text}`, '')"
    rows = pin(docs.select(
        F.expr(f"md5({full})").alias("k"), F.col(doc_id).cast("long").alias("doc_id"),
        F.expr(f"octet_length({full}) + 1L").alias("size"), F.expr(f"crc32({full})").alias("text_crc32")))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    dealt = _ranges(rows, n, max(total, 1), max(range_rows, n // MAX_RANGES))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: a few for every million records
    offsets = dealt.groupBy("r").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")).select(
        "r", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    inside = Window.partitionBy("r").orderBy("k", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = pin(dealt.withColumns({"b": F.sum("size").over(inside), "c": F.count(F.lit(1)).over(inside)})
                 .join(offsets, "r")
                 .select("k", "doc_id", "size", "text_crc32", F.expr("b0 + b - size").alias("start"),
                         F.expr("c0 + c - 1").alias("nth")))
    limit = total // (n_shards * GROUP_PARTS)
    groups = placed.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("start").alias("g0"),
                                     F.sum("size").alias("gb")).where(f"copies > 1 and gb <= {limit}")
    middle = "if(g0 is null, 2 * start + size, 2 * g0 + gb)"
    where = f"cast(least({n_shards - 1}L, ({middle}) * {n_shards} div {2 * max(total, 1)}L) as int)"
    out = pin(placed.join(groups, "k", "left").select(
        "doc_id", "size", "text_crc32", F.expr(where).alias("shard"), "nth"))
    first = out.groupBy("shard").agg(F.min("nth").alias("first"))  # at most n_shards rows
    return out.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", F.expr("nth - first").alias("slot"))


def shard_totals(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of each shard."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))
