"""Class rebalancing: inverse-frequency draws, interpolation, link removal, augmentation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.hashing import hash32, normal, uniform
from pulsegrid.operators.neighbours import nearest_neighbours
from pulsegrid.operators.splits import hash_rank
from pulsegrid.schema import N_CLASSES
from pulsegrid.session import pin, small_side


PIECE = 10_000
SMALL_CLASS_ROWS = 20_000


def _class_sizes(df, y):
    """Rows of each class; rows without a class, or with one outside the class list, are an error."""
    n = F.count(F.lit(1))
    known = F.col(y).between(0, N_CLASSES - 1)
    row = df.agg(*[F.sum(F.when(F.col(y) == c, 1).otherwise(0)).alias(f"n{c}") for c in range(N_CLASSES)],
                 n.alias("rows"), F.sum(known.cast("int")).alias("known")).first()
    if row["rows"] and row["rows"] != row["known"]:
        raise ValueError(f"{row['rows'] - (row['known'] or 0)} rows have no class among 0 to {N_CLASSES - 1}")
    return {c: int(row[f"n{c}"]) for c in range(N_CLASSES) if row[f"n{c}"]}


def _lookup(sizes, col):
    table = F.create_map(*[x for c, n in sorted(sizes.items()) for x in (F.lit(c), F.lit(n).cast("long"))])
    return F.element_at(table, col)


def inverse_frequency(df: DataFrame, seed, y="y", row_id="beat_id") -> DataFrame:
    """As many draws with replacement as there are rows; each class is equally likely.

    Draws are counted per (class, rank) before they meet the rows, so a drawn row moves
    once with its number of copies.
    """
    sizes = _class_sizes(df, y)
    present = F.array(*[F.lit(c) for c in sorted(sizes)])
    slots = df.sparkSession.range(sum(sizes.values()))
    slots = slots.withColumn(
        "_y", F.get(present, (hash32(seed, F.col("id"), "c") % len(sizes)).cast("int")))
    slots = slots.withColumn("_rank", hash32(seed, F.col("id"), "r") % _lookup(sizes, F.col("_y")))
    copies = slots.groupBy("_y", "_rank").agg(F.count(F.lit(1)).alias("copies"))
    keyed = hash_rank(df.withColumn("_y", F.col(y).cast("int")), ["_y"], seed, [row_id], "_rank")
    drawn = keyed.join(copies, ["_y", "_rank"])
    last = F.ceil(F.col("copies") / PIECE) - 1
    drawn = drawn.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    if sum(sizes.values()) / len(sizes) / min(sizes.values()) > PIECE / 2:
        # A class of a few rows gets very many copies of each; no task writes them all.
        drawn = drawn.repartition("_y", "_rank", "_piece")
    first = F.col("_piece") * PIECE + 1
    return drawn.withColumn(
        "copy", F.explode(F.sequence(first, F.least(F.col("copies"), first + PIECE - 1)))
    ).drop("_y", "_rank", "copies", "_piece")


def interpolate_minority(df: DataFrame, seed, y="y", row_id="beat_id", vec="vec", k_max=5) -> DataFrame:
    """Original rows plus interpolated ones up to the majority count of every class.

    k = min(5, smallest class - 1) neighbours of the same class. Returned unchanged if
    there are fewer than two classes or a class has a single row. New ids are negative.
    """
    base = df.select(F.col(row_id).cast("long").alias("id"), F.col(y).cast("int").alias("by"),
                     F.col(vec).cast("array<double>").alias("vec"))
    sizes = _class_sizes(base, "by")
    plain = base.select("id", "by", "vec", F.lit(False).alias("synthetic"))
    if len(sizes) < 2 or min(sizes.values()) < 2:
        return plain.withColumnRenamed("by", "y")
    k = min(k_max, min(sizes.values()) - 1)
    top = max(sizes.values())
    small = [c for c in sorted(sizes) if sizes[c] < top]
    if not small:
        return plain.withColumnRenamed("by", "y")
    minor = pin(base.where(F.col("by").isin(small)))
    near = nearest_neighbours(minor, minor, k, skip_same=True)
    ranked = hash_rank(minor, ["by"], seed, ["id"], "_rank")
    bounds, edge = [], 0
    for c in small:
        edge += top - sizes[c]
        bounds.append((c, edge))
    cls = F.lit(bounds[-1][0])
    for c, e in reversed(bounds[:-1]):
        cls = F.when(F.col("slot") < e, F.lit(c)).otherwise(cls)
    slots = (
        df.sparkSession.range(edge).withColumnRenamed("id", "slot").withColumn("by", cls)
        .withColumn("_rank", hash32(seed, F.col("slot"), "base") % _lookup(sizes, F.col("by")))
        .withColumn("rank", (hash32(seed, F.col("slot"), "near") % k + 1).cast("int"))
        .withColumn("u", uniform(seed, F.col("slot"), "u"))
    )
    # Few minority rows of bounded bytes under many slots are broadcast. Otherwise slots spread over many
    # ranks and the joins shuffle; the adaptive skew split covers a tiny class beside a large one.
    def side(df):
        return small_side(df, SMALL_CLASS_ROWS)

    near = pin(near.select("id", "rank", "neighbour"))
    placed = slots.join(side(ranked.withColumnRenamed("vec", "a")), ["by", "_rank"])
    linked = placed.join(side(near), ["id", "rank"])
    ends = minor.select(F.col("id").alias("neighbour"), F.col("vec").alias("b"))
    made = linked.join(side(ends), "neighbour").select(
        (-F.col("slot") - 1).alias("id"), "by",
        F.zip_with("a", "b", lambda p, q: p + F.col("u") * (q - p)).alias("vec"),
        F.lit(True).alias("synthetic"),
    )
    return plain.unionByName(made).withColumnRenamed("by", "y")


def link_pairs(df: DataFrame, y="y", row_id="id", vec="vec") -> DataFrame:
    """Pairs (a < b) that are each other's nearest neighbour and differ in class."""
    base = pin(df.select(F.col(row_id).cast("long").alias("id"), F.lit(0).alias("by"),
                         F.col(vec).cast("array<double>").alias("vec"), F.col(y).cast("int").alias("_y")))
    near = nearest_neighbours(base, base, 1, skip_same=True).select("id", "neighbour")
    labels = base.select("id", "_y")
    tagged = near.join(labels, "id").join(
        labels.select(F.col("id").alias("neighbour"), F.col("_y").alias("_yn")), "neighbour")
    apart = tagged.where(F.col("_y") != F.col("_yn")).select(
        F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
    return apart.groupBy("a", "b").count().where("count = 2").select("a", "b")


def drop_links(df: DataFrame, y="y", row_id="id", vec="vec") -> DataFrame:
    """Remove both ends of every mutual nearest pair with different classes."""
    ends = link_pairs(df, y, row_id, vec).select(F.explode(F.array("a", "b")).alias(row_id))
    return df.join(ends, row_id, "left_anti")


def interpolate_and_clean(df: DataFrame, seed, y="y", row_id="beat_id", vec="vec") -> DataFrame:
    return drop_links(pin(interpolate_minority(df, seed, y, row_id, vec)), "y", "id", "vec")


def jitter_mask(df: DataFrame, seed, epoch, row_id="beat_id", leads=("b0", "b1"),
                noise=0.01, share=0.25, narrow=8, wide=24) -> DataFrame:
    """Additive noise on every value; with probability ``share`` a random span is zeroed."""
    rid = F.col(row_id)
    width = narrow + (hash32(seed, epoch, rid, "w") % (wide - narrow + 1)).cast("int")
    room = F.greatest(F.size(leads[0]) - width, F.lit(0)) + 1
    start = (hash32(seed, epoch, rid, "s") % room).cast("int")
    df = df.withColumn("_on", uniform(seed, epoch, rid, "m") < share).withColumn(
        "_w", width).withColumn("_s", start)
    for lead in leads:
        df = df.withColumn(lead, _masked_noise(F.col(lead).cast("array<double>"), lead, seed, epoch, rid, noise))
    return df.drop("_on", "_w", "_s")


def _masked_noise(x, lead, seed, epoch, rid, noise):
    def one(v, i):
        inside = F.col("_on") & (i >= F.col("_s")) & (i < F.col("_s") + F.col("_w"))
        return F.when(inside, F.lit(0.0)).otherwise(v + F.lit(float(noise)) * normal(seed, epoch, rid, lead, i))

    return F.transform(x, one)
