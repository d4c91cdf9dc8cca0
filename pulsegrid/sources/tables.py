"""Result tables: materialise, append, overwrite parts, priority reads, documents."""

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.ranking import first_by_priority
from pulsegrid.schema import CLASS_NAMES, RUN_DETAIL


def read_if_present(spark: SparkSession, path: str, where=None):
    """The Parquet table at ``path`` (partition filter applied), or None if absent or empty."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    df = df.where(where) if where is not None else df
    return None if df.isEmpty() else df


def load_or_build(spark, path, build, partition_by=(), where=None, force=False) -> DataFrame:
    """Read a materialised table, or build it, store it partitioned and read it back."""
    if not force:
        found = read_if_present(spark, path, where)
        if found is not None:
            return found
    replace_partitions(build(), path, partition_by)
    df = spark.read.parquet(path)
    return df.where(where) if where is not None else df


def replace_partitions(df: DataFrame, path: str, partition_by=()):
    """Overwrite only the partitions that ``df`` holds; other partitions stay."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


class BrokenContract(ValueError):
    """A written table did not hold what was promised; the table before it stays."""


def checked_write(df: DataFrame, path: str, contracts: dict, partition_by=()) -> dict:
    """Replace the table at ``path`` if its contracts hold; {name: value}.

    ``contracts``: name -> (aggregate column, test of its value). The values are gathered in the pass that writes, so a write is one
    job. Rows go to a folder beside the table, which takes the table's place only after all tests.
    """
    spark = df.sparkSession
    seen = Observation()
    observed = df.observe(seen, *[column.alias(name) for name, (column, _) in contracts.items()])
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    place, fresh, old = (fs_path(f"{path.rstrip('/')}{end}") for end in ("", f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    writer = observed.write
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh.toString())
        values = dict(seen.get)
        broken = [f"{name} is {values[name]}" for name, (_, test) in contracts.items() if not test(values[name])]
        if broken:
            raise BrokenContract("; ".join(broken))
        if fs.exists(place) and not fs.rename(place, old):
            raise OSError(f"{path} can not be moved aside")
        if not fs.rename(fresh, place):
            raise OSError(f"the rows written for {path} can not take its place")
    finally:
        if fs.exists(old) and not fs.exists(place):
            fs.rename(old, place)
        for rest in (fresh, old):
            if fs.exists(rest):
                fs.delete(rest, True)
    return values


def append(df: DataFrame, path: str, partition_by=()):
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def align(df: DataFrame, columns, types=None) -> DataFrame:
    """Fixed column order; missing columns become null, extra ones are dropped."""
    types = types or {}
    have = set(df.columns)
    return df.select(*[
        F.col(c) if c in have else F.lit(None).cast(types.get(c, "double")).alias(c) for c in columns])


def aligned_union(base: DataFrame, extra: DataFrame) -> DataFrame:
    return base.unionByName(extra.select(*[c for c in extra.columns if c in base.columns]),
                            allowMissingColumns=True).select(*base.columns)


def read_first(sources, keys) -> DataFrame:
    """Rows by key from the first source that has the key (newest location first)."""
    tagged = [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    return first_by_priority(every, keys, "_prio").drop("_prio")


def upsert(current: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Update rows with the same key, insert the others."""
    cols = [c for c in current.columns if c not in keys]
    joined = current.select(*keys, F.struct(*cols).alias("_old")).join(
        new.select(*keys, F.struct(*cols).alias("_new")), keys, "full")
    return joined.select(*keys, F.coalesce("_new", "_old").alias("_r")).select(*keys, "_r.*").select(*current.columns)


def read_detail_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_DETAIL).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, mode="overwrite"):
    """Header CSV with doubled quotes, so JSON columns survive the round trip."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_analysis(df: DataFrame, folder: str, stem: str, one_file_rows=100_000):
    """CSV of an analysis table: one file up to ``one_file_rows`` rows, beyond that one per partition."""
    one = df.limit(one_file_rows + 1).count() <= one_file_rows
    write_csv(df.coalesce(1) if one else df, f"{folder}/{stem}_source_data")


def confusion_documents(conf: DataFrame, keys) -> DataFrame:
    """(key, matrix JSON): 5 x 5 nested list per composite key, zero cells included."""
    rows = conf.groupBy(*keys, "y").agg(
        F.map_from_entries(F.collect_list(F.struct("pred", "n"))).alias("_m"))
    full = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("y", "_m"))).alias("_r"))
    idx = F.sequence(F.lit(0), F.lit(len(CLASS_NAMES) - 1))
    matrix = F.transform(idx, lambda i: F.transform(
        idx, lambda j: F.coalesce(F.element_at(F.element_at("_r", i), j), F.lit(0).cast("long"))))
    return full.select(F.concat_ws("|", *keys).alias("key"), F.to_json(matrix).alias("matrix"))


def read_confusions(docs: DataFrame) -> DataFrame:
    """(key, y, pred, n) from keyed matrix JSON."""
    parsed = docs.select("key", F.from_json("matrix", "array<array<bigint>>").alias("m"))
    outer = parsed.select("key", F.posexplode("m").alias("y", "_row"))
    return outer.select("key", "y", F.posexplode("_row").alias("pred", "n"))


def run_metadata(rows: DataFrame, counts: DataFrame, dataset="dataset") -> DataFrame:
    """One document per dataset: seed list and class counts."""
    seeds = rows.groupBy(dataset).agg(F.sort_array(F.collect_set("seed")).alias("seeds"))
    maps = counts.select(dataset, F.create_map(
        *[x for c in CLASS_NAMES for x in (F.lit(c), F.col(f"count_{c}"))]).alias("class_counts"))
    return seeds.join(maps, dataset)


def tagged(df: DataFrame, protocol: str, run_tag: str = "") -> DataFrame:
    """Protocol and tag as partition columns, so result sets live side by side."""
    return df.withColumn("protocol_id", F.lit(protocol)).withColumn("run_tag", F.lit(run_tag or "main"))
