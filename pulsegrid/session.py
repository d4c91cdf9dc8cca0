"""Session defaults and lineage control."""

import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores="*", shuffle_partitions=8, memory="12g"):
    """A session for tests and benches on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pulsegrid")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark):
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="pulsegrid-ckpt-")
    sc.setCheckpointDir(shared)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written copy.

    Used where a result is read several times or feeds a decision, so that a lost
    executor re-reads a file instead of recomputing an expensive branch.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows=200_000, max_bytes=64 << 20):
    """Broadcast hint for a side after measuring its rows and, as JSON, its bytes; else the plain side."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, width = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    if rows <= max_rows and (width or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, *columns, rows=4_096) -> DataFrame:
    """``df`` dealt by ``columns`` over a task for every ``rows`` rows, however few its files are; as it is where that is one task."""
    tasks = -(-df.count() // rows)
    return df if tasks < 2 else df.repartition(tasks, *columns)


def unioned_lists(few: DataFrame, many: DataFrame) -> DataFrame:
    """``few`` and ``many`` under all columns of ``few``; array columns that ``many`` lacks are empty in its rows.

    Not null: Arrow writes a run of null arrays in time that grows with the square of its length.
    """
    lacking = {f.name: F.array().cast(f.dataType) for f in few.schema.fields if f.name not in many.columns and isinstance(f.dataType, T.ArrayType)}
    return few.unionByName(many.withColumns(lacking), allowMissingColumns=True)


def concurrently(spark: SparkSession, fn, items, workers=4) -> list:
    """``fn`` of every item in order, a few jobs at a time, so that small fits do not leave a cluster idle."""
    items = list(items)
    if len(items) < 2 or workers < 2:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(min(workers, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fn), items))
