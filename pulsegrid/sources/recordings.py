"""Recording tables: scans, discovery, completeness, symbol and lead rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schema import ANNOTATIONS, SIGNALS, SYMBOL_CLASS, TEST_RECORDS, TRAIN_RECORDS
from pulsegrid.session import small_side

# Lead names by preference.
FIRST_LEADS = ["MLII", "II", "ECG1", "V5", "I"]
SECOND_LEADS = ["V1", "ECG2", "V2", "III", "I"]
RECORD_FILES = ["hea", "dat", "atr"]


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIGNALS).parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATIONS).parquet(path)


def two_leads(signals: DataFrame) -> DataFrame:
    """(record, fs, chunk, start_idx, v0, v1); a mono recording uses its lead twice."""
    wide = signals.groupBy("record", "fs", "chunk", "start_idx").agg(
        F.max(F.when(F.col("lead") == 0, F.col("values"))).alias("v0"),
        F.max(F.when(F.col("lead") == 1, F.col("values"))).alias("_v1"))
    return wide.select("record", "fs", "chunk", "start_idx", "v0", F.coalesce("_v1", "v0").alias("v1"))


def discover_records(spark: SparkSession, folder: str, ext="hea") -> DataFrame:
    """Distinct record names from file names with one extension; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(folder)
    return files.select(F.regexp_extract("path", rf"([^/]+)\.{ext}$", 1).alias("record")).distinct().orderBy("record")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder)
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1).alias("record"),
        F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 2).alias("ext"))


def missing_files(records: DataFrame, listing: DataFrame, exts=RECORD_FILES) -> DataFrame:
    """(record, ext) pairs that the listing lacks."""
    want = records.select("record", F.explode(F.array(*[F.lit(e) for e in exts])).alias("ext"))
    return want.join(listing.select("record", "ext"), ["record", "ext"], "left_anti")


def symbol_table(spark: SparkSession, mapping=None) -> DataFrame:
    return spark.createDataFrame(sorted((mapping or SYMBOL_CLASS).items()), "symbol string, y int")


def map_symbols(ann: DataFrame, mapping=None, symbol="symbol") -> DataFrame:
    """Add class ``y`` and drop unmapped symbols; the 15-row map is a literal, not a join."""
    table = F.create_map(*[F.lit(x) for kv in sorted((mapping or SYMBOL_CLASS).items()) for x in kv])
    return ann.withColumn("y", F.element_at(table, F.col(symbol))).where(F.col("y").isNotNull())


def skipped(bounds: DataFrame, source, mapping=None, symbol="symbol") -> DataFrame:
    """Per source: annotations without a class or outside their recording, and kept per class."""
    table = F.create_map(*[F.lit(x) for kv in sorted((mapping or SYMBOL_CLASS).items()) for x in kv])
    y = F.element_at(table, F.col(symbol))
    ok = y.isNotNull() & F.col("inside")
    return bounds.groupBy(source).agg(
        F.sum((~ok).cast("long")).alias("skipped"),
        *[F.sum((ok & (y == c)).cast("long")).alias(f"count_{n}") for c, n in enumerate("NSVFQ")])


def record_lists(spark: SparkSession) -> DataFrame:
    rows = [(str(r), "train") for r in TRAIN_RECORDS] + [(str(r), "test") for r in TEST_RECORDS]
    return spark.createDataFrame(rows, "record string, role string")


def in_list(df: DataFrame, lists: DataFrame, record="record") -> DataFrame:
    return df.join(small_side(lists.select(F.col("record").alias(record))), record, "left_semi")


def qualified(database, record):
    return F.concat_ws("_", database, record)


def choose_leads(leads: DataFrame) -> DataFrame:
    """(record, lead0, lead1) positions from (record, pos, name) by name preference.

    The first preferred name present wins, else position 0 (then 1). If both choices meet
    and there is another lead, lead 1 moves to position 1, or to 0 when lead 0 is at 1.
    """
    name = F.upper(F.replace(F.col("name"), F.lit(" "), F.lit("")))

    def pick(order):
        rank = F.array_position(F.array(*[F.lit(n) for n in order]), name)
        return F.min(F.when(rank > 0, F.struct(rank.alias("r"), F.col("pos").alias("pos"))))

    best = leads.groupBy("record").agg(
        F.count(F.lit(1)).alias("n"), pick(FIRST_LEADS).alias("a"), pick(SECOND_LEADS).alias("b"))
    first = F.coalesce("a.pos", F.lit(0))
    second = F.coalesce("b.pos", F.when(F.col("n") > 1, 1).otherwise(0))
    out = best.select("record", "n", first.alias("lead0"), second.alias("_s"))
    fixed = F.when(
        (F.col("_s") == F.col("lead0")) & (F.col("n") > 1),
        F.when(F.col("lead0") != 1, 1).otherwise(0)).otherwise(F.col("_s"))
    return out.select("record", F.col("lead0").cast("int"), fixed.cast("int").alias("lead1"))

