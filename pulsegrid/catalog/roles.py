"""The given tables in the roles the operators expect, as frames and as SQL views."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import probability as P
from pulsegrid.functions.hashing import hash32

EVENT_CLASS = {"view": 0, "click": 1, "purchase": 2, "error": 3, "signup": 4}
DATASETS = ["MIT-BIH", "INCART", "SVDB"]
CHUNK_VECTORS = 20
CHUNK = 64 * CHUNK_VECTORS
RATE = 32.0


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits=6) -> DataFrame:
    """Doubles rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    return df.selectExpr(*[
        f"round(`{f.name}`, {digits}) + 0.0D as `{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else f"`{f.name}`"
        for f in df.schema.fields])


def rounded_sql(sql, columns, digits=6) -> str:
    fix = ", ".join(f"round({c}, {digits}) + 0.0 as {c}" for c in columns.split())
    return f"with _r as ({sql}) select * replace ({fix}) from _r"


def exploded(df: DataFrame, keys, col) -> DataFrame:
    """Array column as (keys, pos, value) rows."""
    return df.select(*keys, F.posexplode(col).alias("pos", "value"))


# Microseconds since the epoch from the wall-clock fields, whatever the session time zone.
MICROS = ("unix_date(to_date(ts)) * 86400000000L + (hour(ts) * 60L + minute(ts)) * 60000000L "
          "+ cast(extract(second from ts) * 1000000 as bigint)")


def event_class(col="symbol"):
    t = F.create_map(*[F.lit(x) for kv in EVENT_CLASS.items() for x in kv])
    return F.element_at(t, F.col(col))


def value_bucket(v):
    return F.when(v < 10, 0).when(v < 25, 1).when(v < 45, 2).when(v < 80, 3).otherwise(4)


def annotations(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("record"), F.col("event_id").alias("ann_idx"),
        F.expr(MICROS).alias("sample"), F.col("event_type").alias("symbol"))


def scored_events(spark, sf) -> DataFrame:
    """record, dataset, beat_id, y, raw_pred, pred: a raw and an adapted prediction per event."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    raw = value_bucket(F.col("value"))
    y = event_class("event_type")
    names = F.array(*[F.lit(d) for d in DATASETS])
    return e.select(
        F.col("user_id").alias("record"), F.get(names, (F.col("user_id") % 3).cast("int")).alias("dataset"),
        F.col("event_id").alias("beat_id"), y.alias("y"), raw.alias("raw_pred"),
        F.when(k < 40, y).otherwise(raw).alias("pred"), F.col("value"), k.alias("k"))


SCORED = """scored as (
  select user_id as record, list_extract(['MIT-BIH','INCART','SVDB'], (user_id % 3)::int + 1) as dataset, event_id as beat_id,
    case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'error' then 3 else 4 end as y,
    case when value < 10 then 0 when value < 25 then 1 when value < 45 then 2 when value < 80 then 3 else 4 end as raw_pred,
    cast(json_extract(props, '$.k') as int) as k, value,
    case when cast(json_extract(props, '$.k') as int) < 40 then
      case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 when 'error' then 3 else 4 end
    else case when value < 10 then 0 when value < 25 then 1 when value < 45 then 2 when value < 80 then 3 else 4 end end as pred
  from events)"""


def beats(spark, sf) -> DataFrame:
    """Embeddings as two-lead windows: first and second half, class label % 5."""
    v = table(spark, sf, "embeddings")
    names = F.array(*[F.lit(d) for d in DATASETS])
    rec = F.floor(F.col("vec_id") / 10)
    emb = F.col("embedding").cast("array<double>")
    return v.select(
        F.col("vec_id").alias("beat_id"), rec.alias("record"),
        F.get(names, (rec % 3).cast("int")).alias("dataset"), (F.col("label") % 5).alias("y"),
        F.slice(emb, 1, 32).alias("b0"), F.slice(emb, 33, 32).alias("b1"))


BEATS = """beats as (
  select vec_id as beat_id, vec_id // 10 as record,
    list_extract(['MIT-BIH','INCART','SVDB'], ((vec_id // 10) % 3)::int + 1) as dataset, label % 5 as y,
    embedding[1:32]::double[] as b0, embedding[33:64]::double[] as b1
  from embeddings)"""

ROLE_SEEDS = [303, 1303]


def role_of(seed, key):
    h = hash32(seed, "role", key) % 100
    return F.when(h < 50, "fit").when(h < 75, "val").otherwise("test")


def probs(spark, sf) -> DataFrame:
    """dataset, family, method, seed, role, beat_id, y, p_backbone, p_evidence for every row and seed."""
    v = table(spark, sf, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    names = F.array(*[F.lit(d) for d in DATASETS])
    rec = F.floor(F.col("vec_id") / 10)
    runs = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(f).alias("family"), F.lit(s).alias("seed"), F.lit(scale).alias("scale"))
        for s in ROLE_SEEDS for m, f, scale in (("logistic_raw", "raw_machine_learning", 6.0), ("raw_mixer", "deep", 12.0))])
    y = F.col("label") % 5
    ev = F.transform(F.slice(emb, 6, 5), lambda x, i: 8.0 * x + F.when(i == y, 1.5).otherwise(0.0))
    rows = v.select(
        F.get(names, (rec % 3).cast("int")).alias("dataset"), F.col("vec_id").alias("beat_id"), y.alias("y"),
        F.slice(emb, 1, 5).alias("_b"), P.softmax(ev).alias("p_evidence"), F.explode(runs).alias("r"))
    return rows.select(
        "dataset", "r.family", "r.method", "r.seed", role_of(F.col("r.seed"), F.col("beat_id")).alias("role"),
        "beat_id", "y", P.softmax(F.transform("_b", lambda x: x * F.col("r.scale"))).alias("p_backbone"), "p_evidence")


def softmax_sql(e):
    return (f"list_transform({e}, lambda x: exp(x - list_max({e})) / "
            f"list_sum(list_transform({e}, lambda z: exp(z - list_max({e})))))")


HASH = "('0x' || substr(md5({}), 1, 8))::bigint"


def hash_sql(*parts):
    return HASH.format("concat_ws('|', " + ", ".join(parts) + ")")


PROBS = f"""runs_(method, family, seed, scale) as (values
    ('logistic_raw','raw_machine_learning',303,6.0::double), ('raw_mixer','deep',303,12.0::double),
    ('logistic_raw','raw_machine_learning',1303,6.0::double), ('raw_mixer','deep',1303,12.0::double)),
  scores_ as (
  select list_extract(['MIT-BIH','INCART','SVDB'], ((vec_id // 10) % 3)::int + 1) as dataset, family, method, seed,
    {hash_sql("seed", "'role'", "vec_id")} % 100 as h, vec_id as beat_id, label % 5 as y,
    list_transform(embedding[1:5]::double[], lambda x: x * scale) as sb,
    list_transform(embedding[6:10]::double[], lambda x, i: 8.0::double * x + case when i - 1 = label % 5 then 1.5::double else 0.0::double end) as se
  from embeddings cross join runs_),
  probs as (select dataset, family, method, seed, case when h < 50 then 'fit' when h < 75 then 'val' else 'test' end as role,
    beat_id, y, {softmax_sql('sb')} as p_backbone, {softmax_sql('se')} as p_evidence from scores_)"""

# Metric name -> (column product, divisor). Prime divisors keep averages off rounding ties.
_SOURCES = {
    "macro_f1_4": ("l_discount", 0.103), "accuracy": ("l_tax", 0.083),
    "F1_S": ("l_quantity", 53), "F1_F": ("l_quantity * l_discount", 2.03), "F1_V": ("l_quantity * l_tax", 2.11),
    "Se_S": ("l_quantity", 59), "Pr_S": ("l_quantity", 47), "Se_F": ("l_discount", 0.113), "Pr_F": ("l_discount", 0.089),
    "raw_macro_f1_4": ("l_tax", 0.097), "raw_accuracy": ("l_tax", 0.101),
    "raw_F1_S": ("l_quantity", 61), "raw_F1_F": ("l_quantity * l_tax", 3.07), "raw_F1_V": ("l_quantity", 71),
    "backbone_train_time": ("l_extendedprice", 1013), "evidence_train_time": ("l_extendedprice", 2027),
    "predict_time": ("l_quantity", 31),
}
DETAIL_METRICS = list(_SOURCES)
DELTAS = ["macro_f1_4", "accuracy", "F1_S", "F1_F", "F1_V"]


def run_detail(spark, sf) -> DataFrame:
    """lineitem as a run table: flag = dataset, status = family, supplier % 10 = method, line = seed.

    Metrics are rounded to 9 digits so that both engines compare the same numbers.
    """
    li = table(spark, sf, "lineitem")
    g = li.groupBy(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("family"),
        F.concat(F.lit("m"), F.col("l_suppkey") % 10).alias("method"), F.col("l_linenumber").alias("seed"))
    out = g.agg(F.count(F.lit(1)).alias("n_rows"),
                *[F.expr(f"round(avg({e}) / {float(d)}D, 9) as {m}") for m, (e, d) in _SOURCES.items()])
    return out.select("*", *[F.round(F.col(m) - F.col(f"raw_{m}"), 9).alias(f"delta_{m}") for m in DELTAS])


DETAIL = (
    "detail0 as (select l_returnflag as dataset, l_linestatus as family, 'm' || (l_suppkey % 10) as method, "
    "l_linenumber as seed, count(*) as n_rows, "
    + ", ".join(f"round(avg({e}) / {float(d)}::double, 9) as {m}" for m, (e, d) in _SOURCES.items())
    + " from lineitem group by all), detail as (select *, "
    + ", ".join(f"round({m} - raw_{m}, 9) as delta_{m}" for m in DELTAS) + " from detail0)"
)


def signals(spark, sf) -> DataFrame:
    """Embeddings as recordings: 100 vectors per record, 20 per chunk; odd records are mono."""
    v = table(spark, sf, "embeddings")
    rec = F.floor(F.col("vec_id") / 100)
    chunk = F.floor((F.col("vec_id") % 100) / CHUNK_VECTORS)
    # 20 vectors per group by construction of the chunk number.
    g = v.groupBy(rec.alias("record"), chunk.alias("chunk")).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]))
        .cast("array<double>").alias("values"))
    base = g.select("record", F.lit(RATE).alias("fs"), "chunk", (F.col("chunk") * CHUNK).alias("start_idx"), "values")
    second = base.where(F.col("record") % 2 == 0).withColumn("values", F.transform("values", lambda x: -2.0 * x))
    return base.withColumn("lead", F.lit(0)).unionByName(second.withColumn("lead", F.lit(1)))


SIGNALS = f"""base_ as (
  select vec_id // 100 as record, (vec_id % 100) // {CHUNK_VECTORS} as chunk,
    flatten(list(embedding::double[] order by vec_id)) as vals
  from embeddings group by all),
signals as (
  select record, chunk, chunk * {CHUNK} as start_idx, 0 as lead, vals from base_
  union all
  select record, chunk, chunk * {CHUNK} as start_idx, 1 as lead, list_transform(vals, lambda x: -2.0::double * x) from base_ where record % 2 = 0)"""


def signal_annotations(spark, sf, records) -> DataFrame:
    """Events placed on the recordings; ``records`` is the number of recordings."""
    a = annotations(spark, sf)
    return a.select(
        (F.col("ann_idx") % records).alias("record"), F.col("ann_idx").alias("beat_id"), "ann_idx",
        (F.floor(F.col("sample") / 1000) % 6500).alias("sample"), "symbol")


SIGNAL_ANN = """rec_ as (select count(distinct record) as n from signals),
sann as (select event_id % (select n from rec_) as record, event_id as beat_id, (epoch_us(ts) // 1000) % 6500 as sample, event_type as symbol from events)"""
