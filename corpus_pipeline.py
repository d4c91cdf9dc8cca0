"""A corpus from raw documents to token ids: filter, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared checkpoint folder and hands the written copy to the next stage. All but the last
return the columns of the documents they were given.
"""

import sys
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pulsegrid.llm import bpe, mixing, pii, quality_rules, simhash  # noqa: E402
from pulsegrid.session import ensure_checkpoint_dir, pin  # noqa: E402

POLICY = "v1"
#: The mix keeps this part of the entropy of equal weights and reads no source more often than this.
ENTROPY, MAX_REPEAT = 0.95, 4.0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Documents that the policy keeps. Null and empty texts are rejected (too few words)."""
    return quality_rules.kept_documents(docs, POLICY)


def near_duplicates(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """One document of each component of near-equal fingerprints: the one with the smallest id.

    Its own fingerprint lies in the component, so texts that share an id but not a component all keep theirs. Of rows with the same id and
    fingerprint one stays; ids of null come last, and a component whose ids are all null keeps one row.
    """
    found = pin(simhash.with_components(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint")).alias("k")
    kept = found.groupBy("root").agg(first).select("k.doc_id", "k.fingerprint")
    rows = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("doc_id", "_id")
    kept = pin(kept.join(rows, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "fingerprint", "n"))
    alone = F.col("doc_id").isNotNull() & (F.col("n") == 1)
    out = docs.join(kept.where(alone).select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    many = kept.where(~alone).select(F.col("doc_id").alias("_id"), F.col("fingerprint").alias("_kf"))
    if many.limit(1).count() == 0:
        return out
    # an id of several rows: its rows are known by their fingerprints
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text").join(many.select("_id").distinct(), same, "left_semi")
    printed = simhash.with_fingerprints(whole).join(many, same & (F.col("_fp") == F.col("_kf")), "left_semi")
    one = printed.groupBy("doc_id", "_fp").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc"))
    return out.unionByName(one.select("_doc.*"))


def personal_data(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Texts with emails, addresses, card and phone numbers replaced, plain or disguised."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Documents as often as the temperature mix takes them."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text")
    return mixing.mix(whole, target_entropy=ENTROPY, max_repeat=MAX_REPEAT).select("_doc.*")


def token_ids(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Ids of every text with their count and digests."""
    return bpe.with_ids(docs.select("doc_id", "source", "text"), VOCABULARY, ids=True).drop("text")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", token_ids),
]

#: Fingerprints, spans and merges are not expressible; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark, sf_dir) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
