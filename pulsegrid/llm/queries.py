"""The numbered queries: each applies one operator to its whole table."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from pulsegrid.llm import (
    ann,
    bpe,
    cap_join,
    html_content,
    lexical,
    mixing,
    pii,
    quality_rules,
    repeats,
    sharding,
    simhash,
    token_counts,
    vector_codes,
)
from pulsegrid.llm import sql as S
from pulsegrid.llm.registry import query, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bucket_refinement")
def op1(spark, sf):
    """Bytes of all documents that lie in a 100-byte string seen earlier."""
    return repeats.remove_repeats(table(spark, sf, "documents"), 100)


@query("op2_linear_token_counts")
def op2(spark, sf):
    """Greedy word-piece lengths of all documents."""
    return token_counts.count_tokens(table(spark, sf, "documents"), VOCABULARY)


@query("op3_temperature_mix", S.MIX)
def op3(spark, sf):
    """Mix to at least 95 % of the entropy of equal weights, no source read more than 4 times."""
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"),
                      target_entropy=0.95, max_repeat=4.0).select(
        "doc_id", "source", "tokens", "epoch", "block", "block_rank", "draw")


@query("op4_sampled_splitters", S.SHARDS)
def op4(spark, sf):
    """All documents in eight shards of near equal bytes."""
    return sharding.shard_by_size(table(spark, sf, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op5_pii_transducers")
def op5(spark, sf):
    """Personal data in all documents, plain and disguised."""
    return pii.detect(table(spark, sf, "documents"))


@query("op6_max_scoring_region")
def op6(spark, sf):
    """Main text of all pages."""
    return html_content.extract(table(spark, sf, "pages"))


@query("op7_rule_ledger", S.QUALITY)
def op7(spark, sf):
    """Ledger of all documents with the verdict of policy v1."""
    led = quality_rules.ledger(table(spark, sf, "documents"))
    return quality_rules.apply_policy(led, "v1").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "failed_bits")


@query("op8_learned_partitions")
def op8(spark, sf):
    """Twenty nearest rows of every twentieth vector, by inner product."""
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op9_simhash_vptree")
def op9(spark, sf):
    """Fingerprints of all documents and the components of those at most three bits apart."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op10_segment_tree_bpe")
def op10(spark, sf):
    """All documents encoded and decoded with the byte-level vocabulary."""
    return bpe.encode(table(spark, sf, "documents"), VOCABULARY)


@query("op11_reversed_search", S.LEXICAL)
def op11(spark, sf):
    """Ten highest-scoring documents of every benchmark item, over all documents."""
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10)


@query("op12_cap_filters", S.CAP_LINKS)
def op12(spark, sf):
    """Links of all vectors at a cosine of 0.9 or more, and their components."""
    return cap_join.linked(table(spark, sf, "embeddings"), 0.9)


@query("op13_hilbert_codes", S.vector_codes())
def op13(spark, sf):
    """Codes of all vectors from four integer codebooks."""
    return vector_codes.encode(table(spark, sf, "embeddings"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    """All stages of the corpus pipeline over documents."""
    return corpus_pipeline.run(spark, sf)
