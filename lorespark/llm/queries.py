"""Registered queries of this subpackage; each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod3, read_table
from . import decontamination, filter_audit, hard_negatives
from .exact_topk import exact_topk, scaled_vectors
from .id_store import read_digests, write_ids
from .language import learn_profiles, predict_languages
from .packing import pack_documents
from .pii import pii_digest
from .quality import judge_quality
from .simhash import simhash_components
from .token_counts import token_counts
from .suffix_dedup import cut_repeats
from .toxicity import learn_toxicity, score_toxicity
from .tokenizing import tokenizer_path

#: A document over this many tokens is marked.
TOKEN_LIMIT = 1024
#: Tokens of a packed sequence.
SEQUENCE_TOKENS = 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_digests(spark, write_ids(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod3(F.col("doc_id")) != 1).select("doc_id", "toxic")
    model = learn_toxicity(docs, labels)
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS, end_id=0)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(crc_mod3(doc_id) == 1, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(crc_mod3(F.col("doc_id")) != 1), "text", "lang", F.col("doc_id"))
    found = predict_languages(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read_table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(scaled_vectors(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return judge_quality(read_table(spark, sf_dir, "documents"), trusted)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hard_negatives.labelled_vectors(read_table(spark, sf_dir, "embeddings"), noisy=F.col("vec_id") % 7 == 0)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_token_id_store, op3_toxicity, op4_simhash_near_dedup, op5_best_fit_packing, op6_exact_topk, op7_language_id, op8_pii, op9_suffix_dedup, op10_benchmark_decontamination, op11_quality_rules, op12_filter_audit, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_topk": OP6_SQL, "op10_benchmark_decontamination": decontamination.oracle(), "op12_filter_audit": filter_audit.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
