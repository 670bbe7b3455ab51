"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame; all but the last keep documents' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination
from .common import materialize, read_table
from .language import UNKNOWN, learn_profiles, predict_languages
from .near_copies import keyed_rows, node_components
from .packing import pack_documents
from .pii import redact
from .queries import SEQUENCE_TOKENS, crc_mod3
from .tokenizing import tokenizer_path

#: Largest number of keys of dropped rows that is broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _small_row_groups(spark: SparkSession) -> None:
    """Tables of texts are written in row groups of 16 MB, unless the session says otherwise: a writer holds one in memory."""
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", str(16 << 20))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts and texts without a letter go; ``lang`` is not changed.

    If no language can be learned (no labelled row), every text with a letter stays. Null and repeated ids
    and repeated rows are rows like any other; whole texts, an empty table stays empty; extra columns stay.
    """
    _small_row_groups(spark)
    profiles = learn_profiles(docs.where(crc_mod3(F.col("doc_id")) != 1), "text", "lang", F.col("doc_id"))
    if not profiles:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return predict_languages(texts, profiles).where(F.col("lang_pred") != UNKNOWN).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest id (null last), then by its text's hash.

    Near: sets of five-word shingles of Jaccard similarity ``similar`` or more, directly or through
    others. Rows are judged by their texts alone: repeated and null ids are rows like any other. Empty and
    null texts are one group; an empty table stays empty; extra columns stay.
    """
    _small_row_groups(spark)
    keyed = keyed_rows(docs, "text", shingle)
    parts = node_components(keyed, "text", shingle, similar)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", F.xxhash64("text").alias("h"), "__row__")
    rows = keyed.select("__row__", F.col("__node__").alias("node"), order.alias("order")).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = rows.groupBy("component").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1").select("component", "best")
    drop = materialize(rows.join(kept, "component").where(F.col("__row__") != F.col("best.__row__")).select("__row__"), "drop")
    if drop.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    return keyed.join(drop, "__row__", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; each text is judged on its own, whatever its id.

    Null and empty texts, and all texts where ``benchmark`` is empty, stay; repeated rows go or stay
    together; an empty table stays empty; extra columns stay.
    """
    _small_row_groups(spark)
    found = decontamination.placings(docs, read_table(spark, sf_dir, "benchmark"))
    dirty = materialize(found.select("th").distinct(), "drop")
    if dirty.count() <= BROADCAST_IDS:
        dirty = F.broadcast(dirty)
    return docs.join(dirty, F.xxhash64(docs["text"]) == dirty["th"], "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text.

    Null texts stay null; null ids, repeated rows and extra columns stay as they are; empty in, empty out.
    """
    _small_row_groups(spark)
    clean = redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are one piece, the end id alone; null and repeated ids are packed as rows of their
    own; texts of any length are cut into pieces; other columns are not read; empty in, empty out.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS, end_id=0)
