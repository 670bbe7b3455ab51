"""Corpus pipeline over documents: language, near copies, benchmark passages, personal data, packing.

Every stage works on all that the one before kept, written as Parquet in the shared folder and
read again, so that a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm import stages
from lorespark.llm.common import read_written, write_table

STAGES = [
    ("language_id", stages.language_stage),
    ("simhash_near_dedup", stages.near_dedup_stage),
    ("benchmark_decontamination", stages.decontamination_stage),
    ("pii", stages.pii_stage),
    ("best_fit_packing", stages.packing_stage),
]

#: Not expressible in SQL (rank-order profiles, components, a library's tokens); tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        docs = read_written(spark, write_table(made, f"stage-{name}"), made)
    return docs
