"""Paged source, incremental index, streaming ingest."""

import json

from pyspark.sql import functions as F

from lorespark import streaming
from lorespark.operators import embedding
from lorespark.sources import works


def test_paged_source(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"items": [{"id": f"W{i}"}]}))
    works.register(spark)
    got = spark.read.format("paged").option("path", str(tmp_path)).option("pages", "2").load()
    assert sorted(r["json"] for r in got.collect()) == ['{"id": "W0"}', '{"id": "W1"}']


def test_index_embeds_only_changes(spark):
    src = spark.createDataFrame([(1, "soul", "s", "## A\n\nalpha beta"), (1, "paper_summary", "p", "gamma [x2020ab]"), (1, "cv", "c", "hidden")], "profile long, source_type string, source_id string, text string")
    chunks = embedding.enumerate_chunks(src, "full").cache()
    assert {r["source_type"] for r in chunks.collect()} == {"soul", "paper_summary"}
    empty = spark.createDataFrame([], "profile long, source_type string, source_id string, chunk_index int, text_hash string, vector array<float>, backend_spec string")
    index = embedding.build_index(chunks, empty, embedding.hash_encoder, "hash:16").cache()
    assert index.count() == 2 and all(len(r["vector"]) == 16 for r in index.collect())
    edited = embedding.enumerate_chunks(src.withColumn("text", F.regexp_replace("text", "x2020ab", "y2021cd")), "full")
    assert {r["status"]: r["count"] for r in embedding.index_report(edited, index).collect()} == {"kept": 2}
    try:
        embedding.build_index(chunks, index, embedding.hash_encoder, "other")
    except ValueError:
        pass
    else:
        raise AssertionError("another backend must be refused")


def test_stream_dedup(spark, tmp_path):
    spark.createDataFrame([("W1", "2024-01-01 00:00:00"), ("W1", "2024-01-01 00:10:00"), ("W2", "2024-01-01 01:00:00")], "openalex_id string, t string").select("openalex_id", F.col("t").cast("timestamp").alias("seen_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("openalex_id string, seen_at timestamp").parquet(str(tmp_path / "in"))
    q = streaming.new_works(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r[0] for r in spark.table("seen").select("openalex_id").collect()) == ["W1", "W2"]
