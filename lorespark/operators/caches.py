"""Derived tables kept by digests of what they were made from: the graph of people, and centroids."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import centroids


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, source_hash: str) -> None:
    """Keep a graph of ``source_hash``: both tables are written to a folder of their own, and the table of meta names it only when both are whole.

    A reader sees the old graph or the new one; a lost writer leaves a folder that nothing names. The graph before goes last.
    """
    spark = nodes.sparkSession
    version = uuid.uuid4().hex
    nodes.write.parquet(f"{path}/{version}/nodes")
    edges.write.parquet(f"{path}/{version}/edges")
    before = _meta(spark, path)
    aside = f"{path}/meta.{version}"
    spark.createDataFrame([(source_hash, version)], "source_hash string, version string").coalesce(1).write.json(aside)
    files, meta = _files(spark, f"{path}/meta")
    files.delete(meta, True)
    files.rename(_files(spark, aside)[1], meta)
    if before is not None:
        files.delete(_files(spark, f"{path}/{before['version']}")[1], True)


def _meta(spark: SparkSession, path: str):
    files, at = _files(spark, f"{path}/meta")
    return spark.read.schema("source_hash string, version string").json(f"{path}/meta").first() if files.exists(at) else None


def load_graph(spark: SparkSession, path: str, source_hash: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The kept graph as ``nodes, edges``; none if there is none, or if it is of another ``source_hash`` than the one given."""
    meta = _meta(spark, path)
    if meta is None or (source_hash is not None and meta["source_hash"] != source_hash):
        return None
    return tuple(spark.read.parquet(f"{path}/{meta['version']}/{name}") for name in ("nodes", "edges"))


def graph(spark: SparkSession, path: str, source_hash: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The kept graph of these sources, built and kept only if what they hash to has changed."""
    found = load_graph(spark, path, source_hash)
    if found is None:
        save_graph(*build(), path, source_hash)
        found = load_graph(spark, path, source_hash)
    return found


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """``profile, digest``: of a profile's chunk ids and vectors, whatever their order, without gathering them: counts and sums of hashes."""
    h = F.xxhash64("chunk_id", "v").cast("decimal(38,0)")
    g = F.xxhash64(F.lit(1), "chunk_id", "v").cast("decimal(38,0)")
    return chunks.groupBy("profile").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(h), F.sum(g)).alias("digest"))


def refresh_centroids(kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """``profile, vec, digest`` of all profiles with chunks: kept rows where the digest still holds, new means elsewhere; profiles without chunks go."""
    now = chunk_digests(chunks)
    same = kept.join(now, ["profile", "digest"], "left_semi")
    changed = now.join(kept.select("profile", "digest"), ["profile", "digest"], "left_anti")
    fresh = centroids(chunks.join(changed.select("profile"), "profile", "left_semi")).join(changed, "profile")
    return same.select("profile", "vec", "digest").unionByName(fresh.select("profile", "vec", "digest"))


def with_centroids(profiles: DataFrame, kept: DataFrame) -> DataFrame:
    """Profiles that have a centroid, with it."""
    return profiles.join(kept.select("profile", "vec"), "profile")
