"""Shared plumbing: the shared folder, written tables, native hashing of documents, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a Parquet row group, which a writer holds in memory.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset in local mode (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if found := spark.sparkContext.getCheckpointDir():
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="lorespark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lorespark/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return read_written(df.sparkSession, write_table(df, what), df)


def write_table(df: DataFrame, what: str, block_bytes: int = ROW_GROUP) -> str:
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").option("parquet.block.size", str(block_bytes)).parquet(path)
    return path


class Scratch:
    """Tables of one run, in a folder of their own that is deleted at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, new_path(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.path}/{what}"
        df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        return read_written(self.spark, path, df)

    def __exit__(self, *_) -> None:
        drop_path(self.spark, self.path)


def read_written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(hadoop).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod3(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3; null ids have null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges(u, v)``: longs, undirected, null-free. Alternates large-star and small-star (each a
    min-aggregation and a join, so a hub is never gathered into one row) until the edges are a
    star forest. Each round is written to the shared folder; the driver sees two numbers a round.
    Empty edges give an empty result. Returns ``node, component``.
    """
    spark = edges.sparkSession
    start = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = write_table(start, "cc")
    now = read_written(spark, path, start)
    before = None
    for _ in range(rounds):
        large = _large_star(now)
        small = _small_star(large)
        new_path_ = write_table(small, "cc")
        drop_path(spark, path)
        path, now = new_path_, read_written(spark, new_path_, small)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if before == (row["n"], row["h"]):
            break
        before = (row["n"], row["h"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(now.select("v", "v").distinct().toDF("node", "component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # edges have u > v
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
