"""Readers and writers: profile folders, tables of one version, vectors as blobs, all-or-nothing publishing."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..schemas import TABLES
from ..session import settled


def read_profile_folders(spark: SparkSession, root: str) -> DataFrame:
    """``slug, document`` (variant), one row a folder with a profile document; dot folders are skipped, bad JSON is null."""
    raw = spark.read.text(f"{root}/*/profile.jsonld", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("slug"), "value")
    return raw.where(~F.startswith("slug", F.lit("."))).select("slug", F.try_parse_json("value").alias("document"))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A declared table, never inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root``: url, size and sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path").alias("url"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


@F.pandas_udf(ST.ArrayType(ST.ArrayType(ST.FloatType())))
def decode_vectors(blob: pd.Series, dim: pd.Series) -> pd.Series:
    """Row-major little-endian float32 rows; null if the length is not a multiple of the dimension."""
    return pd.Series([np.frombuffer(b, "<f4").reshape(-1, d).tolist() if b is not None and d and len(b) % (4 * d) == 0 else None for b, d in zip(blob, dim, strict=True)])


@F.pandas_udf(ST.BinaryType())
def encode_vectors(rows: pd.Series) -> pd.Series:
    return pd.Series([b"".join(struct.pack(f"<{len(v)}f", *v) for v in r) if r is not None else None for r in rows])


# Keys that lead a canonical document.
LEADING_KEYS = ("@context", "@id", "@type", "conformsTo", "name", "identifier")


def canonical_json(obj) -> str:
    """Leading keys, then alphabetical; nulls and empty values go; two-space indent; no ASCII escapes."""

    def clean(x):
        if isinstance(x, dict):
            kept = {k: clean(v) for k, v in x.items()}
            kept = {k: v for k, v in kept.items() if v not in (None, "", [], {})}
            return {k: kept[k] for k in sorted(kept, key=lambda k: (LEADING_KEYS.index(k) if k in LEADING_KEYS else len(LEADING_KEYS), k))}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(obj), indent=2, ensure_ascii=False) + "\n"


@F.pandas_udf(ST.StringType())
def canonical(s: pd.Series) -> pd.Series:
    return s.map(lambda t: canonical_json(json.loads(t)), na_action="ignore")


def content_hash(document: str, soul: str | None) -> str:
    return hashlib.sha256((canonical_json(json.loads(document)) + (soul or "")).encode()).hexdigest()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def rename(profiles: DataFrame, aliases: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``moves(slug, new_slug)``: renamed profiles, and aliases one hop from every old slug; a live slug is no alias."""
    m = F.broadcast(moves)
    out = profiles.join(m, "slug", "left").withColumn("slug", F.coalesce("new_slug", "slug")).drop("new_slug")
    added = profiles.join(m, "slug").select(F.col("slug").alias("old_slug"), "profile_id")
    return out, upsert(aliases, added, ["old_slug"]).join(out.select(F.col("slug").alias("old_slug")), "old_slug", "left_anti")


def merge_identity(aliases: DataFrame, retired: DataFrame) -> DataFrame:
    """``retired(old, new)`` into ``aliases(old, new)``: every chain ends in one hop."""
    r = retired.withColumnRenamed("old", "o").withColumnRenamed("new", "n")
    moved = aliases.join(r, aliases["new"] == r["o"], "left").select("old", F.coalesce("n", "new").alias("new"))
    return upsert(moved, retired, ["old"])


def publish(df: DataFrame, path: str, previous: DataFrame | None, key: str) -> DataFrame | None:
    """Write all or nothing, and name what the last run wrote and this one did not.

    The table is written beside ``path`` and takes its name only when whole; the one before goes last, so a
    failed write leaves it as it was. ``previous`` may read ``path`` itself.
    """
    gone = settled(previous.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")) if previous is not None else None
    aside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(aside)
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at, new, was = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside, old))
    files = at.getFileSystem(conf)
    held = files.exists(at)
    if held and not files.rename(at, was):
        raise OSError(f"{path} could not be moved")
    if not files.rename(new, at):
        if held:
            files.rename(was, at)
        raise OSError(f"{aside} could not take the name {path}")
    if held:
        files.delete(was, True)
    return gone


def pages(fetch, size: int = 1000) -> Iterator:
    """Rows of a paged source: follows tokens, else page numbers."""
    page, token = 0, None
    while True:
        got = fetch(page=page, size=size, token=token)
        yield from got["items"]
        token = got.get("next")
        page += 1
        if not token and page >= got.get("total_pages", 0):
            return
