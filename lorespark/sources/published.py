"""Published collections read through Spark's file systems: documents, rosters, flat embeddings, centroid blobs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, document`` (variant) of whole JSON files; ``document`` is null where a file is no JSON."""
    raw = spark.read.text(list(paths), wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("document"))


def source_kind(document: Column | str) -> Column:
    """What a document is: a ``list`` of addresses, a ``registry`` with cards, a single ``profile``, else ``unrecognized``."""
    top = F.try_variant_get(document, "$", "map<string, variant>")
    holds = lambda key: F.coalesce(F.map_contains_key(top, F.lit(key)), F.lit(False))
    is_list = F.coalesce(F.schema_of_variant(document).startswith("ARRAY<"), F.lit(False))
    return F.when(is_list, "list").when(holds("cards"), "registry").when(holds("hasPart") | holds("subjectOf"), "profile").otherwise("unrecognized")


def roster(documents: DataFrame) -> DataFrame:
    """Profiles that load of ``documents(slug, document)``: ``slug, document``; a malformed one costs no other.

    A document loads if it is a JSON object with a name. Sort by slug where order matters; ``malformed`` has the rest.
    """
    return documents.where(_loads())


def malformed(documents: DataFrame) -> DataFrame:
    """Slugs of ``documents(slug, document)`` that ``roster`` leaves out."""
    return documents.where(~_loads()).select("slug")


def _loads() -> Column:
    return F.coalesce(F.trim(F.try_variant_get("document", "$.name", "string")) != "", F.lit(False))


def read_flat_embeddings(spark: SparkSession, *folders: str) -> DataFrame:
    """``path, row, backend_spec, chunk, vec`` of published embedding folders: ``index.json``, its blob and its chunks.

    ``chunk`` is the chunk's JSON. A blob whose length or SHA-256 is not what its index says is an error, never cut.
    Folders are paired with their files by path. A blob is one value of at most 2 GB, one profile's or collection's.
    """
    index = read_documents(spark, *[f"{f}/index.json" for f in folders])
    get = lambda path, kind: F.try_variant_get("document", path, kind)
    # the readers differ in the slashes after a scheme
    folder = lambda path: F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"^([a-z0-9]+):/+", "$1:/")
    fields = (("file", "string"), ("dim", "int"), ("count", "int"), ("sha256", "string"), ("backend_spec", "string"))
    head = index.select(folder("path").alias("path"), *[get(f"$.{name}", kind).alias(name) for name, kind in fields])
    head = head.withColumn("chunks_file", F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit(".chunks.json")))
    files = spark.read.format("binaryFile").load(list(folders)).select(folder("path").alias("path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content")
    blobs = files.withColumnRenamed("content", "blob")
    texts = files.select("path", F.col("file").alias("chunks_file"), F.col("content").cast("string").alias("chunks"))
    both = head.join(blobs, ["path", "file"]).join(texts, ["path", "chunks_file"])

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                if len(r.blob) != r.count * r.dim * 4:
                    raise ValueError(f"{r.file}: {len(r.blob)} bytes, not {r.count} rows of {r.dim} floats")
                if r.sha256 and hashlib.sha256(r.blob).hexdigest() != r.sha256:
                    raise ValueError(f"{r.file}: its SHA-256 is not its index's")
                told = json.loads(r.chunks)
                told = told["chunks"] if isinstance(told, dict) else told
                if len(told) != r.count:
                    raise ValueError(f"{r.file}: {len(told)} chunks for {r.count} rows")
                x = np.frombuffer(r.blob, "<f4").reshape(r.count, r.dim).astype(float)
                for at in range(0, r.count, 4096):
                    part, said = x[at : at + 4096], [json.dumps(c, ensure_ascii=False) for c in told[at : at + 4096]]
                    yield pd.DataFrame({"path": r.path, "row": np.arange(at, at + len(part)), "backend_spec": r.backend_spec, "chunk": said, "vec": list(part)})

    return both.select("path", "file", "dim", "count", "sha256", "backend_spec", "blob", "chunks").mapInPandas(decode,
        "path string, row long, backend_spec string, chunk string, vec array<double>")


def unit_rows(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows of a hand-made blob: a vector whose length is over 0.001 off 1 is scaled to it; zeros stay."""
    n = V.norm(vec)
    return df.withColumn(vec, F.when((n > 0) & (F.abs(n - 1) > 1e-3), F.transform(vec, lambda x: x / n)).otherwise(F.col(vec)))
