"""Embedding of chunks: deterministic encoders as Arrow functions, incremental index builds, enumeration of chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from .diffs import diff

# Source types that each level of a profile embeds.
LEVEL_SOURCES = {"lite": ("paper_abstract", "soul", "seed_abstract"), "full": ("expertise", "soul", "paper_summary", "seed_abstract"),
    "deep": ("expertise", "soul", "paper_summary", "grant", "cv", "web", "seed_abstract")}


def hash_encoder(dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from hashed words; the offline default."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                d = hashlib.sha256(w.encode()).digest()
                out[i, d[0] % dim] += 1.0 if d[1] % 2 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)

    return encode


def embed(make: Callable[[], Callable[[list[str]], np.ndarray]], text: str) -> Column:
    """Vectors of a text column; ``make`` loads the encoder once a worker."""

    @F.pandas_udf(ST.ArrayType(ST.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for s in parts:
            yield pd.Series(encode(s.tolist()).tolist(), index=s.index)

    return run(F.col(text))


HEADED = ("expertise", "soul", "cv", "web")


def titled_text(title, abstract) -> Column:
    """Text of a grant or seed: title and abstract, blank ones left out; null for neither."""
    trimmed = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return F.nullif(F.concat_ws("\n\n", trimmed(title), trimmed(abstract)), F.lit(""))


def enumerate_chunks(sources: DataFrame, level: str, contaminated: DataFrame | None = None) -> DataFrame:
    """``sources(profile, source_type, source_id, text)`` of a level to chunks with digests of what is embedded.

    The lite level leaves out contaminated papers. Documents with headings are cut at them; summaries
    (without their marker of an abstract alone), abstracts, grants and seeds are packed pieces that keep
    their position as index.
    """
    own = sources.where(F.col("source_type").isin(*LEVEL_SOURCES[level]))
    if level == "lite" and contaminated is not None:
        own = own.join(contaminated, ["profile", "source_id"], "left_anti")
    body = F.when(F.col("source_type") == "paper_summary", F.regexp_replace("text", r"(?i)\[abstract-only\]\s*", "")).otherwise(F.col("text"))
    each = own.select("profile", "source_type", "source_id", F.explode(T.chunk_source(body, F.col("source_type").isin(*HEADED))).alias("c"))
    return each.select("profile", "source_type", "source_id", "c.chunk_index", "c.section", "c.text", "c.embed_text",
        F.sha2(F.col("c.embed_text").cast("binary"), 256).alias("text_hash"), F.length("c.text").alias("char_count"))


CHUNK_KEY = ["profile", "source_type", "source_id", "chunk_index"]


def build_index(chunks: DataFrame, index: DataFrame, make: Callable, backend_spec: str, force: bool = False) -> DataFrame:
    """New index rows: vectors of unchanged chunks are kept, only new and changed ones are embedded.

    Rows of another backend are refused unless ``force``, which embeds all anew.
    """
    if not force and not index.where(F.col("backend_spec") != backend_spec).isEmpty():
        raise ValueError("the index is of another backend; force to rebuild")
    state = diff(index.select(*CHUNK_KEY, "text_hash"), chunks.select(*CHUNK_KEY, "text_hash"), CHUNK_KEY, "text_hash")
    todo = chunks if force else chunks.join(state.where("status in ('added', 'changed')").select(*CHUNK_KEY), CHUNK_KEY, "left_semi")
    fresh = todo.select(*CHUNK_KEY, "text_hash", "embed_text").withColumn("vector", embed(make, "embed_text")).drop("embed_text").withColumn("backend_spec", F.lit(backend_spec))
    if force:
        return fresh
    kept = index.join(state.where("status = 'kept'").select(*CHUNK_KEY), CHUNK_KEY, "left_semi")
    return kept.select(*fresh.columns).unionByName(fresh)


def index_report(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Counts of added, changed, kept and removed chunks; a vanished source counts once."""
    state = diff(index.select(*CHUNK_KEY, "text_hash"), chunks.select(*CHUNK_KEY, "text_hash"), CHUNK_KEY, "text_hash")
    live = chunks.select("profile", "source_type", "source_id").distinct().withColumn("live", F.lit(True))
    own = state.join(live, ["profile", "source_type", "source_id"], "left")
    gone = own.where("status = 'removed' and live is null").select("profile", "source_type", "source_id").distinct()
    stale = own.where("status = 'removed' and live")
    return own.where("status <> 'removed'").groupBy("status").count().unionByName(gone.select(F.lit("removed").alias("status")).unionByName(stale.select(F.lit("removed").alias("status"))).groupBy("status").count())


def flat_export(index: DataFrame, chunk_tiers: DataFrame, viewer: str) -> DataFrame:
    """Blob and chunk list of each profile and backend for a viewer: rows of hidden chunks are not in either."""
    from ..sources.tables import encode_vectors
    from .privacy import secure_view

    seen = secure_view(chunk_tiers, viewer).select(*CHUNK_KEY)
    rows = index.join(seen, CHUNK_KEY, "left_semi").groupBy("profile",
        "backend_spec").agg(F.array_sort(F.collect_list(F.struct("source_type", "source_id", "chunk_index", "vector"))).alias("r"))
    return rows.select("profile", "backend_spec", encode_vectors(F.transform("r", lambda x: x["vector"])).alias("blob"),
        F.to_json(F.transform("r", lambda x: F.struct(x["source_type"], x["source_id"], x["chunk_index"]))).alias("chunks"))
