"""Search over papers and passages: meaning and keywords, fused by rank, behind visibility tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tiers
from ..functions import vectors as V
from .lexical import MIN_COSINE, bm25, fuse, ranked
from .ranking import SEED_TYPE

# The text that each kind of chunk unlocks, and the sources of a profile's passages.
FIELDS = {"paper_summary": "summary", "paper_abstract": "abstract"}
PROFILE_SOURCES = ("soul", "expertise", "cv", "web", "grant")


def visible_chunks(chunks: DataFrame, viewer: str) -> DataFrame:
    """Chunks that may be searched: not rank-only ones, and of a ``tier`` the viewer may see (missing: private)."""
    return chunks.where((F.col("source_type") != SEED_TYPE) & tiers.allows(F.lit(viewer), F.coalesce("tier", F.lit("private"))))


def semantic_hits(chunks: DataFrame, query: Column, viewer: str, source_types: tuple[str, ...] | None = None, source_id=None, k: int | None = None) -> DataFrame:
    """``chunks`` with ``cosine``, best first: restricted by type and source and to what the viewer may see before the cut to ``k``."""
    own = visible_chunks(chunks, viewer)
    if source_types:
        own = own.where(F.col("source_type").isin(*source_types))
    if source_id is not None:
        own = own.where(F.col("source_id") == F.lit(source_id))
    scored = own.withColumn("cosine", F.round(V.cosine("v", query), 6))
    return scored.orderBy(F.desc("cosine"), "chunk_id").limit(k) if k else scored


def best_hits(hits: DataFrame, least: float = MIN_COSINE) -> DataFrame:
    """``id, cosine``: the best hit of each source at or over ``least``."""
    return hits.where(F.col("cosine") >= least).groupBy(F.col("source_id").alias("id")).agg(F.max("cosine").alias("cosine"))


def hybrid_papers(papers: DataFrame, chunks: DataFrame, text: str, query: Column | None, viewer: str, least: float = MIN_COSINE) -> DataFrame:
    """Papers for a query: ``id, score, matched_by, mode``, by fused ranks of meaning and keywords.

    ``papers(id, title, summary, abstract, journal)``, texts null that the viewer may not read. A hit counts
    if its paper carries that side's text; a paper has its best hit. Without a query vector the keyword
    ranking stands alone (mode ``keyword``). Ranks are given range by range, not in one task.
    """
    body = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "abstract", "journal")])
    by_words = ranked(bm25(papers.select("id", body.alias("body")), text, "id", "body").withColumn("b", F.round("bm25", 9)), F.desc("b"), "id").select("id", "rank")
    if query is None:
        return by_words.select("id", F.round(1.0 / (60 + F.col("rank")), 6).alias("score"), F.lit("keyword").alias("matched_by"), F.lit("keyword").alias("mode"))
    hits = semantic_hits(chunks, query, viewer, tuple(FIELDS)).join(papers.select(F.col("id").alias("source_id"), *FIELDS.values()), "source_id")
    carries = F.coalesce(*[F.when(F.col("source_type") == kind, F.col(field).isNotNull()) for kind, field in FIELDS.items()])
    by_meaning = ranked(best_hits(hits.where(carries), least), F.desc("cosine"), "id").select("id", "rank")
    return fuse(by_meaning, by_words).select("id", "score", "matched_by", F.lit("hybrid").alias("mode"))


def current_hits(chunks: DataFrame, texts: DataFrame, query: Column, viewer: str, k: int = 10) -> DataFrame:
    """The best ``k`` of 4 k visible hits whose text is still the embedded one, with it and the number of ``stale`` ones.

    ``chunks(.., char_count)`` and ``texts(chunk_id, text)``: a chunk without a text of its length is stale.
    """
    found = semantic_hits(chunks, query, viewer, k=4 * k).join(texts, "chunk_id", "left").withColumn("fresh", F.coalesce(F.length("text") == F.col("char_count"), F.lit(False)))
    rank = F.row_number().over(Window.orderBy(F.desc("fresh"), F.desc("cosine"), "chunk_id"))
    # a window over at most 4 k rows
    counted = found.withColumn("rank", rank).withColumn("stale", F.count_if(~F.col("fresh")).over(Window.partitionBy()))
    return counted.where(F.col("fresh") & (F.col("rank") <= k)).select("rank", "chunk_id", "cosine", "text", "stale")


def visible_top_hits(chunks: DataFrame, query: Column, viewer: str, k: int = 3) -> DataFrame:
    """The best ``k`` visible chunks of each profile: hidden ones are left out first, so nothing has to be fetched again."""
    scored = semantic_hits(chunks, query, viewer)
    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("cosine"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("profile", "rank", "chunk_id", "cosine")


def passages(candidates: DataFrame, text: str, query: Column | None, k: int = 8, least: float = MIN_COSINE) -> DataFrame:
    """The best ``k`` of ``candidates(id, body[, v])``: ``rank, id, score, matched_by``; keywords and, with vectors, meaning.

    Bodies of fewer than MIN_BODY characters take no part.
    """
    own = candidates.where(F.length(F.trim("body")) >= T.MIN_BODY)
    by_words = ranked(bm25(own, text, "id", "body").withColumn("b", F.round("bm25", 9)), F.desc("b"), "id").select("id", "rank")
    if query is None or "v" not in candidates.columns:
        fused = by_words.select("id", F.round(1.0 / (60 + F.col("rank")), 6).alias("score"), F.lit("keyword").alias("matched_by"),
            F.lit(None).cast("long").alias("s"), F.col("rank").alias("k"))
    else:
        near = own.where("v is not null").select("id", F.round(V.cosine("v", query), 6).alias("cosine")).where(F.col("cosine") >= least)
        fused = fuse(ranked(near, F.desc("cosine"), "id").select("id", "rank"), by_words)
    order = [F.desc("score"), F.col("s").asc_nulls_last(), F.col("k").asc_nulls_last(), F.col("id")]
    return ranked(fused, *order, top=k).select("rank", "id", "score", "matched_by")


def paper_passages(papers: DataFrame, text: str, k: int = 8) -> DataFrame:
    """Passages of full texts ``papers(paper, text)``: windows of 400 to 1,200 characters, verbatim: ``rank, paper, start, body, score``."""
    win = papers.select("paper", "text",
        F.explode(T.windows_of("text")).alias("w")).select(F.struct("paper", F.col("w.start").alias("start")).alias("id"),
            F.expr("substring(text, w.start + 1, w.end - w.start)").alias("body"))
    best = passages(win, text, None, k)
    return best.join(win, "id").select("rank", "id.paper", "id.start", "body", "score")


def profile_passages(chunks: DataFrame, text: str, query: Column | None, viewer: str, k: int = 8) -> DataFrame:
    """Passages of a profile's narrative, CV, web pages and grants: ``chunks(chunk_id, source_type, tier, body, v)``."""
    own = visible_chunks(chunks, viewer).where(F.col("source_type").isin(*PROFILE_SOURCES))
    return passages(own.withColumn("id", F.col("chunk_id")), text, query, k)


def refuse(hits: DataFrame, threshold: float = 0.5, strict: bool = True) -> DataFrame:
    """``query, refused`` of ``hits(query, score)``: a strict corpus answers only if its best hit reaches the threshold."""
    return hits.groupBy("query").agg(F.max("score").alias("top")).select("query", (F.lit(strict) & (F.coalesce("top", F.lit(0.0)) < threshold)).alias("refused"))


def comparison_groups(profiles: DataFrame) -> DataFrame:
    """``profiles(profile, backend_spec, has_centroid)`` by encoder: ``backend_spec, profiles, has_centroids``."""
    return profiles.groupBy("backend_spec").agg(F.count(F.lit(1)).alias("profiles"), F.bool_or("has_centroid").alias("has_centroids"))


# Fixed value: the encoder that a browser can run itself.
LOCAL_BACKEND = "st:all-MiniLM-L6-v2"


def search_tier(spec: Column, has_centroids: Column, verdict: Column) -> Column:
    """3 without embeddings; 1 for the local encoder once its probe agrees; else 2."""
    return F.when(spec.isNull() | (spec == "") | ~has_centroids, 3).when((spec == LOCAL_BACKEND) & F.coalesce(verdict.isin("verified", "degraded"), F.lit(False)), 1).otherwise(2)
