"""Match in full: stored background statistics, required topics, chunks by viewer, evidence, topic boost, diversification."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiers as T
from ..functions import vectors as V
from .interests import effective
from .ranking import CALIBRATION_CHUNKS, EVIDENCE_COSINE, PAPER_TYPES, SEED_TYPE, TOPK_CHUNKS, centroids, mmr
from .records import TOPIC_ID

#: Most background queries; they are part of the plan.
BACKGROUND_QUERIES = 64


def _queries(background: DataFrame) -> Column:
    """``background(query, q)`` as one constant: array of structs."""
    rows = background.select("query", "q").orderBy("query").limit(BACKGROUND_QUERIES + 1).collect()
    if len(rows) > BACKGROUND_QUERIES:
        raise ValueError(f"more than {BACKGROUND_QUERIES} background queries")
    kind = background.schema["query"].dataType.simpleString()
    return F.from_json(F.lit(json.dumps([{"query": r["query"], "q": [float(x) for x in r["q"]]} for r in rows])), f"array<struct<query:{kind},q:array<double>>>")


def background_scores(chunks: DataFrame, background: DataFrame, k: int = CALIBRATION_CHUNKS, cents: DataFrame | None = None) -> DataFrame:
    """``profile, query, raw``: what every profile scores for every background query; no row of a profile without a centroid.

    Half the centroid's similarity and half the mean score of the best ``k`` own chunks, 0 without any. The queries
    are few and constant, so chunks are scored where they lie and only the best ``k`` of a task are shuffled.
    """
    queries = _queries(background)
    own = chunks.where(F.col("source_type") != SEED_TYPE)
    scored = own.select("profile", "chunk_id", F.inline(F.transform(queries, lambda b: F.struct(b["query"].alias("query"), V.cosine("v", b["q"]).alias("cos")))))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("profile", "query").orderBy(F.desc("cos"), "chunk_id"))).where(F.col("r") <= k)
    mean = best.groupBy("profile", "query").agg(F.avg(V.hit_score("cos")).alias("c"))
    sims = (centroids(chunks) if cents is None else cents).select("profile",
        F.inline(F.transform(queries, lambda b: F.struct(b["query"].alias("query"), V.dot("vec", b["q"]).alias("sim")))))
    return sims.join(mean, ["profile", "query"], "left").select("profile", "query", (0.5 * F.col("sim") + 0.5 * F.coalesce("c", F.lit(0.0))).alias("raw"))


def calibration_of(scores: DataFrame) -> DataFrame:
    """``profile, n, s, ss, mean, std`` of background scores: counts, sums and squares, from which mean and deviation follow."""
    sums = scores.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("s"), F.sum(F.col("raw") * F.col("raw")).alias("ss"))
    return sums.select("*", (F.col("s") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2)).alias("std"))


def refreshed(scores: DataFrame, changes: DataFrame, chunks: DataFrame, background: DataFrame, k: int = CALIBRATION_CHUNKS) -> DataFrame:
    """Background scores after ``changes(profile)``: only profiles whose chunks changed are scored again, from ``chunks`` as they are now.

    A profile that has lost its last chunk loses its rows. A chunk difference is ``diffs.diff`` without what it kept.
    """
    gone = changes.select("profile").distinct()
    return scores.join(gone, "profile", "left_anti").unionByName(background_scores(chunks.join(gone, "profile", "left_semi"), background, k))


def topic_codes(interests: DataFrame, system: str) -> DataFrame:
    """``profile, code``: topics of a vocabulary that a profile offers: unweighted ones and those it weighs above 0."""
    own = effective(interests).where((F.col("system") == system) & F.col("code").isNotNull())
    return own.where(F.col("weight").isNull() | (F.col("weight") > 0)).select("profile", "code").distinct()


def required(topics: list[str], codes: DataFrame, labels: DataFrame) -> DataFrame:
    """``profile`` of those that claim one of ``topics``: a topic id among ``codes(profile, code)``, or a label of ``labels(profile, label)``."""
    asked = codes.sparkSession.createDataFrame([(t.strip(), t.lower()) for t in topics] or [("", None)], "t string, low string")
    ids = asked.where(F.col("t").rlike(TOPIC_ID)).select(F.upper(F.regexp_extract("t", TOPIC_ID, 1)).alias("code"))
    names = asked.where(~F.col("t").rlike(TOPIC_ID)).select(F.col("low").alias("label"))
    by_id = codes.withColumn("code", F.upper("code")).join(ids, "code", "left_semi").select("profile")
    by_label = labels.withColumn("label", F.lower("label")).join(names, "label", "left_semi").select("profile")
    return by_id.union(by_label).distinct()


def asked_topics(interests: DataFrame, codes: DataFrame, system: str) -> DataFrame:
    """``profile, topic_score, matched_topics`` of profiles with a topic of the query side's ``interests`` (columns of one profile).

    Declared weights add up, one of -1 or less makes the score null; others add half their share.
    """
    own = effective(interests.withColumn("profile", F.lit(0))).where((F.col("system") == system) & F.col("code").isNotNull()).select("code", "weight", "method", "share")
    declared = (F.col("method") == "declared") & F.col("weight").isNotNull()
    part = F.when(declared, F.col("weight")).otherwise(0.5 * F.coalesce("share", F.lit(0.0)))
    out = F.coalesce(F.bool_or(declared & (F.col("weight") <= -1)), F.lit(False))
    wanted = F.array_sort(F.collect_set(F.when(F.col("weight").isNull() | (F.col("weight") > 0), F.col("code"))))
    met = codes.join(own, "code").groupBy("profile").agg(F.sum(part).alias("topic_score"), out.alias("out"), wanted.alias("matched_topics"))
    return met.select("profile", F.when(~F.col("out"), F.col("topic_score")).alias("topic_score"), "matched_topics")


def overlapping_topics(labels: DataFrame, query: Column, threshold: float = EVIDENCE_COSINE) -> DataFrame:
    """``profile, overlapping_topics`` of ``labels(profile, ordinal, label, v)`` near enough to the query to be evidence, in order."""
    near = labels.where((F.coalesce("label", F.lit("")) != "") & (V.cosine("v", query) >= threshold))
    return near.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "label"))), lambda s: s["label"]).alias("overlapping_topics"))


def evidence(chunks: DataFrame, query: Column, k: int = TOPK_CHUNKS, viewers: DataFrame | None = None) -> DataFrame:
    """``profile, chunk_score, top_chunks, top_papers`` by the best ``k`` own chunks that the viewer may see.

    ``viewers(profile, viewer)``: the tier the caller may see of each profile, against ``chunks.tier`` (a missing one is private); a
    profile without a row is seen in public. What is hidden is left out before the cut, as if it were not indexed.
    """
    own = chunks.where(F.col("source_type") != SEED_TYPE)
    if viewers is not None:
        own = own.join(viewers, "profile", "left").where(T.allows(F.coalesce("viewer", F.lit("public")), F.coalesce("tier", F.lit("private"))))
    scored = own.withColumn("c", V.cosine("v", query)).withColumn("rank",
        F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("c"), "chunk_id"))).where(F.col("rank") <= k)
    hit = F.struct("rank", "chunk_id", "source_type", "source_id", F.round("c", 4).alias("cosine"), V.hit_score("c").alias("score"))
    each = scored.groupBy("profile").agg(F.avg(V.hit_score("c")).alias("chunk_score"), F.array_sort(F.collect_list(hit)).alias("top_chunks"))
    papers = F.transform(F.filter("top_chunks", lambda h: h["source_type"].isin(*PAPER_TYPES)), lambda h: h["source_id"])
    return each.withColumn("top_papers", F.array_distinct(papers))


def match_in_full(cents: DataFrame, chunks: DataFrame, query: Column, k: int = 5, prefilter: int = 10, calibration: DataFrame | None = None,
    allowed: DataFrame | None = None, viewers: DataFrame | None = None, labels: DataFrame | None = None, topics: DataFrame | None = None,
        topic_alpha: float = 0.2, diversify: bool = True, lambda_: float = 0.5, topk_chunks: int = TOPK_CHUNKS) -> DataFrame:
    """Profiles ranked for a query, with the evidence behind each score.

    ``profile, score, centroid_score, chunk_score, top_chunks, top_papers, overlapping_topics, matched_topics, pick``. The
    ``max(prefilter, k)`` profiles of the nearest centroids among those ``allowed(profile)`` are scored by their chunks
    (``evidence``), put on their own scale by stored ``calibration`` (``calibration_of``; raw where there is no row), raised by
    ``topics`` (``asked_topics``; an excluded profile drops out, one without a shared topic stays), ordered, diversified
    where there are more than ``k``, and cut. Ties go to the smaller profile.
    """
    own = cents if allowed is None else cents.join(allowed.select("profile"), "profile", "left_semi")
    kept = own.withColumn("centroid_score", V.dot("vec", query)).orderBy(F.desc("centroid_score"), "profile").limit(max(prefilter, k))
    few = F.broadcast(kept.select("profile"))  # max(prefilter, k) rows
    found = kept.join(evidence(chunks.join(few, "profile", "left_semi"), query, topk_chunks, viewers), "profile", "left")
    found = found.withColumn("chunk_score", F.coalesce("chunk_score", F.lit(0.0))).withColumn("score", 0.5 * F.col("centroid_score") + 0.5 * F.col("chunk_score"))
    if calibration is not None:
        found = found.join(calibration.select("profile", "mean", "std"), "profile", "left").withColumn("score",
            F.coalesce(V.calibrated("score", "mean", "std"), F.col("score"))).drop("mean", "std")
    none = F.array().cast("array<string>")
    if topics is not None:
        told = topics.select("profile", F.lit(True).alias("shares"), "topic_score", "matched_topics")
        found = found.join(told, "profile", "left").where(F.col("shares").isNull() | F.col("topic_score").isNotNull())
        found = found.withColumn("score", F.col("score") + topic_alpha * F.coalesce("topic_score", F.lit(0.0))).drop("shares", "topic_score")
    else:
        found = found.withColumn("matched_topics", none)
    if labels is not None:
        found = found.join(overlapping_topics(labels.join(few, "profile", "left_semi"), query), "profile", "left")
    else:
        found = found.withColumn("overlapping_topics", none)
    for name in ("matched_topics", "overlapping_topics"):
        found = found.withColumn(name, F.coalesce(name, none))
    for name in ("top_chunks", "top_papers"):
        found = found.withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    columns = ["profile", "score", "centroid_score", "chunk_score", "top_chunks", "top_papers", "overlapping_topics", "matched_topics"]
    if diversify:
        return mmr(found.select(*columns, "vec"), k, lambda_, at_most=max(prefilter, k)).select(*columns, "pick")
    top = found.select(*columns).orderBy(F.desc("score"), "profile").limit(k)
    return top.withColumn("pick", F.row_number().over(Window.orderBy(F.desc("score"), "profile")).cast("int"))  # k rows
