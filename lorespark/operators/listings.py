"""Filters, counts and checks of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(c: str, value: str) -> Column:
    return F.lower(F.trim(c)) == value.strip().lower()


def filter_profiles(profiles: DataFrame, text: dict[str, str] | None = None, among: dict[str, list] | None = None, conditions: list[Column] | None = None) -> DataFrame:
    """Profiles whose fields say what is asked: ``text`` without regard to case and blanks around, ``among`` one of some values, and other conditions. Nothing asked: all."""
    for field, value in (text or {}).items():
        profiles = profiles.where(_same(field, value))
    for field, values in (among or {}).items():
        profiles = profiles.where(F.col(field).isin(values))
    for c in conditions or []:
        profiles = profiles.where(c)
    return profiles


def filter_papers(papers: DataFrame, since: int | None = None, until: int | None = None, has_text: bool | None = None,
    contaminated: bool | None = False, ids: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Papers that fit, and ``missing(paper)``: asked ids that no paper has. An unknown year fits no bound; ``None`` asks for nothing."""
    out = papers
    for bound, c in ((since, F.col("year") >= F.lit(since)), (until, F.col("year") <= F.lit(until))):
        out = out if bound is None else out.where(c)
    for want, field in ((has_text, "has_text"), (contaminated, "contaminated")):
        out = out if want is None else out.where(F.coalesce(field, F.lit(False)) == want)
    kind = papers.schema["paper"].dataType
    asked = papers.sparkSession.createDataFrame([(i,) for i in ids or []], f"paper {kind.simpleString()}").distinct()
    if ids is not None:
        out = out.join(asked, "paper", "left_semi")
    return out, asked.join(papers, "paper", "left_anti")


def claim_topics(topics: DataFrame, labels: list[str]) -> DataFrame:
    """``profile`` of those with one of the labels among their ``topics(profile, topic)``."""
    return topics.where(F.lower(F.trim("topic")).isin([x.strip().lower() for x in labels])).select("profile").distinct()


def topic_profiles(topics: DataFrame) -> DataFrame:
    """``topic, profiles``: how many profiles claim each folded label."""
    return topics.select(F.lower(F.trim("topic")).alias("topic"), "profile").distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("profiles"))


def verify_citations(cited: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``cited`` rows with ``cited``: whether what they cite is known."""
    have = known.select(key).distinct().withColumn("__hit", F.lit(True))
    return cited.join(have, key, "left").withColumn("cited", F.coalesce("__hit", F.lit(False))).drop("__hit")


def trim_history(turns: DataFrame, budget: int, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Newest turns of each conversation whose texts together stay within ``budget`` characters."""
    behind = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(F.desc(order)))
    return turns.withColumn("__behind", behind).where(F.col("__behind") <= budget).drop("__behind")


def union_streams(found: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """Streams of several queries as one row a key: ``found_by``, the kinds that found it, and ``first``."""
    return found.groupBy(key).agg(F.array_sort(F.collect_set(kind)).alias("found_by"), F.min(order).alias("first"))


def merge_sets(rows: DataFrame, key: str, order: str, width: Column | None = None) -> DataFrame:
    """The first row of each key; with ``width``, rows of another width than the first of all are refused as an error."""
    from .diffs import dedup_first

    if width is not None and rows.select(width.alias("w")).distinct().limit(2).count() > 1:
        raise ValueError("vectors of several widths cannot be merged")
    return dedup_first(rows, [key], [order])


def coverage(chunks: DataFrame, enough: int) -> DataFrame:
    """``profile, chunks, seeds, indexed``: what is indexed of each profile, and whether it is more than ``enough``."""
    n = F.count(F.lit(1))
    return chunks.groupBy("profile").agg(n.alias("chunks"), F.count_if(F.col("source_type") == "seed_abstract").alias("seeds"), (n > enough).alias("indexed"))


def majority(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The most frequent value, ``value, n``; of several the one that comes first by ``order``."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first")).orderBy(F.desc("n"), "__first").limit(1).select(value, "n")


def edges_between(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``edges(src, dst, ...)`` between a person of ``left(person)`` and another of ``right(person)``, either way: two semi-joins, no pairs made."""
    l, r = left.select(F.col("person")).distinct(), right.select(F.col("person")).distinct()
    one = edges.join(l.withColumnRenamed("person", "src"), "src", "left_semi").join(r.withColumnRenamed("person", "dst"), "dst", "left_semi")
    two = edges.join(l.withColumnRenamed("person", "dst"), "dst", "left_semi").join(r.withColumnRenamed("person", "src"), "src", "left_semi")
    return one.select(*edges.columns).unionByName(two.select(*edges.columns)).dropDuplicates(["src", "dst"])
