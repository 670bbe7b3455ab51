"""Research interests: prevalence of topics, scores, precedence, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Fixed value: the vocabulary of topics.
TOPICS = "https://openalex.org/topics"


def topic_prevalence(topics: DataFrame, top_n: int = 15, min_share: float = 0.05) -> DataFrame:
    """``topics(profile, paper, topic)``: share of papers with any topic; the first ``top_n``, then the share's cut."""
    total = topics.groupBy("profile").agg(F.count_distinct("paper").alias("papers"))
    each = topics.distinct().groupBy("profile", "topic").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("n"), "topic"))
    out = each.withColumn("rank", rank).where(F.col("rank") <= top_n).join(total, "profile")
    return out.withColumn("share", F.col("n") / F.col("papers")).where(F.col("share") >= min_share)


def top_topics(topics: DataFrame, k: int = 10) -> DataFrame:
    """``topics(profile, ordinal, topic)``: most frequent, ties by first appearance."""
    each = topics.groupBy("profile", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= k)


def effective(interests: DataFrame) -> DataFrame:
    """One entry a concept: declared before others, then newest, then earliest in the list.

    Output order ``position``: first appearance of the concept.
    """
    key = F.coalesce(F.concat_ws("|", F.when(F.col("code").isNotNull(), F.col("system")), F.col("code")), F.lit(""))
    key = F.when(F.col("code").isNull(), F.concat(F.lit("text|"), F.lower("label"))).otherwise(key)
    w = Window.partitionBy("profile", "concept")
    rank = F.row_number().over(w.orderBy(F.desc(F.col("method") == "declared"), F.col("asserted_at").desc_nulls_last(), "ordinal"))
    return interests.withColumn("concept", key).withColumn("position", F.min("ordinal").over(w)).withColumn("r", rank).where("r = 1").drop("r")


def topic_code(topic) -> F.Column:
    """The topic's id: what follows the last slash of its IRI, in upper case."""
    return F.upper(F.element_at(F.split(F.col(topic) if isinstance(topic, str) else topic, "/"), -1))


def _mapped(interests: DataFrame, system: str) -> DataFrame:
    """Entries that a topic's id can meet: of the vocabulary, with a code, and not marked ``unmapped`` where that column is there."""
    own = interests.where((F.col("system") == system) & F.col("code").isNotNull())
    if "unmapped" in interests.columns:
        own = own.where(~F.coalesce("unmapped", F.lit(False)))
    return own.withColumn("code", F.upper("code"))


def topic_score(works: DataFrame, interests: DataFrame, system: str = TOPICS) -> DataFrame:
    """``works(work, topic)`` against effective ``interests(profile, system, code, weight, method, share[, unmapped])``.

    Topics meet codes on the exact id, within the vocabulary ``system``; unmapped concepts have no say. Declared weights
    add up; one of -1 or less makes the score null; an entry without a declared weight adds half its share. Works with the same
    topics score alike: each set of topics is scored once, and its scores go to its works.
    """
    own = _mapped(interests, system)
    # a code has no slash
    codes = works.select("work", topic_code("topic").alias("code")).where("code IS NOT NULL").groupBy("work").agg(F.array_join(F.array_sort(F.collect_set("code")), "/").alias("codes"))
    pairs = codes.select("codes").distinct().select("codes", F.explode(F.split("codes", "/")).alias("code")).join(own, "code")
    declared = (F.col("method") == "declared") & F.col("weight").isNotNull()
    part = F.when(declared, F.col("weight")).otherwise(0.5 * F.coalesce("share", F.lit(0.0)))
    out = F.coalesce(F.bool_or(declared & (F.col("weight") <= -1)), F.lit(False))
    scored = pairs.groupBy("profile", "codes").agg(F.when(~out, F.sum(part)).alias("topic_score"))
    return codes.join(scored, "codes").select("profile", "work", "topic_score")


def topic_matches(works: DataFrame, interests: DataFrame, system: str = TOPICS) -> DataFrame:
    """``profile, work, topics``: labels of a work's topics that raise it, in the order of ``works(work, ordinal, topic)``."""
    own = _mapped(interests, system)
    pairs = works.groupBy("work", topic_code("topic").alias("code")).agg(F.min("ordinal").alias("ordinal")).join(own, "code")
    declared = (F.col("method") == "declared") & F.col("weight").isNotNull()
    raises = F.when(declared, F.col("weight") > 0).otherwise(F.coalesce("share", F.lit(0.0)) != 0)
    named = F.struct("ordinal", F.coalesce("label", "code").alias("label"))
    return pairs.where(raises).groupBy("profile", "work").agg(F.transform(F.array_sort(F.collect_list(named)), lambda s: s["label"]).alias("topics"))


def shared_topics(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left(profile, code)`` and ``right(asked, code)``: sorted codes that both have, of pairs that share one."""
    return left.distinct().join(right.distinct(), "code").groupBy("profile", "asked").agg(F.array_sort(F.collect_list("code")).alias("topics"))


def project(interests: DataFrame) -> DataFrame:
    """Labels by sign of weight, in order; null and 0 in neither."""
    own = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("position", "label")))), lambda s: s["label"])
    return interests.groupBy("profile").agg(own(F.col("weight") > 0).alias("interests"), own(F.col("weight") < 0).alias("not_interests"))


def band(weight):
    """Reading bands of weights; null is unrated, never 0."""
    w = F.col(weight)
    return F.when(w.isNull(), "unrated").when(w <= -1, "never").when(w < 0, "lower").when(w == 0, "neutral").when(w >= 1, "core").otherwise("interested")


def from_text(texts: DataFrame) -> DataFrame:
    """``texts(profile, ordinal, label, positive)``: text entries of weight 0.5 or -0.5, first of each folded label."""
    key = F.lower(F.trim("label"))
    first = F.row_number().over(Window.partitionBy("profile", key).orderBy(F.desc("positive"), "ordinal"))
    return texts.where(key != "").withColumn("r", first).where("r = 1").select("profile", "ordinal", F.trim("label").alias("label"),
        F.when(F.col("positive"), 0.5).otherwise(-0.5).alias("weight"))


def replace_generated(existing: DataFrame, generated: DataFrame, prefix: str) -> DataFrame:
    """Entries of a generator, declared ones apart, give way to its new ones."""
    stay = (F.col("method") == "declared") | ~F.coalesce(F.startswith("generator", F.lit(prefix)), F.lit(False))
    return existing.where(stay).unionByName(generated)
