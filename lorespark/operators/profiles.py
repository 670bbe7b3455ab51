"""Profile listings, statistics, coverage, record views, export selection, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions.text import artifact_problems, tokens
from ..session import settled
from .greedy import choose, overlap_likeness


def trial_stats(trials: DataFrame) -> DataFrame:
    """By profile: totals; enrollment is null if any trial's is."""
    return trials.groupBy("profile").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "pi").alias("as_pi"),
        F.count_if(F.col("sponsor") == "industry").alias("industry"), F.count_if(F.col("status") == "completed").alias("completed"),
            F.when(F.count(F.lit(1)) == F.count("enrollment"), F.sum("enrollment")).alias("enrollment"))


def paper_stats(papers: DataFrame) -> DataFrame:
    own = lambda p: F.count_if(F.col("position") == p)
    return papers.groupBy("profile").agg(F.count(F.lit(1)).alias("total"), own("first").alias("as_first"), own("last").alias("as_last"),
        own("middle").alias("as_middle"), F.count_if(F.col("position").isNull()).alias("unknown"), F.count_if("corresponding").alias("corresponding"),
            F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def coverage(papers: DataFrame, updated: DataFrame, as_of: str) -> DataFrame:
    """Counts, years, staleness and caveats by profile of ``updated(profile, updated)``.

    Refreshed at the update or when the newest paper's year began, whichever is later. The score is the days since
    that year began, without a year since the update, over 365, at most 1; a profile of neither counts from 1970.
    """
    day = F.to_date(F.lit(as_of))
    stats = papers.groupBy("profile").agg(F.count(F.lit(1)).alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    newest = F.make_date("last_year", F.lit(1), F.lit(1))
    since = F.date_diff(day, F.coalesce(F.greatest(F.to_date("updated"), newest), F.lit("1970-01-01").cast("date")))
    out = updated.join(stats, "profile", "left").withColumn("days_since_update", since)
    out = out.withColumn("score", F.least(F.lit(1.0), F.coalesce(F.date_diff(day, newest), F.col("days_since_update")) / 365.0))
    out = out.withColumn("label", F.when(F.col("score") < 0.25, "fresh").when(F.col("score") < 0.75, "aging").otherwise("stale"))
    # The sentences of the caveats.
    covers = F.format_string("Index covers %d papers from %d-%d; preprints since then may be missing.", "papers", "first_year", "last_year")
    refreshed = F.format_string("Profile last refreshed %d days ago (label: %s).", "days_since_update", "label")
    return out.withColumn("caveats", F.array_compact(F.array(F.when(F.col("last_year").isNotNull(), covers), refreshed)))


def export_scores(papers: DataFrame) -> DataFrame:
    """1.5 * (2 for a leading position, else 1) + ln(1 + citations) + recency, scaled to 0..1 within the profile."""
    w = Window.partitionBy("profile")
    lo, hi = F.min("year").over(w), F.max("year").over(w)
    recency = F.coalesce((F.col("year") - lo) / F.when(hi == lo, 1).otherwise(hi - lo), F.lit(0.0))
    raw = 1.5 * F.when(F.col("position").isin("first", "last") | F.coalesce("corresponding", F.lit(False)), 2).otherwise(1) + F.log1p(F.coalesce("cites", F.lit(0))) + recency
    own = papers.withColumn("raw", raw.cast("double"))
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    return own.withColumn("score", (F.col("raw") - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo))


def select_export(papers: DataFrame, n: int = 40, diversity: float = 0.7, common: float = 0.6) -> DataFrame:
    """Greedy choice a profile: score less the largest token overlap with what is chosen; then newest first.

    Tokens that more than ``common`` of a profile's papers have say nothing and are left out. Profiles of any length:
    papers are looked at where they lie, and only heads are gathered (``greedy.choose``).
    """
    scored = export_scores(papers).withColumn("tokens", F.array_distinct(tokens("title")))
    scored = settled(scored.select("profile", "paper", F.coalesce("title", F.lit("")).alias("__title"), "title", "year", "score", "tokens"))
    size = scored.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    often = scored.select("profile", F.explode("tokens").alias("t")).groupBy("profile", "t").agg(F.count(F.lit(1)).alias("df")).join(size, "profile")
    usual = often.where(F.col("df") > common * F.col("n")).groupBy("profile").agg(F.collect_list("t").alias("usual"))  # under 1 / common of a paper's tokens each
    own = scored.join(usual, "profile", "left").withColumn("__own", F.array_except("tokens", F.coalesce("usual", F.array().cast("array<string>"))))
    chosen = choose(own.select("profile", "paper", "__title", "title", "year", "score", "__own"), ["profile"], n, "__own", ["paper", "__title"],
        overlap_likeness, 0.0, 1.0, diversity, False)
    return chosen.select("profile", "paper", "title", "year", "score").orderBy("profile", F.col("year").desc_nulls_last(), "title")


def summary_rows(profiles: DataFrame, papers: DataFrame) -> DataFrame:
    """Listing rows: papers, share with full text, contaminated papers, clinical flag."""
    agg = papers.groupBy("profile").agg(F.count(F.lit(1)).alias("papers"),
        F.round(100 * F.avg(F.col("has_text").cast("int")), 1).alias("fulltext_pct"), F.count_if("contaminated").alias("contaminated"))
    none = F.lit(0).cast("long")
    return profiles.join(agg, "profile", "left").withColumns({"papers": F.coalesce("papers", none), "contaminated": F.coalesce("contaminated", none)})


def top_interests(interests: DataFrame, n: int = 8) -> DataFrame:
    """Heaviest ``n`` labels a profile, a null weight as 0, with the number of all."""
    order = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "ordinal"))
    own = interests.withColumn("r", order)
    return own.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= n, F.struct("r", "label")))),
        lambda s: s["label"]).alias("labels"), F.count(F.lit(1)).alias("total"))


def violations(artifacts: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Rule violations ``(profile, pointer, keyword)``: absolute or missing urls, unknown tiers, unclean text."""
    from ..functions.tiers import TIERS
    from .privacy import unresolved

    rule = lambda cond, word: artifacts.where(cond).select("profile", F.col("url").alias("pointer"), F.lit(word).alias("keyword"))
    out = rule(F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), "relative_url").unionByName(rule(F.col("tier").isNotNull() & ~F.col("tier").isin(*TIERS), "enum"))
    out = out.unionByName(unresolved(artifacts).select("profile", F.col("url").alias("pointer"), F.lit("derived_from").alias("keyword")))
    if bodies is not None:
        out = out.unionByName(artifacts.select("profile", "url").join(bodies, "url", "left_anti").select("profile", F.col("url").alias("pointer"),
            F.lit("content_url_missing").alias("keyword")))
        bad = artifacts.select("profile", "url").join(bodies.withColumn("problem", F.explode(artifact_problems("text"))), "url")
        out = out.unionByName(bad.select("profile", F.col("url").alias("pointer"), F.col("problem").alias("keyword")))
    return out


def parse_works(raw: DataFrame, json: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat works of raw JSON records: a work needs title and year; topics primary first, without repeats. Columns in ``keep`` stay."""
    v = F.try_parse_json(json)
    get = lambda path, kind="string": F.try_variant_get(F.col("v"), path, kind)
    own = raw.withColumn("v", v).where("v is not null")
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    topics = F.concat(F.array(get("$.primary_topic.id")), F.coalesce(F.from_json(get("$.topics"), "array<struct<id:string>>")["id"], F.array().cast("array<string>")))
    index = F.from_json(get("$.abstract_inverted_index"), "map<string,array<int>>")
    from ..functions.text import decode_inverted_index

    return own.select(
        tail(get("$.id")).alias("openalex_id"), get("$.title").alias("title"), get("$.publication_year", "int").alias("year"), I.normalize_doi(get("$.doi"), True).alias("doi"),
        get("$.type").alias("type"), get("$.cited_by_count", "int").alias("cited_by_count"), decode_inverted_index(index).alias("abstract"),
        F.array_distinct(F.transform(F.array_compact(topics), tail)).alias("topic_ids"), *keep,
    ).where("title is not null and trim(title) <> '' and year is not null")


def bibtex(papers: DataFrame) -> DataFrame:
    """BibTeX text of each ``(paper, title, year, authors, venue, doi, url)``; missing and empty fields are left out.

    The address is that of the DOI where there is one. A paper without an id is called ``ref``.
    """
    field = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"  {name}={{"), c.cast("string"), F.lit("}")))
    doi = F.nullif(F.col("doi"), F.lit(""))
    authors = F.when(F.size("authors") > 0, F.array_join("authors", " and "))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.col("url"))
    fields = F.array(field("title", F.col("title")), field("author", authors), field("year", F.col("year")), field("journal", F.col("venue")), field("doi", doi), field("url", url))
    key = F.coalesce(F.nullif(F.col("paper").cast("string"), F.lit("")), F.lit("ref"))
    return papers.select("paper", F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(F.array_compact(fields), ",\n"), F.lit("\n}")).alias("bibtex"))


def vocabulary_search(terms: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """``terms(code, label, synonyms)``: exact label, prefix, all words, exact synonym, substring; then label, code."""
    q = query.strip().lower()
    label = F.lower("label")
    words = F.array(*[F.lit(w) for w in q.replace(",", " ").split()])
    have = F.split(F.regexp_replace(label, ",", " "), r"\s+")
    low = F.transform("synonyms", F.lower)
    rank = F.when(label == q, 0).when(F.startswith(label, F.lit(q)), 1).when(F.size(F.array_except(words, have)) == 0,
        2).when(F.array_contains(low, q), 3).when(F.contains(label, F.lit(q)) | F.exists(low, lambda s: F.contains(s, F.lit(q))), 4)
    return terms.withColumn("rank", rank).where("rank is not null").orderBy("rank", "label", "code").limit(limit).select("code", "label", "rank")
