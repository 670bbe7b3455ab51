"""Fetches of an external works source: of an author, by title, by reference, and what is new to a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions.text import decode_inverted_index
from ..sources.works import read_works, record_works
from .profiles import parse_works
from .records import TOPIC_ID, filter_text

# Types of deposits that are no papers.
DEFAULT_EXCLUDE_TYPES = ("software", "other", "paratext", "libguides", "grant", "peer-review", "book")


def _tail(c) -> F.Column:
    return F.element_at(F.split(c, "/"), -1)


def _get(path: str, kind: str = "string") -> F.Column:
    """A field of the parsed work ``__v``."""
    return F.try_variant_get("__v", path, kind)


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("__v", F.try_parse_json("json"))


def _author_orcids() -> F.Column:
    """Bare ids of a raw work's authors, sorted."""
    authors = F.from_json(_get("$.authorships"), "array<struct<author:struct<orcid:string>>>")["author"]["orcid"]
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "")), _tail)))


def record(raw: DataFrame, path: str, page_size: int = 100) -> None:
    """Record raw JSON works, ``raw(json)``, as pages of a works source; rows that are no JSON, or have no id, are left out."""
    words = F.concat(F.lit(" "), I.normalize_title(F.coalesce(_get("$.title"), F.lit(""))), F.lit(" "))
    own = _parsed(raw).select(_tail(_get("$.id")).alias("id"), _get("$.publication_date").alias("published"),
        F.concat(F.lit("|"), F.array_join(_author_orcids(), "|"), F.lit("|")).alias("authors"), words.alias("words"), "json")
    record_works(own.where("id IS NOT NULL AND id <> ''"), path, page_size)


def author_works(spark: SparkSession, path: str, orcid: str) -> DataFrame:
    """Works that the source attributes to an ORCID, bare or as an address; those without title or year are left out."""
    bare = orcid.strip().rsplit("/", 1)[-1]
    if not bare:
        return parse_works(read_works(spark, path).where("false"))
    return parse_works(read_works(spark, path, author=bare).where(F.contains("authors", F.lit(f"|{bare}|"))))


def search_title(spark: SparkSession, path: str, title: str) -> DataFrame:
    """The first hit of a title search, or none: works whose title has all the words, an equal title first, then the shortest, then by id."""
    words = spark.range(1).select(I.normalize_title(filter_text(F.lit(title))).alias("t")).first()["t"].split()
    if not words:
        return parse_works(read_works(spark, path).where("false"))
    found = read_works(spark, path, word=" ".join(words))
    for w in dict.fromkeys(words):
        found = found.where(F.contains("words", F.lit(f" {w} ")))
    equal = F.trim("words") == " ".join(words)
    return parse_works(found.orderBy(F.desc(equal), F.length("words"), "id").limit(1))


def single_work(spark: SparkSession, path: str, ref: str) -> DataFrame:
    """The work of an id, bare or as an address; none if it is missing or has no title or year."""
    wid = ref.strip().rsplit("/", 1)[-1]
    return parse_works(read_works(spark, path, id=wid).where(F.col("id") == wid))


def new_works(spark: SparkSession, path: str, since: str, topics: tuple[str, ...] = (), seeds: tuple[str, ...] = (), orcids: tuple[str, ...] = (),
    exclude_types: tuple[str, ...] = DEFAULT_EXCLUDE_TYPES) -> DataFrame:
    """Works since a date that any query finds: the columns of ``parse_works``, ``found_by``, ``cites_works``, ``author_orcids``.

    Queries in order: topic (ids of topics or concepts), text (labels, all words of one in title or abstract), cites
    (a seed among the references), followed (an author). A work is one row, by its id, else its lower title;
    ``found_by`` names all that found it. All queries are one pass over the source; no page limit applies.
    """
    if not (topics or seeds or orcids):
        raise ValueError("new works need topics, seeds or authors")
    bare = lambda xs: [x.strip().rsplit("/", 1)[-1] for x in xs if x and x.strip()]
    seeds, orcids = bare(seeds), bare(orcids)
    terms = spark.createDataFrame([(t,) for t in topics], "t string").select(
        F.upper(F.regexp_extract(F.trim("t"), TOPIC_ID, 1)).alias("id"), F.trim("t").rlike(TOPIC_ID).alias("coded"), I.normalize_title(filter_text("t")).alias("words")).collect()
    ids, labels = {t["id"] for t in terms if t["coded"]}, [t["words"].split() for t in terms if not t["coded"] and t["words"]]
    raw = _parsed(read_works(spark, path, since=since).where(F.col("published") >= since))
    strings = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<string>")
    listed = lambda p: F.coalesce(F.transform(F.from_json(_get(p), "array<struct<id:string>>")["id"], lambda x: F.upper(_tail(x))), strings([]))
    refs = F.coalesce(F.transform(F.from_json(_get("$.referenced_works"), "array<string>"), _tail), strings([]))
    abstract = decode_inverted_index(F.from_json(_get("$.abstract_inverted_index"), "map<string,array<int>>"))
    body = F.split(F.concat(F.col("words"), I.normalize_title(F.coalesce(abstract, F.lit("")))), " ")
    has = F.lit(False)
    for words in labels:
        has = has | (F.size(F.array_except(strings(words), F.col("body"))) == 0)
    own = raw.select("*", body.alias("body"),
        F.concat(listed("$.topics"), listed("$.concepts"), F.array(F.upper(_tail(F.coalesce(_get("$.primary_topic.id"), F.lit("")))))).alias("codes"),
            F.array_sort(F.array_intersect(refs, strings(seeds))).alias("cites_works"), _author_orcids().alias("author_orcids"))
    kinds = {"topic": F.arrays_overlap("codes", strings(ids)) if ids else F.lit(False), "text": has, "cites": F.size("cites_works") > 0,
        "followed": F.arrays_overlap("author_orcids", strings(orcids)) if orcids else F.lit(False)}
    own = own.withColumn("found_by", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).where(F.size("found_by") > 0)
    works = parse_works(own, keep=("found_by", "cites_works", "author_orcids")).where(~F.coalesce(F.col("type"), F.lit("")).isin([t.strip().lower() for t in exclude_types]))
    key = F.coalesce(F.when(F.col("openalex_id") != "", F.col("openalex_id")), F.concat(F.lit("title:"), F.lower("title")))
    first = Window.partitionBy("key").orderBy("title", "year", F.to_json(F.struct("*")))
    every = Window.partitionBy("key")
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c).over(every)))
    order = F.array(*[F.lit(k) for k in kinds])
    one = works.withColumn("key", key).withColumns({"n": F.row_number().over(first), "all": union("found_by"),
        "cites_works": F.array_sort(union("cites_works")), "author_orcids": F.array_sort(union("author_orcids"))})
    return one.where("n = 1").withColumn("found_by", F.filter(order, lambda k: F.array_contains("all", k))).drop("key", "n", "all")
