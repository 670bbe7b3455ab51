"""Fetches from a works source that is recorded from the given orders."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import works as W
from ..session import shared_folder
from .standins import table

Q, S = {}, {}
AUTHOR, SINCE = 7, "1998-06-01"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def raw_works(spark, sf):
    """``json``: an order is a work, its suppliers are the authors; every 50th has no title."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    orcid = lambda s: F.concat(F.lit("https://orcid.org/0000-000"), s)
    iri = lambda letter, n: F.concat(F.lit("https://openalex.org/"), F.lit(letter), n.cast("string"))
    work = F.struct(
        iri("W", k).alias("id"), F.when(k % 50 != 0, F.concat(F.lit("Study "), k % 997, F.lit(" of "), F.lower(F.substring("o_orderpriority", 3, 20)))).alias("title"), F.year("o_orderdate").alias("publication_year"), day.alias("publication_date"),
        F.when(k % 9 == 0, "software").otherwise("article").alias("type"), F.transform(F.coalesce("s", F.array().cast("array<bigint>")), lambda s: F.struct(F.struct(orcid(s).alias("orcid")).alias("author"))).alias("authorships"),
        F.array(F.struct(iri("T", 10000 + F.col("o_custkey") % 40).alias("id"))).alias("topics"), F.array(iri("W", k - 1), iri("W", k - 7)).alias("referenced_works"))
    return table(spark, sf, "orders").join(li, "o_orderkey", "left").select(F.to_json(work).alias("json"))


def recorded(spark, sf):
    """Path of the recorded works; they are recorded once a session."""
    path = f"{shared_folder(spark)}/lorespark/works-{hashlib.sha256(f'{spark.sparkContext.applicationId} {sf}'.encode()).hexdigest()[:16]}"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    catalog = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalog.json")
    if not catalog.getFileSystem(hadoop).exists(catalog):
        W.record(raw_works(spark, sf), path)
    return path


RAW = """wk AS (SELECT o_orderkey AS k, 'W' || o_orderkey AS id, 'Study ' || (o_orderkey % 997) || ' of ' || lower(substr(o_orderpriority, 3, 20)) AS title, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%d') AS day, 'T' || (10000 + o_custkey % 40) AS topic FROM orders WHERE o_orderkey % 50 <> 0),
au AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1)"""


@query(f"WITH {RAW} SELECT id, title, year FROM wk JOIN au USING (k) WHERE list_contains(s, {AUTHOR})")
def works_of_author(spark, sf):
    return W.author_works(spark, recorded(spark, sf), f"https://orcid.org/0000-000{AUTHOR}").select(F.col("openalex_id").alias("id"), "title", "year")


@query(f"WITH {RAW} SELECT id, title, year FROM wk WHERE contains(' ' || regexp_replace(title, '[^a-z0-9]+', ' ', 'g') || ' ', ' high ') AND contains(' ' || regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g') || ' ', ' 101 ') ORDER BY length(title), id LIMIT 1")
def work_by_title(spark, sf):
    return W.search_title(spark, recorded(spark, sf), "101, of: HIGH").select(F.col("openalex_id").alias("id"), "title", "year")


@query(f"WITH {RAW} SELECT id, title, year FROM wk WHERE id = (SELECT 'W' || max(o_orderkey) FROM orders WHERE o_orderkey % 50 <> 0)")
def work_by_id(spark, sf):
    last = table(spark, sf, "orders").where("o_orderkey % 50 <> 0").agg(F.max("o_orderkey")).first()[0]
    return W.single_work(spark, recorded(spark, sf), f"https://openalex.org/W{last}").select(F.col("openalex_id").alias("id"), "title", "year")


@query(f"""WITH {RAW}, n AS (SELECT wk.*, coalesce(s, []) AS s, list_filter(['W10', 'W30', 'W500'], lambda w: w = 'W' || (k - 1) OR w = 'W' || (k - 7)) AS c FROM wk LEFT JOIN au USING (k) WHERE day >= '{SINCE}' AND k % 9 <> 0),
f AS (SELECT id, list_filter([CASE WHEN topic = 'T10003' THEN 'topic' END, CASE WHEN contains(title, ' urgent') THEN 'text' END, CASE WHEN len(c) > 0 THEN 'cites' END, CASE WHEN list_contains(s, 3) THEN 'followed' END], lambda x: x IS NOT NULL) AS found_by, list_sort(c) AS cites_works, len(s) AS authors FROM n)
SELECT id, found_by, cites_works, CAST(authors AS INTEGER) AS authors FROM f WHERE len(found_by) > 0""")
def works_new(spark, sf):
    got = W.new_works(spark, recorded(spark, sf), SINCE, ("https://openalex.org/t10003", "URGENT"), ("https://openalex.org/W10", "W30", "W500"), ("0000-0003",))
    return got.select(F.col("openalex_id").alias("id"), "found_by", "cites_works", F.size("author_orcids").alias("authors"))
