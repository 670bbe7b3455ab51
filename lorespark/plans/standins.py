"""The engine's shapes laid over the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("vec_id") % 7 == 0, "seed_abstract").when(F.col("vec_id") % 2 == 0, "paper_summary").otherwise("paper_abstract")
    return table(spark, sf, "embeddings").select(F.col("label").alias("profile"), F.col("vec_id").alias("chunk_id"), kind.alias("source_type"), F.floor(F.col("vec_id") / 3).alias("source_id"), V.doubles("embedding").alias("v"))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> F.Column:
    """One stated row."""
    row = table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select(V.doubles("embedding").alias("v")).first()
    return F.array(*[F.lit(float(x)) for x in row["v"]])


CH = "ch AS (SELECT label AS profile, vec_id AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 'seed_abstract' WHEN vec_id % 2 = 0 THEN 'paper_summary' ELSE 'paper_abstract' END AS source_type, vec_id // 3 AS source_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
Q0 = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"


def mean_sql(name: str, source: str, keys: str, v: str = "v") -> str:
    """CTE ``name(keys, m)`` of component-wise means."""
    return f"{name} AS (SELECT {keys}, list(a ORDER BY i) AS m FROM (SELECT {keys}, i, avg(x) AS a FROM (SELECT {keys}, unnest({v}) AS x, generate_subscripts({v}, 1) AS i FROM {source}) GROUP BY {keys}, i) GROUP BY {keys})"


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"


CENT = f"{mean_sql('mm', 'ch', 'profile')}, cent AS (SELECT profile, {unit_sql('m')} AS vec FROM mm)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    """``parts(work, person, year, profiled, owns)``: suppliers of an order; every third is not profiled, the first line's owns."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("work"), F.col("l_suppkey").alias("person")).agg(F.min("l_linenumber").alias("line"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").alias("year"))
    return li.join(o, "work").select("work", "person", "year", (F.col("person") % 3 != 0).alias("profiled"), ((F.col("line") == 1) & (F.col("person") % 3 != 0)).alias("owns"))


PARTS = "parts AS (SELECT l.work, l.person, CAST(year(o.o_orderdate) AS INTEGER) AS year, l.person % 3 <> 0 AS profiled, l.line = 1 AND l.person % 3 <> 0 AS owns FROM (SELECT l_orderkey AS work, l_suppkey AS person, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2) l JOIN orders o ON o.o_orderkey = l.work)"
CO = "co AS (SELECT a.person AS src, b.person AS dst, count(*) AS paper_count, min(a.year) AS first_year, max(a.year) AS last_year, max(CASE WHEN a.owns AND b.owns THEN 2 WHEN a.profiled AND b.profiled THEN 1 ELSE 0 END) AS confidence FROM parts a JOIN parts b ON a.work = b.work AND a.person < b.person AND (a.profiled OR b.profiled) GROUP BY 1, 2)"


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """``stays(person, inst, lo, hi, ordinal)``: a supplier's nation from its first to its last order year; some years are open."""
    span = people(spark, sf).groupBy("person").agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"), F.concat(F.when(F.col("s_nationkey") % 2 == 0, "ror:").otherwise("inst:"), F.col("s_nationkey")).alias("inst"), F.col("s_nationkey").alias("ordinal"))
    lo = F.when(F.col("person") % 5 != 0, F.col("lo") + (F.col("person") % 4).cast("int"))
    hi = F.when((F.col("person") % 5 != 0) & (F.col("person") % 4 != 1), F.col("lo") + (F.col("person") % 4).cast("int") + 1)
    return s.join(span, "person").select("person", "inst", lo.alias("lo"), hi.alias("hi"), "ordinal")


STAYS = "stays AS (SELECT s.s_suppkey AS person, (CASE WHEN s.s_nationkey % 2 = 0 THEN 'ror:' ELSE 'inst:' END) || s.s_nationkey AS inst, CASE WHEN s.s_suppkey % 5 <> 0 THEN p.lo + s.s_suppkey % 4 END AS lo, CASE WHEN s.s_suppkey % 5 <> 0 AND s.s_suppkey % 4 <> 1 THEN p.lo + s.s_suppkey % 4 + 1 END AS hi, s.s_nationkey AS ordinal FROM supplier s JOIN (SELECT person, min(year) AS lo FROM parts GROUP BY 1) p ON p.person = s.s_suppkey)"
INST = "ie AS (SELECT a.person AS src, b.person AS dst, a.inst AS institution, CASE WHEN (a.lo IS NULL AND a.hi IS NULL) OR (b.lo IS NULL AND b.hi IS NULL) THEN NULL ELSE coalesce(a.lo, -1000000000) <= coalesce(b.hi, 1000000000) AND coalesce(b.lo, -1000000000) <= coalesce(a.hi, 1000000000) END AS overlap, CASE WHEN a.inst LIKE 'ror:%' THEN 'high' ELSE 'medium' END AS confidence FROM stays a JOIN stays b ON a.inst = b.inst AND a.person < b.person)"


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """``(profile, paper, topic)``: a supplier's orders and the types of their parts."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_suppkey").alias("profile"), F.col("l_orderkey").alias("paper"), F.col("p_brand").alias("topic"))


TOPICS = "tp AS (SELECT DISTINCT l_suppkey AS profile, l_orderkey AS paper, p_brand AS topic FROM lineitem JOIN part ON l_partkey = p_partkey)"


def interests(spark: SparkSession, sf: str) -> DataFrame:
    """``(profile, ordinal, system, code, label, weight, method, asserted_at, share)``: parts as entries of their size's profile."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (k % 20).alias("profile"), F.col("p_partkey").alias("ordinal"), F.lit("sys").alias("system"), F.when(k % 9 != 0, F.col("p_brand")).alias("code"), F.col("p_type").alias("label"),
        F.when(k % 6 != 0, (F.col("p_size") % 5 - 2) / 2.0).alias("weight"), F.when(k % 3 == 0, "declared").otherwise("inferred").alias("method"),
        F.when(k % 4 != 0, F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size"))).alias("asserted_at"), ((F.col("p_size") % 10) / 10.0).alias("share"),
    )


INTERESTS = "it AS (SELECT p_partkey % 20 AS profile, p_partkey AS ordinal, 'sys' AS system, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS code, p_type AS label, CASE WHEN p_partkey % 6 <> 0 THEN (p_size % 5 - 2) / 2.0 END::DOUBLE AS weight, CASE WHEN p_partkey % 3 = 0 THEN 'declared' ELSE 'inferred' END AS method, CASE WHEN p_partkey % 4 <> 0 THEN DATE '2020-01-01' + p_size END AS asserted_at, ((p_size % 10) / 10.0)::DOUBLE AS share FROM part)"
EFFECTIVE = "ef AS (SELECT * EXCLUDE (r) FROM (SELECT *, CASE WHEN code IS NULL THEN 'text|' || lower(label) ELSE system || '|' || code END AS concept, min(ordinal) OVER (PARTITION BY profile, CASE WHEN code IS NULL THEN 'text|' || lower(label) ELSE system || '|' || code END) AS position, row_number() OVER (PARTITION BY profile, CASE WHEN code IS NULL THEN 'text|' || lower(label) ELSE system || '|' || code END ORDER BY (method = 'declared') DESC, asserted_at DESC NULLS LAST, ordinal) AS r FROM it) WHERE r = 1)"


def papers(spark: SparkSession, sf: str) -> DataFrame:
    """``(profile, paper, title, year, position, corresponding, cites, has_text, contaminated)``: documents by source."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.col("source").alias("profile"), k.alias("paper"), F.col("text").alias("title"), F.when(k % 11 != 0, (2000 + k % 25).cast("int")).alias("year"),
        F.when(k % 4 == 0, "first").when(k % 4 == 1, "last").when(k % 4 == 2, "middle").alias("position"), (k % 6 == 0).alias("corresponding"), (k % 50).cast("int").alias("cites"),
        (k % 3 == 0).alias("has_text"), (k % 13 == 0).alias("contaminated"),
    )


PAPERS = "pp AS (SELECT source AS profile, doc_id AS paper, text AS title, CASE WHEN doc_id % 11 <> 0 THEN CAST(2000 + doc_id % 25 AS INTEGER) END AS year, CASE doc_id % 4 WHEN 0 THEN 'first' WHEN 1 THEN 'last' WHEN 2 THEN 'middle' END AS position, doc_id % 6 = 0 AS corresponding, CAST(doc_id % 50 AS INTEGER) AS cites, doc_id % 3 = 0 AS has_text, doc_id % 13 = 0 AS contaminated FROM documents)"


def artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as a manifest: url, role, paper id, tier, and what each derives from (its predecessor by id, or a role)."""
    k = F.col("page_id")
    role = F.when(k % 5 == 0, "paper_fulltext").when(k % 5 == 1, "paper_summary").when(k % 5 == 2, "cv").when(k % 5 == 3, "soul").otherwise("trials")
    tier = F.when(k % 17 == 0, "private").when(k % 7 == 0, "limited").when(k % 3 == 0, "public")
    ref = F.when((k % 10 != 0) & (k % 4 != 3), F.array(F.concat(F.lit("p"), k - 1))).when(k % 10 == 7, F.array(F.lit("nothing"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "pages").select(F.floor(k / 10).alias("profile"), F.concat(F.lit("f"), k).alias("url"), role.alias("role"), F.concat(F.lit("p"), k).alias("paper_id"), tier.alias("tier"), ref.alias("derived_from"))


ARTIFACTS = "af AS (SELECT page_id // 10 AS profile, 'f' || page_id AS url, CASE page_id % 5 WHEN 0 THEN 'paper_fulltext' WHEN 1 THEN 'paper_summary' WHEN 2 THEN 'cv' WHEN 3 THEN 'soul' ELSE 'trials' END AS role, 'p' || page_id AS paper_id, CASE WHEN page_id % 17 = 0 THEN 'private' WHEN page_id % 7 = 0 THEN 'limited' WHEN page_id % 3 = 0 THEN 'public' END AS tier, CASE WHEN page_id % 10 <> 0 AND page_id % 4 <> 3 THEN ['p' || (page_id - 1)] WHEN page_id % 10 = 7 THEN ['nothing'] ELSE CAST([] AS VARCHAR[]) END AS derived_from FROM pages)"


def profile_tiers(spark: SparkSession, sf: str) -> DataFrame:
    p = F.floor(F.col("page_id") / 10)
    return table(spark, sf, "pages").select(p.alias("profile"), F.when(p % 4 == 1, "limited").otherwise("public").alias("profile_tier")).distinct()


PTIERS = "pt AS (SELECT DISTINCT page_id // 10 AS profile, CASE WHEN (page_id // 10) % 4 = 1 THEN 'limited' ELSE 'public' END AS profile_tier FROM pages)"
ORD = lambda c: f"CASE {c} WHEN 'public' THEN 0 WHEN 'limited' THEN 1 WHEN 'private' THEN 2 END"
NAME = lambda n: f"CASE {n} WHEN 0 THEN 'public' WHEN 1 THEN 'limited' ELSE 'private' END"
