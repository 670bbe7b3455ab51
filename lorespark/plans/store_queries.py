"""Queries of store writes, over customers as profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stores as S_
from .standins import TOPICS, table, topics

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


PR = "pr AS (SELECT c_custkey AS profile_id, 's' || c_custkey AS slug, 'r' || (c_custkey // 2) AS rid FROM customer)"
AL = "al AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 's' ELSE 'o' END || s_suppkey AS old_slug, s_suppkey * 3 AS profile_id FROM supplier)"
RE = "re AS (SELECT DISTINCT 'r' || (n_nationkey * 7 + 1000000) AS rid FROM nation)"
ST = """st AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 's' WHEN 1 THEN 'o' ELSE 'n' END || p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'r' || (p_partkey // 2) WHEN p_partkey % 3 = 1 THEN 'r' || (p_partkey * 3 // 2)
ELSE 'r' || (p_partkey + 1000000) END AS rid FROM part)"""
OUT = f"""{PR}, {AL}, {RE}, {ST}, known AS (SELECT slug, slug AS live_slug, profile_id, rid AS live_rid FROM pr UNION ALL SELECT old_slug, slug, profile_id, rid FROM al JOIN pr USING (profile_id) WHERE old_slug NOT IN (SELECT slug FROM pr)),
oc AS (SELECT st.slug, st.rid, CASE WHEN profile_id IS NULL THEN CASE WHEN st.rid IN (SELECT rid FROM re) THEN 'retired_rid' WHEN st.rid IN (SELECT rid FROM pr) THEN 'second_record' ELSE 'created' END
WHEN live_rid = st.rid THEN 'replaced' WHEN live_slug <> st.slug THEN 'former_slug' ELSE 'rid_mismatch' END AS outcome, profile_id, live_slug FROM st LEFT JOIN known USING (slug))"""
MG = "mg AS (SELECT n_nationkey * 3 + 3 AS retired_id, n_nationkey * 3 + 5 AS survivor_id FROM nation)"


def profiles(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("profile_id"), F.concat(F.lit("s"), k).alias("slug"), F.concat(F.lit("r"), F.floor(k / 2)).alias("rid"))


def aliases(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.concat(F.when(k % 4 == 0, "s").otherwise("o"), k).alias("old_slug"), (k * 3).alias("profile_id"))


def outcomes(spark, sf):
    k = F.col("p_partkey")
    slug = F.concat(F.when(k % 4 == 0, "s").when(k % 4 == 1, "o").otherwise("n"), k)
    rid = F.concat(F.lit("r"), F.when(k % 3 == 0, F.floor(k / 2)).when(k % 3 == 1, F.floor(k * 3 / 2)).otherwise(k + 1000000))
    gone = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey") * 7 + 1000000).alias("rid"))
    return S_.put_outcomes(profiles(spark, sf), aliases(spark, sf), gone, table(spark, sf, "part").select(slug.alias("slug"), rid.alias("rid")), one_record=True)


def merges(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select((k * 3 + 3).cast("long").alias("retired_id"), (k * 3 + 5).cast("long").alias("survivor_id"))


@query(f"WITH {OUT} SELECT * FROM oc")
def put_outcomes(spark, sf):
    return outcomes(spark, sf)


@query(f"WITH {OUT} SELECT slug, rid, (SELECT max(profile_id) FROM pr) + row_number() OVER (ORDER BY slug, rid) AS profile_id FROM oc WHERE outcome = 'created'")
def put_new_ids(spark, sf):
    return S_.new_ids(outcomes(spark, sf), profiles(spark, sf))


@query(f"""WITH {PR}, {AL}, gone AS (SELECT n_nationkey * 6 AS profile_id FROM nation) SELECT 'profiles' AS name, count(*) AS n FROM pr WHERE profile_id NOT IN (SELECT profile_id FROM gone)
UNION ALL SELECT 'aliases', count(*) FROM al WHERE profile_id NOT IN (SELECT profile_id FROM gone) UNION ALL SELECT 'papers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT profile_id FROM gone)""")
def delete_cascade(spark, sf):
    children = table(spark, sf, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("paper"))
    gone = table(spark, sf, "nation").select((F.col("n_nationkey") * 6).alias("profile_id"))
    left = S_.delete_cascade({"profiles": profiles(spark, sf), "aliases": aliases(spark, sf), "papers": children}, gone)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"""WITH {PR}, mg AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN -n_nationkey ELSE n_nationkey + 1 END AS retired_id, CASE WHEN n_nationkey % 5 = 3 THEN -1 WHEN n_nationkey % 5 = 2 THEN n_nationkey + 1 ELSE n_nationkey + 40 END AS survivor_id FROM nation)
SELECT retired_id, survivor_id, CASE WHEN retired_id NOT IN (SELECT profile_id FROM pr) THEN 'no_retired' WHEN survivor_id NOT IN (SELECT profile_id FROM pr) THEN 'no_survivor' WHEN retired_id = survivor_id THEN 'same' END AS refusal FROM mg""")
def merge_refusals(spark, sf):
    k = F.col("n_nationkey")
    asked = table(spark, sf, "nation").select(F.when(k % 5 == 4, -k).otherwise(k + 1).alias("retired_id"), F.when(k % 5 == 3, -1).when(k % 5 == 2, k + 1).otherwise(k + 40).alias("survivor_id"))
    return S_.merge_refusals(profiles(spark, sf), asked)


MERGED = f"""{PR}, {AL}, {MG}, mv AS (SELECT retired_id, survivor_id, a.rid AS old_rid, b.rid AS new_rid, a.slug AS old_slug FROM mg JOIN pr a ON a.profile_id = retired_id JOIN pr b ON b.profile_id = survivor_id),
ri AS (SELECT DISTINCT old_rid, new_rid FROM mv WHERE old_rid <> new_rid), kept AS (SELECT profile_id, slug, coalesce(new_rid, rid) AS rid FROM pr LEFT JOIN ri ON old_rid = rid WHERE profile_id NOT IN (SELECT retired_id FROM mv))"""


@query(f"""WITH {MERGED} SELECT DISTINCT old_slug, profile_id FROM (SELECT old_slug, coalesce(survivor_id, profile_id) AS profile_id FROM al LEFT JOIN (SELECT retired_id, survivor_id FROM mv) ON retired_id = profile_id
UNION ALL SELECT old_slug, survivor_id FROM mv) WHERE old_slug NOT IN (SELECT slug FROM kept)""")
def merged_slug_aliases(spark, sf):
    return S_.merge_profiles(profiles(spark, sf), aliases(spark, sf), profiles(spark, sf).where("false").select(F.col("rid").alias("old_rid"), "rid"), merges(spark, sf))[1]


@query(f"WITH {MERGED} SELECT * FROM kept")
def merged_profiles(spark, sf):
    return S_.merge_profiles(profiles(spark, sf), aliases(spark, sf), profiles(spark, sf).where("false").select(F.col("rid").alias("old_rid"), "rid"), merges(spark, sf))[0]


@query("""WITH a AS (SELECT page_id // 10 AS profile, CASE page_id % 6 WHEN 0 THEN '../up/f' || page_id WHEN 1 THEN '/f' || page_id WHEN 2 THEN 'file:f' || page_id WHEN 3 THEN 'a/..b/f' || page_id ELSE 'f' || (page_id + page_id % 2) END AS url FROM pages)
SELECT profile, url, CASE WHEN url LIKE '../%' OR url LIKE '/%' OR url LIKE 'file:%' THEN 'refused' WHEN (profile, url) IN (SELECT (page_id // 10, 'f' || page_id) FROM pages) THEN 'found' ELSE 'missing' END AS status FROM a""")
def artifact_lookup(spark, sf):
    k, pages = F.col("page_id"), table(spark, sf, "pages")
    url = F.when(k % 6 == 0, F.concat(F.lit("../up/f"), k)).when(k % 6 == 1, F.concat(F.lit("/f"), k)).when(k % 6 == 2, F.concat(F.lit("file:f"), k)).when(k % 6 == 3, F.concat(F.lit("a/..b/f"), k)).otherwise(F.concat(F.lit("f"), k + k % 2))
    own = F.floor(k / 10).alias("profile")
    return S_.artifact_lookup(pages.select(own, url.alias("url")), pages.select(own, F.concat(F.lit("f"), k).alias("url")))


PT = "pa AS (SELECT doc_id AS paper, source AS name, CAST(2000 + doc_id % 25 AS VARCHAR) AS datePublished, CAST(NULL AS VARCHAR) AS doi FROM documents), ch AS (SELECT doc_id * 2 AS paper, CASE doc_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'datePublished' WHEN 2 THEN 'doi' ELSE 'cited_by_count' END AS field, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS value, CASE WHEN doc_id % 7 = 0 THEN 'src1' END AS version FROM documents)"


def papers_and_patches(spark, sf):
    """Works and edits of every second one; some edits name the version that they were made for."""
    k, docs = F.col("doc_id"), table(spark, sf, "documents")
    field = F.when(k % 4 == 0, "name").when(k % 4 == 1, "datePublished").when(k % 4 == 2, "doi").otherwise("cited_by_count")
    patches = docs.select((k * 2).alias("paper"), field.alias("field"), F.when(k % 5 != 0, k.cast("string")).alias("value"), F.when(k % 7 == 0, "src1").alias("version"))
    return docs.select(k.alias("paper"), F.col("source").alias("name"), (2000 + k % 25).cast("string").alias("datePublished"), F.lit(None).cast("string").alias("doi")), patches


@query(f"WITH {PT} SELECT ch.paper, field, CASE WHEN field = 'cited_by_count' THEN 'field' WHEN pa.paper IS NULL THEN 'paper' ELSE 'version' END AS refusal FROM ch LEFT JOIN pa USING (paper) WHERE field = 'cited_by_count' OR pa.paper IS NULL OR version <> name")
def patch_refusals(spark, sf):
    papers, patches = papers_and_patches(spark, sf)
    return S_.patch_refusals(patches, papers, version=F.col("name"))


@query(f"WITH {PT}, ok AS (SELECT ch.* FROM ch JOIN pa USING (paper) WHERE field <> 'cited_by_count' AND coalesce(version = name, TRUE)) SELECT paper, CASE WHEN field = 'name' THEN value ELSE name END AS name, CASE WHEN field = 'datePublished' THEN value ELSE datePublished END AS datePublished, CASE WHEN field = 'doi' THEN value ELSE doi END AS doi FROM pa LEFT JOIN ok USING (paper)")
def patched_works(spark, sf):
    return S_.apply_patches(*papers_and_patches(spark, sf), version=F.col("name"))


@query("""WITH ch AS (SELECT c_custkey AS profile_id, CASE c_custkey % 3 WHEN 0 THEN 'bio' WHEN 1 THEN 'rid' ELSE 'lab' END AS field, 'v' || c_custkey AS value FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey AS profile_id, 'r' || c_custkey AS rid, CASE WHEN field = 'bio' THEN value ELSE c_name END AS bio, CASE WHEN field = 'lab' THEN value END AS lab FROM customer LEFT JOIN ch ON profile_id = c_custkey""")
def patched_metadata(spark, sf):
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    rows = c.select(k.alias("profile_id"), F.concat(F.lit("r"), k).alias("rid"), F.col("c_name").alias("bio"), F.lit(None).cast("string").alias("lab"))
    patches = c.where("c_custkey % 2 = 0").select(k.alias("profile_id"), F.when(k % 3 == 0, "bio").when(k % 3 == 1, "rid").otherwise("lab").alias("field"), F.concat(F.lit("v"), k).alias("value"))
    return S_.apply_patches(rows, patches, S_.editable_metadata(rows), "profile_id")


@query("""WITH c AS (SELECT o_custkey AS profile, count(*) AS paper_count, count(*) FILTER (o_orderkey % 3 = 0) AS summary_count FROM orders GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS slug, c_name AS name, 'profiles/' || c_custkey || '/' AS base, coalesce(paper_count, 0) AS paper_count, coalesce(summary_count, 0) AS summary_count FROM customer LEFT JOIN c ON profile = c_custkey""")
def collection_cards(spark, sf):
    own = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_name").alias("name"))
    return S_.collection_cards(own, table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("profile"), (F.col("o_orderkey") % 3 == 0).alias("has_summary")))


@query(f"WITH {TOPICS} SELECT DISTINCT lower(trim(topic)) AS topic, 'profiles/' || profile || '/' AS base FROM tp")
def topic_index(spark, sf):
    return S_.topics_index(topics(spark, sf))


@query("""WITH rec AS (SELECT o_custkey AS profile, o_orderkey AS ordinal, o_orderkey % 5 AS k FROM orders), keyed AS (SELECT *, min(ordinal) OVER (PARTITION BY profile, k) AS first FROM rec),
fresh AS (SELECT profile, ordinal, row_number() OVER (PARTITION BY profile ORDER BY ordinal) AS place FROM keyed WHERE k > 1 AND ordinal = first)
SELECT profile, ordinal, CASE WHEN k = 0 THEN 'already_authored' WHEN k = 1 THEN 'already_seed' WHEN place + 1 <= 3 THEN 'added'
WHEN (SELECT f.place FROM fresh f WHERE f.profile = keyed.profile AND f.ordinal = keyed.first) <= 2 THEN 'already_seed' ELSE 'over_cap' END AS outcome FROM keyed LEFT JOIN fresh USING (profile, ordinal)""")
def seeds_added(spark, sf):
    """Orders as records whose DOI is one of five; the first is authored, the second a seed."""
    own = table(spark, sf, "orders").select(F.col("o_custkey").alias("profile"), F.col("o_orderkey").alias("ordinal"), F.lit(None).cast("string").alias("openalex_id"), F.concat(F.lit("https://doi.org/10.1/K"), F.col("o_orderkey") % 5).alias("doi"))
    one = lambda doi: table(spark, sf, "customer").select(F.col("c_custkey").alias("profile"), F.lit(None).cast("string").alias("openalex_id"), F.lit(doi).alias("doi"))
    return S_.add_seeds(one("10.1/k1"), one("10.1/k0"), own, cap=3)
