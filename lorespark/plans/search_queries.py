"""Hybrid search and passage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search as S_
from .standins import ORD, Q0, query_vector, table
from .text_queries import WORDS

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


TERMS = "', '".join(WORDS.split())
CH = """ck AS (SELECT vec_id AS chunk_id, label AS profile, vec_id // 2 AS source_id, CASE WHEN vec_id % 7 = 0 THEN 'seed_abstract' WHEN vec_id % 2 = 0 THEN 'paper_summary' ELSE 'paper_abstract' END AS source_type,
CASE vec_id % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'limited' WHEN 2 THEN NULL ELSE 'public' END AS tier, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
VIS = f"vi AS (SELECT ck.*, round(list_cosine_similarity(v, q.q), 6) AS cosine FROM ck, q WHERE source_type <> 'seed_abstract' AND coalesce({ORD('tier')}, 2) <= 1)"
BM = f"""tk AS (SELECT id, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+') AS t FROM bodies), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tk) WHERE term IN ('{TERMS}') GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS bm25 FROM tf JOIN df USING (term), st GROUP BY 1),
kw AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm WHERE bm25 > 0)"""
FUSED = "fu AS (SELECT coalesce(se.id, kw.id) AS id, round(coalesce(1.0 / (60 + se.rank), 0.0) + coalesce(1.0 / (60 + kw.rank), 0.0), 6) AS score, concat_ws('+', CASE WHEN kw.id IS NOT NULL THEN 'keyword' END, CASE WHEN se.id IS NOT NULL THEN 'semantic' END) AS matched_by, se.rank AS s, kw.rank AS k FROM se FULL JOIN kw ON se.id = kw.id)"


def chunks(spark, sf):
    k = F.col("vec_id")
    kind = F.when(k % 7 == 0, "seed_abstract").when(k % 2 == 0, "paper_summary").otherwise("paper_abstract")
    tier = F.when(k % 5 == 0, "private").when(k % 5 == 1, "limited").when(k % 5 >= 3, "public")
    return table(spark, sf, "embeddings").select(k.alias("chunk_id"), F.col("label").alias("profile"), F.floor(k / 2).alias("source_id"), kind.alias("source_type"), tier.alias("tier"), V.doubles("embedding").alias("v"))


@query(f"WITH {CH}, {Q0}, {VIS} SELECT chunk_id, cosine FROM vi WHERE source_type = 'paper_summary' ORDER BY cosine DESC, chunk_id LIMIT 20")
def semantic_hits(spark, sf):
    return S_.semantic_hits(chunks(spark, sf), query_vector(spark, sf), "limited", ("paper_summary",), k=20).select("chunk_id", "cosine")


@query(f"WITH {CH}, {Q0}, {VIS} SELECT source_id AS id, max(cosine) AS cosine FROM vi WHERE cosine >= 0.1 GROUP BY 1")
def best_hit_per_paper(spark, sf):
    return S_.best_hits(S_.semantic_hits(chunks(spark, sf), query_vector(spark, sf), "limited"), 0.1)


@query(f"""WITH {CH}, {Q0}, {VIS}, pa AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN text END AS summary, CASE WHEN doc_id % 4 <> 0 THEN lang END AS abstract, source AS journal FROM documents),
bodies AS (SELECT id, 'title ' || coalesce(summary, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(journal, '') AS body FROM pa), {BM},
be AS (SELECT pa.id, max(cosine) AS c FROM vi JOIN pa ON pa.id = vi.source_id WHERE cosine >= 0.1 AND CASE source_type WHEN 'paper_summary' THEN summary IS NOT NULL WHEN 'paper_abstract' THEN abstract IS NOT NULL END GROUP BY 1),
se AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS rank FROM be), {FUSED} SELECT id, score, matched_by, 'hybrid' AS mode FROM fu""")
def hybrid_papers(spark, sf):
    k = F.col("doc_id")
    papers = table(spark, sf, "documents").select(k.alias("id"), F.lit("title").alias("title"), F.when(k % 3 != 0, F.col("text")).alias("summary"), F.when(k % 4 != 0, F.col("lang")).alias("abstract"), F.col("source").alias("journal"))
    return S_.hybrid_papers(papers, chunks(spark, sf), WORDS, query_vector(spark, sf), "limited", 0.1)


@query(f"""WITH {CH}, {Q0}, {VIS}, top AS (SELECT * FROM vi ORDER BY cosine DESC, chunk_id LIMIT 40), j AS (SELECT top.*, d.text, coalesce(length(d.text) = CASE WHEN chunk_id % 6 = 0 THEN -1 ELSE d.n END, FALSE) AS fresh FROM top LEFT JOIN (SELECT doc_id, text, length(text) AS n FROM documents) d ON d.doc_id = top.chunk_id),
r AS (SELECT *, row_number() OVER (ORDER BY fresh DESC, cosine DESC, chunk_id) AS rank, count(*) FILTER (NOT fresh) OVER () AS stale FROM j) SELECT CAST(rank AS INTEGER) AS rank, chunk_id, cosine, text, stale FROM r WHERE fresh AND rank <= 10""")
def search_current_text(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    counted = chunks(spark, sf).join(texts.select("chunk_id", F.length("text").alias("n")), "chunk_id", "left").withColumn("char_count", F.when(F.col("chunk_id") % 6 == 0, -1).otherwise(F.col("n"))).drop("n")
    return S_.current_hits(counted, texts, query_vector(spark, sf), "limited")


@query(f"WITH {CH}, {Q0}, {VIS}, r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY cosine DESC, chunk_id) AS rank FROM vi) SELECT profile, CAST(rank AS INTEGER) AS rank, chunk_id, cosine FROM r WHERE rank <= 3")
def visible_top_hits(spark, sf):
    return S_.visible_top_hits(chunks(spark, sf), query_vector(spark, sf), "limited")


KINDS = "CASE doc_id % 6 WHEN 0 THEN 'soul' WHEN 1 THEN 'expertise' WHEN 2 THEN 'cv' WHEN 3 THEN 'web' WHEN 4 THEN 'grant' ELSE 'paper_summary' END"


@query(f"""WITH {Q0}, bodies AS (SELECT doc_id AS id, text AS body, CAST(embedding AS DOUBLE[]) AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE {KINDS} <> 'paper_summary' AND doc_id % 5 <> 0 AND length(trim(text, ' ')) >= 40), {BM},
se AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS rank FROM (SELECT id, round(list_cosine_similarity(v, q.q), 6) AS c FROM bodies, q WHERE v IS NOT NULL) WHERE c >= 0.1), {FUSED},
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, s NULLS LAST, k NULLS LAST, id) AS rank FROM fu) SELECT CAST(rank AS INTEGER) AS rank, id, score, matched_by FROM r WHERE rank <= 8""")
def passages_profile(spark, sf):
    k = F.col("doc_id")
    kind = F.when(k % 6 == 0, "soul").when(k % 6 == 1, "expertise").when(k % 6 == 2, "cv").when(k % 6 == 3, "web").when(k % 6 == 4, "grant").otherwise("paper_summary")
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles("embedding").alias("v"))
    own = table(spark, sf, "documents").join(vec, "doc_id", "left").select(k.alias("chunk_id"), kind.alias("source_type"), F.when(k % 5 == 0, "private").otherwise("public").alias("tier"), F.col("text").alias("body"), "v")
    own = own.where((F.col("source_type") != "paper_summary") & (F.col("tier") == "public"))
    return S_.passages(own.withColumn("id", F.col("chunk_id")), WORDS, query_vector(spark, sf), least=0.1)


@query()
def passages_paper(spark, sf):
    return S_.paper_passages(table(spark, sf, "documents").select(F.col("doc_id").alias("paper"), "text"), WORDS)


@query("WITH h AS (SELECT o_custkey AS query, o_orderkey % 100 / 100.0 AS score FROM orders) SELECT query, coalesce(max(score), 0) < 0.95 AS refused FROM h GROUP BY 1")
def refusal_gate(spark, sf):
    return S_.refuse(table(spark, sf, "orders").select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 100 / 100.0).alias("score")), 0.95)


GROUPS = "g AS (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'st:all-MiniLM-L6-v2' WHEN 1 THEN 'remote:x' WHEN 2 THEN 'st:other' END AS backend_spec, count(*) AS profiles, bool_or(c_custkey % 2 = 0) AS has_centroids FROM customer GROUP BY 1)"


@query(f"WITH {GROUPS} SELECT backend_spec, profiles, has_centroids, CASE WHEN backend_spec IS NULL OR NOT has_centroids THEN 3 WHEN backend_spec = 'st:all-MiniLM-L6-v2' THEN 1 ELSE 2 END::INTEGER AS tier FROM g")
def comparison_groups(spark, sf):
    k = F.col("c_nationkey") % 4
    spec = F.when(k == 0, "st:all-MiniLM-L6-v2").when(k == 1, "remote:x").when(k == 2, "st:other")
    groups = S_.comparison_groups(table(spark, sf, "customer").select(F.col("c_custkey").alias("profile"), spec.alias("backend_spec"), (F.col("c_custkey") % 2 == 0).alias("has_centroid")))
    return groups.withColumn("tier", S_.search_tier(F.col("backend_spec"), F.col("has_centroids"), F.lit("degraded")))
