"""Ranking queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clusters, listings
from ..operators import ranking as R
from .standins import CENT, CH, Q0, chunks, mean_sql, query_vector, table, unit_sql

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query(f"WITH {CH}, {Q0}, {CENT} SELECT profile, round(list_inner_product(vec, q.q), 6) AS sim FROM cent, q")
def rank_centroids(spark, sf):
    return R.centroids(chunks(spark, sf)).select("profile", F.round(V.dot("vec", query_vector(spark, sf)), 6).alias("sim"))


@query(f"""WITH {CH}, {Q0},
n AS (SELECT profile, count(DISTINCT CASE WHEN source_type = 'seed_abstract' THEN source_id END) AS n_seed, count(DISTINCT CASE WHEN source_type <> 'seed_abstract' THEN source_id END) AS n_auth FROM ch GROUP BY 1),
au AS (SELECT * FROM ch WHERE source_type <> 'seed_abstract'), se AS (SELECT * FROM ch WHERE source_type = 'seed_abstract'),
{mean_sql("am", "au", "profile")}, {mean_sql("s1", "se", "profile, source_id")}, {mean_sql("s2", "s1", "profile", "m")},
w AS (SELECT n.*, CASE WHEN n_seed = 0 THEN 0.0 WHEN n_auth > 0 THEN least(0.4, n_seed / (n_seed + 3.0 * n_auth)) ELSE n_seed / (n_seed + 3.0) END::DOUBLE AS w FROM n),
u AS (SELECT w.profile, n_seed, n_auth, w, {unit_sql("am.m")} AS a, {unit_sql("s2.m")} AS s FROM w JOIN am USING (profile) LEFT JOIN s2 USING (profile)),
b AS (SELECT profile, n_seed, n_auth, w, CASE WHEN s IS NULL THEN a ELSE list_transform(list_zip(a, s), lambda z: z[1] * (1 - w) + z[2] * w) END AS x FROM u)
SELECT profile, n_seed, n_auth, round(w, 6) AS w, round(list_inner_product(x, q.q) / sqrt(list_inner_product(x, x)), 6) AS sim FROM b, q""")
def seed_blend_centroid(spark, sf):
    b = R.blended_centroids(chunks(spark, sf))
    return b.select("profile", "n_seed", "n_auth", F.round("w", 6).alias("w"), F.round(V.dot("vec", query_vector(spark, sf)), 6).alias("sim"))


BEST = "best AS (SELECT * FROM (SELECT profile, chunk_id, round(c, 4) AS cos, round(greatest(0.0, (1 + c) / 2), 4) AS score, CAST(row_number() OVER (PARTITION BY profile ORDER BY c DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT ch.*, list_cosine_similarity(v, q.q) AS c FROM ch, q WHERE source_type <> 'seed_abstract')) WHERE rank <= 5)"


@query(f"WITH {CH}, {Q0}, {BEST} SELECT profile, chunk_id, cos, score, rank FROM best")
def chunk_topk_per_profile(spark, sf):
    return R.top_chunks(chunks(spark, sf), query_vector(spark, sf)).select("profile", "chunk_id", "cos", "score", "rank")


@query(f"WITH {CH}, o AS (SELECT v AS q FROM ch WHERE chunk_id = 1) SELECT chunk_id, round(list_cosine_similarity(v, o.q), 4) AS cos FROM ch, o WHERE chunk_id <> 1 ORDER BY list_cosine_similarity(v, o.q) DESC, chunk_id LIMIT 10")
def similar_chunks(spark, sf):
    own = chunks(spark, sf).where("chunk_id <> 1").withColumn("c", V.cosine("v", query_vector(spark, sf, 1)))
    return own.orderBy(F.desc("c"), "chunk_id").limit(10).select("chunk_id", F.round("c", 4).alias("cos"))


@query(f"WITH {CH}, {Q0} SELECT chunk_id, round(c, 4) AS cos, round(greatest(0.0, (1 + c) / 2), 4) AS score FROM (SELECT chunk_id, list_cosine_similarity(v, q.q) AS c FROM ch, q WHERE source_type IN ('paper_summary')) ORDER BY c DESC, chunk_id LIMIT 20")
def search_vector(spark, sf):
    own = chunks(spark, sf).where("source_type = 'paper_summary'").withColumn("c", V.cosine("v", query_vector(spark, sf)))
    return own.orderBy(F.desc("c"), "chunk_id").limit(20).select("chunk_id", F.round("c", 4).alias("cos"), V.hit_score("c").alias("score"))


RAW = "rs AS (SELECT cent.profile, list_inner_product(vec, q.q) AS sim, coalesce(b.s, 0.0) AS chunk_score FROM cent CROSS JOIN q LEFT JOIN (SELECT profile, avg(score) AS s FROM best GROUP BY 1) b USING (profile))"


@query(f"WITH {CH}, {Q0}, {CENT}, {BEST}, {RAW} SELECT profile, round(sim, 6) AS sim, round(chunk_score, 6) AS chunk_score, round(0.5 * sim + 0.5 * chunk_score, 6) AS raw FROM rs")
def match_raw_score(spark, sf):
    own = chunks(spark, sf)
    r = R.raw_scores(R.centroids(own), own, query_vector(spark, sf))
    return r.select("profile", *[F.round(c, 6).alias(c) for c in ("sim", "chunk_score", "raw")])


CAL = """bg AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id BETWEEN 1 AND 12),
bc AS (SELECT * FROM (SELECT profile, query, c, row_number() OVER (PARTITION BY profile, query ORDER BY c DESC, chunk_id) AS r FROM (SELECT ch.profile, chunk_id, query, list_cosine_similarity(v, bg.q) AS c FROM ch, bg WHERE source_type <> 'seed_abstract')) WHERE r <= 3),
bm AS (SELECT profile, query, avg(round(greatest(0.0, (1 + c) / 2), 4)) AS c FROM bc GROUP BY 1, 2),
cal AS (SELECT cent.profile, avg(0.5 * list_inner_product(vec, bg.q) + 0.5 * coalesce(bm.c, 0.0)) AS mean, stddev_pop(0.5 * list_inner_product(vec, bg.q) + 0.5 * coalesce(bm.c, 0.0)) AS std FROM cent CROSS JOIN bg LEFT JOIN bm ON bm.profile = cent.profile AND bm.query = bg.query GROUP BY 1)"""


def background(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id").between(1, 12)).select(F.col("vec_id").alias("query"), V.doubles("embedding").alias("q"))


@query(f"WITH {CH}, {CENT}, {CAL} SELECT profile, round(mean, 6) AS mean, round(std, 6) AS std FROM cal")
def calibration_stats(spark, sf):
    own = chunks(spark, sf)
    return R.calibration(R.centroids(own), own, background(spark, sf)).select("profile", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {CH}, {Q0}, {CENT}, {BEST}, {RAW}, {CAL} SELECT profile, round((1 + tanh((0.5 * sim + 0.5 * chunk_score - mean) / greatest(std, 1e-6) / 2)) / 2, 5) AS score FROM rs JOIN cal USING (profile)")
def calibrated_scores(spark, sf):
    own = chunks(spark, sf)
    cents = R.centroids(own)
    raw = R.raw_scores(cents, own, query_vector(spark, sf))
    return raw.join(R.calibration(cents, own, background(spark, sf)), "profile").select("profile", F.round(V.calibrated("raw", "mean", "std"), 5).alias("score"))


@query(f"WITH {CH}, {Q0}, {CENT}, {BEST}, {RAW} SELECT profile, round(0.5 * sim + 0.5 * chunk_score, 6) AS score FROM rs WHERE profile % 3 <> 2 ORDER BY 0.5 * sim + 0.5 * chunk_score DESC, profile LIMIT 5")
def match_visible(spark, sf):
    own = chunks(spark, sf)
    cents = R.centroids(own)
    seen = cents.select("profile").where("profile % 3 <> 2")
    return R.match(cents, own, query_vector(spark, sf), k=5, prefilter=1000, diversify=False, allowed=seen).select("profile", F.round("score", 6).alias("score"))


@query(f"WITH {CH}, {CENT} SELECT chunk_id AS work, round(list_cosine_similarity(v, c.vec), 6) AS score FROM ch, (SELECT vec FROM cent WHERE profile = (SELECT min(profile) FROM cent)) c WHERE list_cosine_similarity(v, c.vec) >= 0.1 ORDER BY list_cosine_similarity(v, c.vec) DESC, chunk_id LIMIT 10")
def rank_works(spark, sf):
    own = chunks(spark, sf)
    first = R.centroids(own).orderBy("profile").select("vec").first()
    works = own.select(F.col("chunk_id").alias("work"), "v")
    return R.rank_works(works, R.literal_vector(first["vec"]), 10, 0.1).select("work", F.round("score", 6).alias("score"))


@query()
def rank_works_diverse(spark, sf):
    own = chunks(spark, sf)
    works = own.select(F.col("chunk_id").alias("work"), "v")
    return R.rank_works(works, query_vector(spark, sf), 10, diversify=True).select("work", "score", "pick")


@query(f"WITH {CH}, {Q0} SELECT chunk_id, CASE WHEN list_cosine_similarity(v, q.q) > 0.99 THEN 'verified' WHEN list_cosine_similarity(v, q.q) > 0.9 THEN 'degraded' ELSE 'incompatible' END AS verdict FROM ch, q")
def probe_verdict(spark, sf):
    return chunks(spark, sf).select("chunk_id", R.agreement(V.cosine("v", query_vector(spark, sf))).alias("verdict"))


@query("SELECT count(*) AS chunks, count(DISTINCT vec_id // 3) FILTER (vec_id % 7 <> 0) AS papers FROM embeddings")
def index_counts(spark, sf):
    own = chunks(spark, sf)
    return own.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.when(F.col("source_type") != "seed_abstract", F.col("source_id"))).alias("papers"))


@query(f"WITH {CH} SELECT profile, count(*) AS chunks, CAST(count_if(source_type = 'seed_abstract') AS BIGINT) AS seeds, count(*) > 45 AS indexed FROM ch GROUP BY 1")
def fleet_coverage(spark, sf):
    return listings.coverage(chunks(spark, sf), 45)


@query("WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'hash:8' ELSE 'hash:16' END AS spec FROM customer) SELECT spec, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, min(c_custkey) LIMIT 1")
def majority_backend(spark, sf):
    own = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "hash:8").otherwise("hash:16").alias("spec"))
    return listings.majority(own, "spec", "c_custkey")


@query()
def kmeans_seeded(spark, sf):
    return clusters.lloyd(R.centroids(chunks(spark, sf)))


@query()
def kmeans_profiles(spark, sf):
    return R.kmeans(R.centroids(chunks(spark, sf)), 3)


@query()
def topic_clusters(spark, sf):
    own = chunks(spark, sf).withColumn("text", F.concat(F.lit("# Part "), F.col("chunk_id").cast("string"), F.lit("\nBody.")))
    return R.topic_clusters(own, 4)[0]


@query()
def mmr_candidates(spark, sf):
    own = R.centroids(chunks(spark, sf)).withColumn("score", V.hit_score(V.dot("vec", query_vector(spark, sf))))
    return R.mmr(own, 5).select("profile", "score", "pick")
