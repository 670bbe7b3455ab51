"""Match in full over embeddings: stored calibration, viewers, required topics, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import match as M
from ..operators import ranking as R
from ..session import settled
from .standins import CENT, CH, EFFECTIVE, INTERESTS, Q0, chunks, interests, query_vector, table
from .vector_queries import CAL, background

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def tiered(spark, sf):
    """Chunks with tiers; the last letter of the kind is not told to anyone."""
    k = F.col("chunk_id")
    return chunks(spark, sf).withColumn("tier", F.when(k % 5 == 0, "private").when(k % 3 == 0, "limited").when(k % 17 != 0, "public"))


def viewers(spark, sf):
    p = F.col("profile")
    return chunks(spark, sf).select("profile").distinct().where(p % 4 != 3).withColumn("viewer", F.when(p % 4 == 0, "private").when(p % 4 == 1, "limited").otherwise("public"))


def labels(spark, sf):
    """Topic labels of profiles: every third vector is one; they are near the query where they are it."""
    k = F.col("vec_id")
    return table(spark, sf, "embeddings").where(k % 3 == 0).select(F.col("label").alias("profile"), k.alias("ordinal"), F.concat(F.lit("t"), k).alias("label"), V.doubles("embedding").alias("v"))


def stored_calibration(spark, sf):
    """Written once: the plan of a match reads it."""
    return settled(M.calibration_of(M.background_scores(chunks(spark, sf), background(spark, sf))))


ASKED = [("sys", "Brand#1", 1.0, "declared"), ("sys", "Brand#2", -1.0, "declared"), ("sys", "Brand#3", None, "inferred"), ("sys", "Brand#4", 0.5, "declared"), ("other", "Brand#5", 1.0, "declared"), ("sys", None, 1.0, "declared")]


def asked(spark):
    rows = [(i, s, c, c or "text", w, m, None, 0.5) for i, (s, c, w, m) in enumerate(ASKED)]
    return spark.createDataFrame(rows, "ordinal int, system string, code string, label string, weight double, method string, asserted_at date, share double")


def codes(spark, sf):
    """Topics of profiles: the effective entries of a few parts each."""
    own = interests(spark, sf).where("ordinal % 100 < 20 AND ordinal < 2000")
    return M.topic_codes(own, "sys").where("code <> 'Brand#2' OR profile % 5 = 0")


@query(f"WITH {CH}, {Q0}, lb AS (SELECT label AS profile, vec_id AS ordinal, 't' || vec_id AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 3 = 0) SELECT profile, list(label ORDER BY ordinal) AS overlapping_topics FROM lb, q WHERE list_cosine_similarity(v, q.q) >= 0.5 GROUP BY 1")
def overlapping_topics(spark, sf):
    """Labels of profiles that are near enough to the query to count as evidence."""
    return M.overlapping_topics(labels(spark, sf), query_vector(spark, sf))


FULL = f"""{CH}, {Q0}, {CENT}, {CAL},
vw AS (SELECT profile, CASE profile % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT label AS profile FROM embeddings)),
vs AS (SELECT ch.*, list_cosine_similarity(v, q.q) AS c FROM ch JOIN vw USING (profile), q WHERE source_type <> 'seed_abstract' AND CASE WHEN chunk_id % 5 = 0 THEN 2 WHEN chunk_id % 3 = 0 THEN 1 WHEN chunk_id % 17 <> 0 THEN 0 ELSE 2 END <= n),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY c DESC, chunk_id) AS r FROM vs) WHERE r <= 5),
ev AS (SELECT profile, avg(round(greatest(0.0, (1 + c) / 2), 4)) AS chunk_score, list(chunk_id ORDER BY r) AS top_chunks, list(source_id ORDER BY r) AS papers FROM tk GROUP BY 1),
{INTERESTS.replace("FROM part)", "FROM part WHERE p_partkey % 100 < 20 AND p_partkey < 2000)")}, {EFFECTIVE},
cd AS (SELECT DISTINCT profile, code FROM ef WHERE code IS NOT NULL AND (weight IS NULL OR weight > 0) AND (code <> 'Brand#2' OR profile % 5 = 0)),
ask AS (SELECT * FROM (VALUES ('Brand#1', 1.0, TRUE), ('Brand#2', -1.0, TRUE), ('Brand#3', 0.25, FALSE), ('Brand#4', 0.5, TRUE)) t(code, part, declared)),
ts AS (SELECT profile, sum(part)::DOUBLE AS ts, bool_or(declared AND part <= -1) AS out, list_sort(list(code) FILTER (NOT declared OR part > 0)) AS matched FROM cd JOIN ask USING (code) GROUP BY 1),
sc AS (SELECT cent.profile, list_inner_product(vec, q.q) AS sim, coalesce(chunk_score, 0.0) AS chunk_score, top_chunks, list_filter(papers, lambda x, i: list_position(papers, x) = i) AS top_papers FROM cent CROSS JOIN q LEFT JOIN ev USING (profile)),
kp AS (SELECT * FROM sc ORDER BY sim DESC, profile LIMIT 8)"""


@query(f"""WITH {FULL}, rk AS (SELECT kp.profile, (1 + tanh((0.5 * sim + 0.5 * chunk_score - mean) / greatest(std, 1e-6) / 2)) / 2 + 0.2 * coalesce(ts, 0.0) AS score, sim, chunk_score, top_chunks, top_papers, coalesce(matched, CAST([] AS VARCHAR[])) AS matched_topics FROM kp JOIN cal USING (profile) LEFT JOIN ts USING (profile) WHERE NOT coalesce(out, FALSE))
SELECT profile, round(score, 5) AS score, round(sim, 6) AS centroid_score, round(chunk_score, 6) AS chunk_score, coalesce(top_chunks, CAST([] AS BIGINT[])) AS top_chunks, coalesce(top_papers, CAST([] AS BIGINT[])) AS top_papers, matched_topics, CAST(row_number() OVER (ORDER BY score DESC, profile) AS INTEGER) AS pick FROM rk ORDER BY rk.score DESC, profile LIMIT 5""")
def match_with_evidence(spark, sf):
    own = tiered(spark, sf)
    topics = M.asked_topics(asked(spark), codes(spark, sf), "sys")
    got = M.match_in_full(R.centroids(own), own, query_vector(spark, sf), k=5, prefilter=8, calibration=stored_calibration(spark, sf), viewers=viewers(spark, sf), labels=labels(spark, sf), topics=topics, diversify=False)
    return got.select("profile", F.round("score", 5).alias("score"), F.round("centroid_score", 6).alias("centroid_score"), F.round("chunk_score", 6).alias("chunk_score"), F.transform("top_chunks", lambda h: h["chunk_id"]).alias("top_chunks"), "top_papers", "matched_topics", "pick")


@query()
def match_rank(spark, sf):
    own = chunks(spark, sf)
    return M.match_in_full(R.centroids(own), own, query_vector(spark, sf), calibration=stored_calibration(spark, sf)).select("profile", "centroid_score", "chunk_score", "score", "top_papers", "pick")


@query(f"WITH {CH}, {CENT}, {CAL} SELECT profile, round(mean, 6) AS mean, round(std, 6) AS std FROM cal")
def refreshed_calibration(spark, sf):
    """Scores of an older state, brought up to date for the profiles whose chunks have changed since."""
    now = chunks(spark, sf)
    before = settled(M.background_scores(now.where("profile % 3 <> 0 OR chunk_id % 4 <> 1"), background(spark, sf)))
    changed = now.select("profile").distinct().where("profile % 3 = 0")
    return M.calibration_of(M.refreshed(before, changed, now, background(spark, sf))).select("profile", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))
