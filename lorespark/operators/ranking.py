"""Vector ranking: centroids, top-k, match, calibration, diversification, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import settled
from .greedy import HEAD, choose, choose_short, cosine_likeness

# Fixed values of ranking.
AUTHORED_WEIGHT, SEED_SHARE_CAP, TOPK_CHUNKS, CALIBRATION_CHUNKS, EVIDENCE_COSINE = 3, 0.4, 5, 3, 0.5
SEED_TYPE, PAPER_TYPES = "seed_abstract", ("paper_summary", "paper_abstract")


def literal_vector(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def seed_share(n_seed, n_auth) -> Column:
    """Weight of interest seeds against authored papers, capped if there is any authored paper."""
    share = n_seed / (n_seed + AUTHORED_WEIGHT * F.greatest(n_auth, F.lit(1)))
    return F.when(n_auth > 0, F.least(F.lit(SEED_SHARE_CAP), share)).otherwise(share)


def centroids(chunks: DataFrame, key: str = "profile") -> DataFrame:
    """Unit mean vector by profile; zero vectors do not rank and are left out."""
    made = V.mean_vector(chunks, [key], "v", "m").select(key, V.unit(F.col("m")).alias("vec"))
    return made.where(V.norm("vec") > 0)


def blended_centroids(chunks: DataFrame, key: str = "profile") -> DataFrame:
    """``chunks(profile, source_type, source_id, v)``: unit blend of authored mean and mean of seed means."""
    is_seed = F.col("source_type") == SEED_TYPE
    counts = chunks.groupBy(key).agg(F.count_distinct(F.when(is_seed, F.col("source_id"))).alias("n_seed"),
        F.count_distinct(F.when(F.col("source_type").isin(*PAPER_TYPES), F.col("source_id"))).alias("n_auth"))
    authored = V.mean_vector(chunks.where(~is_seed), [key], "v", "a")
    seeds = V.mean_vector(V.mean_vector(chunks.where(is_seed), [key, "source_id"], "v", "s"), [key], "s", "s")
    w = seed_share(F.col("n_seed"), F.col("n_auth"))
    mixed = V.unit(F.zip_with(V.unit("a"), V.unit("s"), lambda x, y: x * (1 - F.col("w")) + y * F.col("w")))
    vec = F.when(F.col("s").isNull(), V.unit("a")).when(F.col("a").isNull(), V.unit("s")).otherwise(mixed)
    return counts.withColumn("w", F.when(F.col("n_seed") > 0, w).otherwise(0.0)).join(authored, key, "left").join(seeds, key, "left").select(key,
        "n_seed", "n_auth", "w", vec.alias("vec"))


def top_chunks(chunks: DataFrame, query: Column, k: int = TOPK_CHUNKS, keys: tuple[str, ...] = ("profile",), seeds: bool = False) -> DataFrame:
    """Best ``k`` visible chunks of each profile: cosine, then id; filtered before the cut. ``cos`` and ``score`` to four places."""
    own = chunks if seeds else chunks.where(F.col("source_type") != SEED_TYPE)
    scored = own.withColumn("c", V.cosine("v", query)).withColumn("cos", F.round("c", 4))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", V.hit_score("c")).drop("c")


def raw_scores(cents: DataFrame, chunks: DataFrame, query: Column, k: int = TOPK_CHUNKS) -> DataFrame:
    """Half the centroid's similarity and half the mean score of the best chunks (0 without any)."""
    best = top_chunks(chunks, query, k).groupBy("profile").agg(F.avg("score").alias("chunk_score"))
    sims = cents.select("profile", V.dot("vec", query).alias("sim"))
    return sims.join(best, "profile", "left").withColumn("chunk_score", F.coalesce("chunk_score", F.lit(0.0))).withColumn("raw", 0.5 * F.col("sim") + 0.5 * F.col("chunk_score"))


def calibration(cents: DataFrame, chunks: DataFrame, background: DataFrame, k: int = CALIBRATION_CHUNKS) -> DataFrame:
    """Population mean and deviation of each profile's raw score over background queries ``(query, q)``, few and constant."""
    from .match import background_scores, calibration_of

    return calibration_of(background_scores(chunks, background, k, cents)).select("profile", "mean", "std")


def mmr(df: DataFrame, k: int, lambda_: float = 0.5, score: str = "score", vec: str = "vec", order: str = "profile", by: tuple[str, ...] = (),
    at_most: int | None = None) -> DataFrame:
    """Greedy diversification of one list, or of one each of ``by``: ``df`` and ``pick``; ``k`` rows or fewer stay in order of score.

    The first choice is the best score, each next one the best of ``lambda_ * score - (1 - lambda_) * cosine``, of the largest
    cosine to what is chosen (0 where a vector is missing). Lists of any length (``greedy.choose``); ``at_most``: the caller has cut them to
    so many rows, and where that is a head or less one pass does.
    """
    own = df.withColumn("__list", F.to_json(F.struct(*by)) if by else F.lit("")).withColumn("__unit", F.when(V.norm(vec) > 0, V.unit(F.col(vec))))
    if at_most is not None and at_most <= HEAD:
        # the choices of a short list come first in any case: what is left of ``k`` rows or fewer is put in order of score after them
        made = choose_short(own, ["__list"], at_most, "__unit", [order], cosine_likeness, lambda_, 1 - lambda_, True, score)
        w = Window.partitionBy("__list")
        few = F.count(F.lit(1)).over(w) <= k
        by_score = F.row_number().over(w.orderBy(F.desc(score), order)).cast("int")
        return made.withColumn("pick", F.when(few, by_score).otherwise(F.col("pick"))).where(F.col("pick") <= k).select(*df.columns, "pick")
    own = own.join(own.groupBy("__list").agg(F.count(F.lit(1)).alias("__n")), "__list")
    few = own.where(F.col("__n") <= k).withColumn("pick", F.row_number().over(Window.partitionBy("__list").orderBy(F.desc(score), order)).cast("int"))
    long = choose(own.where(F.col("__n") > k).drop("__n"), ["__list"], k, "__unit", [order], cosine_likeness, -1.0, lambda_, 1 - lambda_, True, score)
    return few.select(*df.columns, "pick").unionByName(long.select(*df.columns, "pick"))


def match(cents: DataFrame, chunks: DataFrame, query: Column, calib: DataFrame | None = None, interests: DataFrame | None = None, k: int = 5,
    prefilter: int = 10, diversify: bool = True, lambda_: float = 0.5, topic_alpha: float = 0.2, allowed: DataFrame | None = None) -> DataFrame:
    """Rank profiles: prefilter by centroid, re-rank by visible chunks, calibrate, boost by topics, diversify, cut.

    ``allowed(profile)``: visible profiles, applied before any cut. ``interests(profile, topic_score)``: a
    null score drops the profile.
    """
    own = cents if allowed is None else cents.join(allowed, "profile", "left_semi")
    kept = own.withColumn("sim", V.dot("vec", query)).orderBy(F.desc("sim"), "profile").limit(max(prefilter, k))
    scored = raw_scores(kept, chunks.join(F.broadcast(kept.select("profile")), "profile", "left_semi"), query)
    scored = scored.join(kept.select("profile", "vec"), "profile")
    if calib is not None:
        scored = scored.join(calib, "profile", "left").withColumn("score", F.coalesce(V.calibrated("raw", "mean", "std"), F.col("raw")))
    else:
        scored = scored.withColumn("score", F.col("raw"))
    if interests is not None:
        scored = scored.join(interests, "profile").where(F.col("topic_score").isNotNull()).withColumn("score", F.col("score") + topic_alpha * F.col("topic_score"))
    scored = scored.select("profile", "sim", "chunk_score", "raw", "score", "vec")
    if not diversify:
        return scored.orderBy(F.desc("score"), "profile").limit(k).drop("vec")
    return mmr(scored, k, lambda_, at_most=max(prefilter, k)).drop("vec")


def rank_works(works: DataFrame, vector: Column, k: int = 10, threshold: float | None = None, diversify: bool = False, pool: int = 200) -> DataFrame:
    """``works(work, v)`` by cosine to a profile's vector."""
    scored = works.withColumn("score", V.cosine("v", vector))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    # diversified among the best ``pool``
    return mmr(scored.orderBy(F.desc("score"), "work").limit(max(pool, k)), k, vec="v", order="work",
        at_most=max(pool, k)) if diversify else scored.orderBy(F.desc("score"), "work").limit(k)


def agreement(cos) -> Column:
    """Verdict on two runs of one encoder."""
    return F.when(cos > 0.99, "verified").when(cos > 0.9, "degraded").otherwise("incompatible")


def kmeans(df: DataFrame, k: int, seed: int = 0, key: str = "profile", vec: str = "vec") -> DataFrame:
    """Clusters at any size by MLlib; the cluster is named for the member nearest its unit centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, vec, array_to_vector(F.col(vec)).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    centers = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, center array<double>")
    near = model.transform(rows).join(F.broadcast(centers), "prediction").withColumn("near", V.cosine(vec, V.unit("center")))
    return near.withColumn("named", F.first(key).over(Window.partitionBy("prediction").orderBy(F.desc("near"), key))).select(key, "prediction", "named")


def _label(text) -> Column:
    """A leading heading without its marks, else the first sentence, cut to 80; ``topic`` for no text."""
    body = F.trim(F.coalesce(text, F.lit("")))
    line = F.regexp_extract(body, r"^#+[ \t]*([^\r\n]*)", 1)
    first = F.element_at(F.split(body, r"(?<=[.!?])\s", 2), 1)
    return F.when(body == "", "topic").otherwise(F.substring(F.when(body.startswith("#"), F.trim(line)).otherwise(first), 1, 80))


def topic_clusters(chunks: DataFrame, n: int = 8, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """Topics of every profile, ``profile, cluster, label, weight, papers``, and members, ``profile, cluster, chunk_id``.

    ``chunks(profile, chunk_id, source_type, source_id, text, v)``; seeds are no topics. Lloyd's rounds of
    all profiles at once: centres are joined by profile and means are partial sums, so a profile's chunks
    are never gathered. First centres: the ``n`` chunks of least hash, fewer for fewer chunks; ties go to
    the lower cluster; a cluster that loses all its chunks ends. A topic is named for the member nearest its unit
    centre; its weight is its share of chunks, to four places; ``papers`` counts the papers whose summaries are in it.
    """
    own = settled(chunks.where(F.col("source_type") != SEED_TYPE).select("profile", "chunk_id", "source_type", "source_id", "text", "v"))
    first = Window.partitionBy("profile").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    centers = own.withColumn("cluster", F.row_number().over(first)).where(F.col("cluster") <= n).select("profile", "cluster", F.col("v").alias("center"))
    before = None
    for _ in range(rounds):
        away = F.aggregate(F.zip_with("v", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
        near = own.join(centers, "profile").groupBy("profile", "chunk_id").agg(F.min(F.struct(away.alias("away"), "cluster")).alias("m"))
        now = settled(near.select("profile", "chunk_id", F.col("m.cluster").alias("cluster")))
        if before is not None and now.join(before.withColumnRenamed("cluster", "was"), ["profile", "chunk_id"]).where("cluster <> was").isEmpty():
            break
        before = now
        centers = settled(V.mean_vector(own.join(now, ["profile", "chunk_id"]), ["profile", "cluster"], "v", "center"))
    at = own.join(now, ["profile", "chunk_id"]).join(centers.withColumn("center", V.unit("center")), ["profile", "cluster"])
    best = F.max_by("text", F.struct(V.dot("v", "center"), -F.col("chunk_id")))
    topics = at.groupBy("profile", "cluster").agg(best.alias("text"), F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(F.col("source_type") == "paper_summary", F.col("source_id"))).alias("papers"))
    total = own.groupBy("profile").agg(F.count(F.lit(1)).alias("all"))
    rows = topics.join(total, "profile").select("profile", "cluster", _label(F.col("text")).alias("label"), F.round(F.col("n") / F.col("all"), 4).alias("weight"), "papers")
    return rows, now
