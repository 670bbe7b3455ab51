"""Keyword ranking: BM25, reciprocal-rank fusion, hybrid search, key phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import settled

# Fixed values of keyword ranking.
K1, B, RRF_K, MIN_COSINE = 1.2, 0.75, 60, 0.30
PHRASE_STOPWORDS = (
    "a an the and or of for to in on at by as is are was were be been being it its this that these those with from into onto "
    "over under than then thus also such same each other more most much many both few own out off via per upon about above "
    "after again against among because before below between during further here once only some very will would could should "
    "may might must can not no but all any has have had do does did we our us they their them he his she her who whom which "
    "what when where why how while toward towards across within without using use used uses based new novel study studies "
    "show shows shown showed provide provides present presents propose proposed proposes paper work works approach "
    "approaches via versus vs through one two three first second"
).split()


def term_counts(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, term, tf, len``: one exploded pass; counts combine before the shuffle."""
    own = docs.select(F.col(id_).alias("id"), tokens(text).alias("t"))
    return own.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, bm25`` of the documents with a positive score.

    Texts are tokenized once: each document's length and its query terms are written, and read for all counts.
    """
    wanted = sorted(set(docs.sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]))
    own = docs.select(F.col(id_).alias("id"), tokens(text).alias("t"))
    hit = settled(own.select("id", F.size("t").alias("len"), F.filter("t", lambda w: w.isin(*wanted) if wanted else F.lit(False)).alias("t")))
    stats = hit.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))
    tf = hit.select("id", "len", F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("len") / F.col("avgdl")))
    # df and stats have a row a query term and one row
    return tf.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy("id").agg(F.sum(part).alias("bm25")).where(F.col("bm25") > 0)


def fuse(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of ``(id, rank)`` lists: ``id, score, matched_by``; ties by semantic, then keyword order."""
    s = semantic.select("id", F.col("rank").alias("s"))
    k = keyword.select("id", F.col("rank").alias("k"))
    each = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    by = F.concat_ws("+", F.when(F.col("k").isNotNull(), F.lit("keyword")), F.when(F.col("s").isNotNull(), F.lit("semantic")))
    return s.join(k, "id", "full_outer").select("id", F.round(each("s") + each("k"), 6).alias("score"), by.alias("matched_by"), "s", "k")


def ranked(df: DataFrame, *order, out: str = "rank", top: int | None = None) -> DataFrame:
    """Positions of a result list. ``top`` cuts it first (a heap a partition), so the window sees a bounded list.

    A whole list is sorted by ranges: each range numbers its own rows after those of the ranges before it.
    """
    if top:
        return df.orderBy(*order).limit(top).withColumn(out, F.row_number().over(Window.orderBy(*order)))
    parts = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # a row a range
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    n = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(before), "__part").withColumn(out, F.col("__before") + n).drop("__part", "__before")


def phrases(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``phrase, papers``: 2- and 3-word phrases between stopwords, numbers and punctuation, once a document."""
    # punctuation, numbers, stopwords and single letters become breaks; grams come from the runs between
    body = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9\s-]+", " | ")
    own = docs.select(body.alias("b"))
    # most texts have no hyphen, or no digit, to look around for
    own = own.select(F.when(F.contains("b", F.lit("-")), F.regexp_replace("b", r"(?<!\S)-+|-+(?!\S)", "")).otherwise(F.col("b")).alias("b"))
    own = own.select(F.when(F.col("b").rlike("[0-9]"), F.regexp_replace("b", r"(?<!\S)[0-9]+(?!\S)", "|")).otherwise(F.col("b")).alias("b"))
    kept = F.transform(F.split(F.trim("b"), r"\s+"), lambda w: F.when((F.length(w) < 2) | w.isin(*PHRASE_STOPWORDS), F.lit("|")).otherwise(w))
    runs = F.filter(F.split(F.array_join(kept, " "), r" ?\| ?"), lambda r: F.contains(r, F.lit(" ")))
    bound = lambda c, f: F.flatten(F.transform(F.array(c), f))
    after = lambda w, n: F.slice(w, n, F.greatest(F.size(w) - (n - 1), F.lit(0)))
    add = lambda a, b: F.concat(a, F.lit(" "), b)
    grams = lambda w: bound(F.zip_with(w, after(w, 2), add), lambda two: F.concat(two, F.zip_with(two, after(w, 3), add)))
    # once a document by its own row, so that one shuffle of counts is all there is
    once = F.array_distinct(F.array_compact(F.flatten(F.transform(runs, lambda r: bound(F.split(r, " "), grams)))))
    return own.select(F.explode(once).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("papers"))


def key_phrases(docs: DataFrame, top_n: int = 8, min_papers: int = 2, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Most shared phrases, longer first on ties, none inside or around one already kept.

    The pruning is sequential. A round reads a bounded head of what does not nest in a phrase kept so far
    and keeps its first at least, so ``top_n`` rounds end it; no phrase is out of reach.
    """
    words, spaced = F.size(F.split("phrase", " ")), F.concat(F.lit(" "), "phrase", F.lit(" "))
    left, kept = settled(phrases(docs, id_, text).where(F.col("papers") >= min_papers)), []
    while len(kept) < top_n:
        # the kept phrases are ``top_n`` at most
        for p, _ in kept:
            left = left.where(~F.contains(spaced, F.lit(f" {p} ")) & ~F.contains(F.lit(f" {p} "), spaced))
        head = left.orderBy(F.desc("papers"), F.desc(words), "phrase").limit(top_n * 8).collect()
        if not head:
            break
        for r in head:
            if len(kept) < top_n and not any(f" {r['phrase']} " in f" {k} " or f" {k} " in f" {r['phrase']} " for k, _ in kept):
                kept.append((r["phrase"], r["papers"]))
    return docs.sparkSession.createDataFrame(kept, "phrase string, papers long")
