"""Quality rules: a hashed n-gram log-likelihood ratio of trusted texts against the raw corpus, in DataFrame functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two multinomials over
the buckets, one of the trusted texts and one of the whole corpus, give every bucket a weight, the
logarithm of its ratio in fixed point. A text's score is the sum of its weights over its n-grams;
sums of integers do not depend on the order of addition, so that a threshold decides the same
way in every run. Counts of the text itself (symbols, repeated lines and windows) are the base rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Buckets of n-grams, the count added to each, and the unit of a weight (one nat is SCALE).
BUCKETS, SMOOTHING, SCALE = 1 << 16, 1.0, 1 << 20
#: A text is kept if its mean log-likelihood ratio, in nats an n-gram, is at least this.
THRESHOLD = -0.15
#: Base rules: fewest words; most words of a hundred that lie in repeated windows; words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Most trusted ids that are broadcast (counted first); more are joined by shuffle.
BROADCAST_IDS = 2_000_000

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: F.Column, body: Callable[[F.Column], F.Column]) -> F.Column:
    """``body`` of a value that is made once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: F.Column) -> F.Column:
    """Maximal runs of characters other than the six white-space ones; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def symbols(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def repeated_lines(text: F.Column) -> F.Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _repeated(pairs: F.Column) -> F.Column:
    """Of sorted structs ``(k, p)`` those whose k another one has."""
    return _let(F.array_sort(pairs), lambda s: F.filter(s, lambda x, i: F.coalesce(x["k"] == F.get(s, i - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(s, i + 1)["k"], F.lit(False))))


def repeated_words(words: F.Column, window: int = WINDOW) -> F.Column:
    """Words that lie in a window of ``window`` words found twice or more, first ones included.

    Windows are compared by hash first; only texts in which a hash comes twice go on, and there the
    words of those windows decide.
    """

    def covered(w: F.Column, hashes: F.Column) -> F.Column:
        alike = _repeated(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("p"))))
        same = _repeated(F.transform(alike, lambda x: F.struct(F.array_join(F.slice(w, x["p"] + 1, window), " ").alias("k"), x["p"].alias("p"))))
        places = F.sort_array(F.transform(same, lambda x: x["p"]))
        steps = _let(places, lambda p: F.transform(p, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - at, F.lit(window)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def of(w: F.Column) -> F.Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(w, h))))

    return _let(words, of).cast("long")


def _bucket(*words: F.Column) -> F.Column:
    """Bucket of an n-gram; null where a word is missing."""
    there = words[0].isNotNull()
    for w in words[1:]:
        there = there & w.isNotNull()
    return F.when(there, F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int"))


def _places(texts: DataFrame, *keep: str) -> DataFrame:
    """A row a place of ``words``, and one before the first: ``w`` (null there), buckets ``one`` and ``two``."""
    at = texts.withColumn("at", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)))
    w, before = F.get("words", F.col("at")), F.get("words", F.col("at") - 1)
    return at.select(*keep, w.alias("w"), _bucket(w).alias("one"), _bucket(before, w).alias("two"))


def ngram_counts(docs: DataFrame, trusted: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, raw, target``: n-grams of all texts, and of those whose id is in ``trusted(doc_id)``.

    Every text is counted whole, repeated rows each time; a null id is never trusted and a null text
    has no n-grams. Trusted ids are broadcast up to BROADCAST_IDS of them; beyond that texts are shuffled by id.
    """
    ids = trusted.select(F.col("doc_id").alias("__id__")).where("__id__ IS NOT NULL").distinct()
    ids = ids.withColumn("__in__", F.lit(1))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.select(F.col(f"`{doc_key}`").alias("__id__"), words_of(F.col(f"`{text}`")).alias("words"))
    marked = texts.join(F.broadcast(ids) if few else ids, "__id__", "left").select("words", F.coalesce("__in__", F.lit(0)).alias("__in__"))
    places = _places(marked, "__in__").select("__in__", F.explode(F.array("one", "two")).alias("bucket")).where("bucket IS NOT NULL")
    return places.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("__in__").alias("target"))


def ngram_weights(counts: DataFrame) -> DataFrame:
    """``bucket, weight`` for every bucket: log of the ratio of the two smoothed multinomials, in 1/SCALE nats.

    Without trusted n-grams all weights are zero, so that the ratio decides nothing.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if not total["target"]:
        return spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("weight"))
    share = lambda c: (F.coalesce(c, F.lit(0)) + SMOOTHING) / (total[c] + SMOOTHING * BUCKETS)
    all_ = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    return all_.select("bucket", F.round((F.log(share("target")) - F.log(share("raw"))) * SCALE).cast("long").alias("weight"))


def quality_rules(docs: DataFrame, weights: DataFrame, doc_key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A verdict on every text: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score``.

    ``weights`` as ``ngram_weights`` gives them: BUCKETS rows, which is what is broadcast. ``score``: mean
    weight of the n-grams in nats, zero for a text without words. ``kept`` if the base rules hold and
    the score is ``threshold`` or more. A null text counts as empty (and fails the base rules); a row that is
    repeated gives a row each time; texts that share an id, null ids too, are judged on their own; other
    columns are not read; an empty table gives an empty result. The texts are never shuffled: what
    is, is one row of sums a text.
    """
    own = F.col(f"`{text}`")
    texts = docs.select(F.col(f"`{doc_key}`").alias("doc_id"), own.alias("text"), words_of(own).alias("words"))
    counted = texts.select(
        "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), "words", F.size("words").cast("long").alias("n_words"),
        symbols(F.col("text")).alias("n_symbols"), repeated_lines(F.col("text")).alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"))
    stats = ["n_words", "n_symbols", "n_dup_lines", "n_repeat_words"]
    places = _places(counted, "doc_id", "h", "g", *stats)
    for name in ("one", "two"):
        table = F.broadcast(weights.select(F.col("bucket").alias(name), F.col("weight").alias(f"{name}_weight")))
        places = places.join(table, name, "left")
    weight = F.coalesce("one_weight", F.lit(0)) + F.coalesce("two_weight", F.lit(0))
    sums = places.groupBy("doc_id", "h", "g").agg(
        F.count_if(F.col("w").isNull()).alias("copies"), F.sum(weight).alias("weight"), F.sum(F.coalesce(F.char_length("w"), F.lit(0)).cast("long")).alias("chars"), *[F.max(c).alias(c) for c in stats])
    n = F.col("n_words")
    grams = n + F.greatest(n - 1, F.lit(0))
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    # of repeated rows the sums hold each
    weight, chars = F.expr("weight DIV copies"), F.expr("chars DIV copies")
    judged = sums.select(
        "doc_id", "copies", "n_words", chars.alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (weight >= F.lit(int(threshold * SCALE)) * grams)).alias("kept"), F.when(grams > 0, weight / grams / SCALE).otherwise(F.lit(0.0)).alias("score"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def judge_quality(docs: DataFrame, trusted: DataFrame, doc_key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``quality_rules`` with the weights of these texts and their trusted part; counts and weights, a row a bucket, are written once."""
    counts = materialize(ngram_counts(docs, trusted, doc_key, text), "ngrams")
    return quality_rules(docs, materialize(ngram_weights(counts), "weights"), doc_key, text, threshold)
