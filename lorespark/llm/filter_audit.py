"""Audit of quality filters: who removes what in every order, by the multilinear extension.

Each part of the corpus is reduced to counts of failure masks (which filters a text fails). The count
of texts that a set S of filters removes has a multilinear extension, the removal polynomial

    f(x) = sum over non-empty T of a(T) * prod of x_i for i in T,   a(T) = (-1)^(|T|+1) * #{texts that fail all of T}.

Its corners f(1_S) are what S removes, so that survivors after each step of each order are differences
of corners. Shapley's value of filter i is the integral of df/dx_i along the diagonal, and
as df/dx_i (t, ..., t) = sum over T with i of a(T) * t^(|T|-1), it is sum a(T) / |T| exactly: rationals
whose denominators divide 60, kept as whole numbers by the factor n! (120 for five filters).
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import words_of

#: The filters, by letter; bit i of a mask is set if a text fails filter i.
FILTERS = "ABCDE"


def failure_mask(text: F.Column, words: F.Column) -> F.Column:
    """Bits of A to D, which follow from the text alone: under 50 words; under 65 distinct of a hundred words;
    over 5 capitals of a hundred code points; a mark of ``#$%&*|``. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    fails = (
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.char_length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    )
    mask = F.lit(0)
    for i, failed in enumerate(fails):
        mask = mask + F.when(failed, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def mask_counts(docs: DataFrame, labels: DataFrame, doc_key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: texts of each part by the filters that they fail.

    Filter E: the text (by its SHA-256; null as empty) is also that of a smaller id, in any part. A null id
    is not smaller than any and has none that is; rows of one id are not copies of each other.
    A text is good, or toxic, if a label row of its id says so; a row that is repeated counts each time.

    Texts are read once and reduced to hash and mask before anything is shuffled. Rows meet by (id, hash), then as
    sums by (hash, part, labels), so a text with any number of copies is as many rows as parts and labels hold it.
    """
    own = docs.select(F.col(f"`{doc_key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    own = own.select("id", "part", "text", words_of(F.col("text")).alias("words"))
    own = own.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), failure_mask(F.col("text"), F.col("words")).alias("mask"))
    own = own.groupBy("id", "h", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    own = own.join(says, "id", "left").select("id", "h", "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # an id and a text are one row a part now: the rows of a group's smallest id are counted beside it
    held = own.groupBy("h", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_null"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    least = held.groupBy("h").agg(F.min("first.id").alias("least"))
    held = held.join(least, "h")
    fresh = F.col("n_null") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    e = 1 << FILTERS.index("E")
    kinds = held.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", fresh.alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - fresh).alias("n")))))
    n = F.col("n")
    return kinds.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), n).otherwise(F.lit(0))).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(F.lit(0))).alias("toxic"))


def diagonal_integral(size: int) -> Fraction:
    """Integral of t^(size-1) from 0 to 1."""
    return Fraction(1, size)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters, step by step, from ``mask_counts``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; every part has
    a row for every order and step, zeros included; no parts, no rows. Everything but the counts is a fixed
    table of the subsets of ``filters`` (243 pairs of subset and superset for five), broadcast.
    """
    spark = counts.sparkSession
    k, full = len(filters), (1 << len(filters)) - 1
    whole = math.factorial(k)
    size = lambda m: bin(m).count("1")
    # coefficients a(T), T = 0 holding the number of texts
    inside = spark.createDataFrame([(m, t, 1 if t == 0 or size(t) % 2 else -1) for m in range(full + 1) for t in range(full + 1) if t & m == t], "mask int, t int, sign int")
    columns = ("n", "good", "toxic")
    terms = counts.join(F.broadcast(inside), "mask").groupBy("part", "t").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in columns])
    # corners of the three polynomials; f leaves the term of the empty set out
    corner = spark.createDataFrame([(t, s) for s in range(full + 1) for t in range(full + 1) if t & s == t], "t int, s int")
    value = lambda c: F.sum(F.when(F.col("t") > 0, F.col(c)).otherwise(F.lit(0))).alias(c)
    corners = terms.join(F.broadcast(corner), "t").groupBy("part", "s").agg(*[value(c) for c in columns])
    # n! times the diagonal's integral of each partial derivative
    slope = spark.createDataFrame([(t, i, int(whole * diagonal_integral(size(t)))) for t in range(1, full + 1) for i in range(k) if t >> i & 1], "t int, i int, times int")
    shapley = terms.join(F.broadcast(slope), "t").groupBy("part", "i").agg(F.sum(F.col("n") * F.col("times")).alias("shapley"))

    texts = terms.where("t = 0").select("part", F.col("n").alias("texts"))
    by_set = corners.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct(*columns)))).alias("f"))
    by_filter = shapley.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("i", "shapley"))).alias("shapley"))
    steps = []
    for order in itertools.permutations(range(k)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((len(steps), name, step, i, before, before | 1 << i, 1 << i, full & ~(1 << i)))
            before |= 1 << i
    each = F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at")
    steps = spark.createDataFrame(steps, "at int, filter_order string, step int, i int, before int, after int, alone int, others int")
    met = texts.join(by_set, "part").join(by_filter, "part", "left").select("*", each).join(F.broadcast(steps), "at")
    at = lambda s, c="n": F.coalesce(F.element_at("f", F.col(s))[c], F.lit(0))
    everything = F.coalesce(F.element_at("f", F.lit(full))["n"], F.lit(0))
    removed = at("after") - at("before")
    return met.select(
        "part", "filter_order", "step", (F.col("texts") - at("after")).alias("kept"), removed.alias("removed"), (at("alone") - removed).alias("redundant"),
        (everything - at("others")).alias("unique_fails"), (at("after", "good") - at("before", "good")).alias("good_lost"), (at("after", "toxic") - at("before", "toxic")).alias("toxic_lost"),
        F.coalesce(F.element_at("shapley", F.col("i")), F.lit(0).cast("long")).alias("shapley"))


def oracle() -> str:
    """The same rows in DuckDB SQL without the polynomial: every text is followed through every order."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM d JOIN c USING (text) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x)
  JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS bad,
  len(list_filter(string_split(before, ''), lambda y: contains(fails, y) AND y <> '')) > 0 AS gone FROM g, s),
t AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM t
"""
