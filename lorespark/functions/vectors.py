"""Vector expressions over ARRAY<DOUBLE>: JVM-side higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import col


def doubles(v) -> Column:
    """Components as double; null and NaN components count as 0."""
    return F.transform(col(v).cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v) -> Column:
    """L2-normalized; norms under 1e-12 are returned as they are."""
    n = norm(v)
    return F.when(n < 1e-12, col(v)).otherwise(F.transform(col(v), lambda x: x / n))


def cosine(a, b) -> Column:
    """Cosine; 0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def hit_score(cos) -> Column:
    """Rounded cosine to a score in 0..1: max(0, (1 + cos) / 2), to four places."""
    return F.round(F.greatest(F.lit(0.0), (1 + col(cos)) / 2), 4)


def mean_vector(df: DataFrame, keys: list[str], v: str, out: str = "vec") -> DataFrame:
    """Component-wise mean by group: partial sums before the shuffle, arrays never collected by group."""
    each = df.select(*keys, F.posexplode(v).alias("__i", "__x"))
    means = each.groupBy(*keys, "__i").agg(F.avg("__x").alias("__m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(out))


def calibrated(raw, mean, std) -> Column:
    """(1 + tanh(z / 2)) / 2 with the deviation at least 1e-6."""
    z = (col(raw) - col(mean)) / F.greatest(col(std), F.lit(1e-6))
    return (1 + F.tanh(z / 2)) / 2
