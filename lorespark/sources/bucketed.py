"""Profiles as tables that lie together: a root and its children, bucketed alike by profile, nested again without a shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "profile_id"


def store(tables: Mapping[str, DataFrame], prefix: str, buckets: int, key: str = KEY) -> None:
    """Write each table as ``prefix_name`` in the warehouse, in ``buckets`` buckets by ``key`` and sorted by it.

    Choose the buckets so that one of the largest table fits a task; all tables of a prefix have as many.
    """
    for name, df in tables.items():
        # one shuffle a table now, so that no read needs one
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(f"{prefix}_{name}")


def table(spark: SparkSession, prefix: str, name: str) -> DataFrame:
    return spark.table(f"{prefix}_{name}")


def nested(spark: SparkSession, prefix: str, children: Mapping[str, tuple[str, ...]], root: str = "profiles", key: str = KEY) -> DataFrame:
    """A row a profile: the root's columns, and for each of ``children`` (name to columns of its order) a list of its rows.

    Tables meet by buckets: rows of a profile lie in one bucket of each, so neither the grouping of children nor
    their joins shuffle. A profile without rows of a child has an empty list; rows without a profile are left out. A
    profile's list is one row by nature: it is what a document holds.
    """
    out = table(spark, prefix, root)
    for name, order in children.items():
        rows = table(spark, prefix, name)
        rest = [c for c in rows.columns if c != key]
        place = F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in order], F.struct(*rest).alias("row"))
        each = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["row"]).alias(name))
        out = out.join(each, key, "left").withColumn(name, F.coalesce(name, F.array().cast(each.schema[name].dataType)))
    return out


def shredded(documents: DataFrame, children: tuple[str, ...], key: str = KEY) -> dict[str, DataFrame]:
    """The tables of nested documents again: ``profiles``, and a table a child; the inverse of ``nested``."""
    out = {"profiles": documents.drop(*children)}
    for name in children:
        out[name] = documents.select(key, F.inline(name))
    return out


class LazyProfile:
    """One profile: its root row at once, its children when asked for; each read looks into one bucket of one table."""

    def __init__(self, spark: SparkSession, prefix: str, key: int | str, root: str = "profiles", column: str = KEY):
        self.spark, self.prefix, self.key, self.column = spark, prefix, key, column
        found = self._rows(root).take(2)
        if not found:
            raise LookupError(f"no profile {key!r}")
        if len(found) > 1:
            raise LookupError(f"several profiles {key!r}")
        self.root = found[0].asDict()

    def _rows(self, name: str) -> DataFrame:
        return table(self.spark, self.prefix, name).where(F.col(self.column) == self.key)

    def child(self, name: str, *order: str | Column) -> DataFrame:
        rows = self._rows(name).drop(self.column)
        return rows.orderBy(*order) if order else rows


def load(spark: SparkSession, prefix: str, ref: str, slug: str = "slug", rid: str = "rid", aliases: str | None = None, key: str = KEY) -> LazyProfile:
    """A profile by a reference: its slug, its rid, its id, or a former slug of the alias table, in this order.

    A slug that several have, or a rid of several records, is an error, as is a reference that nobody has.
    """
    root = table(spark, prefix, "profiles")
    for column in (slug, rid, key):
        hits = root.where(F.col(column).cast("string") == ref).select(key).take(2)
        if len(hits) > 1:
            raise LookupError(f"several profiles with {column} {ref!r}")
        if hits:
            return LazyProfile(spark, prefix, hits[0][0], column=key)
    if aliases is not None:
        hits = table(spark, prefix, aliases).where(F.col("old_slug") == ref).select(key).distinct().take(2)
        if len(hits) == 1:
            return LazyProfile(spark, prefix, hits[0][0], column=key)
    raise LookupError(f"no profile {ref!r}")
