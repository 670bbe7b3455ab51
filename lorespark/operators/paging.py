"""Pages: by number, by key with a bound token, clamped sizes; lookups with fallbacks; batch reads."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clamp(n: int | None, default: int, cap: int) -> int:
    return max(1, min(n or default, cap))


def number_page(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Page ``page`` (from 0) of a totally ordered list; a negative page or an empty size is an error."""
    if page < 0 or size < 1:
        raise ValueError("page is 0 or more, size 1 or more")
    return df.orderBy(*order).offset(page * size).limit(size)


def total_pages(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).alias("total_pages"))


def filters_digest(filters: dict) -> str:
    return hashlib.sha256(json.dumps(filters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def make_token(key: list, filters: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps({"k": key, "f": filters_digest(filters)}).encode()).decode()


def read_token(token: str, filters: dict) -> list:
    """The key to go on after; a token of other filters is an error."""
    try:
        found = json.loads(base64.urlsafe_b64decode(token.encode()))
        key, digest = found["k"], found["f"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("unreadable page token") from e
    if digest != filters_digest(filters):
        raise ValueError("page token of another listing")
    return key


def keyset_page(df: DataFrame, year: str, id_: str, size: int, after: list | None = None) -> DataFrame:
    """Newest first, then id; a missing year is -1. ``after``: (-year, id) of the last row seen. A filter and a top-n, no offset."""
    y = -F.coalesce(F.col(year), F.lit(-1))
    own = df.withColumn("__y", y)
    if after:
        own = own.where((F.col("__y") > after[0]) | ((F.col("__y") == after[0]) & (F.col(id_) > F.lit(after[1]))))
    return own.orderBy("__y", id_).limit(size).drop("__y")


def batch_read(df: DataFrame, ids: str, id_: str, cap: int = 20) -> DataFrame:
    """Rows of a comma list, trimmed, without repeats, in its order, at most ``cap``."""
    wanted = list(dict.fromkeys(x.strip() for x in ids.split(",") if x.strip()))[:cap]
    asked = df.sparkSession.createDataFrame(list(enumerate(wanted)), "pos int, want string")
    return df.join(F.broadcast(asked), F.col(id_).cast("string") == F.col("want")).drop("want")


def point_lookup(asked: DataFrame, profiles: DataFrame, slug_aliases: DataFrame, rid_aliases: DataFrame) -> DataFrame:
    """``asked(ref)`` to profile: its slug, else a retired slug, else its rid if one record has it (retired rids redirected)."""
    by_slug = profiles.select(F.col("slug").alias("ref"), "profile_id", F.lit(1).alias("p"))
    by_alias = slug_aliases.select(F.col("old_slug").alias("ref"), "profile_id", F.lit(2).alias("p"))
    one = profiles.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("profile_id").alias("profile_id")).where("n = 1")
    by_rid = one.select(F.col("rid").alias("ref"), "profile_id", F.lit(3).alias("p"))
    by_old = rid_aliases.join(one, rid_aliases["new_rid"] == one["rid"]).select(F.col("old_rid").alias("ref"), "profile_id", F.lit(4).alias("p"))
    found = asked.join(by_slug.union(by_alias).union(by_rid).union(by_old), "ref")
    return found.groupBy("ref").agg(F.min_by("profile_id", "p").alias("profile_id"), F.min("p").alias("step"))


def text_search_sort(df: DataFrame, needle: str, columns: list[str], order: str, numeric: bool = False, descending: bool = False) -> DataFrame:
    """Rows with the needle in any column, in any case; sorted by any column."""
    n = F.lit(needle.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), n), F.lit(False))
    key = F.col(order).cast("double") if numeric else F.col(order)
    return df.where(hit).orderBy(key.desc() if descending else key.asc(), *columns)


def top_items(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
