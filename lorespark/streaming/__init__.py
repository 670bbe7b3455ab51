"""Incremental ingest of new works by micro-batches; an extension, the profile engine itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_works(stream: DataFrame, key: str = "openalex_id", when: str = "seen_at", late: str = "1 day") -> DataFrame:
    """First record of each key of a stream; state is dropped once it is later than ``late``."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark([key])


def works_by_window(stream: DataFrame, when: str = "seen_at", length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts of works by event-time window and kind, late ones within ``late`` included."""
    return stream.withWatermark(when, late).groupBy(F.window(when, length).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
