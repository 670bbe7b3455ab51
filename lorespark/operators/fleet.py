"""Rebuild of the indexes of all profiles: work dealt by bytes, failures beside results, restart from digests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .diffs import diff
from .embedding import CHUNK_KEY

#: Bytes of text of a task; texts that the encoder gets at once.
TASK_BYTES, BATCH = 16 << 20, 64


def dealt_by_bytes(chunks: DataFrame, text: str = "embed_text", task_bytes: int | None = None) -> DataFrame:
    """``chunks`` in as many partitions as their bytes ask for, each of about as many bytes.

    Rows are put in an order by hash; ranges of it know the bytes before them, one number a range, and a row's
    task is where its first byte falls. A long text is one row, and takes a task of its own if it is that long.
    """
    task_bytes = task_bytes or TASK_BYTES
    order = F.xxhash64(*CHUNK_KEY)
    own = settled(chunks.withColumn("__b", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("__o", order).repartitionByRange("__o",
        *CHUNK_KEY).withColumn("__part", F.spark_partition_id()))
    sizes = own.groupBy("__part").agg(F.sum("__b").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    behind = F.sum("__b").over(Window.partitionBy("__part").orderBy("__o", *CHUNK_KEY)) - F.col("__b")
    tasks = max(1, math.ceil(total / task_bytes))
    placed = own.join(F.broadcast(before), "__part").withColumn("__task", F.floor((F.col("__before") + behind) / task_bytes).cast("int"))
    return placed.repartitionById(tasks, F.least("__task", F.lit(tasks - 1))).select(*chunks.columns)


def _encoded(make: Callable[[], Callable[[list[str]], np.ndarray]]):
    """Vectors of texts; a batch that fails is tried again text by text, so that only its bad texts have an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            encode, broken = make(), None
        except Exception as e:  # an encoder that does not load fails every text, not the job
            encode, broken = None, f"{type(e).__name__}: {e}"

        def each(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
            if broken is not None:
                return [(None, broken)] * len(texts)
            try:
                return [(v, None) for v in np.asarray(encode(texts), np.float32).tolist()]
            except Exception as e:
                if len(texts) == 1:
                    return [(None, f"{type(e).__name__}: {e}")]
                return [x for t in texts for x in each([t])]

        for pdf in parts:
            got = [x for at in range(0, len(pdf), BATCH) for x in each(pdf["embed_text"].iloc[at : at + BATCH].tolist())]
            yield pdf.drop(columns="embed_text").assign(vector=[g[0] for g in got], error=[g[1] for g in got])

    return run


def rebuild(chunks: DataFrame, index: DataFrame, make: Callable, backend_spec: str, force: bool = False, task_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index of all profiles after a rebuild, and a report ``profile, status, embedded, kept, removed, error``.

    ``chunks`` as ``enumerate_chunks`` gives them, ``index(CHUNK_KEY, text_hash, vector, backend_spec)``. Only chunks whose digest or
    encoder has changed are embedded (all with ``force``), so that a second run, or one after a failure, goes on from what
    is there. A profile of which any text fails keeps the index that it had, is ``failed`` and names the first error; it
    costs no other profile anything. Otherwise ``rebuilt``, or ``current`` where nothing had to be done.
    """
    have = index.where("false") if force else index.where(F.col("backend_spec") == backend_spec)
    state = settled(diff(have.select(*CHUNK_KEY, "text_hash"), chunks.select(*CHUNK_KEY, "text_hash"), CHUNK_KEY, "text_hash"))
    todo = chunks.select(*CHUNK_KEY, "text_hash", "embed_text").join(state.where("status IN ('added', 'changed')").select(*CHUNK_KEY), CHUNK_KEY, "left_semi")
    shape = index.select(*CHUNK_KEY, "text_hash", "vector").withColumn("error", F.lit(None).cast("string")).schema
    made = settled(dealt_by_bytes(todo, task_bytes=task_bytes).mapInPandas(_encoded(make), shape))
    errors = made.where("error IS NOT NULL").groupBy("profile").agg(F.min_by("error", F.struct(*CHUNK_KEY[1:])).alias("error"))
    bad = errors.select("profile")
    fresh = made.where("error IS NULL").drop("error").withColumn("backend_spec", F.lit(backend_spec)).join(bad, "profile", "left_anti")
    kept = have.join(state.where("status = 'kept'").select(*CHUNK_KEY), CHUNK_KEY, "left_semi").join(bad, "profile", "left_anti")
    columns = index.columns
    after = fresh.select(*columns).unionByName(kept.select(*columns)).unionByName(index.join(bad, "profile", "left_semi").select(*columns))
    n = state.groupBy("profile").agg(F.count_if(F.col("status").isin("added", "changed")).alias("embedded"),
        F.count_if(F.col("status") == "kept").alias("kept"), F.count_if(F.col("status") == "removed").alias("removed"))
    status = F.when(F.col("error").isNotNull(), "failed").when((F.col("embedded") > 0) | (F.col("removed") > 0), "rebuilt").otherwise("current")
    none = lambda c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    return after, n.join(errors, "profile", "left").select("profile", status.alias("status"), none("embedded"), none("kept"), none("removed"), "error")
