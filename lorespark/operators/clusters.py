"""Seeded clusters of any number of vectors: careful seeding and Lloyd's rounds, a pass over the rows each."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..session import settled
from .lexical import ranked

# The generator of the draws, and the largest of them.
MULTIPLIER, INCREMENT, MASK = 1664525, 1013904223, 0x7FFFFFFF
#: Rows of a block that a draw is looked up in; centres drawn between two writes of the distances.
BLOCK, REFRESH = 8192, 16


class Draws:
    """Numbers from 0 to 1, the same for a seed."""

    def __init__(self, seed: int):
        self.state = seed

    def next(self) -> float:
        self.state = (self.state * MULTIPLIER + INCREMENT) & MASK
        return self.state / MASK


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["x"].tolist(), float)


def _away(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances to every centre, a difference at a time, so that equal points are equally far in any batch."""
    return np.stack([((x - c) ** 2).sum(1) for c in centers], axis=1)


def lloyd(df: DataFrame, k: int | None = None, seed: int = 42, rounds: int = 100, key: str = "profile", vec: str = "vec") -> DataFrame:
    """Clusters of vectors, seeded and deterministic: ``key, cluster, exemplar``. Rows are numbered by ``key``, which is distinct.

    ``k``: the rounded square root of the rows, 2 at least; with as many rows or fewer each is its own. The first centre is
    drawn by number, each next one with a chance that grows with the squared distance from the nearest so far. Then
    rows go to their nearest centre, the lower one on ties, and centres to their means, an empty cluster's to the origin,
    until no row moves. The exemplar is the member nearest the centre, the first on ties.

    The driver holds the centres, a number for each block of BLOCK rows while one is drawn, and that block's
    distances. Everything else is a pass over the rows, whose distances are written every REFRESH centres.
    """
    rows = ranked(df.select(key, F.transform(F.col(vec), lambda e: e.cast("float").cast("double")).alias("x")), key, out="i").withColumn("i", F.col("i").cast("long") - 1)
    rows = settled(rows.select(key, "i", "x").withColumn("away", F.lit(math.inf)))
    n = rows.count()
    kk = k or max(2, math.floor(math.sqrt(n) + 0.5))
    if kk >= n:
        return rows.select(key, F.col("i").cast("int").alias("cluster"), F.lit(True).alias("exemplar"))
    centers = _seeds(rows, n, kk, Draws(seed))
    return _settle(rows, np.array(centers), rounds, key)


def _seeds(rows: DataFrame, n: int, kk: int, draws: Draws) -> list[np.ndarray]:
    at = lambda i: np.array(rows.where(F.col("i") == i).select("x").first()["x"], float)
    centers, since = [at(int(draws.next() * n))], 0
    while len(centers) < kk:
        now = rows.mapInPandas(_nearer(np.array(centers[since:])), rows.schema)
        if len(centers) - since >= REFRESH:
            rows, since = settled(now), len(centers)
            now = rows
        sums = now.groupBy(F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sum("away").alias("s")).orderBy("block").toPandas()
        total = np.cumsum(sums["s"].to_numpy())
        need = draws.next() * total[-1]
        b = int(np.searchsorted(total, need))
        first = int(sums["block"].iat[b]) * BLOCK
        block = now.where(F.col("i").between(first, first + BLOCK - 1)).select("i", "away").orderBy("i").toPandas()
        part = (total[b - 1] if b else 0.0) + np.cumsum(block["away"].to_numpy())
        hit = np.flatnonzero(part >= need)
        centers.append(at(int(block["i"].iat[hit[0] if len(hit) else len(block) - 1])))
    return centers


def _nearer(centers: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def nearer(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield pdf.assign(away=np.minimum(pdf["away"].to_numpy(), _away(_matrix(pdf), centers).min(1)))

    return nearer


def _settle(rows: DataFrame, centers: np.ndarray, rounds: int, key: str) -> DataFrame:
    def step(before: np.ndarray | None, now: np.ndarray):
        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Of each batch and cluster: rows, their sum, and how many came from another cluster."""
            for pdf in parts:
                if not len(pdf):
                    continue
                x = _matrix(pdf)
                own = _away(x, now).argmin(1)
                was = _away(x, before).argmin(1) if before is not None else np.zeros(len(x), int)
                for c in np.unique(own):
                    mine = own == c
                    yield pd.DataFrame({"c": [int(c)], "n": [int(mine.sum())], "moved": [int((was[mine] != c).sum())], "s": [x[mine].sum(0)]})

        each = rows.select("x").mapInPandas(sums, "c int, n long, moved long, s array<double>")
        told = each.groupBy("c").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"))
        means = each.select("c", F.posexplode("s")).groupBy("c", "pos").agg(F.sum("col").alias("s"))
        means = means.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda e: e["s"]).alias("s"))
        return told.join(means, "c").collect()  # a row a centre

    used, before = centers, None
    for _ in range(rounds):
        found = step(before, centers)
        used = centers
        if not sum(r["moved"] for r in found):
            break
        before, centers = centers, np.zeros_like(centers)
        for r in found:
            centers[r["c"]] = np.array(r["s"]) / r["n"]

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = _matrix(pdf)
                own = _away(x, used).argmin(1)
                yield pd.DataFrame({key: pdf[key], "i": pdf["i"], "cluster": own.astype("int32"), "off": ((x - centers[own]) ** 2).sum(1)})

    at = settled(rows.select(key, "i", "x").mapInPandas(ends,
        ST.StructType([ST.StructField(key, rows.schema[key].dataType), ST.StructField("i", ST.LongType()),
            ST.StructField("cluster", ST.IntegerType()), ST.StructField("off", ST.DoubleType())])))
    best = at.groupBy("cluster").agg(F.min(F.struct("off", "i")).alias("b"))
    return at.join(best, "cluster").select(key, "cluster", (F.col("i") == F.col("b.i")).alias("exemplar"))
