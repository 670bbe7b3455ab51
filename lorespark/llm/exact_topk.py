"""Exact inner-product top-k: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Vectors of a block, queries tried at once, queries of a group, rows that the rotation is fitted on, least rows of a lane.
BLOCK, QUERIES, QUERY_GROUP, FIT_ROWS, LANE_ROWS = 1024, 512, 1 << 20, 8192, 1024
#: Most vectors of the head that gives first floors; most bytes of a lane, or of the head, as a matrix.
HEAD_ROWS, MATRIX_BYTES = 4096, 16 << 20
_SLACK = 1e-6


def scaled_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) of each component as double; vectors that are null or
    have null or non-finite components, and rows with a null id, go. Columns in ``keep`` stay."""
    x = F.col(f"`{vector}`").cast("array<double>")
    good = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return df.where(good & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"), *[F.col(f"`{c}`") for c in keep])


def fit_rotation(vectors: DataFrame, dim: int, total: int, rows: int = FIT_ROWS) -> np.ndarray:
    """Right singular vectors of a bounded, hash-drawn sample (any orthogonal matrix gives right results)."""
    if not dim:
        return np.zeros((0, 0))
    share = int((1 << 20) * min(1.0, rows / max(1, total)))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("v").limit(4 * rows).collect()
    x = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        x[i, : len(r["v"])] = r["v"]
    _, basis = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(basis[:, ::-1])


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Block:
    """Candidates of about one norm, with their rotated sums."""

    def __init__(self, ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, head: int):
        self.ids, self.c = ids, c
        rotated = c @ rotation
        self.first = np.ascontiguousarray(rotated[:, :head])
        self.norm = np.sqrt((rotated**2).sum(1))
        self.rest = np.sqrt((rotated[:, head:] ** 2).sum(1))
        self.most = self.norm.max(initial=0.0)


def blocks(ids: np.ndarray, c: np.ndarray, rotation: np.ndarray, head: int) -> list[Block]:
    """Blocks by falling norm."""
    order = np.argsort(-(c.astype(float) ** 2).sum(1), kind="stable")
    return [Block(ids[o], c[o], rotation, head) for o in (order[at : at + BLOCK] for at in range(0, len(order), BLOCK))]


class TopK:
    """The best so far of some queries, above their floors: score falling, then id rising."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int, head: int):
        self.ids, self.q, self.k = ids, q, k
        rotated = q @ rotation
        self.first = np.ascontiguousarray(rotated[:, :head])
        self.norm = np.sqrt((rotated**2).sum(1))
        self.rest = np.sqrt((rotated[:, head:] ** 2).sum(1))
        self.floor = floor.astype(float).copy()
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def feed(self, block: Block) -> bool:
        """Take in a block; False once no block of smaller norm can matter."""
        live = np.flatnonzero(self.norm * block.most * (1 + _SLACK) + _SLACK >= self.floor)
        if not len(live):
            return False
        bound = self.first[live] @ block.first.T + np.outer(self.rest[live], block.rest)
        bound += _SLACK * (1 + np.outer(self.norm[live], block.norm))
        i, j = np.nonzero((bound >= self.floor[live][:, None]) & (self.ids[live][:, None] != block.ids[None, :]))
        i = live[i]
        score = np.empty(len(i), np.int64)
        if 16 * len(i) > len(live) * len(block.ids) and self.norm.max() * block.most < 1 << 52:
            # many are left: one product of matrices, whose sums of integers doubles hold exactly
            score[:] = (self.q.astype(float) @ block.c.T.astype(float))[i, j]
        else:
            for at in range(0, len(i), 1 << 15):
                s = slice(at, at + (1 << 15))
                score[s] = np.einsum("ij,ij->i", self.q[i[s]], block.c[j[s]])
        good = score >= self.floor[i]
        qi, sc, vi = (np.concatenate([a, b]) for a, b in zip(self.best, (i[good], score[good], block.ids[j[good]]), strict=True))
        order = np.lexsort((vi, -sc, qi))
        qi, sc, vi = qi[order], sc[order], vi[order]
        new = np.ones(len(qi), bool)
        new[1:] = (np.diff(qi) != 0) | (np.diff(sc) != 0) | (np.diff(vi) != 0)
        qi, sc, vi = qi[new], sc[new], vi[new]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep, full = place < self.k, place == self.k - 1
        self.floor[qi[full]] = np.maximum(self.floor[qi[full]], sc[full])
        self.best = qi[keep], sc[keep], vi[keep]
        return True


def exact_topk(vectors: DataFrame, queries: F.Column, k: int = 5) -> DataFrame:
    """Of each query row its ``k`` highest inner products among all other rows: ``query_id, rank, vec_id, score``.

    ``vectors(vec_id, v)`` as ``scaled_vectors`` gives them; ``queries``: a condition on vec_id. Ties go
    to the smaller vec_id. Shorter vectors count as padded with zeros. Rows repeated whole count once;
    a query's own row is every row of its id. Fewer than ``k`` others: all; empty in, empty out.

    The longest vectors, a head of a bounded number, go to every query first and give its floor. The
    others lie in lanes by falling norm, shuffled once; a query goes only to lanes whose longest vector
    times its own length still reaches its floor. A lane is a matrix of bounded bytes and its queries
    pass by it in batches, so a task holds no more at any size of the table.
    """
    spark = vectors.sparkSession
    n2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = materialize(vectors.distinct().withColumn("n2", n2), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.count_if(queries).alias("asked")).first()
    total, dim = size["n"], size["dim"] or 0
    rotation = fit_rotation(rows, dim, total)
    part = max(1, dim // 4)
    most = max(1, MATRIX_BYTES // (8 * max(1, dim)))

    top = rows.orderBy(F.desc("n2"), "vec_id").limit(min(HEAD_ROWS, most)).select("vec_id", "v").toArrow().combine_chunks()
    longest = blocks(top["vec_id"].to_numpy(), matrix(top["v"].combine_chunks(), dim), rotation, part)

    # lanes of at most ``most`` rows, as many as there are tasks to run where rows allow
    lanes = max(1, math.ceil(total / most), min(shuffle_partitions(spark), total // LANE_ROWS))
    groups = max(1, math.ceil(size["asked"] / QUERY_GROUP))
    dealt = materialize(rows.repartitionByRange(lanes, F.desc("n2"), "vec_id", F.xxhash64("v")).withColumn("lane", F.spark_partition_id()), "lanes")
    # a number a lane; a session may deal more lanes than asked for
    lengths = {r["lane"]: math.sqrt(r["n2"]) for r in dealt.groupBy("lane").agg(F.max("n2").alias("n2")).collect()}
    lanes = 1 + max(lengths, default=0)
    reach = np.maximum.accumulate(np.array([lengths.get(lane, 0.0) for lane in range(lanes)])[::-1])[::-1]

    def tried(ids: np.ndarray, q: np.ndarray, floor: np.ndarray, against: list[Block]) -> TopK:
        found = TopK(ids, q, floor, rotation, k, part)
        for block in against:
            if not found.feed(block):
                break
        return found

    def first_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), QUERIES):
                b = whole.slice(at, QUERIES)
                ids = b["vec_id"].to_numpy()
                found = tried(ids, matrix(b["v"], dim), np.full(len(ids), -np.inf), longest)
                qi, score, vec = found.best
                ends = np.searchsorted(qi, np.arange(len(ids) + 1)).astype(np.int32)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = (found.floor - _SLACK) / (1 + _SLACK) / found.norm
                least = np.where(found.norm > 0, least, -np.inf)
                upto = np.searchsorted(-reach, -least, side="right").astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(score), pa.array(vec)], ["score", "vec_id"])
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(found.floor), pa.array(upto), pa.ListArray.from_arrays(ends, hits)], ["vec_id", "v", "floor", "lanes", "hits"])

    asked = materialize(rows.where(queries).select("vec_id", "v").repartition(shuffle_partitions(spark), "vec_id", "v").mapInArrow(
        first_floors, "vec_id long, v array<long>, floor double, lanes int, hits array<struct<score:long,vec_id:long>>"), "floors")

    def by_lane(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of a lane come first, by falling norm, then its queries."""
        key, ids, rows_, lane = None, [], [], None
        for whole in batches:
            kind = whole["at"].to_numpy() * 2 + whole["asks"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1), len(kind)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                run = whole.slice(lo, hi - lo)
                at, asks = divmod(int(kind[lo]), 2)
                if at != key:
                    key, ids, rows_, lane = at, [], [], None
                if not asks:
                    ids.append(run["vec_id"].to_numpy())
                    rows_.append(matrix(run["v"], dim))
                    continue
                if lane is None:
                    lane = blocks(np.concatenate(ids), np.vstack(rows_), rotation, part) if ids else []
                    ids, rows_ = [], []
                for q in range(0, len(run), QUERIES):
                    b = run.slice(q, QUERIES)
                    mine = b["vec_id"].to_numpy()
                    qi, score, vec = tried(mine, matrix(b["v"], dim), b["floor"].to_numpy(zero_copy_only=False), lane).best
                    yield pa.RecordBatch.from_arrays([pa.array(mine[qi]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")
    cand = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cand = cand.select((F.col("lane") * groups + F.col("group")).alias("at"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("floor"))
    sent = asked.where("lanes > 0").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    sent = sent.select((F.col("lane") * groups + group).alias("at"), F.lit(True).alias("asks"), "vec_id", "v", "floor")
    met = cand.union(sent).repartitionById(lanes * groups, F.col("at")).sortWithinPartitions("at", "asks")
    found = met.mapInArrow(by_lane, "query_id long, vec_id long, score long")
    first = asked.select(F.col("vec_id").alias("query_id"), F.inline("hits")).select("query_id", "vec_id", "score")
    ranked = found.union(first).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
