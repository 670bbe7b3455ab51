"""Hard negatives over one-dimensional distance keys.

Vectors get one more component, so that all have the length of the longest: then the nearest ones to an
anchor are those of the highest inner product. Each is keyed by its nearest pivot and its
distance from it, and the table lies sorted by (pivot, distance) in lanes. By the triangle inequality
a row whose key differs from the anchor's own distance to that pivot by b is at least b away: an anchor
scans the key interval around it, widens it lane by lane, and stops once the bound on what
remains is below the worst that it holds. A lower bound on scores takes the same form, so a search
between two scores is a search of an annulus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, shuffle_partitions
from .exact_topk import matrix, scaled_vectors

#: Rows that pivots are fitted on at most, most pivots, rounds of fitting; any pivots give the same result.
FIT_ROWS, PIVOTS, FIT_ROUNDS = 8192, 64, 5
#: Bytes of a lane's vectors as a matrix, least rows of a lane, rows of a block, anchors tried at once.
LANE_BYTES, LANE_ROWS, BLOCK, QUERIES = 16 << 20, 2048, 1024, 256
#: Lanes of the first scan of an anchor; each scan after it reaches this many times further.
FIRST_LANES, WIDEN = 2, 8
_SLACK = 1e-6

_ASKED = "q long, vec_id long, label long, v array<long>, windows array<struct<w:int,hi:double,floor:double>>"
_HITS = "q long, w int, vec_id long, score long"


def labelled_vectors(df: DataFrame, noisy: F.Column | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, classes: int = 10) -> DataFrame:
    """``vec_id, label, v``: scaled as ``scaled_vectors`` does; rows with a null id, label or vector, or with a null or
    non-finite component, take no part. Where ``noisy`` (a condition on vec_id) holds, the label is the next of ``classes``."""
    own = df.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"), F.col(f"`{label}`").cast("long").alias("label"))
    rows = scaled_vectors(own, scale=scale, keep=("label",))
    if noisy is not None:
        rows = rows.withColumn("label", F.when(noisy, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    return rows.select("vec_id", "label", "v")


def fit_pivots(rows: DataFrame, dim: int, total: int, longest: float) -> np.ndarray:
    """Pivots of a bounded, hash-drawn sample of the augmented vectors; none for an empty table."""
    share = int((1 << 20) * min(1.0, FIT_ROWS / max(1, total)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("v").limit(4 * FIT_ROWS).toArrow().combine_chunks()
    x = augmented(matrix(sample["v"].combine_chunks(), dim), longest) if len(sample) else np.zeros((1, dim + 1))
    order = np.lexsort(x.T[::-1])
    x = x[order]
    pivots = np.unique(x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)], axis=0)
    for _ in range(FIT_ROUNDS):
        near = distances(x, pivots).argmin(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(pivots))
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def augmented(v: np.ndarray, longest: float) -> np.ndarray:
    """One more component, with which all vectors have the length ``longest``."""
    v = v.astype(float)
    return np.hstack([v, np.sqrt(np.maximum(0.0, longest**2 - (v**2).sum(1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


class Bounds:
    """Score bounds of runs of keys: a run is a pivot and the least and greatest distance from it."""

    def __init__(self, pivot: np.ndarray, least: np.ndarray, most: np.ndarray, longest: float):
        self.pivot, self.least, self.most, self.longest = pivot, least, most, longest

    def of(self, own: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most and least score of anchors (their distances to all pivots, their squared lengths) in each run.

        The distance d of an anchor (q, 0) and a row has d^2 = |q|^2 + longest^2 - 2 * score.
        """
        at = own[:, self.pivot]
        slack = _SLACK * (1 + at + self.most[None, :])
        near = np.maximum(0.0, np.maximum(at - self.most, self.least - at) - slack)
        far = at + self.most + slack
        both = square[:, None] + self.longest**2
        # scores are whole numbers; a thousandth covers what the arithmetic rounds
        give = 1e-3 + _SLACK * both
        return (both - near**2) / 2 + give, (both - far**2) / 2 - give


class Asked:
    """Some anchors and the windows of scores that each is asked for."""

    def __init__(self, batch: pa.RecordBatch, dim: int, pivots: np.ndarray):
        self.ids, self.label = batch["vec_id"].to_numpy(), batch["label"].to_numpy()
        self.v = matrix(batch["v"], dim)
        self.square = (self.v.astype(float) ** 2).sum(1)
        self.own = distances(np.hstack([self.v.astype(float), np.zeros((len(self.v), 1))]), pivots)
        windows = batch["windows"]
        flat = windows.flatten()
        self.of = np.repeat(np.arange(len(windows)), np.diff(windows.offsets.to_numpy()))
        self.w, self.hi, self.floor = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("w", "hi", "floor"))
        self.floor = self.floor.copy()

    def least_floor(self) -> np.ndarray:
        out = np.full(len(self.ids), np.inf)
        np.minimum.at(out, self.of, self.floor)
        return out

    def highest(self) -> np.ndarray:
        out = np.full(len(self.ids), -np.inf)
        np.maximum.at(out, self.of, self.hi)
        return out


def scan(asked: Asked, blocks: list[tuple], bounds: Bounds, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` rows of some blocks for every window of the anchors: window, id, score. Blocks are tried from the anchors' keys outward."""
    none = np.zeros(0, np.int64)
    best = none, none, none
    most, least = bounds.of(asked.own, asked.square)
    highest = asked.highest()
    for b in np.argsort(-most.max(0), kind="stable"):
        live = np.flatnonzero((most[:, b] >= asked.least_floor()) & (least[:, b] <= highest))
        if not len(live):
            continue
        ids, label, v, size = blocks[b]
        if math.sqrt(asked.square.max()) * size < 1 << 52:
            # doubles hold every sum of whole numbers up to here exactly
            score = (asked.v[live].astype(float) @ v.T.astype(float)).astype(np.int64)
        else:
            score = asked.v[live] @ v.T
        fits = (asked.label[live][:, None] == label[None, :]) == same
        fits &= asked.ids[live][:, None] != ids[None, :]
        row = np.full(len(asked.ids), -1)
        row[live] = np.arange(len(live))
        win = np.flatnonzero(row[asked.of] >= 0)
        mine = score[row[asked.of[win]]]
        i, j = np.nonzero(fits[row[asked.of[win]]] & (mine >= asked.floor[win][:, None]) & (mine <= asked.hi[win][:, None]))
        w, sc, vi = (np.concatenate(x) for x in zip(best, (win[i], mine[i, j], ids[j]), strict=True))
        order = np.lexsort((vi, -sc, w))
        w, sc, vi = w[order], sc[order], vi[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        last = place == k - 1
        asked.floor[w[last]] = np.maximum(asked.floor[w[last]], sc[last])
        best = w[place < k], sc[place < k], vi[place < k]
    return best[0], best[2], best[1]


class Index:
    """A table of labelled vectors, sorted by (pivot, distance) in lanes."""

    def __init__(self, rows: DataFrame, scratch: Scratch):
        """``rows(vec_id, label, v)``, written already. A lane is a bounded matrix; of each lane and pivot the driver holds one row."""
        self.spark, self.scratch = rows.sparkSession, scratch
        n2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(n2).alias("n2")).first()
        self.total, self.dim, self.longest = size["n"], size["dim"] or 0, math.sqrt(size["n2"] or 0.0)
        self.pivots = fit_pivots(rows, self.dim, self.total, self.longest)
        most = max(1, LANE_BYTES // (8 * max(1, self.dim)))
        lanes = max(1, math.ceil(self.total / most), min(shuffle_partitions(self.spark), self.total // LANE_ROWS))
        keyed = rows.mapInArrow(self._keys(), "pivot int, dist double, vec_id long, label long, v array<long>")
        dealt = keyed.repartitionByRange(lanes, "pivot", "dist", "vec_id", F.xxhash64("label", "v")).sortWithinPartitions("pivot", "dist", "vec_id").withColumn("lane", F.spark_partition_id())
        self.rows = scratch.table(dealt, "lanes")
        runs = self.rows.groupBy("lane", "pivot").agg(F.min("dist").alias("least"), F.max("dist").alias("most")).orderBy("lane", "pivot").toArrow()
        self.run_lane, pivot, least, most_ = (runs[c].to_numpy() for c in ("lane", "pivot", "least", "most"))
        self.lanes = 1 + int(self.run_lane.max(initial=0))
        self.bounds = Bounds(pivot, least, most_, self.longest)

    def _keys(self):
        dim, longest, pivots = self.dim, self.longest, self.pivots

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = distances(augmented(matrix(b["v"], dim), longest), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), b["vec_id"], b["label"], b["v"]], ["pivot", "dist", "vec_id", "label", "v"])

        return keys

    def search(self, asked: DataFrame, same: bool, k: int, what: str) -> DataFrame:
        """The best ``k`` rows of every window: ``q, w, vec_id, score, rank``.

        ``asked`` as _ASKED: anchors by a key ``q`` of their own, each with windows from ``floor`` to ``hi``, both included.
        ``same``: rows of the anchor's label, or of any other. Higher scores come first, ties by smaller id.

        Each round takes the anchors that are not done yet over the lanes next in order of their bounds; what they
        hold after it raises their floors, and an anchor is done once the bound of its next lane is below all of them.
        """
        first = self.scratch.table(asked, f"{what}-asked")
        now, best, done, reach = first, None, 0, FIRST_LANES
        top = Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id")
        for step in range(64):
            hits = self._visit(now, done, reach, same, k)
            if best is not None:
                hits = best.drop("rank").unionByName(hits)
            best = self.scratch.table(hits.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), f"{what}-best-{step}")
            if reach >= self.lanes:
                return best
            done, reach = reach, min(self.lanes, reach * WIDEN)
            floors = best.where(F.col("rank") == k).select("q", "w", F.col("score").cast("double").alias("held"))
            floors = floors.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "held"))).alias("held"))
            raised = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), x["hi"].alias("hi"), F.greatest(x["floor"], F.element_at("held", x["w"])).alias("floor")))
            now = first.join(floors, "q", "left").withColumn("windows", raised).select(*first.columns)
        raise RuntimeError("a table of more lanes than 8^64")

    def _visit(self, asked: DataFrame, done: int, reach: int, same: bool, k: int) -> DataFrame:
        """Hits of the lanes from the ``done``-th to the ``reach``-th of each anchor, as far as their bounds ask for them."""
        dim, pivots, bounds, run_lane, lanes = self.dim, self.pivots, self.bounds, self.run_lane, self.lanes

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), QUERIES):
                    b = whole.slice(at, QUERIES)
                    mine = Asked(b, dim, pivots)
                    most, least = bounds.of(mine.own, mine.square)
                    top, low = np.full((lanes, len(b)), -np.inf), np.full((lanes, len(b)), np.inf)
                    np.maximum.at(top, run_lane, most.T)
                    np.minimum.at(low, run_lane, least.T)
                    order = np.argsort(-top.T, axis=1, kind="stable")[:, done:reach]
                    wanted = np.take_along_axis(top.T, order, 1) >= mine.least_floor()[:, None]
                    wanted &= np.take_along_axis(low.T, order, 1) <= mine.highest()[:, None]
                    i, j = np.nonzero(wanted)
                    take = b.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(order[i, j].astype(np.int32)), *take.columns], ["lane", *take.schema.names])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of a lane its rows come first, by key, then its anchors."""
            lane, parts, ready = None, [], None
            for whole in batches:
                kind = whole["lane"].to_numpy() * 2 + whole["asks"].to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1), len(kind)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if lo == hi:
                        continue
                    run, (at, asks) = whole.slice(lo, hi - lo), divmod(int(kind[lo]), 2)
                    if at != lane:
                        lane, parts, ready = at, [], None
                    if not asks:
                        parts.append((run["pivot"].to_numpy(), run["dist"].to_numpy(), run["vec_id"].to_numpy(), run["label"].to_numpy(), matrix(run["v"], dim)))
                        continue
                    if ready is None:
                        ready, parts = _blocks(parts, bounds.longest), []
                    for x in range(0, len(run), QUERIES):
                        b = run.slice(x, QUERIES)
                        mine = Asked(b, dim, pivots)
                        w, ids, score = scan(mine, *ready, same, k)
                        yield pa.RecordBatch.from_arrays([pa.array(b["q"].to_numpy()[mine.of[w]]), pa.array(mine.w[w].astype(np.int32)), pa.array(ids), pa.array(score)], ["q", "w", "vec_id", "score"])

        none = F.lit(None)
        windows = asked.schema["windows"].dataType
        sent = asked.mapInArrow(send, f"lane int, {_ASKED}")
        sent = sent.select("lane", F.lit(True).alias("asks"), F.lit(0).alias("pivot"), F.lit(0.0).alias("dist"), "q", "vec_id", "label", "v", "windows")
        rows = self.rows.select("lane", F.lit(False).alias("asks"), "pivot", "dist", F.lit(0).cast("long").alias("q"), "vec_id", "label", "v", none.cast(windows).alias("windows"))
        met = rows.union(sent).repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "asks", "pivot", "dist")
        return met.mapInArrow(meet, _HITS)


def _blocks(parts: list[tuple], longest: float) -> tuple[list[tuple], Bounds]:
    """Rows of a lane, sorted by key, as blocks of one pivot each, and the bounds of those."""
    if not parts:
        none = np.zeros(0)
        return [], Bounds(none.astype(int), none, none, longest)
    pivot, dist, ids, label, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.flatnonzero(np.diff(pivot, prepend=-1))
    cuts = sorted({int(at) for lo, hi in zip(starts, [*starts[1:], len(pivot)]) for at in range(lo, hi, BLOCK)})
    spans = list(zip(cuts, [*cuts[1:], len(pivot)]))
    blocks = [(ids[a:b], label[a:b], v[a:b], math.sqrt((v[a:b].astype(float) ** 2).sum(1).max())) for a, b in spans]
    return blocks, Bounds(pivot[cuts], np.array([dist[a:b].min() for a, b in spans]), np.array([dist[a:b].max() for a, b in spans]), longest)


def hard_negatives(vectors: DataFrame, anchors: F.Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and positive the hardest negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` as ``labelled_vectors`` gives them; ``anchors``: a condition on vec_id. An anchor's positives are its
    first ``positives`` other rows of its label by inner product; its negatives for each are the first ``negatives`` rows
    of another label whose score is between ``low`` and ``high`` hundredths of the positive's, both included. Ties go to
    the smaller id; fewer: all. Positives of a negative score have none.

    Shorter vectors count as padded with zeros. Rows repeated whole count once; other rows that share an
    id each take part, and none of them is its own anchor's positive. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    with_key = vectors.withColumn("q", F.xxhash64("vec_id", "label", "v"))
    with Scratch(spark) as scratch:
        rows = scratch.table(with_key, "rows")
        # whole rows are shuffled only where a key does come twice
        if rows.groupBy("q").count().where("count > 1").limit(1).count():
            rows = scratch.table(rows.distinct(), "distinct")
        index = Index(rows.select("vec_id", "label", "v"), scratch)
        base = rows.where(anchors).select("q", "vec_id", "label", "v")
        window = F.struct(F.lit(1).alias("w"), F.lit(math.inf).alias("hi"), F.lit(-math.inf).alias("floor"))
        found = index.search(base.withColumn("windows", F.array(window)), True, positives, "positives")
        # a window of scores for each positive: ceil(low * score / 100) to floor(high * score / 100)
        s = F.col("score")
        hi, floor = F.expr(f"score * {high} - pmod(score * {high}, 100)") / 100, F.expr(f"score * {low} + pmod(-score * {low}, 100)") / 100
        windows = found.where(s >= 0).groupBy("q").agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("w"), hi.cast("double").alias("hi"), floor.cast("double").alias("floor"))).alias("windows"))
        bad = index.search(base.join(windows, "q").select("q", "vec_id", "label", "v", "windows"), False, negatives, "negatives")
        pairs = found.select("q", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = bad.select("q", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["q", "w"])
        out = out.join(base.select("q", F.col("vec_id").alias("anchor_id")), "q")
        return materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")


def oracle() -> str:
    """The same rows in DuckDB SQL: every anchor against every row."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, c.label = q.label AS alike, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE alike) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
