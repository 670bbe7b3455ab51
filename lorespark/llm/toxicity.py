"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores.

Labels are of documents, so the tokens' labels are derived: a word is toxic where it stands in a row
of label 1 and one of its units (itself, or a beginning of it) goes with label 1 far more often than
chance in the training rows. Emissions add up the same units, so that unseen words of a known
beginning are tagged too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORDS = re.compile(r"[^\W\d_]+")
#: Rows of either label that are learned from, units the model knows, training windows and their width on each side.
TRAIN_ROWS, MODEL_UNITS, WINDOWS, SIDE = 4000, 2000, 6000, 8
#: Lengths of the beginnings of words that are units.
BEGINNINGS = (4, 5, 6, 7, 8)
LONGEST = 40
#: A unit is a label unit if this many rows of label 1 have it, and its rate there is this many times the other.
LEAST_ROWS, LEAST_RATIO = 5, 12.0
_TEXT = "__text__"


def units(word: str) -> list[str]:
    """The word itself (marked; not of words over LONGEST letters), and its beginnings."""
    own = ["=" + word] if len(word) <= LONGEST else []
    return [*own, *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def _presence(sample: DataFrame) -> DataFrame:
    """Rows of either label that have each unit: ``w, toxic, n``; added up in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[y].update({u for w in set(WORDS.findall((t.as_py() or "").lower())) for u in units(w)})
            for y, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["w", "toxic", "n"])

    return sample.select(_TEXT, "toxic").mapInArrow(count, "w string, toxic int, n long").groupBy("w", "toxic").agg(F.sum("n").alias("n"))


def _windows(sample: DataFrame, label_units: frozenset[str], share: float) -> DataFrame:
    """Training windows ``words, tags``: around label units in rows of label 1, and a share of other places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            rows = []
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = [w[: LONGEST + 1] for w in WORDS.findall((t.as_py() or "").lower())]
                for at in range(SIDE, len(words) + SIDE, 2 * SIDE + 1):
                    own = words[at - SIDE : at + SIDE + 1]
                    marked = [not label_units.isdisjoint(units(w)) for w in own]
                    tags, hit = [int(y == 1 and m) for m in marked], any(marked)
                    # a place is drawn by its own words, so reruns draw the same
                    if hit or zlib.crc32(" ".join(own).encode()) < share * 2**32:
                        rows.append((own, tags, hit))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.bool_())], names=["words", "tags", "hit"])

    return sample.select(_TEXT, "toxic").mapInArrow(cut, "words array<string>, tags array<int>, hit boolean")


class Crf:
    """Two tags (0 other, 1 toxic); emissions by word, transitions between neighbouring tags."""

    def __init__(self, weights: dict[str, float], transitions: np.ndarray, start: np.ndarray, other: float, scale: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.weights, self.transitions, self.start, self.other, self.scale = weights, transitions, start, other, scale
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def _emission(self, word: str) -> float:
        found = self.other + sum(self.weights.get(u, 0.0) for u in units(word))
        if len(word) <= 40:
            self.memo[word] = found
        return found

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log-odds of tag 1 of each word by itself; words are kept between texts, up to a bound."""
        if len(self.memo) > 300_000:
            self.memo.clear()
        have = self.memo
        return np.array([have[w] if w in have else self._emission(w) for w in words])

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Forward-backward probability of tag 1 at every word of every text, texts of like length together."""
        return list(self.each_marginal([self.emissions(t) for t in texts]))

    def each_marginal(self, odds: list[np.ndarray], group: int = 512) -> list[np.ndarray]:
        order = sorted(range(len(odds)), key=lambda i: len(odds[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(odds)
        at = 0
        while at < len(order):
            # a group is of texts up to twice as long as its shortest, and of bounded size
            top = max(64, 2 * len(odds[order[at]]))
            end = at + 1
            while end < len(order) and end - at < group and len(odds[order[end]]) <= top and (end - at + 1) * len(odds[order[end]]) <= 1 << 22:
                end += 1
            own = order[at:end]
            for i, p in zip(own, self._group([odds[i] for i in own]), strict=True):
                out[i] = p
            at = end
        return out

    def _group(self, odds: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(o) for o in odds])
        steps, n = int(sizes.max(initial=0)), len(odds)
        e = np.zeros((steps, n))
        for k, o in enumerate(odds):
            e[: len(o), k] = o
        e = np.exp(np.clip(e, -30, 30))
        t = np.exp(self.transitions)
        s = np.exp(self.start)
        # the ratio of the two forward (backward) messages is all that a two-tag chain needs
        ahead, back = np.zeros((steps, n)), np.ones((steps, n))
        if steps:
            ahead[0] = s[1] / s[0] * e[0]
        for i in range(1, steps):
            r = ahead[i - 1]
            ahead[i] = (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0]) * e[i]
        for i in range(steps - 2, -1, -1):
            q = back[i + 1] * e[i + 1]
            back[i] = np.where(i + 1 < sizes, (t[1, 0] + t[1, 1] * q) / (t[0, 0] + t[0, 1] * q), 1.0)
        ratio = ahead * back
        p = ratio / (1 + ratio)
        return [p[: len(o), k] for k, o in enumerate(odds)]

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * most)))


def train_crf(windows: list[tuple[list[str], list[int]]], vocabulary: list[str], steps: int = 300, rate: float = 0.2, decay: float = 3e-4) -> Crf:
    """Maximum conditional likelihood by adaptive gradient steps; gradients from forward-backward."""
    ids = {u: i + 1 for i, u in enumerate(vocabulary)}
    width, most = max((len(w) for w, _ in windows), default=1), 2 + len(BEGINNINGS)
    n, none = max(1, len(windows)), len(ids) + 1
    # features of a place: the constant, its known units, and a unit that weighs nothing
    x, y, on = np.full((n, width, most), none), np.zeros((n, width), int), np.zeros((n, width), bool)
    x[:, :, 0] = 0
    for k, (words, tags) in enumerate(windows):
        for i, w in enumerate(words):
            known = [ids[u] for u in units(w) if u in ids]
            x[k, i, 1 : 1 + len(known)] = known
        y[k, : len(tags)] = tags
        on[k, : len(words)] = True
    theta = np.zeros(len(ids) + 2 + 4 + 2)
    theta[0] = -2
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = on[:, 1:] & on[:, :-1]
    for step in range(1, steps + 1):
        emit, trans, start = theta[: none + 1], theta[-6:-2].reshape(2, 2), theta[-2:]
        pot = np.zeros((n, width, 2))
        pot[:, :, 1] = emit[x].sum(2)
        pot = np.exp(np.clip(pot, -30, 30))
        t = np.exp(trans)
        a, b = np.zeros((n, width, 2)), np.ones((n, width, 2))
        a[:, 0] = pot[:, 0] * np.exp(start)
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for i in range(1, width):
            a[:, i] = np.where(on[:, i, None], (a[:, i - 1] @ t) * pot[:, i], a[:, i - 1])
            a[:, i] /= a[:, i].sum(1, keepdims=True)
        for i in range(width - 2, -1, -1):
            b[:, i] = np.where(on[:, i + 1, None], (b[:, i + 1] * pot[:, i + 1]) @ t.T, 1.0)
            b[:, i] /= b[:, i].sum(1, keepdims=True)
        p = a * b
        p /= p.sum(2, keepdims=True)
        pair = a[:, :-1, :, None] * t * (pot[:, 1:] * b[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        grad = np.zeros_like(theta)
        grad[: none + 1] = np.bincount(x[on].ravel(), np.repeat((y - p[:, :, 1])[on], most), none + 1)
        grad[none] = 0
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        grad[-6:-2] = (seen - pair[both].sum(0)).ravel()
        grad[-2:] = np.bincount(y[on[:, 0], 0], minlength=2) - p[on[:, 0], 0].sum(0)
        grad = grad / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf({u: float(theta[i]) for u, i in ids.items()}, theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy(), float(theta[0]))


def _fit_scale(total: np.ndarray, most: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the rows' labels on the marginals' sum and maximum (Newton steps, slight ridge)."""
    x = np.stack([np.ones(len(y)), np.log1p(total), most], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.diag([1e-6, 1, 1])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.5 * np.array([0, 1, 1]) * w)
    return tuple(float(v) for v in w)


def learn_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> Crf:
    """A tagger from texts of ``docs`` with a row of ``labels`` that is 0 or 1.

    Learns from about ``train_rows`` rows of either label (all, if fewer), drawn by a hash of the key:
    that many keys are broadcast to the texts, so texts are not shuffled, and the sample is written
    once. The driver gets at most MODEL_UNITS units, WINDOWS windows of 2 * SIDE + 1 words and two
    numbers a sampled row. A key with both labels is learned from twice, once as each; null texts count as empty;
    without rows of either label the model gives every text the share of label 1.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key__"), F.col(label).cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    part = {y: int((1 << 20) * min(1.0, train_rows / n)) for y, n in sizes.items()}
    h = F.pmod(F.xxhash64("__key__"), F.lit(1 << 20))
    drawn = rows.where(h < F.when(F.col("toxic") == 1, part.get(1, 0)).otherwise(part.get(0, 0)))
    sample = materialize(docs.select(F.col(key).alias("__id__"), F.col(text).alias(_TEXT)).join(F.broadcast(drawn), F.col("__id__") == F.col("__key__")).select(_TEXT, "toxic"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        rate = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Crf({}, np.zeros((2, 2)), np.zeros(2), -2.0, (float(np.log(rate / (1 - rate))), 0.0, 0.0))
    n1, n0 = sizes[1], sizes[0]
    words = _presence(sample).groupBy("w").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
    ratio = (F.col("a") / n1) / ((F.col("n") - F.col("a") + 0.5) / n0)
    strong = words.where(F.col("a") >= LEAST_ROWS).withColumn("q", ratio).where(F.col("q") >= LEAST_RATIO).withColumn("by", F.col("a") * F.log("q"))
    label_units = [r["w"] for r in strong.orderBy(F.desc("by"), "w").select("w").limit(MODEL_UNITS // 4).collect()]
    common = [r["w"] for r in words.orderBy(F.desc("n"), "w").select("w").limit(MODEL_UNITS - len(label_units)).collect()]
    vocabulary = list(dict.fromkeys([*label_units, *common]))
    found = materialize(_windows(sample, frozenset(label_units), 0.02), "toxic-windows")
    by_hash = F.xxhash64("words")
    drawn = [r for hit in (True, False) for r in found.where(F.col("hit") == hit).orderBy(by_hash).select("words", "tags").limit(WINDOWS // 2).collect()]
    model = train_crf([(r["words"], r["tags"]) for r in drawn], vocabulary)
    fitted = _summaries(sample.select(_TEXT, "toxic"), model).select("total", "most", "toxic").toPandas()
    model.scale = _fit_scale(fitted["total"].to_numpy(), fitted["most"].to_numpy(), fitted["toxic"].to_numpy(float))
    return model


def _summaries(df: DataFrame, model: Crf, body: str = _TEXT, least: float = 0.5) -> DataFrame:
    """``df`` (its text in ``body``) with the marginals' ``total`` and ``most``, and the words over ``least``."""
    at = df.columns.index(body)
    schema = df.drop(body).withColumns({"total": F.lit(0.0), "most": F.lit(0.0), "spans": F.lit(None).cast("array<struct<start:int,end:int>>")}).schema
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t.as_py() or "") for t in b.column(at)]
            total, most, spans = np.zeros(len(texts)), np.zeros(len(texts)), [None] * len(texts)
            first = 0
            while first < len(texts):
                end, size = first, 0
                while end < len(texts) and (end == first or size < 8 << 20):
                    size += len(texts[end])
                    end += 1
                own = texts[first:end]
                # lower case can change a text's length; offsets are then looked up in the text itself
                lowered = [WORDS.findall(t.lower()) for t in own]
                for k, p in enumerate(model.marginals(lowered)):
                    i = first + k
                    total[i], most[i] = p.sum(), p.max(initial=0.0)
                    spans[i] = _spans(own[k], p, least)
                first = end
            cols = [c for i, c in enumerate(b.columns) if i != at]
            names = [n for i, n in enumerate(b.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total), pa.array(most), pa.array(spans, span)], names=[*names, "total", "most", "spans"])

    return df.mapInArrow(run, schema)


def _spans(text: str, p: np.ndarray, least: float) -> list[dict]:
    """Maximal runs of words over ``least`` as code-point offsets."""
    marked = np.flatnonzero(p >= least)
    if not len(marked):
        return []
    places = [m.span() for m in WORDS.finditer(text)]
    if len(places) != len(p):  # some letters' lower case is more than one character: mark by the folded text
        places = [m.span() for m in WORDS.finditer(text.lower())]
    out: list[dict] = []
    last = -2
    for i in marked.tolist():
        if i == last + 1:
            out[-1]["end"] = places[i][1]
        else:
            out.append({"start": places[i][0], "end": places[i][1]})
        last = i
    return out


def score_toxicity(df: DataFrame, model: Crf, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` without ``text``, with ``score``, ``predicted`` and the offending ``spans`` (start, end in code points).

    Whole texts; null, empty and word-less texts get the score of no evidence. Rows repeat as they
    do in ``df``; columns of these names are replaced; an empty table stays empty.
    """
    keep = [c for c in df.columns if c not in (text, "score", "predicted", "spans", "total", "most")]
    body = _TEXT
    while body in keep:
        body += "_"
    found = _summaries(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body)), model, body)
    a, b, c = model.scale
    score = 1 / (1 + F.exp(-(F.lit(a) + b * F.log1p("total") + c * F.col("most"))))
    return found.withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("total", "most")
