"""Language by rank-order profiles: out-of-place distance of a document's n-gram ranks to each language's."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of n-grams of a padded word, ranks of a profile, rows that a language's profile is learned from.
NGRAMS, RANKS, TRAIN_ROWS = (1, 2, 3), 300, 3000
UNKNOWN = "und"
_FOUND = "__lorespark_language__"
_MEMO_WORDS, _MEMO_GRAMS = 100_000, 200_000


def letter_runs(text: str) -> list[str]:
    """Runs of letters of the lower-case text."""
    found = _WORDS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in NGRAMS for i in range(len(padded) - n + 1)]


def learn_profiles(labelled: DataFrame, text: str, lang: str, sample_key: F.Column, train_rows: int = TRAIN_ROWS, ranks: int = RANKS) -> dict[str, dict[str, int]]:
    """Ranks of the most frequent n-grams of each language.

    Learns from about ``train_rows`` rows a language (all, if fewer), drawn by ``sample_key``'s hash;
    the driver gets one count a language and at most ``ranks`` n-grams of each.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.pmod(F.xxhash64(sample_key), F.lit(1 << 20)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int((1 << 20) * min(1.0, train_rows / n)))])
    sample = known.where(F.col("h") < share[F.col("lang")]).select("lang", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, Counter] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(k, Counter()).update(letter_runs(t))
            for k, own in words.items():
                total: Counter = Counter()
                for w, n in own.items():
                    for g in grams(w):
                        total[g] += n
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(total), pa.string()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "g", "n"])

    counted = sample.mapInArrow(count, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g")) - 1).where(F.col("r") < ranks)
    profiles: dict[str, dict[str, int]] = {}
    for r in top.select("lang", "g", "r").collect():
        profiles.setdefault(r["lang"], {})[r["g"]] = r["r"]
    return profiles


class Ranker:
    """Predicts from profiles. N-grams of words are kept between texts, up to a bound."""

    def __init__(self, profiles: dict[str, dict[str, int]], ranks: int = RANKS):
        self.langs, self.ranks = sorted(profiles), ranks
        self.fixed = {g: i for i, g in enumerate(sorted({g for p in profiles.values() for g in p}))}
        self.places = np.full((len(self.langs), len(self.fixed)), ranks, np.int64)
        for k, lang in enumerate(self.langs):
            for g, r in profiles[lang].items():
                self.places[k, self.fixed[g]] = r
        self._fresh()

    def _fresh(self) -> None:
        self.ids, self.words = dict(self.fixed), {}

    def _word(self, word: str) -> np.ndarray:
        ids = self.ids
        made = np.array([ids.setdefault(g, len(ids)) for g in grams(word)], np.int64)
        if len(word) <= 40:
            self.words[word] = made
        return made

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score). Nothing to compare, no letter or null: unknown, 0. Ties: the first language by name."""
        counts = Counter(letter_runs(text)) if text else None
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        if len(self.words) > _MEMO_WORDS or len(self.ids) > _MEMO_GRAMS:
            self._fresh()
        have = self.words
        each = [have[w] if w in have else self._word(w) for w in counts]
        ids = np.concatenate(each)
        weights = np.repeat(np.fromiter(counts.values(), np.int64, len(each)), [len(e) for e in each])
        if len(self.ids) < 60_000:
            n = np.bincount(ids, weights).astype(np.int64)
            own = np.flatnonzero(n)
            n = n[own]
        else:
            own, inverse = np.unique(ids, return_inverse=True)
            n = np.bincount(inverse, weights).astype(np.int64)
        # a rank is the number of n-grams that are more frequent, so equal counts need no order
        rank = len(n) - np.searchsorted(np.sort(n), n, side="right")
        top = rank < self.ranks
        own, rank = own[top], rank[top]
        known = own < len(self.fixed)
        away = np.abs(self.places[:, own[known]] - rank[known]).sum(axis=1) + self.ranks * int((~known).sum())
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.ranks * len(own)))


def predict_languages(df: DataFrame, profiles: dict[str, dict[str, int]], text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; replaces columns of these names.

    Profiles (bounded: languages x ranks) travel with the function. Null texts and texts without a
    letter: ``und`` with score 0. Whole texts, every row; an empty table stays empty.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ranker = Ranker(profiles)
        for batch in texts:
            yield pd.DataFrame([ranker.predict(t) for t in batch], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    # a function of the text alone: other columns do not travel to Python and back
    found = F.pandas_udf(run, "lang_pred string, score double")(F.col(f"`{text}`"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")]
    made = df.select(*keep, found.alias(_FOUND))
    return made.select(*keep, F.col(f"{_FOUND}.lang_pred").alias("lang_pred"), F.col(f"{_FOUND}.score").alias("score"))
