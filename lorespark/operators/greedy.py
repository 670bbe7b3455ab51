"""Greedy choices for many lists at once, in rounds over certified heads.

A greedy choice takes the row of the highest value, the row's score less a penalty for its likeness to what
is chosen already. The largest likeness only rises, so a value only falls, and the value at the last look bounds it
for good. Each round looks at every list's rows once, in tasks of any size, and sends the rows of the highest
values, a head of bounded length, to one place. There choices are made one by one for as long as the best of the
head comes before all rows outside. A list of any length is never gathered, a round makes many choices, and it
makes one at least, as the first of a fresh head is the first of all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..session import settled

#: Rows of a list's head.
HEAD = 512

#: Likeness of rows to one chosen row, by their items; NaN is no likeness at all.
Likeness = Callable[[list, object], np.ndarray]


def choose(df: DataFrame, keys: list[str], k: int, item: str, order: list[str], likeness: Likeness, least: float, keep: float, penalty: float,
    first_by_score: bool, score: str = "score") -> DataFrame:
    """The first ``k`` choices of every list (``keys``): columns of ``df`` and ``pick`` from 1.

    A row's value is ``keep * score - penalty * likeness``, of the largest likeness to any chosen row by the column ``item``, or of 0
    where there is none; no likeness is under ``least``. ``first_by_score``: the first choice goes by the score alone. Ties go
    to the higher score, then by ``order``, which must tell the rows of a list apart. Keys are not null.
    """
    rows = settled(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    narrow = [*dict.fromkeys([*keys, *order, score, item])]
    state_schema = ST.StructType([*[ST.StructField(c, kinds[c]) for c in narrow], ST.StructField("__near", ST.DoubleType())])
    made_schema = ST.StructType([*[ST.StructField(c, kinds[c]) for c in dict.fromkeys([*keys, *order])], ST.StructField("__item", kinds[item]),
        ST.StructField("pick", ST.IntegerType()), ST.StructField("__more", ST.BooleanType())])

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__r").reset_index(drop=True)
        names, done = list(pdf[order].itertuples(index=False, name=None)), int(pdf["__done"].iloc[0])
        out, outside = _pick(pdf[score].to_numpy(float), pdf["__near"].to_numpy(float), list(pdf["__item"]), names, done, k,
            bool(pdf["__open"].iloc[0]), likeness, keep, penalty, first_by_score, HEAD)
        made = pdf.iloc[out][[*dict.fromkeys([*keys, *order]), "__item"]].copy()
        made["pick"] = np.arange(done + 1, done + 1 + len(out), dtype="int32")
        return made.assign(__more=outside and done + len(out) < k)

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.reset_index(drop=True)
            near = pdf["__near"].to_numpy(float).copy()
            for at in pdf.groupby(keys, sort=False, dropna=False).indices.values():
                latest, items = pdf["__latest"].iat[at[0]], [pdf[item].iat[i] for i in at]
                for other in latest:
                    near[at] = np.fmax(near[at], likeness(items, other["__item"]))
            yield pdf[narrow].assign(__near=near)

    value = keep * F.col(score) - penalty * F.coalesce(F.nanvl("__near", F.lit(0.0)), F.lit(0.0))
    unknown = F.isnan(F.coalesce("__near", F.lit(float("nan")))) & F.col(item).isNotNull() & F.lit(least < 0)
    by = Window.partitionBy(*keys).orderBy(F.desc("__value"), F.desc(score), *order)
    state, chosen = rows.select(*narrow).withColumn("__near", F.lit(None).cast("double")), None
    while True:
        told = state.groupBy(*keys).agg(F.bool_or(unknown).alias("__open"))
        if chosen is None:
            told = told.withColumn("__done", F.lit(0))
        else:
            told = told.join(chosen.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("__done")), keys)
        now = state.join(told, keys).withColumn("__value", F.when((F.col("__done") == 0) & F.lit(first_by_score), F.col(score)).otherwise(value))
        heads = now.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= HEAD + 1)
        fresh = settled(heads.withColumn("__item", F.col(item)).groupBy(*keys).applyInPandas(pick, made_schema))
        chosen = fresh if chosen is None else chosen.unionByName(fresh)
        more = fresh.where("__more")
        if more.isEmpty():
            break
        # lists that go on: at most ``k`` choices each
        latest = more.groupBy(*keys).agg(F.collect_list(F.struct("__item")).alias("__latest"))
        names = [*dict.fromkeys([*keys, *order])]
        rest = state.join(latest, keys).join(more.select(*names), names, "left_anti")
        state = settled(rest.mapInPandas(look, state_schema))
    return rows.join(chosen.drop("__item", "__more"), [*dict.fromkeys([*keys, *order])]).select(*df.columns, "pick")


def _pick(s: np.ndarray, near: np.ndarray, items: list, names: list[tuple], done: int, k: int, open_: bool, likeness: Likeness, keep: float,
    penalty: float, first_by_score: bool, head: int) -> tuple[list[int], bool]:
    """Choices among the first ``head`` rows, as places, and whether there is a row outside; ``open_``: one outside may yet turn out to be unlike."""
    near, n = near.copy(), min(head, len(s))
    place = lambda i, by_score=False: (-(s[i] if by_score else keep * s[i] - penalty * np.nan_to_num(near[i])), -s[i], *names[i])
    outside = place(head) if len(s) > head else None
    left, out = list(range(n)), []
    while left and done + len(out) < k:
        best = min(left, key=lambda i: place(i, first_by_score and done + len(out) == 0))
        # after the first choice rows outside may have come first
        if out and outside is not None and (open_ or not place(best) < outside):
            break
        left.remove(best)
        out.append(best)
        near[:n] = np.fmax(near[:n], likeness(items[:n], items[best]))
    return out, outside is not None


def choose_short(df: DataFrame, keys: list[str], k: int, item: str, order: list[str], likeness: Likeness, keep: float, penalty: float,
    first_by_score: bool, score: str = "score") -> DataFrame:
    """``choose`` for lists that the caller has cut to HEAD rows or fewer: one pass; a longer list is an error."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > HEAD:
            raise ValueError(f"a list of more than {HEAD} rows: use choose")
        names = list(pdf[order].itertuples(index=False, name=None))
        out, _ = _pick(pdf[score].to_numpy(float), np.full(len(pdf), np.nan), list(pdf[item]), names, 0, k, False, likeness, keep, penalty, first_by_score, HEAD)
        return pdf.iloc[out].assign(pick=np.arange(1, len(out) + 1, dtype="int32"))

    schema = ST.StructType([*df.schema.fields, ST.StructField("pick", ST.IntegerType())])
    return df.groupBy(*keys).applyInPandas(pick, schema)


def cosine_likeness(items: list, other: object) -> np.ndarray:
    """Dot products of unit vectors with one; none where either is missing or lengths differ."""
    out = np.full(len(items), np.nan)
    if other is None or not len(other):
        return out
    o = np.asarray(other, float)
    fits = [i for i, v in enumerate(items) if v is not None and len(v) == len(o)]
    if fits:
        # a sum a row, so that equal vectors are equally alike in any batch
        out[fits] = (np.stack([np.asarray(items[i], float) for i in fits]) * o).sum(1)
    return out


def overlap_likeness(items: list, other: object) -> np.ndarray:
    """Common words over the words of the smaller set; 0 for an empty one."""
    o = set(other)
    small = [min(len(v), len(o)) for v in items]
    return np.array([len(o.intersection(v)) / n if n else 0.0 for v, n in zip(items, small, strict=True)])
