"""Best-fit packing of token sequences after dominance reduction, planned on the lengths' counts.

The plan works on how many pieces have each length, at most ``capacity`` numbers however many
documents there are. Pieces then find their place by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .tokenizing import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, tokenizer: str, capacity: int, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text and its end id; only longer documents are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(tokenizer), 4 * capacity
        for b in batches:
            keys = b.column(0).to_pylist()
            rows = []
            for k, ids in zip(keys, enc.encode_column(b.column(1)), strict=True):
                ids += end
                rows += [(k, i // width, i // 4, len(p) // 4, zlib.crc32(p)) for i in range(0, len(ids), width) for p in [ids[i : i + width]]]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(cut, PIECES)


class _Counts:
    """Lengths that are left, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {w: c for w, c in counts.items() if c > 0}
        self.w = sorted(self.n)

    def take(self, w: int, k: int) -> None:
        self.n[w] -= k
        if not self.n[w]:
            del self.n[w]
            self.w.pop(bisect_left(self.w, w))

    def fit(self, room: int) -> int:
        """The largest length of at most ``room``; 0 if none."""
        at = bisect_right(self.w, room)
        return self.w[at - 1] if at else 0


def reduce_dominated(counts: _Counts, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fix sets that dominate every other set with the same longest item (Martello and Toth).

    For the longest length w left over: with no partner, {w}; with a partner that fills the bin,
    {w, partner}; if no two others fit beside it, {w, longest partner}; if at most two fit and the
    longest partner is as long as the best pair, {w, longest partner}; and {w, a, b} if a is the
    longest partner and b, beside it, is as long as the shorter of any pair that fits. Lengths that
    no rule covers stay; they are passed over, and the rules go on with the next.
    Returns (times, lengths) sets.
    """
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def fix(*items: int) -> None:
        need = {w: items.count(w) for w in items}
        k = min(counts.n[w] // c for w, c in need.items())
        fixed.append((k, items))
        for w, c in need.items():
            counts.take(w, k * c)

    passed: list[int] = []
    at = capacity
    while w := counts.fit(at):
        room = capacity - w
        left = dict(counts.n)
        left[w] -= 1
        small = [x for x in counts.w[:3] for _ in range(min(3, left[x]))][:3]
        if not small or small[0] > room:
            fix(w)
            continue
        longest = counts.fit(room)
        if longest == w and not left[w]:
            longest = counts.fit(w - 1)
        if longest == room or len(small) < 2 or small[0] + small[1] > room:
            fix(w, longest)
            continue
        if len(small) < 3 or sum(small) > room:
            best, low = 0, 0
            lengths = [x for x in counts.w if left[x] and x <= room]
            for x in lengths:
                at_y = bisect_right(lengths, min(room - x, x))
                while at_y:
                    y = lengths[at_y - 1]
                    if y != x or left[x] > 1:
                        best, low = max(best, x + y), max(low, y)
                        break
                    at_y -= 1
            if longest >= best:
                fix(w, longest)
                continue
            beside = bisect_right(lengths, room - longest)
            while beside and lengths[beside - 1] == longest and left[longest] < 2:
                beside -= 1
            if beside and min(longest, lengths[beside - 1]) >= low and max(longest, lengths[beside - 1]) == longest:
                fix(w, longest, lengths[beside - 1])
                continue
        passed.append(w)
        at = w - 1
    return fixed


def best_fit(counts: _Counts, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit in order of falling length, for all pieces of one length at once."""
    rooms: list[int] = []  # ascending rooms of open bins
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(times: int, items: tuple[int, ...]) -> None:
        room = capacity - sum(items)
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((times, items))

    while counts.w:
        w = counts.w[-1]
        n = counts.n[w]
        counts.take(w, n)
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                each = capacity // w
                if n >= each:
                    put(n // each, (w,) * each)
                if n % each:
                    put(1, (w,) * (n % each))
                break
            room = rooms[at]
            times, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            k = min(times, n)
            if times > k:
                put(times - k, items)
            put(k, (*items, w))
            n -= k
    return [x for v in open_.values() for x in v]


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of every sequence: the fixed sets, then best-fit of the rest."""
    counts = _Counts(lengths)
    return reduce_dominated(counts, capacity) + best_fit(counts, capacity)


def place_slots(sets: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of each item of each set."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for times, items in sets:
        at = 0
        for w in items:
            r = rank.get(w, 0)
            out.append((w, r, r + times, base, at))
            rank[w] = r + times
            at += w
        base += times
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with ``length``, written already) with ``sequence_id`` and ``offset``.

    At most ``capacity`` counts reach the driver. Its plan, whose size follows the number of
    distinct lengths and not of pieces, is broadcast. Ranks are dealt by length and a salt, so one
    length that a third of all pieces share is spread over all partitions.
    """
    spark = pieces.sparkSession
    salts = shuffle_partitions(spark)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    slots = spark.createDataFrame(place_slots(plan(counts, capacity)), "w long, lo long, hi long, seq long, offset long")
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("w")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.withColumn("sequence_id", F.col("seq") + F.col("rank") - F.col("lo")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pack every whole document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece, the end id alone. Null and repeated ids are packed as rows of
    their own; other columns are not read. An empty table gives an empty table. Text is encoded once
    and its pieces written; ids are not moved.
    """
    return pack(materialize(cut_pieces(df, tokenizer, capacity, key, text, end_id), "pieces"), capacity)
