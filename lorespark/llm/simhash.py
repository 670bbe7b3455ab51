"""Near duplicates by SimHash: fingerprints, a grid of segment bit counts, exact links, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, shuffle_partitions

SHINGLE = 3
RADIUS = 3
#: Groups that the 32 two-bit segments are dealt into: (first bit, bits). A segment's bit count is one coordinate.
GROUPS = ((0, 12), (12, 12), (24, 10), (34, 10), (44, 10), (54, 10))
#: Largest number of fingerprints on one side of a block of a crowded cell.
BLOCK = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each the majority of the shingles' XXH64 (seed 42); none: zero."""
    import xxhash

    h = xxhash.xxh64_intdigest
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    if len(words) < shingle:
        hashed = [h(b" ".join(words), 42)]
    else:
        join = b" ".join
        hashed = [h(join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    return majority(np.array(hashed, "<u8"))


def majority(hashed: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, repeats included."""
    ones = np.zeros(64, np.int64)
    raw = hashed.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 14):
        ones += np.unpackbits(raw[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashed)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: F.Column) -> F.Column:
    """Bit counts of the 32 two-bit segments, each in its own two bits of a long."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grid_cells(fp: F.Column, radius: int = RADIUS) -> F.Column:
    """Cells of the grid of bit counts that hold ``fp``, one for each choice of groups.

    Two points within Manhattan distance ``radius`` differ in at most ``radius`` groups of
    coordinates, so they share the cell (all coordinates equal) of at least one choice of the others.
    """
    counts = segment_counts(fp)
    cells = []
    for n, kept in enumerate(combinations(GROUPS, len(GROUPS) - radius)):
        mask = 0
        for first, bits in kept:
            mask |= ((1 << bits) - 1) << first
        signed = mask - (1 << 64) if mask >> 63 else mask
        cells.append(F.struct(F.lit(n).cast("byte").alias("n"), counts.bitwiseAND(F.lit(signed).cast("long")).alias("c")))
    return F.array(*cells)


def links_in_block(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between two sides: Manhattan distance first, then exact bits."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    edges = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ua, ub = nodes[left].view("<u8"), nodes[right].view("<u8")
    low = np.uint64(0x5555555555555555)
    ca, cb = (((u & low) + ((u >> np.uint64(1)) & low)) for u in (ua, ub))
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        d = ca[at : at + step, None] ^ cb[None, :]
        # counts 0..2: an odd difference is one, otherwise differing high bits are two
        manhattan = np.bitwise_count(d & low) + 2 * np.bitwise_count((d >> np.uint64(1)) & ~d & low)
        i, j = np.nonzero(manhattan <= radius)
        exact = np.bitwise_count(ua[at + i] ^ ub[j]) <= radius
        x, y = left[at + i[exact]], right[j[exact]]
        # a vectorized pass joins most; the loop sees only links between different roots
        while len(x):
            rx, ry = parent[x], parent[y]
            while (parent[rx] != rx).any():
                rx = parent[rx]
            while (parent[ry] != ry).any():
                ry = parent[ry]
            apart = rx != ry
            x, y, rx, ry = x[apart], y[apart], np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart]
            if not len(x):
                break
            top, first = np.unique(rx, return_index=True)
            parent[top] = ry[first]
            edges += zip(nodes[x[first]].tolist(), nodes[y[first]].tolist(), strict=True)
    return edges


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` that join exactly the fingerprints of ``distinct(fp)`` that links within ``radius`` join.

    Cells with one fingerprint go first. A crowded cell is dealt into sides of about ``block``; each
    pair of sides is a task's work of bounded size and returns a forest, never all of its pairs.
    """
    spark = distinct.sparkSession
    cells = distinct.select("fp", F.explode(grid_cells(F.col("fp"), radius)).alias("g")).select("fp", "g.n", "g.c")
    crowded = cells.groupBy("n", "c").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sides = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("sides")).cast("int")
    dealt = (
        cells.join(crowded, ["n", "c"])
        .withColumn("sides", sides)
        .withColumn("own", own)
        .select("n", "c", "fp", "own", F.explode(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))).alias("b"))
        .select("n", "c", "b.i", "b.j", "own", "fp")
    )
    keys = ["n", "c", "i", "j"]
    dealt = dealt.repartition(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows: np.ndarray) -> list[tuple[int, int]]:
            a, b = rows[rows[:, 4] == rows[:, 2], 5], rows[rows[:, 4] == rows[:, 3], 5]
            return links_in_block(np.ascontiguousarray(a), np.ascontiguousarray(b), radius)

        rest = np.zeros((0, 6), np.int64)
        for b in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)])
            cut = np.r_[0, np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1]
            found = _pairs_of_two(rows, cut, radius)
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if e - s > 2:
                    found += emit(rows[s:e])
            rest = rows[cut[-1] :]
            if found:
                yield _links(found)
        if len(rest) > 1 and (found := emit(rest)):
            yield _links(found)

    return dealt.mapInArrow(link, "u long, v long")


def _pairs_of_two(rows: np.ndarray, cut: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of the cells with just two fingerprints, all at once; the last cell may go on."""
    s = cut[:-1][np.diff(cut) == 2]
    a, b = rows[s, 5], rows[s + 1, 5]
    near = np.bitwise_count(a.view("<u8") ^ b.view("<u8")) <= radius
    return list(zip(a[near].tolist(), b[near].tolist(), strict=True))


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def simhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row; ``component_id``: smallest id reachable by links.

    Equal fingerprints are one node, with its smallest id and no pairs. Null and empty texts have
    fingerprint zero and link like any other. Rows with a null id are kept; a component of null ids
    alone has a null component_id. Repeated rows stay; other columns are not read; empty in, empty out.
    """
    docs = materialize(fingerprints(df, key, text, shingle), "simhash")
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = materialize(near_links(docs.select("fp").distinct(), radius).distinct(), "links")
    parts = connected_components(links).withColumnRenamed("node", "fp")
    grouped = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
