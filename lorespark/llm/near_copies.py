"""Near copies by exact Jaccard similarity of shingle sets; fingerprints only find the candidates.

The SimHash operator's grid join links fingerprints within three bits. It puts pairs at similarity 0.8 about
ten bits apart, and no grid of 64 bits can search so wide a radius, so further candidates come from several
short fingerprints of each set: BANDS of ROWS min-wise values, of which a pair at similarity J shares one with probability 1 - (1 - J^ROWS)^BANDS
(all but 3 in a million at 0.8, fewer above). Every link is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, materialize
from .simhash import majority, near_links

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
#: Bits of a set's parities, a multiple of 64.
PARITIES = 512
#: Largest number of rows of one side that is broadcast.
BROADCAST_ROWS = 1_000_000
_U = np.uint64
_MULTIPLY, _ADD = np.random.default_rng(4).integers(0, 1 << 64, (2, BANDS * ROWS, 1), _U, endpoint=False)
_MULTIPLY |= _U(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word runs, repeats included; a text of fewer words is one run, one without words has none."""
    import xxhash

    h, join = xxhash.xxh64_intdigest, b" ".join
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return np.zeros(0, _U)
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.array([h(join(s), 42) for s in runs], _U)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word runs."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(have: np.ndarray) -> np.ndarray:
    """One key a band of min-wise values; an empty set has none."""
    if not len(have):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, _U)
    with np.errstate(over="ignore"):
        for at in range(0, len(have), 2048):
            mixed = have[None, at : at + 2048] * _MULTIPLY + _ADD
            least = np.minimum(least, mixed.min(axis=1))
        key = np.zeros(BANDS, _U)
        for values in least.reshape(BANDS, ROWS).T:
            key = (key ^ values) * _U(0x9E3779B97F4A7C15)
            key ^= key >> _U(32)
    return key.view(np.int64)


def parities(have: np.ndarray) -> np.ndarray:
    """PARITIES bits: whether an odd number of the set's shingles fall on each; two sets differ in at least as many shingles as bits."""
    odd = np.bincount((have % _U(PARITIES)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def keyed_rows(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``__row__`` (its own number), ``__node__`` (its shingle set's hash), ``__fp__`` and ``__bands__``; written."""

    def keys(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in texts:
            nodes, fps, bands = [], [], []
            for t in batch:
                every = shingle_hashes(t, shingle)
                have = np.unique(every)
                nodes.append(xxhash.xxh64_intdigest(have.tobytes(), 42))
                fps.append(majority(every) if len(every) else 0)
                bands.append(band_keys(have))
            yield pd.DataFrame({"node": np.array(nodes, _U).view("<i8"), "fp": np.array(fps, _U).view("<i8"), "bands": pd.Series(bands, dtype=object)})

    made = F.pandas_udf(keys, "node long, fp long, bands array<long>")
    src = docs.withColumn("__row__", F.monotonically_increasing_id()).withColumn("__keys__", made(F.col(f"`{text}`")))
    plain = src.withColumns({"__node__": F.col("__keys__.node"), "__fp__": F.col("__keys__.fp"), "__bands__": F.col("__keys__.bands")}).drop("__keys__")
    return materialize(plain, "keyed")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def node_components(keyed: DataFrame, text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``node, component`` of the nodes that have a link, from ``keyed_rows``.

    Linked: shingle sets of at least ``similar`` exact Jaccard similarity. Equal sets are one node. A
    band's bucket is first tried against one leading node; then only pairs that are still in different
    components and whose exact upper bounds reach ``similar`` (see ``_could_link`` and ``parities``), so a cluster of many
    near copies, or of texts around one passage, is not compared pair by pair.
    """
    with Scratch(keyed.sparkSession) as scratch:
        nodes = keyed.groupBy("__node__").agg(F.min("__row__").alias("row"), F.first("__fp__").alias("fp"), F.first("__bands__").alias("bands"))
        prints = scratch.table(nodes.groupBy("fp").agg(F.min("__node__").alias("least"), F.count(F.lit(1)).alias("n")), "prints")
        near = near_links(prints.select("fp"))
        least = prints.select("fp", "least")
        apart = near.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        equal = nodes.select("fp", F.col("__node__").alias("v")).join(prints.where("n > 1").select("fp", F.col("least").alias("u")), "fp").where("u <> v").select("u", "v")
        by_print = scratch.table(apart.union(equal).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "by-print")
        each = nodes.select(F.col("__node__").alias("node"), "row", F.posexplode("bands").alias("n", "c"))
        shared = each.groupBy("n", "c").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        members = scratch.table(each.join(shared, ["n", "c"]), "buckets")
        linked = by_print.select(F.explode(F.array("u", "v")).alias("__node__")).distinct()
        rows = members.select("row").union(nodes.join(linked, "__node__").select("row")).distinct()
        wanted = _small(rows.withColumnRenamed("row", "__row__"), rows.count())

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                have = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
                cols = [pa.array([f(x) for x in have], pa.list_(pa.int64())) for f in (lambda x: x.view("<i8"), parities)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["node", "own", "bits"])

        own = scratch.table(keyed.join(wanted, "__row__", "left_semi").select("__node__", text).mapInArrow(sets, "node long, own array<long>, bits array<long>"), "sets")

        def verified(pairs: DataFrame) -> DataFrame:
            both = pairs.join(own.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
            common = F.size(F.array_intersect("a", "b"))
            return both.where(common / (F.size("a") + F.size("b") - common) >= similar).select("u", "v")

        sized = scratch.table(_bounds(members.select("node").distinct(), own).drop("bits"), "bounds")
        # the node with the least of its own leads a bucket: in a family of copies, the one they come from
        placed = members.select("n", "c", "node").join(sized, "node")
        leaders = placed.groupBy("n", "c").agg(F.min(F.struct((F.col("size") - F.col("most")).alias("own"), "node"))["node"].alias("leader"))
        led = placed.join(leaders, ["n", "c"]).where("node <> leader").select(F.least("leader", "node").alias("u"), F.greatest("leader", "node").alias("v"))
        first = scratch.table(led.union(by_print).distinct(), "pairs")
        links = scratch.table(verified(first), "links")
        parts = connected_components(links)
        now = scratch.table(members.join(parts, "node", "left").select("n", "c", "node", F.coalesce("component", "node").alias("comp")), "parts")
        left = scratch.table(_could_link(_several(now), own, similar), "left")
        right = left.select("n", "c", F.col("node").alias("v"), F.col("comp").alias("other"), F.col("size").alias("size_v"), F.col("most").alias("most_v"), F.col("bits").alias("bits_v"))
        # every bit that differs is a shingle that only one of the two has
        differ = sum((F.bit_count(F.get("bits", F.lit(k)).bitwiseXOR(F.get("bits_v", F.lit(k)))) for k in range(PARITIES // 64)), F.lit(0))
        common = F.least("most", "most_v", (F.col("size") + F.col("size_v") - differ) / 2)
        pairs = left.withColumnRenamed("node", "u").join(right, ["n", "c"]).where("u < v and comp <> other").where(common >= similar * (F.col("size") + F.col("size_v") - common) - 1e-9)
        tested = scratch.table(pairs.select("u", "v").distinct(), "tested")
        more = scratch.table(verified(tested), "more")
        return materialize(connected_components(links.union(more)), "components")


def _several(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    apart = members.groupBy("n", "c").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("n", "c")
    return members.join(apart, ["n", "c"])


def _bounds(asked: DataFrame, own: DataFrame) -> DataFrame:
    """``node, size, most``: shingles of each asked node, and those that another asked node has too."""
    mine = own.join(asked, "node", "left_semi")
    once = mine.select("node", F.explode("own").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count(F.lit(1)).alias("once"))
    return mine.select("node", "bits", F.size("own").alias("size")).join(once, "node", "left").select("node", "bits", "size", (F.col("size") - F.coalesce("once", F.lit(0))).alias("most"))


def _could_link(members: DataFrame, own: DataFrame, similar: float) -> DataFrame:
    """Members of undecided buckets that may have a link in theirs, with ``size`` and ``most``.

    ``most``: shingles that any other of these nodes has too. No other set can have more in common, so
    most / (size + least size in the bucket - most) bounds every similarity: a text with much of its own goes.
    """
    sized = members.join(_bounds(members.select("node").distinct(), own), "node")
    least = sized.groupBy("n", "c").agg(F.min("size").alias("least_size"))
    could = sized.join(least, ["n", "c"]).where(F.col("most") >= similar * (F.col("size") + F.greatest("most", "least_size") - F.col("most")) - 1e-9)
    return _several(could.drop("least_size"))
