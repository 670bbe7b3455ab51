"""Token-id store: raw id payloads in shards, with a minimal perfect hash from keys to offsets.

File format: one row a shard in Parquet files (written by Spark's committer, so a lost executor
leaves no half shard). ``payload``: ids as little-endian unsigned 32-bit integers, one document
after the other. ``keys``: the documents' 64-bit keys in payload order, with ``null_keys`` leading
null ones. ``pilots``/``slots``: the hash. A key's bucket names a pilot; the pilot gives the slot;
a slot holds fingerprint, order, offset and length, all in ids, so that an access costs two probes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, write_table
from .tokenizing import encoder

SLOT = np.dtype([("fp", "<u4"), ("order", "<u4"), ("offset", "<u4"), ("length", "<u4")])
SHARD_SCHEMA = "part int, seq int, first_key long, last_key long, n_docs long, n_ids long, null_keys int, payload binary, keys binary, pilots binary, slots binary"
KEYS_PER_BUCKET = 3
_U = np.uint64


def mix(x: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit finalizer of a counter-based generator (splitmix); seeds broadcast against ``x``."""
    with np.errstate(over="ignore"):
        z = x.astype(_U) + np.asarray(2 * seed + 1).astype(_U) * _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def hash_keys(keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Hashes of keys; ``turn`` tells repeated keys apart (0 for the first)."""
    return mix(keys.view(_U) ^ mix(turn.astype(_U), 7) * (turn > 0), 0)


def build_hash(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of the buckets, and each key's slot in 0..n-1, without gaps or clashes.

    Buckets from the largest: the first pilot that sends all of its keys to free slots. A bucket of
    one key takes a free slot as it stands (pilot -1 - slot).
    """
    n = len(hashed)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    of = (mix(hashed, 1) % _U(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=buckets)
    ends = np.cumsum(sizes)
    pilots, slots, used = np.zeros(buckets, "<i4"), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        size = sizes[b]
        if size <= 1:
            break
        own = order[ends[b] - size : ends[b]]
        first, width = 0, 32
        while True:
            # a run of pilots at once
            if first >= 1 << 22:
                raise ValueError("no pilot: two keys of a shard share a hash")
            tried = (mix(hashed[own][None, :], 2 + np.arange(first, first + width)[:, None]) % _U(n)).astype(np.int64)
            hit = next((i for i in np.flatnonzero(~used[tried].any(axis=1)) if len(set(tried[i].tolist())) == size), None)
            if hit is not None:
                break
            first, width = first + width, min(4096, 4 * width)
        at, pilot = tried[hit], first + int(hit)
        used[at] = True
        pilots[b], slots[own] = pilot, at
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~used)
    pilots[single] = -1 - free
    slots[order[ends[single] - 1]] = free
    return pilots, slots


def find_slots(hashed: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    pilot = pilots[(mix(hashed, 1) % _U(len(pilots))).astype(np.int64)].astype(np.int64)
    out = -1 - pilot
    sel = pilot >= 0
    out[sel] = (mix(hashed[sel], 2 + pilot[sel]) % _U(n)).astype(np.int64)
    return out


def turns(keys: np.ndarray) -> np.ndarray:
    """How often each of the sorted keys came before."""
    if not len(keys):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))


def _key_turns(keys: np.ndarray, nulls: int) -> np.ndarray:
    """Null keys lead and count as keys of their own, apart from an integer key of 0."""
    return np.r_[np.arange(nulls) + (1 << 40), turns(keys[nulls:])]


def pack_shard(part: int, seq: int, keys: list, ids: list[bytes]) -> dict:
    nulls = sum(k is None for k in keys)
    own = np.array([0 if k is None else k for k in keys], "<i8")
    lengths = np.array([len(i) // 4 for i in ids], np.int64)
    hashed = hash_keys(own, _key_turns(own, nulls))
    pilots, slot = build_hash(hashed)
    table = np.zeros(len(own), SLOT)
    table["fp"][slot] = (mix(hashed, 3) >> _U(32)).astype("<u4")
    table["order"][slot] = np.arange(len(own))
    table["offset"][slot] = np.cumsum(lengths) - lengths
    table["length"][slot] = lengths
    known = [k for k in keys if k is not None]
    return {"part": part, "seq": seq, "first_key": known[0] if known else None, "last_key": known[-1] if known else None, "n_docs": len(own), "n_ids": int(lengths.sum()), "null_keys": nulls, "payload": b"".join(ids), "keys": own.tobytes(), "pilots": pilots.tobytes(), "slots": table.tobytes()}


class Shard:
    """A read shard: keyed access in constant time, and its keys in payload order."""

    def __init__(self, row: dict):
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.nulls = row["null_keys"]
        self.pilots = np.frombuffer(row["pilots"], "<i4")
        self.slots = np.frombuffer(row["slots"], SLOT)
        self.payload = memoryview(row["payload"])

    def find(self, keys: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot records of the keys, and whether the stored fingerprint agrees."""
        hashed = hash_keys(np.asarray(keys, "<i8"), np.asarray(turn))
        if not len(self.slots):
            return np.zeros(len(hashed), SLOT), np.zeros(len(hashed), bool)
        got = self.slots[find_slots(hashed, self.pilots, len(self.slots))]
        return got, got["fp"] == (mix(hashed, 3) >> _U(32)).astype("<u4")

    def all(self) -> np.ndarray:
        got, ok = self.find(self.keys, _key_turns(self.keys, self.nulls))
        if not ok.all() or not (got["order"] == np.arange(len(got))).all():
            raise ValueError("a stored fingerprint does not agree with its key")
        return got

    def ids(self, slot) -> memoryview:
        return self.payload[4 * int(slot["offset"]) : 4 * (int(slot["offset"]) + int(slot["length"]))]


def write_ids(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, shard_ids: int = 1 << 20) -> str:
    """Encode every whole text, append ``end_id``, write shards in ascending key order; the path written.

    Shards hold about ``shard_ids`` ids, so a task's memory does not follow its partition; one very
    long document is a shard of its own. Null texts are empty (the end id alone). Null keys come
    first. Repeated keys are all kept, in the order of their texts' hashes, told apart by their turn;
    they may lie in several partitions, so one key with many rows burdens no single task. Other
    columns are not written. An empty table writes no shard.
    """
    spark = df.sparkSession
    src = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    ordered = ["k", F.xxhash64("t")]
    src = src.repartitionByRange(shuffle_partitions(spark), *ordered).sortWithinPartitions(*ordered)
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys, ids, size = [], [], 0
        for b in batches:
            for k, got in zip(b.column(0).to_pylist(), enc.encode_column(b.column(1)), strict=True):
                if size and size + len(got) > 4 * shard_ids:
                    yield _batch([pack_shard(part, seq, keys, ids)])
                    keys, ids, size, seq = [], [], 0, seq + 1
                keys.append(k)
                ids.append(got + end)
                size += len(got) + 4
        if keys:
            yield _batch([pack_shard(part, seq, keys, ids)])

    return write_table(src.mapInArrow(pack, SHARD_SCHEMA), "ids", block_bytes=16 << 20)


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), *[(c, pa.int64()) for c in ("first_key", "last_key", "n_docs", "n_ids")], ("null_keys", pa.int32()), *[(c, pa.binary()) for c in ("payload", "keys", "pilots", "slots")]])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Of every document in the files: ``doc_id, start, n_tokens, ids_crc32`` (``start``: ids of all before it).

    Each shard's keys go through its hash; fingerprints must agree. Only one row a shard, of its
    size, is summed up over shards; payloads stay where they are read.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                got = shard.all()
                keys = pa.array(shard.keys, pa.int64(), mask=np.arange(len(got)) < shard.nulls)
                n = len(got)
                crc = pa.array([zlib.crc32(shard.ids(s)) for s in got], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), keys, pa.array(got["offset"].astype("i8")), pa.array(got["length"].astype("i8")), crc], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    docs = shards.mapInArrow(digest, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "seq", "n_ids")
    # partitions first, then shards inside each: neither window sees more than one row a shard
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_at", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    base = sizes.join(parts, "part").select("part", "seq", (F.col("part_at") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("base"))
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """``keys`` with ``ids`` (array of long, null where no document has the key; of repeated ones the first).

    A key finds its shard by bisection of the shards' first and last keys, which lie in order: two numbers a shard, some
    millionth of its payload, are what every task gets. Only shards that are asked are joined with their
    requests, and a key's place in one comes from its hash and fingerprint. No keys, or only null ones: no ids.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    ranges = shards.where("first_key is not null").select("part", "seq", "first_key", "last_key").orderBy("first_key", "last_key", "part", "seq").toArrow()
    part, seq, first, last = (ranges[c].to_numpy() for c in ("part", "seq", "first_key", "last_key"))
    # equal keys may lie in several shards, and then their ends do not fall
    upto = np.maximum.accumulate(last) if len(last) else last

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0).to_numpy()
            lo, hi = np.searchsorted(upto, k, side="left"), np.searchsorted(first, k, side="right")
            n = np.maximum(hi - lo, 0)
            each = np.repeat(np.arange(len(k)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[each]
            holds = last[at] >= k[each]
            yield pa.RecordBatch.from_arrays([pa.array(part[at[holds]], pa.int32()), pa.array(seq[at[holds]], pa.int32()), pa.array(k[each[holds]], pa.int64())], names=["part", "seq", "k"])

    wanted = keys.select(F.col(f"`{key}`").cast("long").alias("k")).where("k is not null").distinct()
    requests = wanted.mapInArrow(route, "part int, seq int, k long").groupBy("part", "seq").agg(F.collect_list("k").alias("asked"))  # no more than a shard has keys, or was asked for
    asked = shards.join(requests, ["part", "seq"]).select(*shards.columns, "asked")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                shard, own = Shard(row), np.array(row["asked"], np.int64)
                slots, ok = shard.find(own, np.zeros(len(own), np.int64))
                ok &= shard.keys[slots["order"]] == own
                ids = [np.frombuffer(shard.ids(s), "<u4").astype("i8").tolist() for s in slots[ok]]
                n = int(ok.sum())
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(ids, pa.list_(pa.int64()))], names=["k", "part", "seq", "ids"])

    found = asked.mapInArrow(probe, "k long, part int, seq int, ids array<long>")
    first_ids = found.groupBy("k").agg(F.min_by("ids", F.struct("part", "seq")).alias("ids"))
    return keys.join(first_ids, keys[f"`{key}`"].cast("long") == first_ids["k"], "left").drop("k")
