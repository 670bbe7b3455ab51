"""Repeated substrings across documents by merging shard Burrows-Wheeler transforms.

A string of ``span`` bytes (a gram) that also starts in a document with a smaller id is removed. Each gram belongs
to its minimizer (the place of the least hash of K bytes inside it), so equal grams have equal minimizers. Runs of
grams with one minimizer are windows. Minimizers only route text to the transforms; bytes decide:

1. Texts that repeat whole are settled by their SHA-256, so that a group of copies is transformed once.
2. Windows whose minimizer occurs in one document only cannot hold a repeated gram and are left aside. A batch that
   sees a minimizer in two documents keeps its windows without asking, so a common one costs a batch one entry.
3. Bytes of the other windows are read. Equal ones are settled by comparing bytes, in the batch first: all but the
   smallest document's go. The others are dealt to tasks by minimizer; in a task, document shards get transforms, which are
   merged by interleave refinement, a few symbols a round; after ``span`` symbols, places with a common prefix of
   ``span`` bytes lie together (repeated intervals), and all but the smallest document's go. A block that lies in
   one shard leaves the merge: its shard's transform holds the intervals.
4. A minimizer with many windows is dealt by 44 bytes of context. Where still more than KEY_ROWS different windows
   share those, their grams are grouped themselves.
5. Removed runs of each document are united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, shuffle_partitions

SPAN, K = 50, 24
#: Context bytes that two windows must share for their grams to be compared; offsets of a minimizer in a gram that are dealt together.
CONTEXT, OFFSETS = 13, 7
#: Bytes that a round of a merge adds, as long as their numbers have 16 bits.
STEP = 3
BROADCAST_ROWS = 1_000_000
NO_ID = (1 << 63) - 1
_U = np.uint64
#: A window: minimizer's hash, document, text hash, start, grams (0: only tells that the minimizer is common), minimizer's place.
SPOT = [("h", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("s", "<u4"), ("run", "u1"), ("p", "u1")]
WINDOW = "key long, doc long, th long, s int, e int, p int, b binary"


@dataclass(frozen=True)
class Sizes:
    """Bytes of text hashed at once, read at once, of a bucket of minimizers and of a merge; document shards of a
    merge; windows of a minimizer that are dealt by context; windows of a key beyond which grams are grouped."""

    segment: int = 1 << 18
    flush: int = 4 << 20
    bucket: int = 4 << 20
    merge: int = 1 << 20
    shards: int = 4
    crowd: int = 1024
    key_rows: int = 1 << 14


SIZES = Sizes()


class Windows:
    """Minimizer windows of texts, many texts at once."""

    def __init__(self, span: int = SPAN, segment: int = SIZES.segment):
        self.span, self.segment = span, max(segment, 2 * span)

    def of(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Arrays: text number, start, run (grams), minimizer's place after start, its hash."""
        parts: list[tuple[int, int, bytes]] = []
        for i, t in enumerate(texts):
            if len(t) >= self.span:
                for at in range(0, len(t) - self.span + 1, self.segment - self.span + 1):
                    parts.append((i, at, t[at : at + self.segment]))
        out: list[dict[str, np.ndarray]] = []
        at = 0
        while at < len(parts):
            size, end = 0, at
            while end < len(parts) and (end == at or size + len(parts[end][2]) <= self.segment):
                size += len(parts[end][2])
                end += 1
            out.append(self._joined(parts[at:end]))
            at = end
        if not out:
            return {n: np.zeros(0, t) for n, t in (("text", np.int64), ("s", np.int64), ("run", np.int64), ("p", np.int64), ("h", _U))}
        return {n: np.concatenate([o[n] for o in out]) for n in out[0]}

    def _joined(self, parts: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
        span = self.span
        b = np.frombuffer(b"".join(p[2] for p in parts) + b"\0" * span, np.uint8).astype(_U)
        n = len(b) - span
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore"):
            two = b[:-1] | (b[1:] << _U(8))
            four = two[:-2] | (two[2:] << _U(16))
            eight = four[:-4] | (four[4:] << _U(32))
            h = eight[:n] * _U(0x9E3779B97F4A7C15) + eight[8 : n + 8] * _U(0xC2B2AE3D27D4EB4F) + eight[16 : n + 16] * _U(0x165667B19E3779F9)
            h ^= h >> _U(29)
            h *= _U(0xBF58476D1CE4E5B9)
            h ^= h >> _U(32)
        key = (h & ~_U((1 << 22) - 1)) | np.arange(n, dtype=_U)
        # least key of the span - K + 1 places of each gram, by doubling
        width, m, done = span - K + 1, key, 1
        while 2 * done <= width:
            m = np.minimum(m[:-done], m[done:])
            done *= 2
        least = np.minimum(m[: n - width + 1], m[width - done :][: n - width + 1])
        place = (least & _U((1 << 22) - 1)).astype(np.int64)
        grams = np.concatenate([np.arange(e - s, e - span + 1) for s, e in zip(sizes, ends, strict=True)])
        which = np.repeat(np.arange(len(parts)), sizes - span + 1)
        p = place[grams]
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (which[1:] != which[:-1])])
        start, part = grams[first], which[first]
        base = ends - sizes
        offset, text = np.array([q[1] for q in parts]), np.array([q[0] for q in parts])
        return {"text": text[part], "s": start - base[part] + offset[part], "run": np.diff(np.r_[first, len(p)]), "p": p[first] - start, "h": h[p[first]]}


def _groups(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal ``h``, and for every place whether its run has more than one document."""
    cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    several = np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts)
    return cuts, np.repeat(several, np.diff(np.r_[cuts, len(h)]))


def _packed(e: np.ndarray) -> bytes:
    return b"".join(e[n].tobytes() for n, _ in SPOT)


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // np.dtype(SPOT).itemsize
    e, at = np.zeros(n, SPOT), 0
    for name, kind in SPOT:
        size = n * np.dtype(kind).itemsize
        e[name] = np.frombuffer(blob[at : at + size], kind)
        at += size
    return e


def spots(docs: DataFrame, buckets: int, span: int = SPAN, sizes: Sizes = SIZES) -> DataFrame:
    """``docs(doc, th, b)`` to blobs of windows by bucket of minimizers; ``known``: the batch saw the minimizers in two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Windows(span, sizes.segment)
        for b in batches:
            ids, ths, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            at = 0
            while at < len(ids):
                own, size = [], 0
                while at + len(own) < len(ids) and (not own or size < sizes.flush):
                    own.append(texts[at + len(own)].as_py())
                    size += len(own[-1])
                found = made.of(own)
                # minimizers are least hashes and so crowd at 0; an odd factor keeps them apart and spreads them over buckets
                with np.errstate(over="ignore"):
                    found["h"] *= _U(0xD6E8FEB86659FD93)
                order = np.argsort(found["h"], kind="stable")
                e = np.zeros(len(order), SPOT)
                text = found["text"][order]
                e["doc"], e["th"] = ids[at : at + len(own)][text], ths[at : at + len(own)][text]
                for name in ("h", "s", "run", "p"):
                    e[name] = found[name][order]
                at += len(own)
                if not len(e):
                    continue
                cuts, several = _groups(e["h"], e["doc"])
                bucket = ((e["h"] >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                rows = []
                if several.any():
                    known = e[several]
                    # these are only passed on, so any bucket will do; their hashes would deal those of all batches to the first
                    rows.append(((int(known["doc"][0]) + int(known["th"][0])) % buckets, True, _packed(known)))
                    # one entry tells other batches that the minimizer is common
                    teller = cuts[several[cuts]]
                    e["run"][teller] = 0
                    go = ~several
                    go[teller] = True
                    e, bucket = e[go], bucket[go]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                rows += [(int(bucket[s]), False, _packed(e[s:t])) for s, t in zip(cut, np.r_[cut[1:], len(e)], strict=True)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary())], names=["bucket", "known", "blob"])

    return docs.mapInArrow(run, "bucket long, known boolean, blob binary")


def asked_windows(blobs: DataFrame) -> DataFrame:
    """Windows whose minimizer occurs in two documents: ``doc, th, s, run, p, h``."""
    blobs = blobs.repartition(shuffle_partitions(blobs.sparkSession), "bucket").sortWithinPartitions("bucket")

    def rows(e: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array(e["doc"]), pa.array(e["th"]), pa.array(e["s"].astype("i4")), pa.array(e["run"].astype("i4")), pa.array(e["p"].astype("i4")), pa.array(np.ascontiguousarray(e["h"]).view("<i8"))]
        return pa.RecordBatch.from_arrays(cols, names=["doc", "th", "s", "run", "p", "h"])

    def one(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(parts)
        e = e[np.argsort(e["h"], kind="stable")]
        cuts, several = _groups(e["h"], e["doc"])
        told = np.minimum.reduceat(e["run"], cuts) == 0
        keep = (several | np.repeat(told, np.diff(np.r_[cuts, len(e)]))) & (e["run"] > 0)
        if keep.any():
            yield rows(e[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for bucket, known, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if known:
                    yield rows(_unpacked(blob.as_py()))
                    continue
                if bucket != now and parts:
                    yield from one(parts)
                    parts = []
                now = bucket
                parts.append(_unpacked(blob.as_py()))
        if parts:
            yield from one(parts)

    return blobs.mapInArrow(run, "doc long, th long, s int, run int, p int, h long")


class Settled:
    """Equal windows by their bytes: the places of the smallest document stay, those of others go."""

    def __init__(self):
        self.seen: dict[tuple[int, int, bytes], list] = {}
        self.size = 0
        self.gone: list[tuple[int, int, int, int]] = []

    def add(self, key: int, doc: int, th: int, s: int, p: int, piece: bytes) -> None:
        have = self.seen.get((key, p, piece))
        if have is None:
            self.seen[key, p, piece] = [doc, [(th, s)]]
            self.size += len(piece)
        elif doc == have[0]:
            have[1].append((th, s))
            self.size += 16
        elif doc > have[0]:
            self.gone.append((doc, th, s, s + len(piece)))
        else:
            self.gone += [(have[0], t, x, x + len(piece)) for t, x in have[1]]
            have[:] = doc, [(th, s)]


def _decided(gone: list[tuple[int, int, int, int]], names: tuple[str, ...] = ("doc", "th", "s", "e")) -> list[pa.Array]:
    cols = list(zip(*gone, strict=True)) if gone else [()] * 4
    return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]


def read_windows(texts: DataFrame, asked: DataFrame, span: int = SPAN, sizes: Sizes = SIZES) -> DataFrame:
    """The asked windows' bytes (``key`` set), each batch's equal ones settled (``key`` null: the run s to e goes)."""
    many = asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > sizes.crowd).select("h", F.lit(True).alias("crowded"))
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    each = asked.join(many, "h", "left").groupBy("doc", "th").agg(F.collect_list(F.struct("s", "run", "p", "h", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("w"))
    joined = texts.join(each, ["doc", "th"]).select("doc", "th", "b", "w")

    def emit(settled: Settled) -> Iterator[pa.RecordBatch]:
        rows = [(key, doc, th, s, s + len(piece), p, piece) for (key, p, piece), (doc, places) in settled.seen.items() for th, s in places]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kept = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
        doc, th, s, e = _decided(settled.gone)
        n = len(settled.gone)
        gone = [pa.nulls(n, pa.int64()), doc, th, s, e, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        for cols in (kept, gone):
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc", "th", "s", "e", "p", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        settled = Settled()
        for b in batches:
            docs, ths, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
            for i, (doc, th) in enumerate(zip(docs, ths, strict=True)):
                text, w = b.column(2)[i].as_py(), lists[i].values
                for s, grams, p, h, crowded in zip(*[w.field(k).to_pylist() for k in range(5)], strict=True):
                    if not crowded:
                        settled.add(h, doc, th, s, p, text[s : s + grams + span - 1])
                        continue
                    at = s + p
                    for j in range((p - grams + 1) // OFFSETS, p // OFFSETS + 1):
                        # grams with the minimizer at an offset of this class all hold the same context
                        most, least = min(OFFSETS * (j + 1) - 1, p), max(OFFSETS * j, p - grams + 1)
                        context = text[at - OFFSETS * j : at - OFFSETS * (j + 1) + 1 + span]
                        key = (xxhash.xxh64_intdigest(context, j) ^ (h & ((1 << 64) - 1))) - (1 << 63)
                        settled.add(key, doc, th, at - most, most, text[at - most : at - least + span])
                    if settled.size >= sizes.flush:
                        yield from emit(settled)
                        settled = Settled()
                if settled.size >= sizes.flush or len(settled.gone) >= 1 << 17:
                    yield from emit(settled)
                    settled = Settled()
        yield from emit(settled)

    return joined.mapInArrow(run, WINDOW)


# --- Burrows-Wheeler transforms of shards, and their merge ---------------------------------------------


def _raised(strings: list[bytes]) -> np.ndarray:
    """The strings one after the other, bytes raised by one, so that 0 marks the end of each."""
    raised = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8) + np.uint8(1)  # UTF-8 has no byte 255, so nothing wraps
    raised[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
    return raised


def shard_transform(raised: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of a shard's strings by their first ``span`` bytes, and where it starts groups with all of these in common.

    Ranks of eight bytes are doubled up to ``span``; nothing behind an end mark counts.
    """
    n = len(raised)
    marks = np.flatnonzero(raised == 0)
    left = np.repeat(marks, np.diff(np.r_[-1, marks])) - np.arange(n)
    width = min(8, span)
    padded = np.concatenate([raised, np.zeros(width, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for j in range(width):
        key = (key << _U(8)) | np.where(left >= j, padded[j : j + n], _U(0))
    rank, order, new = _ranks(key)
    while width < span:
        step = min(width, span - width)
        behind = np.zeros(n, np.int64)
        far = np.flatnonzero(left >= step)
        behind[far] = rank[far + step] + 1
        # the first ``step`` bytes agree whenever the first ``width`` do, so the two ranks overlap or meet
        rank, order, new = _ranks((rank.astype(_U) * _U(n + 1)) + behind.astype(_U))
        width += step
    return order, np.flatnonzero(new)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.r_[True, sorted_[1:] != sorted_[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order, new


def _before(raised: np.ndarray, step: int) -> np.ndarray | None:
    """Number of the ``step`` bytes before each suffix, in their order; 0 where an end mark is among them. None: over 16 bits."""
    letters = np.flatnonzero(np.bincount(raised[raised > 0], minlength=256))
    base = len(letters) + 1
    if base**step > 1 << 23 and step > 2:
        return None
    small = np.zeros(256, np.int32)
    small[letters] = np.arange(1, base)
    text = np.concatenate([np.zeros(step, np.int32), small[raised]])
    n = len(raised)
    code, ok = np.zeros(n, np.int32), np.ones(n, bool)
    for j in range(step):
        c = text[j : j + n]
        code = code * base + c
        ok &= c > 0
    code[~ok] = 0
    if base**step > 1 << 16:
        present = np.zeros(base**step, bool)
        present[code] = True
        present[0] = True
        if np.count_nonzero(present) > 1 << 16:
            return None
        code = (np.cumsum(present, dtype=np.int32) - 1).astype(np.uint16)[code]
    return code.astype(np.uint16)


def merge_transforms(raised: np.ndarray, orders: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (their places in the text) whose first ``span`` bytes occur in several shards, interleaved, and where
    their groups start.

    ``orders``: each shard's sorted suffixes, which lie in the text one shard after the other. The interleave starts with one
    shard after the other. A round sends every suffix to that of the suffix ``step`` bytes longer: a stable sort
    by the bytes before it, after which the interleave is right for as many bytes more; no suffix is compared.
    Blocks with suffixes of one shard only leave the interleave: what lies in them is decided by that
    shard's transform, and so is every longer suffix. The same goes for end marks, which nothing may cross.
    """
    shard = np.repeat(np.arange(len(orders), dtype=np.uint8), [len(o) for o in orders])
    step = STEP
    while (before := _before(raised, step)) is None:
        step -= 1
    steps = [step] * (span // step)
    now = np.concatenate(orders)
    group = np.zeros(len(now), np.int32)
    cuts = np.zeros(1, np.int64)
    for width in ([span % step] if span % step else []) + steps:
        key = (before if width == step else _before(raised, width))[now]
        if width != step or not key.all():
            inside = np.flatnonzero(key)
            key, now, group = key[inside], now[inside], group[inside]
        order = np.argsort(key, kind="stable")
        key, now, group = key[order], now[order] - width, group[order]
        if not len(now):
            return now, now
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        sizes = np.diff(np.r_[cuts, len(now)])
        # a block's suffixes lie in the order of their shards
        own = shard[now]
        mixed = own[cuts] != own[cuts + sizes - 1]
        if not mixed.all():
            now = now[np.repeat(mixed, sizes)]
            sizes = sizes[mixed]
            cuts = np.cumsum(sizes) - sizes
        group = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return now, cuts


def repeated_grams(strings: list[bytes], docs: np.ndarray, span: int = SPAN, shards: int = SIZES.shards) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every gram that also starts in a string of a smaller document."""
    own = [part for part in np.array_split(np.argsort(docs, kind="stable"), shards) if len(part)]  # documents in order
    which = np.concatenate(own)
    sizes = np.array([len(strings[i]) + 1 for i in which])
    starts = np.cumsum(sizes) - sizes
    raised = _raised([strings[i] for i in which])
    of = np.repeat(np.arange(len(which), dtype=np.int32), sizes)
    doc = docs[which][of]
    gone = np.zeros(len(raised), bool)

    def settle(places: np.ndarray, cuts: np.ndarray) -> None:
        if len(places):
            d = doc[places]
            least = np.repeat(np.minimum.reduceat(d, cuts), np.diff(np.r_[cuts, len(d)]))
            gone[places[d > least]] = True

    orders, at = [], 0
    for part in own:
        n = sum(len(strings[i]) + 1 for i in part)
        order, cuts = shard_transform(raised[at : at + n], span)
        orders.append(order + at)
        settle(orders[-1], cuts)
        at += n
    settle(*merge_transforms(raised, orders, span))
    s = np.flatnonzero(gone)
    start = s - starts[of[s]]
    whole = start + span < sizes[of[s]]
    return which[of[s[whole]]], start[whole]


def shared_context(strings: list[bytes], places: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Part of each window whose grams can be shared: (from, to), empty if none can.

    A gram holds its minimizer with CONTEXT bytes before it, or else with CONTEXT bytes behind it. Only
    grams whose context another window has too can be shared; contexts are compared by hash.
    """
    sizes = np.array([len(x) for x in strings])
    starts = np.cumsum(sizes) - sizes
    b = np.frombuffer(b"".join(strings) + b"\0" * 64, np.uint8).astype(_U)
    wide = K + CONTEXT

    def keys(at: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), _U)
            for j in range(wide):
                h = (h ^ b[at + j]) * _U(0x9E3779B97F4A7C15)
                h ^= h >> _U(32)
        return h

    def shared(ok: np.ndarray, offset: int) -> np.ndarray:
        out = np.zeros(len(ok), bool)
        ix = np.flatnonzero(ok)
        _, inverse, n = np.unique(keys((starts + places + offset)[ix]), return_inverse=True, return_counts=True)
        out[ix] = n[inverse] > 1
        return out

    left = shared((places >= CONTEXT) & (places + K <= sizes), -CONTEXT)
    right = shared(places + wide <= sizes, 0)
    frm = np.where(left, 0, np.minimum(np.maximum(places - CONTEXT + 1, 0), sizes))
    to = np.where(right, sizes, np.minimum(places - CONTEXT + span, sizes))
    return frm, np.where((left | right) & (to - frm >= span), to, frm)


def merge_windows(windows: DataFrame, span: int = SPAN, sizes: Sizes = SIZES) -> DataFrame:
    """Grams that go among the windows of each key, as runs ``doc, th, s, e``; a key has at most ``key_rows`` windows."""
    windows = windows.select("key", "doc", "th", "s", "p", "b").repartition(shuffle_partitions(windows.sparkSession), "key").sortWithinPartitions("key")

    def merged(strings: list[bytes], docs: list[int], places: list[list[tuple[int, int]]], p: list[int]) -> list[tuple[int, int, int, int]]:
        frm, to = shared_context(strings, np.array(p), span)
        ix = np.flatnonzero(to > frm)
        if not len(ix):
            return []
        s, at = repeated_grams([strings[i][frm[i] : to[i]] for i in ix], np.array(docs)[ix], span, sizes.shards)
        s, start = ix[s], at + frm[ix[s]]
        order = np.lexsort((start, s))
        s, start = s[order], start[order]
        if not len(s):
            return []
        # neighbouring grams of a window are one run
        cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.r_[cut[1:], len(s)] - 1
        return [(docs[w], th, x + a, x + z + span) for w, a, z in zip(s[cut].tolist(), start[cut].tolist(), start[last].tolist(), strict=True) for th, x in places[w]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, settled, size = None, Settled(), 0
        strings: list[bytes] = []
        docs: list[int] = []
        places: list[list[tuple[int, int]]] = []
        p: list[int] = []

        def close() -> None:
            nonlocal size
            mine = settled.seen
            if len(mine) > 1 and len({v[0] for v in mine.values()}) > 1:
                for (_, place, piece), (doc, where) in mine.items():
                    strings.append(piece), docs.append(doc), places.append(where), p.append(place)
                    size += len(piece)

        def flush() -> Iterator[pa.RecordBatch]:
            gone = settled.gone + (merged(strings, docs, places, p) if strings else [])
            yield pa.RecordBatch.from_arrays(_decided(gone), names=["doc", "th", "s", "e"])

        for b in batches:
            for key, doc, th, s, place, piece in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != now:
                    close()
                    settled.seen = {}
                    if size >= sizes.merge or len(settled.gone) >= 1 << 17:
                        yield from flush()
                        settled, size = Settled(), 0
                        strings, docs, places, p = [], [], [], []
                    now = key
                settled.add(key, doc, th, s, place, piece)
        close()
        yield from flush()

    return windows.mapInArrow(run, "doc long, th long, s int, e int")


def group_grams(windows: DataFrame, span: int = SPAN) -> DataFrame:
    """The same for keys of any size: each gram by its own bytes, grouped and joined by Spark."""
    each = F.expr(f"transform(sequence(0, octet_length(b) - {span}), i -> struct(s + i AS s, substring(b, i + 1, {span}) AS g))")
    grams = windows.select("doc", "th", F.explode(each).alias("x")).select("doc", "th", "x.s", "x.g")
    least = grams.groupBy("g").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("g", "least")
    return grams.join(least, "g").where("doc > least").select("doc", "th", "s", (F.col("s") + span).alias("e"))


def row_hash(df: DataFrame, key: str, body: F.Column) -> tuple[F.Column, bool]:
    """What tells rows of one id apart, and whether any id repeats: their text's hash, or 0 for all where none does."""
    again = df.groupBy(F.col(f"`{key}`").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (F.lit(0).cast("long"), False) if again.isEmpty() else (F.xxhash64(body), True)


def repeated_runs(texts: DataFrame, repeats: bool, span: int = SPAN, sizes: Sizes = SIZES) -> DataFrame:
    """Runs ``doc, th, s, e`` that cover every removed byte of ``texts(doc, th, b)`` (they may overlap)."""
    with Scratch(texts.sparkSession) as scratch:
        base = scratch.table(texts.select("doc", "th", F.sha2("b", 256).alias("sha"), F.octet_length("b").alias("n")).where(F.col("n") >= span), "texts")
        total = base.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        firsts = base.groupBy("sha").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        copies = scratch.table(base.join(firsts, "sha").where("doc > least").select("doc", "th", "n").distinct(), "copies")
        gone = copies.select("doc", "th")
        if copies.count() <= BROADCAST_ROWS:
            gone = F.broadcast(gone)
        rest = texts.where(F.octet_length("b") >= span).join(gone, ["doc", "th"], "left_anti")
        if repeats:
            rest = rest.dropDuplicates(["doc", "th"])
        asked = scratch.table(asked_windows(spots(rest, max(1, total // sizes.bucket), span, sizes)), "asked")
        windows = scratch.table(read_windows(rest, asked, span, sizes), "windows")
        open_ = windows.where("key is not null")
        large = scratch.table(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > sizes.key_rows).select("key"), "large")
        n = large.count()
        large = F.broadcast(large) if n <= BROADCAST_ROWS else large
        runs = windows.where("key is null").select("doc", "th", "s", "e")
        runs = runs.unionByName(copies.select("doc", "th", F.lit(0).alias("s"), F.col("n").cast("int").alias("e")))
        runs = runs.unionByName(merge_windows(open_.join(large, "key", "left_anti") if n else open_, span, sizes))
        if n:
            runs = runs.unionByName(group_grams(open_.join(large, "key", "left_semi"), span))
        return materialize(runs, "runs")


def cut_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, sizes: Sizes = SIZES) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the bytes that stay).

    Null and empty texts: nothing. Rows with a null id count as after all ids: they lose what any other
    row has, and nothing to each other. Rows that repeat an id lose nothing to each other. Strings are
    judged on the input. Other columns are not read; empty in, empty out.
    """
    doc_id = F.col(f"`{key}`").cast("long")
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    th, repeats = row_hash(df, key, body)
    src = df.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), th.alias("th"), body.alias("b"))
    runs = repeated_runs(src.select("doc", "th", "b"), repeats, span, sizes)
    # a row's runs follow its length: united by maximum of end over start before they travel
    merged = runs.groupBy("doc", "th", "s").agg(F.max("e").alias("e")).groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))
    joined = src.join(merged.hint("shuffle_hash"), ["doc", "th"], "left").select("doc_id", "b", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, b, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, spans, removed, done = [], 0, 0, 0
                for r in runs or []:
                    if r["s"] > done or not spans:
                        kept.append(b[done : r["s"]])
                        spans += 1
                        removed += r["e"] - r["s"]
                        done = r["e"]
                    elif r["e"] > done:
                        removed += r["e"] - done
                        done = r["e"]
                kept = b"".join([*kept, b[done:]])
                out.append((doc, len(b), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
