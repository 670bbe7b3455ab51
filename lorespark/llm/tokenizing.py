"""Library tokenizers over safe segments of text, with a bounded memo of what the library returned."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A segment may start before a single space or line break between two non-space characters, or
#: after such a line break: no token of a byte-level pre-tokenizer spans these places.
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
_ODD = re.compile(r"\s\s|[^\S \n]|\s\Z|\x02")
LITERAL = "\x02"
MEMO_ENTRIES = 400_000
MEMO_CHARS = 48
#: Texts of so many bytes are split into words at once.
COLUMN_BYTES = 8 << 20
#: Words that the library gets in one string.
JOINED_WORDS = 200
#: Kinds of bytes: letters (ASCII, and Latin-1 as 0xC3 and one more byte: stable under NFC, one lower-case letter each),
#: separators, ASCII punctuation, all others.
_SEP, _PUNCT, _OTHER = 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), 0xC3]] = 0
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _PUNCT
_KIND[[0x20, 0x0A]] = _SEP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class SegmentEncoder:
    """Encodes whole texts exactly as the library does, from the library's ids of their segments.

    Two kinds of file: byte-level with its own pattern and no normalizer (white space is part of
    tokens), and word-end with white space dropped and collapsed. Anything else is encoded whole.
    """

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        post = spec.get("post_processor") is None
        if plain and post and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "byte"
        elif plain and post and spec["model"].get("end_of_word_suffix") and pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and pre["pretokenizers"][0].get("invert"):
            self.kind = "word"
        else:
            self.kind = "whole"
        # a word's letters may be encoded apart from what follows, if no added token starts with a letter
        self.letters = None
        if self.kind == "word" and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and not any(t["content"][:1].isalpha() for t in spec["added_tokens"]):
            from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

            # the library's own model for lower-case words of letters alone, which need no normalizer
            self.letters = Tokenizer.from_file(path)
            self.letters.no_truncation()
            self.letters.no_padding()
            self.letters.normalizer = None
            self.letters.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
            self.ends_word[[i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
            self.known, self.known_ids = pa.array([], pa.binary()), pa.array([], pa.large_binary())
        self.entries = memo_entries
        self.memo: dict[str, bytes] = {}
        self.lengths: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """Keys of segments that encode on their own as they do inside the text (see ``_literal``)."""
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        if self.kind == "whole":
            return [LITERAL + text]
        if _ODD.search(text) or text[:1].isspace():
            return [LITERAL + t for t in _SAFE.split(text)]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = LITERAL + keys[0]
        return keys

    def _literal(self, key: str) -> str:
        """A key's text: literal ones and line starts as they are, others are words after a single space."""
        if self.kind == "word":
            return key
        return key[1:] if key[:1] == LITERAL else key if key[:1] == "\n" else " " + key

    def _encode(self, keys: list[str]) -> list[bytes]:
        return self._library(keys)

    def _library(self, keys: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch([self._literal(k) for k in keys], add_special_tokens=False)]

    def _count(self, keys: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch([self._literal(k) for k in keys], add_special_tokens=False)]

    def encode_many(self, texts: list[str], batch_bytes: int = 1 << 20) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; batches hold about ``batch_bytes``."""
        if self.letters is not None:
            return list(self.encode_column(pa.array(texts, pa.string())))
        return self._batches(texts, list(map(len, texts)), batch_bytes, self.memo, self._encode, b"".join)

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode_many`` for a column of strings, where null is empty.

        Texts are split into words in numpy, some megabytes at once, and only their distinct words go to the library.
        """
        if self.letters is None:
            yield from self.encode_many(texts.fill_null("").to_pylist())
            return
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        upto, at = np.cumsum(sizes), 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + COLUMN_BYTES, side="right")))
            yield from self._encode_words(texts.slice(at, end - at).cast(pa.string()), sizes[at:end])
            at = end
        pa.default_memory_pool().release_unused()  # workers live on, and the allocator would keep it

    def _encode_words(self, texts: pa.Array, sizes: np.ndarray) -> Iterator[bytes]:
        """Pieces are words between separators; a word that starts with letters is cut before the punctuation that follows them."""
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")
        raw = np.frombuffer(whole[0].as_buffer(), np.uint8)
        kind = _KIND[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        kind[lead[np.isin(raw[lead + 1], (0x97, 0xB7))]] = _OTHER  # the signs for times and divided by
        # where letters end, and what by
        at = np.append(np.flatnonzero(kind), len(raw))
        what = np.append(kind[at[:-1]], _SEP)
        head = np.append(True, what[:-1] == _SEP) & (at > np.append(0, at[:-1] + 1)) & (what != _OTHER)
        stop = (what == _SEP) | head
        ends, head = at[stop], head[stop]
        lengths = ends - np.append(0, ends[:-1] + (what[stop][:-1] == _SEP))
        some = lengths > 0
        ends, head, lengths = ends[some], head[some], lengths[some]
        data, low = raw[kind != _SEP], np.repeat(head, lengths)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[low[lead] & (data[lead + 1] < 0x9F)]
        data = np.where(low, _LOWER[data], data)
        data[lead + 1] += 0x20
        pieces = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        codes = pieces.indices.to_numpy()
        letters = np.zeros(len(pieces.dictionary), bool)
        letters[codes] = head
        ids = self._ids(pieces.dictionary, letters).take(pieces.indices)
        offsets = np.frombuffer(ids.buffers()[1], np.int64)
        payload = memoryview(ids.buffers()[2] or b"")
        bounds = offsets[np.append(0, np.searchsorted(ends, np.cumsum(sizes + 1) - 1, side="right"))].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield bytes(payload[a:b])

    def _ids(self, words: pa.Array, letters: np.ndarray) -> pa.Array:
        """Ids of distinct words, from the memo or the library; ``letters``: lower-case letters alone."""
        place = pc.index_in(words, value_set=self.known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy().copy()
        plain, rest = np.flatnonzero(new & letters), np.flatnonzero(new & ~letters)
        names, made = self.known, self.known_ids
        for own, make in ((plain, self._letters), (rest, lambda keys: pa.array(self._library(keys.to_pylist()), pa.large_binary()))):
            if len(own):
                place[own] = len(names) + np.arange(len(own))
                more = words.take(pa.array(own))
                names, made = pa.concat_arrays([names, more]), pa.concat_arrays([made, make(more.cast(pa.string()))])
        found = made.take(pa.array(place))
        # the memo starts again, from these words, when it is full
        if len(names) > self.entries:
            names, made = words.slice(0, self.entries), found.slice(0, self.entries)
        short = pc.less_equal(pc.binary_length(names), MEMO_CHARS)
        self.known, self.known_ids = names.filter(short), made.filter(short)
        return found

    def _letters(self, words: pa.Array) -> pa.Array:
        """Ids of lower-case words, many in one string: each ends at its one token with the suffix of ends."""
        n = len(words)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([*range(0, n, JOINED_WORDS), n], pa.int32()), words), " ")
        ids = np.concatenate([np.asarray(self.letters.encode_batch_fast([s.as_py()], add_special_tokens=False)[0].ids, "<u4") for s in joined])
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) != n:  # a byte that the vocabulary lacks
            return pa.array(self._library(words.to_pylist()), pa.large_binary())
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(ids)])

    def count_many(self, texts: list[str], sizes: list[int], batch_bytes: int = 1 << 20) -> list[int]:
        """Numbers of ids only; ``sizes``: UTF-8 bytes of the texts, which balance the batches."""
        return self._batches(texts, sizes, batch_bytes, self.lengths, self._count, sum)

    def _batches(self, texts, sizes, batch_bytes, memo, make, join) -> list:
        out: list = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + sizes[end] <= batch_bytes):
                size += sizes[end]
                end += 1
            out += self._batch([self.segments(t) for t in texts[at:end]], memo, make, join)
            at = end
        return out

    def _batch(self, parts: list[list[str]], memo: dict, make, join) -> list:
        extra = {}
        need = set().union(*parts).difference(memo)
        if need:
            todo = list(need)
            for w, made in zip(todo, make(todo), strict=True):
                (memo if len(w) <= MEMO_CHARS else extra)[w] = made
        look = memo.__getitem__
        got = [join([memo[w] if w in memo else extra[w] for w in p]) if extra else join(map(look, p)) for p in parts]
        if len(memo) > min(self.entries, 400_000):
            memo.clear()
        return got


_ENCODERS: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SegmentEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
