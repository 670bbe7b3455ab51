"""Personal data by anchor expansion: an automaton finds anchors, local parsers expand and validate."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# The patterns of the base kinds, as the contract gives them.
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

#: Everything that an address, a card or a phone number can consist of, from its first digit or plus on.
_NUMERIC = re.compile(r"\+?[0-9][0-9 ().+\-]*")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:-]+@[A-Za-z0-9.-]+(:[0-9]+)?[^\s\"'<>]*")
_IBAN = re.compile(r"[\s:]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b")
_SECRET = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{16,})")
#: Identifier cues, each in lower case, capitalized and upper case.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, "digit")
    a.add_word("@", "at")
    a.add_word("://", "scheme")
    for cue, kind in (("iban", "iban"), *((c, "secret") for c in SECRET_CUES)):
        for form in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(form, kind)
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _numeric(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    for m in _IP.finditer(text, start, end):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text, start, end):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in _PHONE.finditer(text, start, end):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield "phone", *m.span()


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Finder:
    """All spans of a text: (kind, start, end) in code points, end exclusive, by start, then kind."""

    def __init__(self):
        self.automaton = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        numeric_to = email_to = extra_to = 0
        for end, kind in self.automaton.iter(text):
            if kind == "digit":
                if end >= numeric_to:
                    start = end - (end > numeric_to and text[end - 1] == "+")
                    numeric_to = _NUMERIC.match(text, start).end()
                    found += _numeric(text, start, numeric_to)
            elif kind == "at":
                if end < email_to:
                    continue
                # the local part is the whole run to the left that no earlier match took
                reach = 64
                while not (m := _LOCAL.search(text, max(email_to, end - reach), end)) or (m.start() == end - reach > email_to):
                    if not m or end - reach <= email_to:
                        break
                    reach *= 4
                if m and (d := _DOMAIN.match(text, end + 1)):
                    email_to = d.end()
                    found.append(("email", m.start(), email_to))
            elif kind == "scheme":
                m, user = _URL.search(text, max(extra_to, end - 22), end - 2), _USERINFO.match(text, end + 1)
                if m and user:
                    extra_to = user.end()
                    found.append(("url", m.start(), extra_to))
            elif kind == "iban":
                if (m := _IBAN.match(text, end + 1)) and m.start(1) >= extra_to and _iban_ok(m[1]):
                    extra_to = m.end(1)
                    found.append(("iban", *m.span(1)))
            elif (m := _SECRET.match(text, end + 1)) and m.start(1) >= extra_to:
                extra_to = m.end(1)
                found.append(("secret", *m.span(1)))
        found.sort(key=lambda s: (s[1], _ORDER[s[0]]))
        return found


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with ``out``: all spans of the whole text, by start, then kind. Null and empty texts: none."""
    keep = [c for c in df.columns if c != out]
    src = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in finder.spans(t.as_py() or "")] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, out])

    return src.mapInArrow(run, src.withColumn(out, F.lit(None).cast(SPAN_TYPE)).schema)


def pii_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of base spans, ``n_spans`` of all, ``base_sha256`` and ``spans``.

    Rows with null or repeated ids stay; null texts are empty; other columns, whatever their names, are not read; empty in, empty out.
    """
    found = find_pii(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("t")), "t")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.size("pii").cast("long").alias("n_spans"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans become one mark.

    Null texts stay null. Columns and their order stay.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    parts, done = [], 0
                    for k, s, e in finder.spans(t):
                        if s >= done:
                            parts += [t[done:s], f"<{k.upper()}>"]
                        done = max(done, e)
                    t = "".join([*parts, t[done:]])
                out.append(t)
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)
