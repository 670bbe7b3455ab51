"""Text expressions: tokens, cuts, citations, inverted indexes, artifact checks, and the UDTF-like splitters."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ._names import col

# Limits of chunks and passages.
MAX_CHUNK, SECTION_SPLIT, WINDOW_MIN, WINDOW_MAX, SNIPPET, MIN_BODY = 8000, 2000, 400, 1200, 1200, 40
_CITATION = r"\s*\[[A-Za-z0-9_.:-]+(?:\s*[,;]\s*[A-Za-z0-9_.:-]+)*\]"


def tokens(c) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def truncate_words(c, limit: int = SNIPPET) -> Column:
    """At most ``limit`` characters, back to the last space if that is past the half."""
    x = col(c)
    head = F.substring(x, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    back = (F.locate(" ", head) > 0) & (space > limit / 2)
    return F.when(F.length(x) <= limit, x).otherwise(F.when(back, F.left(head, space)).otherwise(head))


def strip_frontmatter(c) -> Column:
    return F.regexp_replace(col(c), r"(?s)^---.*?\n---\n*", "")


def strip_citations(c) -> Column:
    """Bracketed lists of paper ids, with the space before them."""
    return F.regexp_replace(col(c), _CITATION, "")


def decode_inverted_index(index) -> Column:
    """Text of a map word -> positions: by position, the alphabetically first word of a shared one, gaps closed."""
    pairs = F.flatten(F.transform(F.map_entries(col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    # bound as a lambda's variable, so that the sorted array is made once and not for every element
    first = F.transform(F.array(F.array_sort(pairs)), lambda o: F.filter(o, lambda s, i: (i == 0) | (F.get(o, i - 1)["p"] != s["p"])))[0]
    return F.array_join(F.transform(first, lambda s: s["w"]), " ")


def parse_since(since: str, as_of: str) -> Column:
    """Cutoff year of 1y, 6m, 4w, 30d or a bare year, counted back from the date ``as_of``."""
    n, day = int(re.match(r"\d+", since)[0]), F.to_date(F.lit(as_of))
    unit = since[len(str(n)) :]
    return F.year({"y": F.add_months(day, -12 * n), "m": F.add_months(day, -n), "w": F.date_sub(day, 7 * n), "d": F.date_sub(day, n)}[unit]) if unit else F.lit(n)


def artifact_problems(c, min_chars: int = 0) -> Column:
    """Names of failed rules: replacement characters over 1 %, NUL, control characters over 2 %, PDF bytes, too short."""
    x = col(c)
    n = F.greatest(F.length(x), F.lit(1))
    bad = F.regexp_count(x, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))
    markers = sum((x.rlike(p).cast("int") for p in (r"(?m)^\d+ \d+ obj\b", r"(?m)^endobj\b", r"(?m)^endstream\b", r"(?m)^startxref\b", r"(?m)^%%EOF\b")), F.lit(0))
    rules = [
        F.when(F.regexp_count(x, F.lit("�")) / n > 0.01, F.lit("replacement_characters")),
        F.when(x.contains("\x00"), F.lit("nul")),
        F.when(bad / n > 0.02, F.lit("control_characters")),
        F.when(x.rlike(r"^\s*%PDF-"), F.lit("pdf_header")).when(markers >= 2, F.lit("pdf_structure")),
    ]
    if min_chars:
        rules.append(F.when(F.length(F.trim(x)) < min_chars, F.lit("too_short")))
    return F.array_compact(F.array(*rules))


def split_refs(c) -> Column:
    """DOIs and work ids of a list separated by white space, commas or semicolons, without repeats."""
    parts = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"[\s,;]+"), lambda p: p != "")
    doi = lambda p: F.regexp_extract(p, r"(?i)(10\.\d{4,9}/\S+)", 1)
    wid = lambda p: F.upper(F.regexp_extract(p, r"(?i)(?:^|/)(W\d+)$", 1))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.when(doi(p) != "", doi(p)).otherwise(wid(p))), lambda p: p != ""))


# --- splitters: sequential over one text, so Arrow-batched functions ---------------------------------


def headings(text: str, level: int) -> list[tuple[str | None, str]]:
    """(heading, body) pieces at headings of ``level``; what comes before the first has none."""
    cuts = [m for m in re.finditer(rf"(?m)^{'#' * level}[ \t]+(.+?)[ \t]*$", text)]
    if not cuts:
        return [(None, text)]
    ends = [m.start() for m in cuts[1:]] + [len(text)]
    lead = [(None, text[: cuts[0].start()])] if text[: cuts[0].start()].strip() else []
    return lead + [(m[1], text[m.end() : e]) for m, e in zip(cuts, ends, strict=True)]


def pack_paragraphs(text: str, limit: int = MAX_CHUNK) -> list[str]:
    """Blank-line paragraphs packed up to ``limit`` (two characters each for the gap); a long one stays whole."""
    if len(text) <= limit:
        return [text]
    groups: list[list[str]] = []
    size = 0
    for p in re.split(r"\n\s*\n", text):
        if groups and size + len(p) + 2 <= limit:
            groups[-1].append(p)
            size += len(p) + 2
        else:
            size = len(p) + (0 if groups else 2)
            groups.append([p])
    return [j for g in groups if (j := "\n\n".join(g).strip())]


def markdown_chunks(text: str) -> list[dict]:
    """Chunks at second-level headings; a long section with third-level ones is cut there; each packed."""
    out: list[dict] = []
    for h2, body in headings(re.sub(r"(?s)\A---.*?\n---\n*", "", text), 2):
        parts = [(h2 if h3 is None else f"{h2} / {h3}" if h2 else h3, b) for h3, b in headings(body, 3)] if len(body) > SECTION_SPLIT else [(h2, body)]
        for section, b in parts:
            for piece in pack_paragraphs(b.strip()):
                clean = re.sub(_CITATION, "", piece).strip()
                if clean:
                    out.append({"chunk_index": len(out), "section": section, "text": piece, "embed_text": f"{section}\n\n{clean}" if section else clean})
    return out


def piece_chunks(text: str) -> list[dict]:
    """Packed paragraphs without sections; a piece keeps its position, so one of citations alone leaves a gap."""
    body = text.strip()
    pieces = [(i, p, re.sub(_CITATION, "", p).strip()) for i, p in enumerate(pack_paragraphs(body) if body else [])]
    return [{"chunk_index": i, "section": None, "text": p, "embed_text": clean} for i, p, clean in pieces if clean]


def passage_windows(text: str) -> list[tuple[int, int]]:
    """Spans of 400 to 1,200 characters from blank-line paragraphs; longer ones are cut at spaces."""
    pieces: list[tuple[int, int]] = []
    at = 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        s, e = at, m.start() if m else len(text)
        at = m.end() if m else at
        while e - s > WINDOW_MAX:
            cut = text.rfind(" ", s + WINDOW_MIN, s + WINDOW_MAX)
            cut = s + WINDOW_MAX if cut < 0 else cut
            pieces.append((s, cut))
            s = cut + (text[cut] == " ")
        if text[s:e].strip():
            pieces.append((s, e))
    out: list[tuple[int, int]] = []
    for s, e in pieces:
        if out and out[-1][1] - out[-1][0] < WINDOW_MIN and e - out[-1][0] <= WINDOW_MAX:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def sections(text: str) -> list[dict]:
    """Headings of levels 1 to 3 with offsets; a repeated name gets its number; each ends where the next starts."""
    seen: dict[str, int] = {}
    out: list[dict] = []
    for m in re.finditer(r"(?m)^#{1,3}[ \t]+(.+?)[ \t]*$", text):
        seen[m[1]] = seen.get(m[1], 0) + 1
        out.append({"name": m[1] if seen[m[1]] == 1 else f"{m[1]} ({seen[m[1]]})", "offset": m.start()})
    for a, b in zip(out, [*out[1:], {"offset": len(text)}], strict=True):
        a["length"] = b["offset"] - a["offset"]
    return out


def text_page(text: str, start: int, size: int, end: int | None = None, look_back: int = 2000) -> tuple[str, int | None]:
    """A page and the next offset, cut after the last blank line within its final ``look_back`` characters."""
    stop = min(end if end is not None else len(text), len(text))
    start = max(0, min(start, stop))
    cut = min(start + size, stop)
    if cut < stop and (blank := text.rfind("\n\n", max(start + 1, cut - look_back), cut)) >= 0:
        cut = blank + 2
    return text[start:cut], cut if cut < stop else None


# types as objects: a worker that imports this module has no session to parse text with
CHUNK_TYPE = ST.ArrayType(ST.StructType().add("chunk_index", ST.IntegerType()).add("section", ST.StringType()).add("text", ST.StringType()).add("embed_text", ST.StringType()))
SPAN_TYPE = ST.ArrayType(ST.StructType().add("start", ST.IntegerType()).add("end", ST.IntegerType()))
SECTION_TYPE = ST.ArrayType(ST.StructType().add("name", ST.StringType()).add("offset", ST.IntegerType()).add("length", ST.IntegerType()))


@F.pandas_udf(CHUNK_TYPE)
def chunk_markdown(s: pd.Series) -> pd.Series:
    return s.map(lambda t: markdown_chunks(t or ""))


@F.pandas_udf(CHUNK_TYPE)
def chunk_source(s: pd.Series, headed: pd.Series) -> pd.Series:
    """Chunks at headings where ``headed``, else packed pieces."""
    return pd.Series([markdown_chunks(t or "") if h else piece_chunks(t or "") for t, h in zip(s, headed, strict=True)], index=s.index)


@F.pandas_udf(SPAN_TYPE)
def windows_of(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"start": a, "end": b} for a, b in passage_windows(t or "")])


@F.pandas_udf(SECTION_TYPE)
def sections_of(s: pd.Series) -> pd.Series:
    return s.map(lambda t: sections(t or ""))


@F.pandas_udf(ST.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two titles as matching-block ratio."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
