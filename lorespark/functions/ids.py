"""Identifier expressions: normalizers, check digits, keys of works and institutions, names."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ._names import col

# Tokens that carry no identity in a name.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "msc", "bsc", "dr")


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def normalize_doi(c, lowercase: bool = False) -> Column:
    """Bare DOI: one resolver prefix, a label and leading slashes go; null if nothing is left."""
    x = F.regexp_replace(F.trim(col(c)), r"(?i)^(https?://)?(dx\.)?doi\.org/", "")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)^doi:", ""), r"^/+", ""))
    return F.nullif(F.lower(x) if lowercase else x, F.lit(""))


def normalize_pmid(c) -> Column:
    x = F.trim(F.regexp_replace(F.trim(col(c).cast("string")), r"(?i)^(https?://(www\.)?ncbi\.nlm\.nih\.gov/pubmed/|pmid:)", ""))
    return F.when(x.rlike(r"^[0-9]+$"), x)


def normalize_pmcid(c) -> Column:
    x = F.trim(F.regexp_replace(F.upper(F.trim(col(c).cast("string"))), r"^PMCID:", ""))
    x = F.regexp_replace(x, r"^(PMC\s*)+", "")
    return F.when(x.rlike(r"^[0-9]+$"), F.concat(F.lit("PMC"), x))


def normalize_arxiv(c) -> Column:
    x = F.trim(F.regexp_replace(F.lower(F.trim(col(c))), r"^arxiv:", ""))
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, r"/+$", ""), r"v[0-9]+$", "")), F.lit(""))


def orcid_valid(c) -> Column:
    """Shape, and the ISO 7064 MOD 11-2 check digit over the first 15 digits."""
    x = col(c)
    digits = F.regexp_replace(x, "-", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda acc, i: (acc + F.coalesce(F.substring(digits, i, F.lit(1)).try_cast("int"), F.lit(0))) * 2 % 11)
    check = (12 - total) % 11
    last = F.when(check == 10, F.lit("X")).otherwise(check.cast("string"))
    return F.coalesce(x.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$") & (F.substring(digits, 16, 1) == last), F.lit(False))


def is_local(c) -> Column:
    return F.startswith(col(c), F.lit("local:"))


def is_rid(c) -> Column:
    return F.coalesce(orcid_valid(c) | col(c).rlike(r"^local:[a-z0-9][a-z0-9-]*-[0-9a-f]{6}$"), F.lit(False))


def orcid_of(c) -> Column:
    return F.when(~is_local(c), col(c))


def fold_ascii(c) -> Column:
    """Lower-case letters and digits only; for ASCII text. Other text needs ``fold``."""
    return F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "")


@F.pandas_udf(ST.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII, lower case, letters and digits only."""
    return s.map(_fold, na_action="ignore")


def _fold(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower())


_ASCII = r"^[\x00-\x7F]*$"


def folded(c) -> Column:
    """``fold`` of any text; only rows with other than ASCII letters go through Python."""
    return F.when(col(c).rlike(_ASCII), fold_ascii(c)).otherwise(fold(F.when(~col(c).rlike(_ASCII), col(c))))


def any_name_key(c) -> Column:
    """``name_key`` of any name; only rows with other than ASCII letters go through Python."""
    return F.when(col(c).rlike(_ASCII), name_key(c)).otherwise(name_key_udf(F.when(~col(c).rlike(_ASCII), col(c))))


def normalize_title(c) -> Column:
    """Lower case, letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9 ]", ""), r"\s+", " "))


def work_key(doi, openalex_id, paper_id, lowercase_doi: bool = False) -> Column:
    """Identity of a work: DOI, else OpenAlex tail in lower case, else paper id in lower case."""
    tail = F.lower(F.element_at(F.split(F.trim(col(openalex_id)), "/"), -1))
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi, lowercase_doi)), F.concat(F.lit("openalex:"), F.nullif(tail, F.lit(""))),
        F.concat(F.lit("paperid:"), F.nullif(F.lower(F.trim(col(paper_id))), F.lit(""))))


def institution_key(affiliation_id, name) -> Column:
    return F.coalesce(F.concat(F.lit("ror:"), F.lower(blank_to_null(affiliation_id))), F.concat(F.lit("inst:"), F.nullif(folded(name), F.lit(""))))


def name_key(c) -> Column:
    """"surname initial" of an ASCII display name (comma form too); null for blank. Others: ``name_key_udf``."""
    raw = F.trim(col(c))
    comma = F.locate(",", raw) > 0
    tokens = F.split(raw, r"\s+")
    folded = F.transform(tokens, fold_ascii)
    # suffixes go from the end while more than one token is left
    last = F.aggregate(F.sequence(F.lit(1), F.size(tokens)), F.size(tokens), lambda n, _: F.when((n > 1) & F.element_at(folded, n).isin(*NAME_SUFFIXES), n - 1).otherwise(n))
    surname = F.when(comma, fold_ascii(F.substring_index(raw, ",", 1))).otherwise(F.element_at(folded, last))
    rest = F.regexp_replace(raw, r"^[^,]*,", "")
    given = F.when(comma, fold_ascii(rest)).otherwise(F.array_join(F.slice(folded, 1, last - 1), ""))
    initial = F.substring(given, 1, 1)
    key = F.when(surname == "", given).when(initial == "", surname).otherwise(F.concat_ws(" ", surname, initial))
    return F.nullif(F.when(raw == "", F.lit(None)).otherwise(key), F.lit(""))


@F.pandas_udf(ST.StringType())
def name_key_udf(s: pd.Series) -> pd.Series:
    """As ``name_key``, for names of any script that decomposes to ASCII."""
    return s.map(_name_key, na_action="ignore")


def _name_key(name: str) -> str | None:
    raw = name.strip()
    if "," in raw:
        before, _, after = raw.partition(",")
        surname, given = _fold(before), _fold(after)
    else:
        parts = [_fold(t) for t in raw.split()]
        while len(parts) > 1 and parts[-1] in NAME_SUFFIXES:
            parts.pop()
        surname, given = (parts or [""])[-1], "".join(parts[:-1])
    return (f"{surname} {given[0]}" if surname and given else surname or given) or None


def slug(c) -> Column:
    """Hyphenated lower-case slug of ASCII text; "person" if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(x == "", F.lit("person")).otherwise(x)


def minted_rid(key) -> Column:
    """Local id that a mint key always gives: its words, hyphenated, up to 48 characters, and six hex digits of its digest."""
    stem = F.regexp_replace(F.substring(F.regexp_replace(col(key), " ", "-"), 1, 48), r"-+$", "")
    return F.concat(F.lit("local:"), stem, F.lit("-"), F.substring(F.sha2(col(key).cast("binary"), 256), 1, 6))


def _given_names(tokens: list[str]) -> list[str]:
    """Folded given names; runs of initials ("J.A.", "W.-K.") are taken apart, suffixes go."""
    out: list[str] = []
    for t in tokens:
        whole = _fold(t)
        initials = [f for f in map(_fold, re.split(r"[.\-]", t)) if f]
        if whole in NAME_SUFFIXES or not whole:
            continue
        out += initials if len(initials) > 1 and max(map(len, initials)) == 1 else [whole]
    return out


def _identity(name: str | None) -> dict | None:
    """What a name is matched and minted by; null for a name that folds to nothing."""
    raw = (name or "").strip()
    if "," in raw:
        before, _, after = raw.partition(",")
        surname, rest = _fold(before), after.split()
    else:
        parts = raw.split()
        while len(parts) > 1 and _fold(parts[-1]) in NAME_SUFFIXES:
            parts.pop()
        surname, rest = _fold(parts[-1]) if parts else "", parts[:-1]
    given = _given_names(rest)
    if not surname:
        surname, given = _fold("".join(rest)), []
    if not surname:
        return None
    return {"key": _name_key(raw), "mint_key": " ".join([surname, *given]), "given": given[0] if given else "", "tokens": [surname, *given]}


IDENTITY_TYPE = ST.StructType([*[ST.StructField(n, ST.StringType()) for n in ("key", "mint_key", "given")], ST.StructField("tokens", ST.ArrayType(ST.StringType()))])


@F.pandas_udf(IDENTITY_TYPE)
def name_identity(s: pd.Series) -> pd.DataFrame:
    """``key`` (surname and initial), ``mint_key`` (surname and all given names), first ``given`` name, ``tokens``, folded; nulls for no name."""
    none = dict.fromkeys(("key", "mint_key", "given", "tokens"))
    return pd.DataFrame([_identity(x) or none for x in s], columns=list(none))


def slugify_backend(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[:/\\ ]", "-"), r"-{2,}", "-")


def same_space(a, b) -> Column:
    """Equal encoder specs, or the same model under two local runtimes."""
    def model(c) -> Column:
        return F.when(col(c).rlike(r"^(st|fastembed):"), F.element_at(F.split(F.regexp_replace(col(c), r"^(st|fastembed):", ""), "/"), -1))

    return F.coalesce((col(a) == col(b)) | (model(a) == model(b)), F.lit(False))
