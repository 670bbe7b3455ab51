"""What a profile hands out: manifests in published order, interest nodes, vectors by kind, reports, paper groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import vectors as V
from ..functions._names import col
from .embedding import embed
from .interests import effective
from .ranking import centroids

MARKDOWN, JSON, JSONLD = "text/markdown", "application/json", "application/ld+json"

# Known files in the order of a published manifest, as (pattern, role, encoding format, name).
# A first group of a pattern is the stem of a file's name.
SUBJECTS = (
    (r"^personality/SOUL\.md$", "soul", MARKDOWN, "SOUL"),
    (r"^personality/expertise\.md$", "expertise", MARKDOWN, "Expertise"),
    (r"^personality/clinical_expertise\.md$", "clinical_expertise", MARKDOWN, "Clinical expertise"),
    (r"^personality/topics\.json$", "topics", JSON, "Research topics"),
)
PARTS = (
    (r"^index\.html$", "html", "text/html", "Profile page"),
    (r"^SKILL\.md$", "agent_entry_point", MARKDOWN, "Agent entry point"),
    (r"^sources/papers\.jsonld$", "works", JSONLD, "Works"),
    (r"^sources/grants\.jsonld$", "grants", JSONLD, "Grants"),
    (r"^sources/trials\.jsonld$", "trials", JSONLD, "Clinical trials"),
    (r"^sources/seed_papers\.jsonld$", "seed_papers", JSONLD, "Interest seed papers"),
    (r"^sources/citations\.json$", "citations", JSON, "Citations"),
    (r"^sources/cv\.md$", "cv", MARKDOWN, "CV"),
    (r"^sources/interview\.md$", "interview", MARKDOWN, "Interview digest"),
    (r"^sources/summaries/([^/]*)\.summary\.md$", "paper_summary", MARKDOWN, "Summary: "),
    (r"^sources/papers/([^/]*)\.md$", "paper_fulltext", MARKDOWN, "Full text: "),
    (r"^sources/web/([^/]*)\.md$", "web", MARKDOWN, "Web page: "),
    (r"^embeddings/index\.json$", "embedding_index", JSON, "Embedding index"),
    (r"^\.cache/embeddings\.sqlite$", "embedding_index_sqlite", "application/vnd.sqlite3", "Embedding index (local sqlite)"),
)


def manifest(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Known ``files(profile, url, size_bytes, sha256)`` as manifest rows; order them by ``profile, slot, place, url``.

    ``recorded(profile, ordinal, url, sha256, inputs_digest)`` is the manifest before: a digest of inputs is carried
    over only while the file's bytes are the same, the last record's if several are. Other files have no row.
    ``paper_id`` is the stem of a summary's or full text's name. Null urls, hashes and digests carry nothing.
    """
    known = [(slot, place, *spec) for slot, specs in (("subjectOf", SUBJECTS), ("hasPart", PARTS)) for place, spec in enumerate(specs)]
    pick = lambda i: F.coalesce(*[F.when(F.col("url").rlike(k[2]), F.lit(k[i])) for k in known])
    stem = F.coalesce(*[F.when(F.col("url").rlike(k[2]), F.regexp_extract("url", k[2], 1)) for k in known if "(" in k[2]])
    out = files.withColumns({"slot": pick(0), "place": pick(1), "role": pick(3), "encoding_format": pick(4)}).where("slot is not null")
    out = out.withColumn("name", F.concat(pick(5), F.coalesce(stem, F.lit(""))))
    out = out.withColumn("paper_id", F.when(F.col("role").isin("paper_summary", "paper_fulltext"), stem))
    good = recorded.where("url <> '' and sha256 <> '' and inputs_digest <> ''")
    kept = good.groupBy("profile", "url", "sha256").agg(F.max_by("inputs_digest", "ordinal").alias("inputs_digest"))
    cols = ["profile", "slot", "place", "url", "name", "role", "encoding_format", "paper_id", "size_bytes", "sha256"]
    return out.select(*cols).join(kept, ["profile", "url", "sha256"], "left").select(*cols, "inputs_digest")


def interest_nodes(interests: DataFrame) -> DataFrame:
    """``profile, position, node``: a JSON node for every concept whose effective weight is above 0, in order of the list.

    ``interests`` as of ``interests.effective`` with ``iri``. A concept without a code is its label alone; one with
    an IRI is named by it, others by system and code. Null and negative weights have no node: it cannot say "not".
    """
    own = effective(interests).where("weight > 0")
    label = F.col("label").alias("skos:prefLabel")
    scheme = F.struct(F.col("system").alias("@id")).alias("skos:inScheme")
    coded = F.to_json(F.struct(scheme, F.col("code").alias("skos:notation"), label))
    node = F.when(F.col("code").isNull(), F.to_json(F.struct(label))).when(F.col("iri") != "", F.to_json(F.struct(F.col("iri").alias("@id"), label))).otherwise(coded)
    return own.select("profile", "position", node.alias("node"))


def profile_vectors(chunks: DataFrame, texts: DataFrame, make: Callable) -> DataFrame:
    """``profile, kind, vec``: ``centroid`` of its chunks, ``expertise`` and ``summary`` of ``texts(profile, summary, expertise)``.

    A blank expertise text has zeros. A missing summary falls back on the first 500 characters of the expertise text.
    Profiles without chunks have no centroid row.
    """
    summary = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.col("summary")).otherwise(F.substring(F.coalesce("expertise", F.lit("")), 1, 500))
    each = F.explode(F.create_map(F.lit("expertise"), F.coalesce("expertise", F.lit("")), F.lit("summary"), summary)).alias("kind", "text")
    made = texts.select("profile", each).withColumn("raw", embed(make, "text").cast("array<double>"))
    zero = (F.col("kind") == "expertise") & (F.trim("text") == "")
    vec = F.when(zero, F.transform("raw", lambda x: x * 0)).otherwise(V.unit("raw"))
    return centroids(chunks).select("profile", F.lit("centroid").alias("kind"), "vec").unionByName(made.select("profile", "kind", vec.alias("vec")))


def reports(profiles: DataFrame, violations: DataFrame) -> DataFrame:
    """``profile, ok, violations`` of every profile: ``violations(profile, pointer, keyword)`` as ``profiles.violations`` gives them."""
    bad = violations.groupBy("profile").agg(F.count(F.lit(1)).alias("violations"))
    return profiles.select("profile").distinct().join(bad, "profile", "left").select("profile", F.col("violations").isNull().alias("ok"),
        F.coalesce("violations", F.lit(0)).alias("violations"))


def report_lines(profiles: DataFrame, violations: DataFrame, as_json: bool = False) -> DataFrame:
    """``profile, pointer, keyword, line``: reports as text or JSON lines, a status line (null pointer) and one a violation.

    A row a line: a report of any length is never gathered; order by ``profile, pointer, keyword``, nulls first.
    """
    head = reports(profiles, violations)
    if as_json:
        status, line = F.to_json(F.struct("profile", "ok", "violations")), F.to_json(F.struct("profile", F.col("pointer").alias("json_pointer"), "keyword"))
    else:
        status = F.concat(F.lit("Validation: "), F.when(F.col("ok"), "PASS").otherwise("FAIL"))
        line = F.concat(F.lit("  "), F.coalesce("pointer", F.lit("")), F.lit(": "), "keyword")
    none = F.lit(None).cast("string")
    first = head.select("profile", none.alias("pointer"), none.alias("keyword"), status.alias("line"))
    return first.unionByName(violations.select("profile", "pointer", "keyword", line.alias("line")))


def local_key(owner: Column | str, paper_id: Column | str, title: Column | str) -> Column:
    """Key of a work that has no identifier of its own: its owner's, by paper id, else by its title's words."""
    slug = F.trim(F.regexp_replace(F.lower(col(title)), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.lit("local:"), col(owner), F.lit(":"), F.coalesce(F.nullif(col(paper_id), F.lit("")), slug, F.lit("")))


def paper_groups(papers: DataFrame) -> DataFrame:
    """Works of all profiles by identity: ``work_key, owners, evidence, first_year, last_year``.

    ``papers(owner, doi, openalex_id, paper_id, title, year)``. ``owners`` counts the profiles that list the work,
    ``evidence`` the identifiers they cite it by (DOI, else paper id, else OpenAlex id). Both lists are rows of
    ``paper_group_rows``, so a work that very many list is never gathered. A year of 0 is no year.
    """
    rows = paper_group_rows(papers)
    return rows.groupBy("work_key").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("evidence").alias("evidence"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def paper_group_rows(papers: DataFrame) -> DataFrame:
    """``work_key, owner, evidence, year`` of every listed paper, without repeats."""
    key = F.coalesce(I.work_key("doi", "openalex_id", "paper_id"), local_key("owner", "paper_id", "title"))
    evidence = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("doi", "paper_id", "openalex_id")])
    return papers.select(key.alias("work_key"), "owner", evidence.alias("evidence"), F.nullif("year", F.lit(0)).alias("year")).distinct()
