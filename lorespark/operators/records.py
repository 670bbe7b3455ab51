"""Records, listings, evidence and citations of papers, works and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions._names import col

# Most authors, topics and abstract characters of a row; ranks in training and of faculty.
AUTHORS, TOPICS, ABSTRACT = 10, 5, 1500
TRAINEE_RANKS = ("undergraduate", "graduate_student", "postdoc")
FACULTY_RANKS = ("assistant_professor", "associate_professor", "professor", "research_faculty")
DOI = r"(?i)10\.\d{4,9}/[^\s/]+"
TOPIC_ID = r"(?i)^(?:https?://openalex\.org/)?([TC][0-9]+)$"


def paper_rows(papers: DataFrame) -> DataFrame:
    """Listing rows: authors, topics and the abstract cut to their limits."""
    return papers.withColumns({"authors": F.slice("authors", 1, AUTHORS), "topics": F.slice("topics", 1, TOPICS), "abstract": F.substring("abstract", 1, ABSTRACT)})


def papers_listing(papers: DataFrame, exclude_contaminated: bool = False, exclude_untitled: bool = False) -> DataFrame:
    """``papers(paper, title, year, contaminated)``, without contaminated or untitled ones if asked."""
    if exclude_contaminated:
        papers = papers.where(~F.coalesce("contaminated", F.lit(False)))
    return papers.where(F.trim(F.coalesce("title", F.lit(""))) != "") if exclude_untitled else papers


def by_year(papers: DataFrame) -> DataFrame:
    """Newest first, without a year last; ties by paper."""
    return papers.orderBy(F.col("year").desc_nulls_last(), "paper")


def clinical_flag(profiles: DataFrame, parts: DataFrame) -> DataFrame:
    """``profile, clinical``: capabilities that say anything, or a trials part that the viewer may see (``parts(profile, role)``)."""
    trials = parts.where("role = 'trials'").select("profile", F.lit(True).alias("trials")).distinct()
    return profiles.join(trials, "profile", "left").select("profile", (F.coalesce(F.size(F.col("capabilities")) > 0, F.lit(False)) | F.col("trials").isNotNull()).alias("clinical"))


def select_parts(parts: DataFrame, selectors: DataFrame) -> DataFrame:
    """Manifest entries ``parts(profile, url, role)`` that any of ``selectors(profile, role, url)`` names; a null field matches all."""
    by_role = selectors.where("url is null and role is not null").select("profile", "role").distinct()
    by_url = selectors.where("url is not null").select("profile", "url", F.col("role").alias("wanted")).distinct()
    named = parts.join(by_url, ["profile", "url"]).where("wanted is null or wanted = role").select(*parts.columns)
    return parts.join(by_role, ["profile", "role"], "left_semi").select(*parts.columns).union(named).distinct()


def undeclared_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc, term`` of the keys of ``documents(doc, fields map)`` that ``terms(term)`` lacks."""
    keys = documents.select("doc", F.explode(F.map_keys("fields")).alias("term"))
    return keys.join(terms, "term", "left_anti").select("doc", "term")


def role_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("profile", "role").agg(F.count(F.lit(1)).alias("n"))


def probe_agreement(probes: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``profile, agrees`` of ``probes(ordinal, profile, text, vector)`` with the first that has a text and a vector.

    Null: no vector to compare. Vectors of another length disagree; near: tolerance plus 1e-5 of the component.
    """
    first = probes.where("text is not null and text <> '' and size(vector) > 0").agg(F.min_by("vector", "ordinal").alias("ref"))
    near = F.forall(F.zip_with("ref", "vector", lambda a, b: F.abs(a - b) <= tolerance + 1e-5 * F.abs(b)), lambda ok: F.coalesce(ok, F.lit(False)))
    # one row
    return probes.join(F.broadcast(first)).select("profile",
        F.when(F.coalesce(F.size(F.col("vector")) > 0, F.lit(False)), (F.size("ref") == F.size("vector")) & near).alias("agrees"))


def merged_topics(topics: DataFrame) -> DataFrame:
    """``topic, bases, size`` of per-source indexes ``topics(base, topic, profile)``: distinct profiles over all sources."""
    return topics.groupBy("topic").agg(F.array_sort(F.collect_set("base")).alias("bases"), F.count_distinct("profile").alias("size"))


def with_ordinals(new: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``new`` with ``ordinal``: after the largest that ``existing(key, ordinal)`` has, in ``order``; from 0."""
    top = existing.groupBy(key).agg(F.max("ordinal").alias("top"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(top, key, "left").withColumn("ordinal", F.coalesce(F.col("top") + 1, F.lit(0)) + n - 1).drop("top")


def sections_at(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(doc, at)`` with the ``section`` that starts last at or before it, of ``sections(doc, name, offset)``: one sort a document."""
    both = sections.select("doc", F.col("offset").alias("at"), "name",
        F.lit(0).alias("asked")).unionByName(asked.select("doc", "at", F.lit(None).cast("string").alias("name"), F.lit(1).alias("asked")))
    last = F.last("name", ignorenulls=True).over(Window.partitionBy("doc").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("section", last).where("asked = 1").select("doc", "at", "section").distinct()


def citation_best(hits: DataFrame) -> DataFrame:
    """``hits(paper, score, span)``: each paper's best score and its span, ties to the smaller span."""
    return hits.groupBy("paper").agg(F.max("score").alias("score"), F.max_by("span", F.struct("score", -F.col("span"))).alias("span"))


def resolve_descriptor(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``asked(q, rid, orcid, name)`` against ``index(key, rid)`` of unique names: ``q, node, kind``.

    A well-formed rid wins, then an ORCID, then a name of one profile, then the folded name as an external
    node; with nothing usable ``kind`` is ``error``.
    """
    known = index.select("key", F.col("rid").alias("found"))
    own = asked.withColumn("key", I.any_name_key("name")).join(known, "key", "left")
    node = F.coalesce(F.when(I.is_rid("rid"), F.col("rid")), F.when(I.is_rid("orcid"), F.col("orcid")), F.col("found"))
    return own.select("q", F.coalesce(node, F.col("key")).alias("node"),
        F.when(node.isNotNull(), "profiled").when(F.col("key").isNotNull(), "external").otherwise("error").alias("kind"))


def work_lite(works: DataFrame) -> DataFrame:
    """Flat rows of works: ``openalex_id, doi, title, year, venue, cited_by``."""
    return works.select(F.element_at(F.split("id", "/"), -1).alias("openalex_id"), I.normalize_doi("doi").alias("doi"), "title", "year", "venue",
        F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def authorship_evidence(works: DataFrame, orcid: Column) -> DataFrame:
    """What a work's authorships say of the author with ``orcid`` (bare or IRI).

    ``works(work, authorships array<struct<id, orcid, name, affiliations, institution_ids, institution_names>>)``. The last matching
    authorship counts; the ids of the others are co-authors.
    """
    bare = F.element_at(F.split(F.regexp_replace(orcid, "/+$", ""), "/"), -1)
    is_own = lambda a: (bare != "") & F.coalesce(a["orcid"], F.lit("")).endswith(bare)
    every = F.coalesce("authorships", F.array().cast(works.schema["authorships"].dataType))
    own = F.try_element_at(F.filter(every, is_own), F.lit(-1))
    others = F.transform(F.filter(every, lambda a: ~is_own(a) & a["id"].isNotNull()), lambda a: a["id"])
    none = F.array().cast("array<string>")
    return works.select("work", own.isNotNull().alias("orcid_present"), F.coalesce(own["name"], F.lit("")).alias("display_name"),
        F.coalesce(F.filter(own["affiliations"], lambda s: s != ""), none).alias("raw_affiliations"),
            F.coalesce(own["institution_ids"], none).alias("institution_ids"),
                F.coalesce(F.filter(own["institution_names"], lambda s: s.isNotNull() & (s != "")), none).alias("institution_names"), others.alias("coauthor_ids"))


def query_terms(sources: DataFrame, cap: int = 10) -> DataFrame:
    """``profile, source, topics`` of ``sources(profile, priority, source, ordinal, term)``: the first source with a term.

    Terms once, in order; topic ids are all kept, free text up to ``cap``.
    """
    terms = sources.where(F.trim(F.coalesce("term", F.lit(""))) != "")
    first = terms.groupBy("profile").agg(F.min(F.struct("priority", "source")).alias("f")).select("profile", F.col("f.priority").alias("priority"),
        F.col("f.source").alias("source"))
    own = terms.join(first, ["profile", "priority", "source"]).groupBy("profile", "source", F.trim("term").alias("term")).agg(F.min("ordinal").alias("ordinal"))
    own = own.withColumn("id", F.col("term").rlike(TOPIC_ID))
    n = F.row_number().over(Window.partitionBy("profile", "id").orderBy("ordinal", "term"))
    kept = own.withColumn("n", n).where(F.col("id") | (F.col("n") <= cap))
    return kept.groupBy("profile", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "term"))), lambda s: s["term"]).alias("topics"))


def filter_text(c) -> Column:
    """Free text that is safe inside a filter: commas, bars and colons become spaces, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[,|:]+", " "), r"\s+", " "))


def topic_filters(c) -> Column:
    """Filter clauses of a list of topics: topic ids, concept ids, then searched labels."""
    every = F.transform(col(c), lambda t: F.trim(t))
    ids = F.transform(F.filter(every, lambda t: t.rlike(TOPIC_ID)), lambda t: F.upper(F.regexp_extract(t, TOPIC_ID, 1)))
    labels = F.filter(F.transform(F.filter(every, lambda t: ~t.rlike(TOPIC_ID)), filter_text), lambda t: t != "")
    clause = lambda key, xs: F.when(F.size(xs) > 0, F.concat(F.lit(key), F.array_join(xs, "|")))
    return F.array_compact(F.array(clause("topics.id:", F.filter(ids, lambda t: t.startswith("T"))),
        clause("concepts.id:", F.filter(ids, lambda t: t.startswith("C"))), clause("title_and_abstract.search:", labels)))


# How entries of a bibliography and their DOIs are written.
BIB_ENTRY = r"(?i)@\s*(\w+)\s*[{(]\s*([^,\s]*)\s*,"
BIB_DOI = r"(?i)\bdoi\s*=\s*[{\"]\s*([^}\"]+?)\s*[}\"]"
BIB_URL = r"(?i)\burl\s*=\s*[{\"]\s*https?://(?:dx\.)?doi\.org/([^}\"\s]+)\s*[}\"]"


def bibliography_dois(texts: DataFrame) -> DataFrame:
    """Entries of ``texts(file, text)``: ``file, n, key, doi``; doi null where an entry has none; comments and strings go."""
    marked = F.split(F.regexp_replace("text", BIB_ENTRY, "\u0001$1\u0002$2\u0003"), "\u0001")
    each = texts.select("file", F.posexplode(marked).alias("n", "e")).where("n > 0")
    kind, key = F.lower(F.substring_index("e", "\u0002", 1)), F.substring_index(F.substring_index("e", "\u0003", 1), "\u0002", -1)
    body = F.substring_index("e", "\u0003", -1)
    found = lambda p: F.nullif(F.regexp_extract(body, p, 1), F.lit(""))
    doi = I.normalize_doi(F.coalesce(found(BIB_DOI), found(BIB_URL)))
    return each.where(~kind.isin("comment", "preamble", "string")).select("file", "n",
        F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("entry-"), F.col("n"))).alias("key"), F.when(doi.rlike(r"^10\.\d{4,9}/"), doi).alias("doi"))


def looks_like_pdf(url) -> Column:
    u = F.lower(F.coalesce(col(url), F.lit("")))
    return u.endswith(".pdf") | u.contains("/full.pdf") | u.contains(".pdf?")


def extract_doi(url) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(url), F.lit("")), f"({DOI})", 1), F.lit(""))


def citations(papers: DataFrame) -> DataFrame:
    """``paper, ris, csl, plain`` of ``papers(paper, title, authors, year, venue, doi, url)``; missing fields are left out."""
    doi = F.coalesce("doi", extract_doi("url"))
    url = F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi)).when(~looks_like_pdf("url"), F.col("url"))
    line = lambda tag, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{tag}  - "), v))
    year = F.col("year").cast("string")
    names = F.coalesce("authors", F.array().cast("array<string>"))
    authors = F.nullif(F.array_join(F.transform(names, lambda a: F.concat(F.lit("AU  - "), a)), "\n"), F.lit(""))
    ris = F.concat_ws("\n", F.lit("TY  - JOUR"), line("TI", F.col("title")), authors, line("PY", year), line("JO", F.col("venue")), line("DO", doi),
        line("UR", url), F.lit("ER  - "))
    people = F.when(F.size(names) > 0, F.transform(names, lambda a: F.struct(a.alias("family"))))
    issued = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array(F.col("year"))).alias("date-parts")))
    csl = F.to_json(F.struct(F.col("paper").cast("string").alias("id"), F.lit("article-journal").alias("type"), F.col("title"),
        people.alias("author"), issued.alias("issued"), F.col("venue").alias("container-title"), doi.alias("DOI"), url.alias("URL")))
    plain = F.concat(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("Unknown")), F.lit(" et al., "), F.coalesce("venue", F.lit("n.d.")),
        F.lit(" ("), F.coalesce(year, F.lit("n.d.")), F.lit(")"))
    return papers.select("paper", ris.alias("ris"), csl.alias("csl"), plain.alias("plain"))


def node_id(given, doi, openalex_id, paper_id) -> Column:
    """The node's IRI: its own, that of its DOI, of its work id, else a fragment of the paper id."""
    oa = F.nullif(F.trim(col(openalex_id)), F.lit(""))
    work = F.when(oa.startswith("http"), oa).otherwise(F.concat(F.lit("https://openalex.org/"), oa))
    return F.coalesce(col(given), F.concat(F.lit("https://doi.org/"), I.normalize_doi(doi)), work, F.concat(F.lit("#paper/"), col(paper_id).cast("string")))


def first_sentence(c, cap: int = 240) -> Column:
    """Up to the first full stop, mark or question mark before white space or the end, cut to ``cap``; null for none."""
    text = F.trim(col(c))
    head = F.regexp_extract(text, r"^([\s\S]*?[.!?])(?:\s|$)", 1)
    return F.nullif(F.substring(F.when(head != "", head).otherwise(text), 1, cap), F.lit(""))


def career(stages: DataFrame) -> DataFrame:
    """``person, rank, trainee, self_reported, independence`` of ``stages(person, current_rank, source, independence, ranks)``."""
    known = F.array_contains("ranks", F.col("current_rank"))
    rank = F.when(F.coalesce(known, F.lit(False)), F.col("current_rank")).otherwise("unknown")
    own = F.coalesce((F.col("source") == "self_reported") & F.col("current_rank").isNotNull(), F.lit(False))
    implied = F.when(own & rank.isin(*TRAINEE_RANKS), "trainee").when(own & rank.isin(*FACULTY_RANKS), "independent")
    return stages.select("person", rank.alias("rank"), rank.isin(*TRAINEE_RANKS).alias("trainee"), own.alias("self_reported"),
        F.coalesce(implied, "independence", F.lit("unknown")).alias("independence"))


def paper_version(record) -> Column:
    """The first 16 digits of the canonical record's SHA-256."""
    return F.substring(F.sha2(col(record).cast("binary"), 256), 1, 16)


def concepts(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``asked(system, code)`` with the ``label`` of ``vocabulary(system, code, label)``; codes are trimmed, case aside."""
    norm = F.upper(F.trim("code"))
    return asked.withColumn("k", norm).join(vocabulary.select("system", norm.alias("k"), "label"), ["system", "k"], "left").drop("k")


#: Records that an asked rid meets under one key.
BLOCK = 4096


def records_about(profiles: DataFrame, aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """``rid, n, profile_id``: all records about each asked rid, after its alias, oldest first.

    Records of a rid are numbered once, before those who ask meet them, so what is found is neither shuffled nor sorted.
    They are dealt into blocks of ``BLOCK`` by number, and one who asks is copied once a block, so no key is hot. Only a
    rid that comes several times in ``asked``, or has several aliases, is numbered after the join.
    """
    own = asked.join(aliases.select(F.col("old").alias("rid"), F.col("new").alias("now")), "rid", "left").select("rid", F.coalesce("now", "rid").alias("now"))
    known = profiles.select(F.col("rid").alias("now"), "profile_id").where("now IS NOT NULL")
    several = own.groupBy("rid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("rid")
    block = lambda n: F.floor((F.col(n) - 1) / BLOCK).cast("int")
    numbered = known.withColumn("n", F.row_number().over(Window.partitionBy("now").orderBy("profile_id"))).withColumn("block", block("n"))
    blocks = known.groupBy("now").agg(F.count(F.lit(1)).alias("many"))
    dealt = own.join(several, "rid", "left_anti").join(blocks, "now").select("rid", "now", F.explode(F.sequence(F.lit(0), block("many"))).alias("block"))
    found = dealt.join(numbered, ["now", "block"]).select("rid", "n", "profile_id")
    mixed = own.join(several, "rid", "left_semi").join(known, "now")
    return found.unionAll(mixed.select("rid", F.row_number().over(Window.partitionBy("rid").orderBy("profile_id")).alias("n"), "profile_id"))


def rids_with_email(profiles: DataFrame, emails: DataFrame) -> DataFrame:
    """``email, rid`` whose trimmed, lower-case address is an asked one; blank finds nothing."""
    key = F.lower(F.trim("email"))
    asked = emails.select(key.alias("email")).where("email <> ''").distinct()
    return profiles.select("rid", key.alias("email")).join(asked, "email").select("email", "rid").distinct()


def join_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows that have a vector, by key; adaptive execution picks the join."""
    return chunks.join(vectors, key)
