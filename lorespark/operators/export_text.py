"""One text of a profile for a knowledge base: deterministic, within a budget of characters, of whole papers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I

# The budget, and the fence of fields before a summary.
CHAR_BUDGET = 120_000
FRONTMATTER = r"(?s)\A---\r?\n.*?\r?\n---[ \t]*\r?\n"
LINE = "\n"


def normalized(text: Column) -> Column:
    """Line ends of one kind, no more than one empty line together, nothing around the whole."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", LINE), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _filled(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def _section(heading: str, *lines: Column) -> Column:
    """A section of the lines that are not null, or nothing at all."""
    body = F.array_compact(F.array(*lines))
    return F.when(F.size(body) > 0, F.concat(F.lit(f"## {heading}\n\n"), F.array_join(body, LINE)))


def _bullets(heading: str, items: Column, trailer: Column | None = None) -> Column:
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), _filled), lambda x: x.isNotNull())
    lines = F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), LINE))
    body = lines if trailer is None else F.nullif(F.concat_ws("\n\n", lines, trailer), F.lit(""))
    return F.when(body.isNotNull(), F.concat(F.lit(f"## {heading}\n\n"), body))


def signed_labels(interests: DataFrame) -> DataFrame:
    """``profile, wanted, unwanted`` of effective ``interests(profile, position, label, weight)``: labels with their weights, as ``ATAC (+0.5)``."""
    number = F.regexp_replace(F.call_function("format_number", F.abs("weight"), F.lit("0.######")), r"\.$", "")
    text = F.concat(F.trim("label"), F.lit(" ("), F.when(F.col("weight") > 0, "+").otherwise("-"), number, F.lit(")"))
    each = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("position", text.alias("t"))))), lambda x: x["t"])
    return interests.groupBy("profile").agg(each(F.col("weight") > 0).alias("wanted"), each(F.col("weight") < 0).alias("unwanted"))


def head(profiles: DataFrame) -> DataFrame:
    """``profile, head``: everything but the papers.

    ``profiles(profile, name, rid, job_title, affiliation, url, summary, field, subfields, expertise, interests, not_interests, commitments,
    career array<struct<role, institution, start_year, end_year>>, training array<struct<degree, field, institution, year_end>>,
    expertise_doc, soul)``; what a viewer may not see is null already (``privacy.project_sections``). Sections without content have no heading.
    """
    c = F.col
    some = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: _filled(x).isNotNull())
    role = F.nullif(F.array_join(some(F.array("job_title", "affiliation")), ", "), F.lit(""))
    orcid = F.concat(F.lit("ORCID: "), I.orcid_of("rid"))
    title = F.concat(F.lit("# "), c("name"), F.lit("\n\n"), F.concat_ws(LINE, role, orcid, F.concat(F.lit("Profile: "), F.nullif(c("url"), F.lit("")))))
    sub = some(c("subfields"))
    subfields = F.when(F.size(sub) > 0, F.concat(F.lit("Subfields: "), F.array_join(F.transform(sub, lambda x: F.trim(x)), ", ")))
    no = some(c("not_interests"))
    trailer = F.when(F.size(no) > 0, F.concat(F.lit("Not interested in: "), F.array_join(F.transform(no, lambda x: F.trim(x)), ", ")))
    year = lambda y: F.coalesce(y.cast("string"), F.lit(""))
    span = lambda e: F.when(e["start_year"].isNotNull() | e["end_year"].isNotNull(),
        F.concat(F.lit(" ("), year(e["start_year"]), F.lit("-"), F.coalesce(e["end_year"].cast("string"), F.lit("present")), F.lit(")"))).otherwise("")
    career = F.transform("career", lambda e: F.concat(e["role"], F.lit(", "), e["institution"], span(e)))
    studied = lambda e: F.coalesce(F.concat(F.lit(", "), _filled(e["field"])), F.lit(""))
    ended = lambda e: F.when(e["year_end"].isNotNull(), F.concat(F.lit(" ("), e["year_end"].cast("string"), F.lit(")"))).otherwise("")
    training = F.transform("training", lambda e: F.concat(e["degree"], studied(e), F.lit(", "), e["institution"], ended(e)))
    doc = lambda heading, body: F.concat(F.lit(f"## {heading}\n\n"), F.nullif(normalized(body), F.lit("")))
    parts = (
        title, _section("Overview", _filled(c("summary"))), _section("Field", _filled(c("field")), subfields), _bullets("Expertise", c("expertise")),
        _bullets("Interests", c("interests"), trailer), _bullets("Methodological commitments", c("commitments")), _bullets("Career", career), _bullets("Training", training),
        doc("Research narrative", c("expertise_doc")), doc("Approach and voice", c("soul")))
    return profiles.select("profile", normalized(F.concat_ws("\n\n", *parts)).alias("head"))


def paper_bodies(papers: DataFrame) -> DataFrame:
    """``papers`` with ``body`` and ``body_source``: the summary without frontmatter and its marker of an abstract alone, else the abstract."""
    summary = F.nullif(normalized(F.regexp_replace(F.regexp_replace("summary", FRONTMATTER, ""), r"(?i)\[abstract-only\]\s*", "")), F.lit(""))
    abstract = F.nullif(normalized(F.col("abstract")), F.lit(""))
    source = F.when(summary.isNotNull(), "summary").otherwise("abstract")
    return papers.withColumn("body", F.coalesce(summary, abstract)).withColumn("body_source", source)


def blocks(papers: DataFrame) -> DataFrame:
    """``profile, place, block`` of selected ``papers(profile, place, title, year, journal, doi, body)``, each with its line of facts."""
    doi = F.concat(F.lit("doi:"), I.normalize_doi("doi"))
    facts = F.nullif(F.concat_ws(" · ", F.col("year").cast("string"), F.nullif(F.col("journal"), F.lit("")), doi), F.lit(""))
    return papers.select("profile", "place", normalized(F.concat_ws("\n\n", F.concat(F.lit("### "), F.trim("title")), facts, F.col("body"))).alias("block"))


def render(profiles: DataFrame, papers: DataFrame, budget: int | None = CHAR_BUDGET) -> DataFrame:
    """``profile, text, papers``: the head and as many whole papers, in order of ``place``, as the budget of characters allows.

    Papers come off the end; none is cut. A head over the budget stays whole. Only blocks that can still fit are gathered: a running
    length is kept where blocks are sorted, and what is past the budget is dropped before the rest is joined.
    """
    from pyspark.sql import Window

    heads = head(profiles)
    selected = F.lit("## Selected work")
    sized = blocks(papers).join(heads.select("profile", F.length("head").alias("h")), "profile")
    # the head and the heading before the first block, a paragraph break before each, a line end at the very end
    upto = F.sum(F.length("block") + 2).over(Window.partitionBy("profile").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    total = F.col("h") + F.when(F.col("h") > 0, 2).otherwise(0) + F.length(selected) + upto + 1
    fit = sized.withColumn("total", total)
    fit = fit if budget is None else fit.where(F.col("total") <= budget)
    body = fit.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("place", "block"))).alias("b"))
    text = F.concat(F.concat_ws("\n\n", F.nullif(F.col("head"), F.lit("")),
        F.when(F.size("b") > 0, F.concat(selected, F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")))), F.lit(LINE))
    return heads.join(body, "profile", "left").select("profile", text.alias("text"), F.coalesce(F.size("b"), F.lit(0)).alias("papers"))


def content_hash(bundles: DataFrame, *columns: str) -> Column:
    """``sha256:`` and the digest of the columns as one JSON object, keys in order: what tells a changed export from the last."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256))


def foaf(profiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``profile, node``: the person as a FOAF node of what they are interested in.

    ``profiles(profile, iri, name)``; ``nodes(profile, position, node)`` as ``exports.interest_nodes`` gives them. A person without positive
    interests has an empty list: there is no way to say "not interested".
    """
    context = '"@context":{"foaf":"http://xmlns.com/foaf/0.1/","skos":"http://www.w3.org/2004/02/skos/core#"}'
    topics = nodes.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node"))), lambda x: x["node"]).alias("t"))
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(c))
    node = F.concat(F.lit("{" + context + ',"@id":'), text("iri"), F.lit(',"@type":"foaf:Person","foaf:name":'), text("name"),
        F.lit(',"foaf:topic_interest":['), F.array_join(F.coalesce("t", F.array().cast("array<string>")), ","), F.lit("]}"))
    return profiles.join(topics, "profile", "left").select("profile", node.alias("node"))
