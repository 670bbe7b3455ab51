"""Validation of published folders: rules as data, compiled to expressions over parsed documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions.text import artifact_problems
from ..functions.tiers import TIERS
from ..session import settled
from .exports import manifest
from .privacy import derivations, doubled, unresolved

# Levels of a profile, provenances that hold no ORCID, renamed fields, folders of derived files and what is rebuilt there.
LEVELS, LOCAL_PROVENANCE = ("lite", "full", "deep"), ("synthetic", "historical")
RETIRED_TERMS = {"artifacts": "researchOutputs"}
CACHE, LEGACY_CACHE, DERIVED = ".cache/", "cache/", (".cache/embeddings.sqlite",)
TEXT_FILES = r"^(?:sources/papers/[^/]+\.md|sources/summaries/[^/]+\.summary\.md)$"
SUMMARY = r"^sources/summaries/([^/]+)\.summary\.md$"
REMOTE = r"^(?:https?://|/)"
FOUND = 120

VIOLATION = "struct<severity:string,json_pointer:string,keyword:string,message:string,found:string,expected:string,fix:string>"


@dataclass(frozen=True)
class Rule:
    """One thing that a field must be. ``test``: required, string, list, filled, literal, format or rid."""

    field: str
    test: str
    among: tuple[str, ...] = ()


#: Of the document of a person, of a manifest entry, of a proof, and of a work.
PROFILE_RULES = (
    *(Rule(f, "required") for f in ("name", "rid", "provenance")),
    *(Rule(f, "string") for f in ("name", "rid", "provenance", "conformsTo")),
    *(Rule(f, "text") for f in ("url", "email", "field", "summary", "license", "jobTitle", "dateModified", "verifiedAt", "provenanceNote")),
    *(Rule(f, "list") for f in ("hasPart", "subjectOf", "proof", "subfields", "sameAs", "identifier", "training", "career", "expertise", "interests", "researchOutputs")),
    Rule("name", "filled"), Rule("conformsTo", "format"), Rule("rid", "rid"), Rule("visibility", "literal", TIERS), Rule("level", "literal", LEVELS),
)
ENTRY_RULES = (Rule("contentUrl", "required"), Rule("contentUrl", "string"), Rule("role", "text"), Rule("paperId", "text"), Rule("sha256", "text"),
    Rule("derivedFrom", "list"), Rule("visibility", "literal", TIERS))
PROOF_RULES = (Rule("kind", "required"), Rule("kind", "string"))
WORK_RULES = (Rule("name", "required_title"), Rule("paper_id", "text"), Rule("doi", "text"), Rule("abstract", "text"))


def _at(v: Column, field: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$['{field}']", kind)


def _kind(v: Column, field: str) -> Column:
    """Type of a field, null where it is missing; ``VOID`` for a JSON null."""
    return F.schema_of_variant(_at(v, field, "variant"))


def _cap(c: Column) -> Column:
    return F.when(F.length(c) > FOUND, F.concat(F.substring(c, 1, FOUND - 3), F.lit("..."))).otherwise(c)


def _violation(bad: Column, keyword: str, pointer: Column, message, found: Column, expected, fix=None, severity: str = "error") -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    fix = F.concat(F.lit(f"fix the {keyword} error at "), pointer) if fix is None else text(fix)
    return F.when(bad, F.struct(F.lit(severity).alias("severity"), pointer.alias("json_pointer"), F.lit(keyword).alias("keyword"),
        text(message).alias("message"), _cap(found).alias("found"), text(expected).alias("expected"), fix.alias("fix")))


def _compiled(rule: Rule, v: Column, at: Column, format_iri: Column) -> Column:
    """A rule as a violation or null, of the object ``v`` at the pointer ``at``."""
    kind, pointer, raw = _kind(v, rule.field), F.concat(at, F.lit(f"/{rule.field}")), F.coalesce(_at(v, rule.field), F.to_json(_at(v, rule.field, "variant")), F.lit("None"))
    value, there = _at(v, rule.field), kind.isNotNull()
    is_text = F.coalesce(kind == "STRING", F.lit(False))
    if rule.test in ("required", "required_title"):
        gone = kind.isNull() if rule.test == "required" else kind.isNull() & _kind(v, "title").isNull()
        return _violation(gone, "missing", pointer, "Field required", F.lit("<missing>"), "field is required", F.concat(F.lit("add the required field at "), pointer))
    if rule.test == "string":
        return _violation(there & ~is_text, "string_type", pointer, "Input should be a valid string", raw, "type: string")
    if rule.test == "text":
        return _violation(there & ~is_text & (kind != "VOID"), "string_type", pointer, "Input should be a valid string", raw, "type: string")
    if rule.test == "list":
        return _violation(there & ~kind.startswith("ARRAY"), "list_type", pointer, "Input should be a valid list", raw, "type: list")
    if rule.test == "filled":
        return _violation(is_text & (value == ""), "string_too_short", pointer, "String should have at least 1 character", raw, "String should have at least 1 character")
    if rule.test == "literal":
        names = ", ".join(f"'{x}'" for x in rule.among[:-1]) + f" or '{rule.among[-1]}'"
        return _violation(there & ~F.coalesce(is_text & value.isin(*rule.among), F.lit(False)), "literal_error", pointer, f"Input should be {names}", raw, f"one of: {names}")
    if rule.test == "format":
        message = F.concat(F.lit("Value error, conformsTo is '"), raw, F.lit("', expected '"), format_iri, F.lit("'"))
        return _violation(is_text & (value != format_iri), "value_error", pointer, message, raw, message,
            F.concat(F.lit("set conformsTo to the @context IRI ("), format_iri, F.lit(")")))
    message = F.concat(F.lit("Value error, not a researcher id: '"), raw, F.lit("'"))
    return _violation(is_text & ~I.is_rid(value), "value_error", pointer, message, raw, message, message)


def _claims(v: Column) -> list[Column]:
    """What a provenance and a proof may say of whom."""
    rid, said, at = _at(v, "rid"), _at(v, "provenance"), F.lit("/")
    local, verified = F.coalesce(I.is_local(rid), F.lit(False)), said == "orcid_verified"
    own = F.concat(F.lit("https://orcid.org/"), rid)
    rule = lambda bad, text, found: _violation(F.coalesce(bad, F.lit(False)), "value_error", at, F.concat(F.lit("Value error, "), F.lit(text)),
        F.coalesce(found, F.lit("None")), text, text)
    logins = F.filter(F.coalesce(F.from_json(F.to_json(_at(v, "proof", "variant")), "array<struct<kind:string,orcid:string>>"),
        F.array().cast("array<struct<kind:string,orcid:string>>")), lambda p: p["kind"] == "orcid_login")
    other = F.filter(logins, lambda p: ~p["orcid"].eqNullSafe(F.when(~local, rid)))
    first = F.when(verified & local, 1).when(verified & ~F.coalesce(_at(v, "@id") == own, F.lit(False)),
        2).when(verified & (F.coalesce(_at(v, "url"), F.lit("")) == ""), 3).when(verified & (F.coalesce(_at(v, "verifiedAt"), F.lit("")) == ""), 4)
    return [
        rule(first == 1, "provenance 'orcid_verified' requires an ORCID rid", rid),
        rule(first == 2, "provenance 'orcid_verified' requires @id to be the ORCID address", _at(v, "@id")),
        rule(first == 3, "provenance 'orcid_verified' requires a url", F.lit("None")),
        rule(first == 4, "provenance 'orcid_verified' requires verifiedAt", F.lit("None")),
        rule(said.isin(*LOCAL_PROVENANCE) & rid.isNotNull() & ~local, "a synthetic or historical profile requires a local: rid", rid),
        rule(F.size(logins) > 1, "a document carries at most one orcid_login proof", F.size(logins).cast("string")),
        rule((F.size(logins) == 1) & (F.size(other) > 0), "orcid_login proof names another ORCID iD than this profile's rid", F.get(other, 0)["orcid"]),
    ]


def _checked(rows: DataFrame, columns: list[str], violations: list[Column]) -> DataFrame:
    return rows.select(*columns, F.inline(F.array_compact(F.array(*[v.cast(VIOLATION) for v in violations]))))


def validate(files: DataFrame, format_iri: str | None = None) -> DataFrame:
    """What is wrong with published folders, ``files(profile, url, text)``: a row a violation.

    ``profile, artifact, severity, json_pointer, keyword, message, found, expected, fix``. Documents are read by rules that are
    data (PROFILE_RULES and the others), the manifest is held against the files, derivations must end, and
    texts must be text. ``format_iri``: what ``conformsTo`` must say, the document's own ``@context`` by default. ``severity``
    is ``error``, or ``warning`` for an index that is only not built here. Files without text (null) count as there. A
    profile without violations has no row; folders are checked all at once, each document by one pass.
    """
    # bodies are read twice, for the two documents and for the texts; all else asks for names
    names = settled(files.select("profile", "url"))
    read = settled(files.where("url IN ('profile.jsonld', 'sources/papers.jsonld')").select("profile", "url", "text"))
    docs, works = (read.where(F.col("url") == u).select("profile", F.try_parse_json("text").alias("v")) for u in ("profile.jsonld", "sources/papers.jsonld"))
    everyone = names.select("profile").distinct()
    iri = F.coalesce(F.lit(format_iri).cast("string"), _at(F.col("v"), "@context"), F.lit(""))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))

    out = []
    for name, found in (("profile.jsonld", docs), ("sources/papers.jsonld", works)):
        root, art = F.lit("/"), F.lit(name).alias("artifact")
        gone = everyone.join(found, "profile", "left_anti").withColumn("v", F.lit(1))
        out.append(_checked(gone.select("profile", art), ["profile", "artifact"],
            [_violation(F.lit(True), "file", root, f"file not found: {name}", F.lit("<missing>"), "file exists", f"create {name}")]))
        out.append(_checked(found.where("v IS NULL").select("profile", art), ["profile", "artifact"],
            [_violation(F.lit(True), "parse", root, "parse error", F.lit("<unparseable>"), "valid JSON", "fix the JSON syntax")]))
        out.append(_checked(found.where(F.col("v").isNotNull() & ~is_object).select("profile", art), ["profile", "artifact"],
            [_violation(F.lit(True), "model_type", root, "Input should be a valid dictionary", F.lit("<not an object>"), "Input should be a valid dictionary")]))
    docs, works = docs.where(is_object), works.where(is_object)

    v, none = F.col("v"), F.lit("")
    retired = [_violation(_kind(v, old).isNotNull(), "retired_term", F.lit(f"/{old}"), f"'{old}' was renamed to '{new}'", F.lit(old), new,
        f"rename '{old}' to '{new}' at /{old}") for old, new in RETIRED_TERMS.items()]
    here = F.lit("profile.jsonld").alias("artifact")
    schema = _checked(docs.select("*", here), ["profile", "artifact"], [*[_compiled(r, v, none, iri) for r in PROFILE_RULES], *_claims(v)])
    out.append(_checked(docs.select("*", here), ["profile", "artifact"], retired))

    node, at = F.col("node"), F.concat(F.lit("/"), F.col("section"), F.lit("/"), F.col("i").cast("string"))
    broken = F.array_compact(F.array(*[_compiled(r, node, at, none).cast(VIOLATION) for r in ENTRY_RULES]))
    entries = _nodes(docs, ("hasPart", "subjectOf")).select("*", here, broken.alias("broken"))
    schema = schema.unionByName(entries.select("profile", "artifact", F.inline("broken")))
    schema = settled(schema.unionByName(_checked(_nodes(docs, ("proof",)).select("*", here), ["profile", "artifact"], [_compiled(r, node, at, none) for r in PROOF_RULES])))
    out.append(schema)
    entry = F.to_json("node")
    out.append(_checked(entries, ["profile", "artifact"],
        [_violation(F.size("broken") > 0, "manifest_entry", F.concat(F.lit("/"), F.col("section")),
            F.concat(F.lit("manifest entry is not valid: "), F.get("broken", 0)["message"]), entry, "a valid manifest entry", "regenerate the manifest")]))
    out.append(_checked(_nodes(works, ("hasPart",)).withColumn("artifact", F.lit("sources/papers.jsonld")), ["profile", "artifact"],
        [_compiled(r, node, at, none) for r in WORK_RULES]))

    text = files.where(F.col("url").rlike(TEXT_FILES) & F.col("text").isNotNull()).withColumn("problem", F.explode(artifact_problems("text")))
    again = F.when(F.col("url").rlike(SUMMARY), "delete the summary and regenerate it").otherwise("delete the file and re-download the paper")
    out.append(_checked(text.withColumn("artifact", F.col("url")), ["profile", "artifact"],
        [_violation(F.lit(True), "text_content", F.lit("/"), F.col("problem"), F.col("url"), "clean UTF-8 text", again)]))
    out.append(_against_files(names, docs, entries, works, schema.select("profile").distinct()))
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made


def _nodes(docs: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """``profile, section, i, node``: objects of the lists of a document, with their places; what is no object is passed over."""
    lists = F.array(*[F.struct(F.lit(s).alias("section"), _at(F.col("v"), s, "array<variant>").alias("nodes")) for s in sections])
    own = docs.select("profile", F.inline(lists)).where("nodes IS NOT NULL")
    return own.select("profile", "section", F.posexplode("nodes").alias("i", "node")).where(F.coalesce(F.schema_of_variant("node").startswith("OBJECT"), F.lit(False)))


def _against_files(files: DataFrame, docs: DataFrame, entries: DataFrame, works: DataFrame, broken: DataFrame) -> DataFrame:
    """Manifest, derivations and summaries against what is there.

    A profile without a readable document is not asked, an entry that is not valid lists nothing, and derivations are followed
    only in documents that are valid (all but ``broken(profile)``).
    """
    n = F.col("node")
    own = entries.select("profile", "section", (F.size("broken") == 0).alias("good"), _at(n, "contentUrl").alias("url"), _at(n, "role").alias("role"),
        _at(n, "paperId").alias("paper_id"), F.coalesce(_at(n, "derivedFrom", "array<string>"), F.array().cast("array<string>")).alias("derived_from")).where("url <> ''")
    have = files.select("profile", "url").distinct().withColumn("have", F.lit(True))
    none = files.select("profile", "url").where("false").select("profile", F.lit(0).alias("ordinal"), "url", F.lit("").alias("sha256"), F.lit("").alias("inputs_digest"))
    known = manifest(files.select("profile", "url", F.lit(0).alias("size_bytes"), F.lit(None).cast("string").alias("sha256")), none).select("profile", "url")
    good = own.where("good").select("profile", "url").distinct()
    listed = good.join(have, ["profile", "url"], "left")
    readable = docs.select("profile").distinct()
    stale, built = listed.where("have IS NULL"), F.col("url").isin(*DERIVED)
    old = F.startswith("url", F.lit(LEGACY_CACHE))

    def told(rows: DataFrame, keyword: str, what: str, expected: str, fix: str, severity: str = "error", pointer: str = "/hasPart") -> DataFrame:
        """One violation a profile, with the number of its urls and the first of them."""
        counted = rows.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first")).withColumn("artifact", F.lit("profile.jsonld"))
        message = F.concat(F.col("n").cast("string"), F.lit(f" {what}, the first: "), "first")
        return _checked(counted, ["profile", "artifact"], [_violation(F.lit(True), keyword, F.lit(pointer), message, message, expected, fix, severity)])

    unlisted = known.join(good, ["profile", "url"], "left_anti").join(readable, "profile", "left_semi")
    out = told(unlisted, "manifest_unlisted", "file(s) on disk not in manifest", "manifest lists all artifacts on disk", "regenerate the manifest")
    out = out.unionByName(told(listed.where(old & F.col("have")), "legacy_cache_dirname", "manifest entry(ies) under the retired cache directory",
        CACHE, "move the files and regenerate the manifest"))
    out = out.unionByName(told(stale.where(built), "index_not_built", "derived index(es) not built here", "a built index", "rebuild the index", "warning"))
    out = out.unionByName(told(stale.where(~built), "manifest_stale", "manifest entry(ies) with no file", "every manifest entry has a file on disk",
        "restore the files; in a copy that is partial on purpose, do not regenerate the manifest"))
    pointer = F.concat(F.lit("/"), F.col("section"), F.lit("/contentUrl"))
    each = own.join(have, ["profile", "url"], "left").withColumn("artifact", F.lit("profile.jsonld"))
    remote = F.col("url").rlike(REMOTE)
    out = out.unionByName(_checked(each, ["profile", "artifact"], [
        _violation(remote, "relative_url", pointer, F.concat(F.lit("contentUrl is absolute: "), "url"), F.col("url"), "relative path",
            "change to a relative path within the profile directory"),
        _violation(~remote & F.col("have").isNull() & ~built, "content_url_missing", pointer, F.concat(F.lit("contentUrl resolves to a missing file: "), "url"), F.col("url"), "file exists on disk", F.concat(F.lit("create "), "url", F.lit(" or remove the manifest entry")))]))

    sound = own.join(broken, "profile", "left_anti")
    _, cyclic, _ = doubled(settled(derivations(sound)), sound.select("profile", "url", F.lit(0).alias("n")).distinct())
    round_ = cyclic.groupBy("profile").agg(F.min("url").alias("url")).withColumn("why", F.concat(F.lit("derivation goes round at "), "url"))
    # a cycle stops the walk, and is all that is said of its profile
    lost = unresolved(sound).join(round_, "profile", "left_anti").select("profile",
        F.concat("url", F.lit(" is derivedFrom '"), "ref", F.lit("', which names no artifact in this manifest")).alias("why"))
    ends = lost.unionByName(round_.select("profile", "why")).withColumn("artifact", F.lit("profile.jsonld"))
    out = out.unionByName(_checked(ends, ["profile", "artifact"],
        [_violation(F.lit(True), "derivation", F.lit("/hasPart/derivedFrom"), F.col("why"), F.lit("an unresolvable derivedFrom graph"),
            "every derivedFrom names a manifest paperId or role, acyclically", "point derivedFrom at an artifact in this manifest, or remove it")]))

    papers = _nodes(works, ("hasPart",)).select("profile", _at(n, "paper_id").alias("paper")).where("paper <> ''")
    summaries = files.where(F.col("url").rlike(SUMMARY)).select("profile", F.regexp_extract("url", SUMMARY, 1).alias("paper"),
        "url").join(works.select("profile").distinct(), "profile", "left_semi")
    orphans = summaries.join(papers, ["profile", "paper"], "left_anti")
    return out.unionByName(told(orphans, "cross_artifact", "summary file(s) with no matching paper_id", "every summary matches a paper",
        "remove orphan summaries or add papers", pointer="/sources/summaries"))


def verdicts(files: DataFrame, violations: DataFrame) -> DataFrame:
    """``profile, ok, errors, warnings`` of every folder."""
    n = violations.groupBy("profile").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return files.select("profile").distinct().join(n, "profile", "left").select("profile", (zero("errors") == 0).alias("ok"),
        zero("errors").alias("errors"), zero("warnings").alias("warnings"))


def read_folders(spark, root: str) -> DataFrame:
    """``profile, url, text`` of every file under ``root``, a folder a profile; text of what is no text is null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    rest = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    is_text = rest.rlike(r"\.(?:md|json|jsonld|html|txt)$")
    return raw.select(F.substring_index(rest, "/", 1).alias("profile"), F.regexp_replace(rest, "^[^/]*/", "").alias("url"),
        F.when(is_text, F.decode("content", "UTF-8")).alias("text"))
