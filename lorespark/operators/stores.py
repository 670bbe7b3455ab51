"""Writes to a store of profile tables as whole-table rewrites: outcomes, refusals, cascades, merges and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..session import settled
from .lexical import ranked
from .pointers import ends

# Fields of a work that its owner may edit, fields of a profile that no owner may, and the longest list of interest seeds.
EDITABLE_WORK_FIELDS = ("doi", "openalex_id", "name", "datePublished", "type", "citation", "full_text_link", "access", "summary", "first_author",
    "author_position", "is_corresponding")
LOCKED_METADATA_FIELDS = (
    "rid", "id_", "provenance", "provenance_note", "proof", "verified_at", "identifier",
    "paper_stats", "anchor", "level", "has_citation_graph", "has_embedding_index", "expertise_cites_paper_ids", "synthesis_inputs_digest",
    "has_part", "subject_of", "context", "type_", "conforms_to", "url", "date_modified", "visibility", "section_visibility",
)
SEEDS = 200


def put_outcomes(profiles: DataFrame, slug_aliases: DataFrame, retired: DataFrame, staged: DataFrame, one_record: bool = False) -> DataFrame:
    """What a put of each ``staged(slug, rid)`` does: ``slug, rid, outcome, profile_id, live_slug``.

    ``profiles(profile_id, slug, rid)``, ``slug_aliases(old_slug, profile_id)``, ``retired(rid)``. A live
    slug, or a former one whose record is about the same rid, is ``replaced`` and keeps its id and its
    live slug. ``former_slug``: a former slug of another rid's record; ``rid_mismatch``: a live slug of
    another rid; ``retired_rid``: a create for a rid that a merge retired; ``second_record``: a create
    where the store holds one record a person and has one; all others are ``created`` and have no id yet.
    A live slug goes before an alias of the same text. Null slugs are created.
    """
    live = profiles.select(F.col("slug").alias("live_slug"), "profile_id", F.col("rid").alias("live_rid"))
    own = live.withColumn("slug", F.col("live_slug"))
    former = slug_aliases.join(profiles.select("slug"), F.col("old_slug") == F.col("slug"), "left_anti").join(live, "profile_id").withColumn("slug", F.col("old_slug"))
    known = own.unionByName(former.select(*own.columns))
    out = staged.select("slug", "rid").join(known, "slug", "left").join(retired.select("rid").distinct().withColumn("gone", F.lit(True)), "rid", "left")
    out = out.join(profiles.select("rid").distinct().withColumn("held", F.lit(True)), "rid", "left")
    create = F.when(F.col("gone"), "retired_rid").when(F.lit(one_record) & F.col("held"), "second_record").otherwise("created")
    other = F.when(F.col("live_slug") != F.col("slug"), "former_slug").otherwise("rid_mismatch")
    outcome = F.when(F.col("profile_id").isNull(), create).when(F.col("live_rid").eqNullSafe(F.col("rid")), "replaced").otherwise(other)
    return out.select("slug", "rid", outcome.alias("outcome"), "profile_id", "live_slug")


def new_ids(outcomes: DataFrame, profiles: DataFrame) -> DataFrame:
    """``created`` rows with ids after the highest in use, by slug; ranges number themselves, so no task has all."""
    top = profiles.agg(F.coalesce(F.max("profile_id"), F.lit(0)).alias("top"))
    rows = ranked(outcomes.where("outcome = 'created'").select("slug", "rid"), "slug", "rid", out="n")
    # one row
    return rows.join(F.broadcast(top)).select("slug", "rid", (F.col("top") + F.col("n")).alias("profile_id"))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``gone(profile_id)``: the profiles, their children and their aliases."""
    ids = gone.select("profile_id").distinct()
    return {name: df.join(ids, "profile_id", "left_anti") for name, df in tables.items()}


def merge_refusals(profiles: DataFrame, merges: DataFrame) -> DataFrame:
    """``merges(retired_id, survivor_id)`` with a ``refusal``, null where it may go on.

    ``no_retired``, ``no_survivor``, ``same``; ``twice``: one record into several survivors; ``cycle``: following the batch's merges from here
    comes back to a record that it retires.
    """
    have = profiles.select("profile_id").distinct()
    a = have.select(F.col("profile_id").alias("retired_id"), F.lit(True).alias("r"))
    b = have.select(F.col("profile_id").alias("survivor_id"), F.lit(True).alias("s"))
    out = merges.join(a, "retired_id", "left").join(b, "survivor_id", "left")
    twice = merges.groupBy("retired_id").agg((F.count_distinct("survivor_id") > 1).alias("twice"))
    round_ = merge_ends(merges).where("cyclic").select("retired_id", "cyclic")
    out = out.join(twice, "retired_id", "left").join(round_, "retired_id", "left")
    why = F.when(F.col("r").isNull(), "no_retired").when(F.col("s").isNull(), "no_survivor").when(F.col("retired_id") == F.col("survivor_id"),
        "same").when(F.col("twice"), "twice").when(F.col("cyclic"), "cycle")
    return out.select("retired_id", "survivor_id", why.alias("refusal"))


def merge_ends(merges: DataFrame) -> DataFrame:
    """``retired_id, survivor_id, cyclic``: the record that a chain of merges in one batch ends in, null where it goes round.

    A record that is merged into several goes with the smallest.
    """
    links = merges.groupBy(F.col("retired_id").alias("node")).agg(F.min("survivor_id").alias("next"))
    return ends(links).select(F.col("node").alias("retired_id"), F.col("end").alias("survivor_id"), "cyclic")


def merge_profiles(profiles: DataFrame, slug_aliases: DataFrame, rid_aliases: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, slug aliases and rid aliases after ``merges(retired_id, survivor_id)``; merges into a record that the batch retires too end where that one does.

    The survivor keeps its id and slug. Every handle of a retired record, its live slug included, leads to
    the survivor in one hop; a live slug is no alias. Other records about a retired rid follow to the
    survivor's; rid aliases (``old_rid, rid``) end in one hop.
    """
    merges = merge_ends(merges).where("NOT cyclic").select("retired_id", "survivor_id")
    own = profiles.select(F.col("profile_id").alias("retired_id"), F.col("rid").alias("old_rid"), F.col("slug").alias("old_slug"))
    to = profiles.select(F.col("profile_id").alias("survivor_id"), F.col("rid").alias("new_rid"))
    moved = merges.join(own, "retired_id").join(to, "survivor_id")
    rids = moved.where("old_rid <> new_rid").select("old_rid", "new_rid").distinct()
    kept = profiles.join(moved.select(F.col("retired_id").alias("profile_id")), "profile_id", "left_anti")
    kept = kept.join(rids, kept["rid"] == rids["old_rid"], "left").withColumn("rid", F.coalesce("new_rid", "rid")).drop("old_rid", "new_rid")
    ids = moved.select(F.col("retired_id").alias("profile_id"), "survivor_id")
    slugs = slug_aliases.join(ids, "profile_id", "left").select("old_slug", F.coalesce("survivor_id", "profile_id").alias("profile_id"))
    slugs = slugs.unionByName(moved.select("old_slug", F.col("survivor_id").alias("profile_id")))
    slugs = slugs.join(kept.select(F.col("slug").alias("old_slug")), "old_slug", "left_anti").distinct()
    hops = rids.withColumnsRenamed({"old_rid": "was", "new_rid": "now"})
    older = rid_aliases.join(hops, rid_aliases["rid"] == hops["was"], "left").select("old_rid", F.coalesce("now", "rid").alias("rid"))
    older = older.join(rids.select("old_rid"), "old_rid", "left_anti").where("old_rid <> rid")
    return kept, slugs, older.unionByName(rids.withColumnRenamed("new_rid", "rid"))


def escapes(url: Column) -> Column:
    """Whether a content url leaves its profile: absolute, with a drive or scheme, or with a parent step."""
    return url.rlike(r"^(?:/|\\|[A-Za-z][A-Za-z0-9+.-]*:)") | url.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)")


def artifact_lookup(asked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``asked(profile, url)`` against ``artifacts(profile, url, ...)``: ``status`` is refused, found or missing."""
    have = artifacts.select("profile", "url").distinct().withColumn("have", F.lit(True))
    bad = F.coalesce(escapes(F.col("url")), F.lit(True))
    return asked.join(have, ["profile", "url"], "left").select("profile", "url", F.when(bad, "refused").when(F.col("have"), "found").otherwise("missing").alias("status"))


def editable_metadata(profiles: DataFrame) -> tuple[str, ...]:
    """Columns of a profile that its owner may edit: all but the locked ones and its id."""
    return tuple(c for c in profiles.columns if c not in LOCKED_METADATA_FIELDS and c != "profile_id")


def patch_refusals(patches: DataFrame, rows: DataFrame, allowed: tuple[str, ...] = EDITABLE_WORK_FIELDS, key: str = "paper", version: Column | None = None) -> DataFrame:
    """``patches(key, field, value[, version])`` that must not be applied, with a reason each: ``key, field, refusal``.

    ``field``: not editable, or not of these rows; ``paper`` (or what ``key`` is called): unknown; ``version``: the patch names a version
    of the row that is not the row's now, by the expression ``version`` over ``rows``.
    """
    now = rows.select(key, F.lit(True).alias("known"), (F.lit(None).cast("string") if version is None else version).alias("now")).dropDuplicates([key])
    own = patches if "version" in patches.columns else patches.withColumn("version", F.lit(None).cast("string"))
    fields = [f for f in allowed if f in rows.columns]
    why = F.when(~F.col("field").isin(*fields), "field").when(F.col("known").isNull(),
        key).when(F.col("version").isNotNull() & F.col("now").isNotNull() & (F.col("version") != F.col("now")), "version")
    return own.join(now, key, "left").withColumn("refusal", why).where("refusal is not null").select(key, "field", "refusal")


def apply_patches(rows: DataFrame, patches: DataFrame, allowed: tuple[str, ...] = EDITABLE_WORK_FIELDS, key: str = "paper", version: Column | None = None) -> DataFrame:
    """``rows`` with each patched field set, to null too; one value a key and field; refused fields leave the row alone.

    A row with any refused field is left as it was: an edit is whole or not at all. For metadata ``allowed`` is ``editable_metadata``.
    """
    bad = patch_refusals(patches, rows, allowed, key, version).select(key).distinct()
    entry = F.map_from_entries(F.collect_list(F.struct("field", "value")))
    by = patches.join(bad, key, "left_anti").groupBy(key).agg(entry.alias("patch"))
    out, kinds = rows.join(by, key, "left"), dict(rows.dtypes)
    for f in (f for f in allowed if f in kinds):
        out = out.withColumn(f, F.when(F.coalesce(F.map_contains_key("patch", F.lit(f)), F.lit(False)), F.col("patch")[f].cast(kinds[f])).otherwise(F.col(f)))
    return out.select(*rows.columns)


def collection_cards(profiles: DataFrame, papers: DataFrame) -> DataFrame:
    """A card a profile: ``slug, name, base, paper_count, summary_count``."""
    counts = papers.groupBy("profile").agg(F.count(F.lit(1)).alias("paper_count"), F.count_if("has_summary").alias("summary_count"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return profiles.join(counts, profiles["slug"] == counts["profile"], "left").select("slug", "name",
        F.concat(F.lit("profiles/"), "slug", F.lit("/")).alias("base"), n("paper_count"), n("summary_count"))


def topics_index(topics: DataFrame) -> DataFrame:
    """``topic, base``: every profile of every label, folded and trimmed; blank labels go. A row a pair, so no label's list is held whole."""
    rows = topics.select(F.lower(F.trim("topic")).alias("topic"), F.concat(F.lit("profiles/"), F.col("profile").cast("string"), F.lit("/")).alias("base"))
    return rows.where("topic <> ''").distinct()


def seed_keys(openalex_id: str, doi: str) -> Column:
    """Comparable keys of a work: the last part of its OpenAlex id, and its DOI in lower case."""
    bare = F.upper(F.regexp_extract(F.trim(openalex_id), r"([^/]*)/*$", 1))
    oa = F.when(bare != "", F.concat(F.lit("oa:"), bare))
    return F.array_compact(F.array(oa, F.concat(F.lit("doi:"), F.lower(I.normalize_doi(doi)))))


def add_seeds(seeds: DataFrame, papers: DataFrame, records: DataFrame, cap: int = SEEDS) -> DataFrame:
    """``records(profile, ordinal, openalex_id, doi)`` with what becomes of each, in order: ``profile, ordinal, outcome``.

    ``already_authored``: shares a key with one of ``papers(profile, openalex_id, doi)``; ``already_seed``:
    with one of ``seeds`` (of the same columns) or with a record added before; ``over_cap``: the list is full; else ``added``.
    An ordinal is a record's own in its profile. A round adds every record that comes first by all its keys, and
    sets aside those that share one with it; chains of shared keys take a round a link.
    """
    keyed = lambda df: df.select("profile", F.explode(seed_keys("openalex_id", "doi")).alias("key")).distinct()
    own = settled(records.select("profile", "ordinal", seed_keys("openalex_id", "doi").alias("keys")))
    each = own.select("profile", "ordinal", F.explode("keys").alias("key"))
    authored = each.join(keyed(papers), ["profile", "key"], "left_semi").select("profile", "ordinal").distinct()
    held = each.join(keyed(seeds), ["profile", "key"], "left_semi").select("profile", "ordinal").distinct()
    known = settled(authored.withColumn("outcome",
        F.lit("already_authored")).unionByName(held.join(authored, ["profile", "ordinal"], "left_anti").withColumn("outcome", F.lit("already_seed"))))
    free = settled(own.join(known, ["profile", "ordinal"], "left_anti"))
    added, left = free.where(F.size("keys") == 0).select("profile", "ordinal"), free.select("profile", "ordinal", F.explode("keys").alias("key"))
    while not left.isEmpty():
        first = left.withColumn("first", F.min("ordinal").over(Window.partitionBy("profile", "key"))).groupBy("profile",
            "ordinal").agg(F.bool_and(F.col("first") == F.col("ordinal")).alias("f")).where("f")
        added = settled(added.unionByName(first.select("profile", "ordinal")))
        taken = left.join(added, ["profile", "ordinal"], "left_semi").select("profile", "key").distinct()
        gone = left.join(taken, ["profile", "key"], "left_semi").select("profile", "ordinal").distinct()
        left = settled(left.join(gone, ["profile", "ordinal"], "left_anti"))
    have = seeds.groupBy("profile").agg(F.count(F.lit(1)).alias("have"))
    place = F.row_number().over(Window.partitionBy("profile").orderBy("ordinal"))
    fits = added.withColumn("place", place).join(have, "profile", "left").where(F.col("place") + F.coalesce("have", F.lit(0)) <= cap).select("profile", "ordinal")
    by_key = each.join(fits, ["profile", "ordinal"], "left_semi").groupBy("profile", "key").agg(F.min("ordinal").alias("by"))
    again = each.join(by_key, ["profile", "key"]).where("by < ordinal").select("profile", "ordinal").distinct().withColumn("again", F.lit(True))
    late = free.join(fits.withColumn("fits", F.lit(True)), ["profile", "ordinal"], "left").join(again, ["profile", "ordinal"], "left")
    return known.unionByName(late.select("profile", "ordinal", F.when(F.col("fits"), "added").when(F.col("again"), "already_seed").otherwise("over_cap").alias("outcome")))
