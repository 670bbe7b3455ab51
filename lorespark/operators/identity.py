"""Who is this person: binding names to profiles through a folded key, with deferral and minting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I

# Folded tokens that are placeholders, not names.
PLACEHOLDERS = ("al", "anon", "anonymous", "author", "authors", "corresponding", "dr", "et", "etal", "na", "none", "null", "staff", "tbd", "test",
    "the", "unknown", "unnamed", "various")


def strength(a, b) -> Column:
    """strong: full given names agree, or neither has one; weak: one side has none, or an initial that fits; null: they differ."""
    full = (F.length(a) > 1) & (F.length(b) > 1)
    return F.when((a == "") & (b == ""), "strong").when((a == "") | (b == ""), "weak").when(full & (a == b),
        "strong").when(~full & (F.substring(a, 1, 1) == F.substring(b, 1, 1)), "weak")


def successors(aliases: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rid, live``: every rid that leads to a person: live ones to themselves, retired ones (``aliases(old_rid, rid)``, one hop) to their successor."""
    live = profiles.where("rid IS NOT NULL").select("rid").distinct()
    old = aliases.select(F.col("old_rid").alias("rid"), F.col("rid").alias("live")).join(live, "rid", "left_anti")
    return live.select("rid", F.col("rid").alias("live")).unionByName(old)


def _blank(c: str) -> Column:
    return I.blank_to_null(c)


def resolve(asked: DataFrame, profiles: DataFrame, aliases: DataFrame | None = None, salt: str = "") -> DataFrame:
    """``asked(q, rid, name, affiliation[, create_new])`` against ``profiles(rid, name, affiliation, tier)``.

    ``q, outcome, resolved, confidence, candidates, created, reason``. Outcomes:

    - exact: a rid that is known, or that ``aliases(old_rid, rid)`` retired: its successor
    - bind: the name is that of one person (see ``_bound``)
    - defer: it may be that of several; ``resolved`` is null, ``candidates`` says how many
    - mint: a new person, under the ORCID that was given, or the rid that the name always gives; where someone else has
      that one, or ``create_new`` asks for a new person, under a rid of its own (of name, ``q`` and ``salt``)
    - refuse, with a ``reason``: nothing, both, malformed, local, nameless, placeholder, unfolded

    ``created``: this is the first request of the batch for a rid that nobody has. Profiles that are private are nobody's
    candidates. Names meet in one equi-join of folded keys, both sides grouped by given name and affiliation
    first, so that a common key costs its distinct forms, not its rows.
    """
    mine = asked if "create_new" in asked.columns else asked.withColumn("create_new", F.lit(False))
    mine = mine.select("q", _blank("rid").alias("rid"), _blank("name").alias("name"), F.coalesce(I.folded("affiliation"), F.lit("")).alias("a"),
        F.coalesce("create_new", F.lit(False)).alias("fresh"))
    mine = mine.withColumn("who", I.name_identity("name")).select("q", "rid", "name", "a", "fresh", "who.*")
    mine = mine.withColumn("mint_rid", I.minted_rid("mint_key")).withColumn("junk", F.coalesce(F.forall("tokens", lambda t: t.isin(*PLACEHOLDERS)), F.lit(False)))
    known = profiles.where("rid IS NOT NULL").select("rid", F.coalesce("tier", F.lit("public")).alias("tier"),
        F.coalesce(I.folded("affiliation"), F.lit("")).alias("ca"), I.name_identity("name").alias("who"))
    known = known.select("rid", "tier", "ca", F.col("who.key").alias("key"), F.col("who.given").alias("cg"), F.col("who.mint_key").alias("c_mint"))
    every = successors(aliases, profiles) if aliases is not None else profiles.where("rid IS NOT NULL").select("rid", F.col("rid").alias("live")).distinct()

    found = _bound(mine.where("rid IS NULL AND NOT fresh AND NOT junk AND key IS NOT NULL"), known.where("tier <> 'private'"))
    # who has the rid that a name gives: one row a rid, the first by name where records are many
    holder = every.join(known.select(F.col("rid").alias("live"), F.struct(F.col("tier") != "private", "c_mint", "ca").alias("h")), "live").groupBy("rid").agg(F.max("h").alias("h"))
    holder = holder.select(F.col("rid").alias("mint_rid"), F.col("h.col1").alias("seen"), F.col("h.c_mint").alias("h_mint"), F.col("h.ca").alias("h_a"))
    own = mine.join(found, "q", "left").join(every.withColumnRenamed("live", "exact"), "rid", "left").join(holder, "mint_rid", "left")

    rid, name = F.col("rid").isNotNull(), F.col("name").isNotNull()
    reason = (
        F.when(~rid & ~name, "nothing").when(rid & F.col("fresh"), "both").when(rid & ~I.is_rid("rid") & F.col("exact").isNull(), "malformed")
        .when(F.col("exact").isNotNull(), None).when(rid & I.is_local("rid"), "local").when(rid & ~name, "nameless").when(F.col("junk"), "placeholder")
        .when(~rid & F.col("mint_key").isNull(), "unfolded")
    )
    n = F.coalesce("candidates", F.lit(0).cast("long"))
    named = ~rid & ~F.col("fresh")
    outcome = F.when(reason.isNotNull(), "refuse").when(F.col("exact").isNotNull(), "exact").when(named & F.col("bound").isNotNull(),
        "bind").when(named & (n > 0), "defer").otherwise("mint")
    person = F.col("seen") & (F.col("h_mint") == F.col("mint_key")) & ((F.col("a") == "") | (F.col("h_a") == "") | (F.col("a") == F.col("h_a")))
    taken = F.col("seen").isNotNull()
    anew = I.minted_rid("mint_key")
    anew = F.concat(F.regexp_replace(anew, "[0-9a-f]{6}$", ""),
        F.substring(F.sha2(F.concat_ws("\x1f", "mint_key", F.col("q").cast("string"), F.lit(salt)).cast("binary"), 256), 1, 6))
    minted = F.when(rid, F.col("rid")).when(F.col("fresh"), anew).when(taken & ~F.coalesce(person, F.lit(False)), anew).otherwise(F.col("mint_rid"))
    out = own.withColumn("outcome", outcome).withColumn("reason", reason)
    resolved = F.when(F.col("outcome") == "exact", F.col("exact")).when(F.col("outcome") == "bind", F.col("bound")).when(F.col("outcome") == "mint", minted)
    confidence = F.when((F.col("outcome") == "exact") | ((F.col("outcome") == "mint") & rid), "exact").when(F.col("outcome").isin("bind", "mint"),
        "high").when(F.col("outcome") == "defer", "low")
    had = taken & F.coalesce(person, F.lit(False)) & ~rid & ~F.col("fresh")
    out = out.select("q", "outcome", resolved.alias("resolved"), confidence.alias("confidence"), n.alias("candidates"),
        ((F.col("outcome") == "mint") & ~had).alias("new"), "reason")
    first = out.where("new").groupBy("resolved").agg(F.min("q").alias("first"))
    return out.join(first, "resolved", "left").select("q", "outcome", "resolved", "confidence", "candidates",
        F.coalesce(F.col("new") & (F.col("q") == F.col("first")), F.lit(False)).alias("created"), "reason")


def _bound(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``q, candidates, bound`` of names that somebody could have; ``bound`` is null where that does not decide.

    One person with the full given name, unless affiliations conflict. With initials only: the person whose rid this very name gives,
    unless an ORCID could be meant or affiliations conflict; or the only one, where affiliations agree. Of several with the full name the
    one that agrees, where all others conflict.
    """
    people = known.groupBy("key", "cg", "ca").agg(F.count(F.lit(1)).alias("n"), F.count_if(~I.is_local("rid")).alias("better"), F.min("rid").alias("one"))
    forms = asked.select("key", "given", "a").distinct()
    pairs = forms.join(people, "key").withColumn("s", strength(F.col("given"), F.col("cg"))).where("s IS NOT NULL")
    both = (F.col("a") != "") & (F.col("ca") != "")
    agree, conflict, strong, n = both & (F.col("a") == F.col("ca")), both & (F.col("a") != F.col("ca")), F.col("s") == "strong", F.col("n")
    count = lambda c, what=n: F.sum(F.when(c, what).otherwise(F.lit(0)))
    told = pairs.groupBy("key", "given", "a").agg(
        F.sum("n").alias("candidates"), count(strong).alias("n_strong"), count(strong & conflict).alias("n_conflict"),
            count(strong & agree).alias("n_agree"), count(~strong & agree).alias("w_agree"),
        F.sum("better").alias("better"), F.min(F.when(strong, F.col("one"))).alias("one_strong"), F.min(F.when(strong & agree, F.col("one"))).alias("one_agree"), F.min("one").alias("any"))
    # the holder of the rid that the name gives, if its own name gives it too
    self = known.select(F.col("rid").alias("mint_rid"), F.col("c_mint").alias("mint_key"), F.col("key").alias("self_key"), "ca").groupBy("mint_rid",
        "mint_key", "self_key").agg(F.count(F.lit(1)).alias("own"), F.min("ca").alias("own_a"))
    out = asked.join(told, ["key", "given", "a"]).join(self, ["mint_rid", "mint_key"], "left")
    own_fits = (F.col("own") == 1) & (F.col("self_key") == F.col("key")) & (F.col("better") == 0) & ((F.col("a") == "") | (F.col("own_a") == "") | (F.col("a") == F.col("own_a")))
    bound = (
        F.when((F.col("n_strong") == 1) & (F.col("n_conflict") == 0), F.col("one_strong"))
        .when((F.col("n_strong") == 0) & own_fits, F.col("mint_rid"))
        .when((F.col("n_strong") == 0) & (F.col("candidates") == 1) & (F.col("w_agree") == 1), F.col("any"))
        .when((F.col("n_strong") > 1) & (F.col("n_agree") == 1) & (F.col("n_conflict") == F.col("n_strong") - 1), F.col("one_agree"))
    )
    return out.select("q", "candidates", bound.alias("bound"))


def stubs(resolved: DataFrame, asked: DataFrame) -> DataFrame:
    """Profiles to create for what ``resolve`` minted: ``rid, name, affiliation, provenance, level, visibility``, one a rid."""
    new = resolved.where("created").select("q", F.col("resolved").alias("rid"))
    return new.join(asked.select("q", F.trim("name").alias("name"), _blank("affiliation").alias("affiliation")), "q").select("rid", "name",
        "affiliation", F.lit("third_party").alias("provenance"), F.lit("lite").alias("level"), F.lit("limited").alias("visibility"))
