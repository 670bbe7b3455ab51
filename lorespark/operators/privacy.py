"""Tier rules over manifests: transitive tiers, unresolved sources, visible chunks, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tiers as T
from ..session import settled

# Prefixes of files that are always private, and the access-right terms of the tiers.
PRIVATE_PREFIXES = (".cache/", ".keys/")
ACCESS_RIGHTS = {tier: f"http://publications.europa.eu/resource/authority/access-right/{term}" for tier,
    term in (("public", "PUBLIC"), ("limited", "RESTRICTED"), ("private", "NON_PUBLIC"))}


def derivations(artifacts: DataFrame) -> DataFrame:
    """Edges of ``artifacts(profile, url, role, paper_id, tier, derived_from)``: artifact to each source by paper id or role."""
    refs = artifacts.select("profile", "url", F.explode("derived_from").alias("ref"))
    by_paper = artifacts.select("profile", F.col("paper_id").alias("ref"), F.col("url").alias("source"))
    by_role = artifacts.select("profile", F.col("role").alias("ref"), F.col("url").alias("source"))
    return refs.join(by_paper.union(by_role).where("ref is not null").distinct(), ["profile", "ref"]).select("profile", "url", "source").distinct()


def unresolved(artifacts: DataFrame) -> DataFrame:
    """(profile, url, ref) of references that name neither a paper id nor a role."""
    refs = artifacts.select("profile", "url", F.explode("derived_from").alias("ref"))
    known = artifacts.select("profile", F.explode(F.array_compact(F.array("paper_id", "role"))).alias("ref")).distinct()
    return refs.join(known, ["profile", "ref"], "left_anti").select("profile", "url", "ref")


def doubled(edges: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The largest ``n`` of all that each node reaches, ``profile, url, n``; nodes that reach a cycle; rounds taken.

    ``edges(profile, url, source)``, ``values(profile, url, n)``. By path doubling: after k rounds a node has the
    largest value of up to 2^k - 1 steps, and its edges lead 2^k steps away, so that a chain of any
    length takes the logarithm of it. Edges that are left once their length passes the nodes of the largest
    profile can only be walks that go round: who has one reaches a cycle. One table is written a round; it has at
    most one row for each node and each node that far away from it.
    """
    node, walk = F.lit(None).cast(edges.schema["source"].dataType), F.lit(None).cast("int")
    now = settled(values.select("profile", "url", node.alias("source"), "n").unionByName(edges.select("profile", "url", "source", walk.alias("n")).distinct()))
    most = edges.groupBy("profile").agg(F.count_distinct("url").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds, length = 0, 1
    while True:
        held, paths = now.where("source IS NULL").select("profile", "url", "n"), now.where("source IS NOT NULL").select("profile", "url", "source")
        if length > most or paths.isEmpty():
            return held, paths.select("profile", "url").distinct(), rounds
        far = held.select("profile", F.col("url").alias("source"), F.col("n").alias("up"))
        up = paths.join(far, ["profile", "source"]).groupBy("profile", "url").agg(F.max("up").alias("up"))
        raised = held.join(up, ["profile", "url"], "left").select("profile", "url", node.alias("source"), F.greatest("n", "up").alias("n"))
        on = paths.select("profile", F.col("url").alias("source"), F.col("source").alias("next"))
        longer = paths.join(on, ["profile", "source"]).select("profile", "url", F.col("next").alias("source"), walk.alias("n")).distinct()
        now, rounds, length = settled(raised.unionByName(longer)), rounds + 1, 2 * length


def effective_tiers(artifacts: DataFrame, profile_tiers: DataFrame) -> DataFrame:
    """Tier of each artifact: the most restrictive of profile, own and all sources' tiers, and whether a cycle is behind it.

    An artifact without a declared tier has its role's default. Sources are followed by path doubling, so
    no chain is too long. A cycle fails closed: what derives from itself is private.
    """
    own = F.coalesce(T.ordinal("tier"), T.ordinal(T.role_tier("role")))
    values = artifacts.join(profile_tiers, "profile", "left").select("profile", "url", F.greatest(F.coalesce(T.ordinal("profile_tier"), F.lit(0)), own).alias("n"))
    held, cyclic, _ = doubled(settled(derivations(artifacts)), values)
    out = held.join(cyclic.withColumn("cyclic", F.lit(True)), ["profile", "url"], "left")
    return out.select("profile", "url", F.when(F.col("cyclic"), F.lit("private")).otherwise(T.tier_name("n")).alias("tier"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def cyclic_profiles(effective: DataFrame) -> DataFrame:
    """Profiles with a derivation cycle, which fail closed as a whole."""
    return effective.where("cyclic").select("profile", F.lit(True).alias("broken")).distinct()


def chunk_tiers(chunks: DataFrame, effective: DataFrame, profile_tiers: DataFrame, soul_tiers: DataFrame | None = None) -> DataFrame:
    """``chunks(profile, chunk_id, source_type, url)`` with ``tier``: profile, role default, artifact and, of ``soul``, its section.

    ``soul_tiers(profile, soul_tier)``: declared tiers of that section. Private: unknown types, files under
    PRIVATE_PREFIXES, and all chunks of a profile with a derivation cycle.
    """
    role = T.chunk_role("source_type")
    own = chunks.join(profile_tiers, "profile", "left").join(effective.select("profile", "url", F.col("tier").alias("artifact_tier")), ["profile", "url"], "left")
    own = own.join(cyclic_profiles(effective), "profile", "left")
    own = own.join(soul_tiers, "profile", "left") if soul_tiers is not None else own.withColumn("soul_tier", F.lit(None).cast("string"))
    hidden = role.isNull() | F.coalesce("broken", F.lit(False))
    for prefix in PRIVATE_PREFIXES:
        hidden = hidden | F.coalesce(F.startswith("url", F.lit(prefix)), F.lit(False))
    section = F.when(F.col("source_type") == "soul", F.col("soul_tier"))
    tier = F.when(hidden, F.lit("private")).otherwise(T.most_restrictive("profile_tier", T.role_tier(role), "artifact_tier", section))
    return own.withColumn("tier", tier).drop("artifact_tier", "profile_tier", "soul_tier", "broken")


def access_rights(artifacts: DataFrame, effective: DataFrame) -> DataFrame:
    """``profile, url, access``: the access-right term of the effective tier; none of any artifact of a profile with a cycle."""
    terms = F.create_map(*[F.lit(x) for kv in ACCESS_RIGHTS.items() for x in kv])
    own = artifacts.select("profile", "url").join(effective, ["profile", "url"], "left").join(cyclic_profiles(effective), "profile", "left")
    return own.select("profile", "url", F.when(F.col("broken").isNull(), F.try_element_at(terms, F.col("tier"))).alias("access"))


def withheld_by_role(artifacts: DataFrame, effective: DataFrame, viewer: str = "public") -> DataFrame:
    """``role, withheld``: artifacts whose effective tier the viewer may not see."""
    own = artifacts.join(effective.select("profile", "url", F.col("tier").alias("effective")), ["profile", "url"])
    return own.where(~T.allows(F.lit(viewer), "effective")).groupBy("role").agg(F.count(F.lit(1)).alias("withheld"))


def size_index(artifacts: DataFrame, effective: DataFrame, sizes: DataFrame, viewer: str = "public") -> DataFrame:
    """``url, reason, approx_tokens`` of artifacts with ``sizes(url, b)``: bytes over four where the viewer may read them."""
    own = artifacts.join(sizes, "url").join(effective.select("profile", "url", F.col("tier").alias("effective")), ["profile", "url"])
    seen = T.allows(F.lit(viewer), "effective")
    return own.select("url", F.when(~seen, "not_permitted").when(F.col("b") == 0, "not_uploaded").alias("reason"), F.when(seen, F.floor(F.col("b") / 4)).alias("approx_tokens"))


def project_sections(profiles: DataFrame, viewer: str, declared: str = "section_tiers", profile_tier: str = "profile_tier") -> DataFrame:
    """Profiles without what the viewer may not see: fields of a section above the viewer become null, lists empty.

    A section's tier is the most restrictive of the profile's and the one in the map ``declared``.
    """
    changed = {}
    for section, fields in T.SECTIONS.items():
        tier = T.most_restrictive(profile_tier, F.try_element_at(F.col(declared), F.lit(section)))
        for name in fields:
            if name in profiles.columns:
                kind = profiles.schema[name].dataType
                empty = F.array().cast(kind) if kind.typeName() == "array" else F.lit(None).cast(kind)
                changed[name] = F.when(T.allows(F.lit(viewer), tier), F.col(name)).otherwise(empty)
    return profiles.withColumns(changed) if changed else profiles


def artifact_visible(refs: DataFrame, effective: DataFrame, profile_tiers: DataFrame, viewer: str) -> DataFrame:
    """``refs(profile, url, role)`` with ``visible``; a file off the manifest has its profile's and role's defaults."""
    own = refs.join(effective.select("profile", "url", F.col("tier").alias("effective")), ["profile", "url"], "left").join(profile_tiers, "profile", "left")
    tier = F.coalesce("effective", T.most_restrictive("profile_tier", T.role_tier("role")))
    return own.withColumn("visible", T.allows(F.lit(viewer), tier)).drop("effective", "profile_tier")


def allowed_source_types(profile_tiers: DataFrame, viewer: str) -> DataFrame:
    """``profile, types``: chunk source types whose defaults the viewer may see, in order; null means all."""
    each = [F.when(T.allows(F.lit(viewer), T.most_restrictive("profile_tier", T.role_tier(F.lit(role)))), F.lit(kind)) for kind, role in sorted(T.CHUNK_ROLES.items())]
    types = F.array_compact(F.array(*each))
    return profile_tiers.select("profile", (F.lit(None).cast("array<string>") if viewer == "private" else types).alias("types"))


def secure_view(df: DataFrame, viewer: str, tier: str = "tier") -> DataFrame:
    """Rows that the viewer may see; a missing tier is private."""
    return df.where(T.allows(F.lit(viewer), F.coalesce(F.col(tier), F.lit("private"))))
