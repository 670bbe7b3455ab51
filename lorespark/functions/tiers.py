"""Visibility tiers as ordinals: public < limited < private."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._names import col

# The tiers in order, the default tiers of roles, and the role that governs a chunk's source type.
TIERS = ("public", "limited", "private")
ROLE_TIERS = {"paper_fulltext": "private", "cv": "private", "web": "private", "interview": "private", "grant": "private",
    "embedding_index_sqlite": "private", "trials": "limited", "seed_papers": "private"}
CHUNK_ROLES = {"soul": "soul", "expertise": "expertise", "paper_summary": "paper_summary", "paper_abstract": "paper_abstract", "cv": "cv",
    "web": "web", "grant": "grant", "seed_abstract": "seed_papers"}
SECTIONS = {"summary": ("summary",), "expertise": ("expertise",), "focus": ("subfields", "interests", "not_interests", "research_interests"),
    "methods": ("methodological_commitments",), "soul": (), "clinical": ("therapeutic_areas",), "site_capabilities": ("site_capabilities",),
        "regulatory_experience": ("regulatory_experience",), "contact": ("email",), "background": ("training", "career", "job_title", "affiliation")}


def _map(m: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def ordinal(tier) -> Column:
    """0, 1, 2; null for an unknown or missing tier."""
    c = col(tier)
    return F.when(c == TIERS[0], 0).when(c == TIERS[1], 1).when(c == TIERS[2], 2)


def tier_name(n) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TIERS]), col(n) + 1)


def allows(viewer, artifact) -> Column:
    return ordinal(artifact) <= ordinal(viewer)


def most_restrictive(*tiers) -> Column:
    """Unknown and missing tiers count as public."""
    return tier_name(F.greatest(F.lit(0), *[F.coalesce(ordinal(t), F.lit(0)) for t in tiers]))


def narrow_viewer(*viewers) -> Column:
    return tier_name(F.least(F.lit(2), *[ordinal(v) for v in viewers]))


def role_tier(role) -> Column:
    return F.coalesce(F.try_element_at(_map(ROLE_TIERS), col(role)), F.lit("public"))


def chunk_role(source_type) -> Column:
    """Null for an unknown source type, which is then private."""
    return F.try_element_at(_map(CHUNK_ROLES), col(source_type))


def redact_above(value, tier, viewer) -> Column:
    """The value if the viewer may see its section, else null."""
    return F.when(allows(viewer, tier), col(value))
