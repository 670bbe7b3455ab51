"""Queries of what profiles hand out and of published sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports as E
from ..operators import profiles as P
from ..operators.embedding import hash_encoder
from ..sources import published as U
from . import record_queries
from .standins import EFFECTIVE, INTERESTS, artifacts, chunks, interests, table

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


#: Url, slot, place, role and paper id of the stand-in's files, by page id modulo ten.
FILES = (
    ("personality/SOUL.md", "subjectOf", 0, "soul", None), ("sources/cv.md", "hasPart", 7, "cv", None), ("sources/summaries/a.summary.md", "hasPart", 9, "paper_summary", "a"),
    ("sources/papers/b.md", "hasPart", 10, "paper_fulltext", "b"), ("sources/web/c.md", "hasPart", 11, "web", None), ("embeddings/index.json", "hasPart", 12, "embedding_index", None),
    (".cache/embeddings.sqlite", "hasPart", 13, "embedding_index_sqlite", None), ("notes.txt", None, None, None, None), ("sources/papers/d/e.md", None, None, None, None), ("SKILL.md", "hasPart", 1, "agent_entry_point", None),
)
quoted = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
MAN = f"""kn AS (SELECT * FROM (VALUES {", ".join(f"({i}, " + ", ".join(map(quoted, f)) + ")" for i, f in enumerate(FILES))}) AS t(i, url, slot, place, role, paper_id)),
fi AS (SELECT page_id, page_id // 10 AS profile, kn.*, 'h' || page_id AS sha256 FROM pages JOIN kn ON page_id % 10 = i WHERE slot IS NOT NULL)"""


@query(f"WITH {MAN} SELECT profile, slot, place, url, role, paper_id, CASE WHEN page_id % 3 = 0 THEN 'd' || page_id END AS inputs_digest FROM fi")
def manifest_entries(spark, sf):
    k = F.col("page_id")
    url = F.element_at(F.array(*[F.lit(f[0]) for f in FILES]), (k % 10 + 1).cast("int"))
    profile = F.floor(k / 10).alias("profile")
    pages = table(spark, sf, "pages")
    files = pages.select(profile, url.alias("url"), F.lit(1).alias("size_bytes"), F.concat(F.lit("h"), k).alias("sha256"))
    sha, digest = F.concat(F.when(k % 3 == 0, "h").otherwise("old"), k), F.concat(F.lit("d"), k)
    recorded = pages.select(profile, k.alias("ordinal"), url.alias("url"), sha.alias("sha256"), digest.alias("inputs_digest"))
    return E.manifest(files, recorded).select("profile", "slot", F.col("place").cast("int").alias("place"), "url", "role", "paper_id", "inputs_digest")


@query(f"""WITH {INTERESTS}, {EFFECTIVE} SELECT profile, position, CASE WHEN code IS NULL THEN '{{"skos:prefLabel":"' || label || '"}}'
WHEN ordinal % 2 = 0 THEN '{{"@id":"https://x.org/' || code || '","skos:prefLabel":"' || label || '"}}'
ELSE '{{"skos:inScheme":{{"@id":"' || system || '"}},"skos:notation":"' || code || '","skos:prefLabel":"' || label || '"}}' END AS node FROM ef WHERE weight > 0""")
def interest_nodes(spark, sf):
    own = interests(spark, sf)
    return E.interest_nodes(own.withColumn("iri", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("https://x.org/"), "code"))))


VIOLATIONS = f"vi AS ({record_queries.S['validation_rules']})"


def _violations(spark, sf):
    return record_queries.Q["validation_rules"](spark, sf)


@query(f"WITH {VIOLATIONS}, p AS (SELECT DISTINCT page_id // 10 AS profile FROM pages) SELECT p.profile, count(vi.pointer) = 0 AS ok, count(vi.pointer) AS violations FROM p LEFT JOIN vi USING (profile) GROUP BY 1")
def validation_reports(spark, sf):
    return E.reports(artifacts(spark, sf), _violations(spark, sf))


@query(f"""WITH {VIOLATIONS}, p AS (SELECT DISTINCT page_id // 10 AS profile FROM pages) SELECT profile, 'Validation: ' || CASE WHEN profile IN (SELECT profile FROM vi) THEN 'FAIL' ELSE 'PASS' END AS line FROM p
UNION ALL SELECT profile, '  ' || pointer || ': ' || keyword FROM vi""")
def validation_lines(spark, sf):
    return E.report_lines(artifacts(spark, sf), _violations(spark, sf)).select("profile", "line")


LISTED = """li AS (SELECT l_suppkey AS owner, CASE WHEN l_orderkey % 3 = 0 THEN '10.1000/' || l_orderkey END AS doi, CASE WHEN l_orderkey % 3 = 1 THEN 'https://x.org/W' || l_orderkey END AS openalex_id,
CASE WHEN l_partkey % 2 = 0 THEN 'P' || l_partkey END AS paper_id, 'On ' || l_returnflag || ', again' AS title, CASE WHEN l_linenumber > 1 THEN CAST(year(l_shipdate) AS INTEGER) END AS year FROM lineitem)"""


@query(f"""WITH {LISTED} SELECT CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN openalex_id IS NOT NULL THEN 'openalex:w' || split_part(openalex_id, '/W', 2) WHEN paper_id IS NOT NULL THEN 'paperid:' || lower(paper_id)
ELSE 'local:' || owner || ':' || replace(replace(lower(title), ', ', '-'), ' ', '-') END AS work_key, count(DISTINCT owner) AS owners, count(DISTINCT coalesce(doi, paper_id, openalex_id)) AS evidence,
min(year) AS first_year, max(year) AS last_year FROM li GROUP BY 1""")
def paper_groups(spark, sf):
    k = F.col("l_orderkey")
    return E.paper_groups(table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("owner"), F.when(k % 3 == 0, F.concat(F.lit("10.1000/"), k)).alias("doi"), F.when(k % 3 == 1, F.concat(F.lit("https://x.org/W"), k)).alias("openalex_id"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("P"), "l_partkey")).alias("paper_id"), F.concat(F.lit("On "), "l_returnflag", F.lit(", again")).alias("title"),
        F.when(F.col("l_linenumber") > 1, F.year("l_shipdate")).alias("year"),
    ))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'list' WHEN 1 THEN 'registry' WHEN 2 THEN 'profile' WHEN 3 THEN 'profile' ELSE 'unrecognized' END AS kind FROM documents")
def source_kinds(spark, sf):
    k = F.col("doc_id") % 6
    shape = F.when(k == 0, '["a", "b"]').when(k == 1, '{"cards": [], "hasPart": []}').when(k == 2, '{"name": "n", "hasPart": []}').when(k == 3, '{"subjectOf": null}').when(k == 4, '{"x": {"cards": 1}}').otherwise("no json")
    return table(spark, sf, "documents").select("doc_id", F.try_parse_json(shape).alias("d")).select("doc_id", U.source_kind("d").alias("kind"))


@query("SELECT 's' || doc_id AS slug FROM documents WHERE doc_id % 4 > 1")
def malformed_profiles(spark, sf):
    k = F.col("doc_id") % 4
    made = F.when(k == 0, '{"name": "n"}').when(k == 1, '{"name": "m", "x": [1]}').when(k == 2, '{"name": " "}').otherwise('{"name":')
    return U.malformed(table(spark, sf, "documents").select(F.concat(F.lit("s"), "doc_id").alias("slug"), F.try_parse_json(made).alias("document")))


@query()
def vectors_by_kind(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("summary"), F.col("text").alias("expertise"))
    return E.profile_vectors(chunks(spark, sf), texts.withColumnRenamed("doc_id", "profile"), hash_encoder)
