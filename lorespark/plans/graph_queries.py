"""Graph, conflict and privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import tiers as T
from ..operators import graph as G
from ..operators import privacy as P
from ..operators.listings import edges_between as edges_among
from .standins import ARTIFACTS, CO, INST, NAME, ORD, PARTS, PTIERS, STAYS, artifacts, people, profile_tiers, stays, table

Q, S = {}, {}
YEAR = 1998


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query(f"WITH {PARTS}, {CO} SELECT src, dst, paper_count, first_year, last_year, CAST(confidence AS INTEGER) AS confidence FROM co")
def coauthor_edges(spark, sf):
    return G.coauthor_edges(people(spark, sf))


@query(f"WITH {PARTS}, {CO} SELECT co.src, co.dst, paper_count, list_slice(list_sort(list(a.work)), 1, 3) AS evidence FROM co JOIN parts a ON a.person = co.src JOIN parts b ON b.person = co.dst AND b.work = a.work GROUP BY ALL")
def coauthor_evidence(spark, sf):
    return G.coauthor_edges(people(spark, sf), evidence=3).select("src", "dst", "paper_count", "evidence")


@query(f"WITH {PARTS}, {STAYS}, {INST} SELECT src, dst, institution, overlap, confidence FROM ie")
def shared_institution_overlap(spark, sf):
    return G.institution_edges(stays(spark, sf))


@query(f"""WITH {PARTS}, {CO}, tw AS (SELECT src, dst, paper_count, last_year FROM co WHERE paper_count >= 2 UNION ALL SELECT dst, src, paper_count, last_year FROM co WHERE paper_count >= 2),
h1 AS (SELECT dst, paper_count, last_year FROM tw WHERE src = 1), n1 AS (SELECT DISTINCT dst FROM h1),
h2 AS (SELECT tw.dst, tw.paper_count, tw.last_year FROM tw JOIN n1 ON tw.src = n1.dst WHERE tw.dst <> 1)
SELECT dst, min(hops) AS hops, max(paper_count) AS paper_count, max(last_year) AS last_year FROM (SELECT dst, 1 AS hops, paper_count, last_year FROM h1 UNION ALL SELECT dst, 2, paper_count, last_year FROM h2) GROUP BY 1""")
def k_hop_neighbors(spark, sf):
    return G.neighbors(G.coauthor_edges(people(spark, sf)).where("paper_count >= 2"), 1, 2)


COI = f"""{PARTS}, {CO}, {STAYS}, {INST}, au AS (SELECT work AS paper, person FROM parts), ca AS (SELECT DISTINCT paper, 1 + paper * 7 % (SELECT max(s_suppkey) FROM supplier) AS candidate FROM au),
pr AS (SELECT DISTINCT paper, candidate, least(person, candidate) AS src, greatest(person, candidate) AS dst FROM au JOIN ca USING (paper) WHERE person <> candidate),
re AS (SELECT paper, candidate, 'c' AS t, last_year IS NULL OR last_year >= {YEAR} - 4 AS ok FROM pr JOIN co USING (src, dst) UNION ALL SELECT paper, candidate, 'i', TRUE FROM pr JOIN ie USING (src, dst)),
ve AS (SELECT ca.paper, ca.candidate, coalesce(bool_or(ok), FALSE) AS has_coi, CAST(coalesce(count_if(t = 'c'), 0) AS BIGINT) AS coauthors, CAST(coalesce(count_if(t = 'i'), 0) AS BIGINT) AS institutions FROM ca LEFT JOIN re ON ca.paper = re.paper AND ca.candidate = re.candidate GROUP BY 1, 2)"""


def _verdicts(spark, sf):
    parts = people(spark, sf)
    authors = parts.select(F.col("work").alias("paper"), "person")
    last = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("n")).first()["n"]
    cands = authors.select("paper", (1 + F.col("paper") * 7 % last).alias("candidate")).distinct()
    return G.conflicts(authors, cands, G.coauthor_edges(parts), stays(spark, sf), YEAR).drop("reasons")


@query(f"WITH {COI} SELECT * FROM ve")
def coi_verdict(spark, sf):
    return _verdicts(spark, sf)


@query(f"""WITH {COI}, ad AS (SELECT DISTINCT least(s_suppkey, 1 + s_suppkey * 3 % 50) AS src, greatest(s_suppkey, 1 + s_suppkey * 3 % 50) AS dst FROM supplier WHERE s_suppkey <> 1 + s_suppkey * 3 % 50),
il AS (SELECT DISTINCT paper, CASE WHEN paper % 25 % 2 = 0 THEN 'ror:' ELSE 'inst:' END || paper % 25 AS inst FROM ca), sh AS (SELECT DISTINCT paper, candidate FROM pr JOIN ie USING (src, dst)),
rs AS (SELECT paper, candidate, 'coauthor' AS t, last_year IS NULL OR last_year >= {YEAR} - 4 AS ok FROM pr JOIN co USING (src, dst) UNION ALL SELECT paper, candidate, 'institution', TRUE FROM sh UNION ALL SELECT paper, candidate, 'advisor', TRUE FROM pr JOIN ad USING (src, dst)
UNION ALL SELECT DISTINCT ca.paper, ca.candidate, 'affiliation', TRUE FROM ca JOIN il ON il.paper = ca.paper JOIN stays ON stays.person = ca.candidate AND stays.inst = il.inst WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.paper = ca.paper AND sh.candidate = ca.candidate))
SELECT ca.paper, ca.candidate, coalesce(bool_or(ok), FALSE) AS has_coi, coalesce(list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)), CAST([] AS VARCHAR[])) AS reasons FROM ca LEFT JOIN rs ON rs.paper = ca.paper AND rs.candidate = ca.candidate GROUP BY 1, 2""")
def coi_in_full(spark, sf):
    parts = people(spark, sf)
    authors = parts.select(F.col("work").alias("paper"), "person")
    last = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("n")).first()["n"]
    cands = authors.select("paper", (1 + F.col("paper") * 7 % last).alias("candidate")).distinct()
    k, n = F.col("s_suppkey"), F.col("paper") % 25
    advisors = table(spark, sf, "supplier").select(k.alias("src"), (1 + k * 3 % 50).alias("dst")).where("src <> dst")
    inline = cands.select("paper", F.concat(F.when(n % 2 == 0, "ror:").otherwise("inst:"), n).alias("inst")).distinct()
    return G.conflicts(authors, cands, G.coauthor_edges(parts), stays(spark, sf), YEAR, advisors=advisors, inline=inline).select("paper", "candidate", "has_coi", "reasons")


@query(f"""WITH {PARTS}, {CO}, tw AS (SELECT src, dst FROM co WHERE last_year >= 1997 UNION ALL SELECT dst, src FROM co WHERE last_year >= 1997) SELECT DISTINCT dst, CAST(1 AS INTEGER) AS hops FROM tw WHERE src = 1""")
def neighbors_since(spark, sf):
    edges = G.coauthor_edges(people(spark, sf)).withColumn("type", F.lit("coauthor"))
    return G.neighbors(edges, 1, 1, ("coauthor",), 1997).select("dst", "hops")


@query(f"WITH {COI} SELECT candidate, count(*) AS papers, CAST(count_if(NOT has_coi) AS BIGINT) AS free FROM ve GROUP BY 1")
def reviewer_match(spark, sf):
    """How many papers each candidate could review (mode: drop conflicts)."""
    return _verdicts(spark, sf).groupBy("candidate").agg(F.count(F.lit(1)).alias("papers"), F.count_if(~F.col("has_coi")).alias("free"))


@query(f"WITH {PARTS}, {CO} SELECT src, dst, paper_count FROM co WHERE (src = 7 AND dst BETWEEN 1 AND 40) OR (dst = 7 AND src BETWEEN 1 AND 40)")
def edges_between(spark, sf):
    person = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("person"))
    return edges_among(G.coauthor_edges(people(spark, sf)), person(7, 8), person(1, 41)).select("src", "dst", "paper_count")


@query("WITH n AS (SELECT 'name' || (c_custkey % 400) AS key, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 400 ELSE c_custkey END AS rid FROM customer) SELECT key, CASE WHEN count(DISTINCT rid) = 1 THEN min(rid) END AS rid FROM n GROUP BY 1")
def name_index(spark, sf):
    k = F.col("c_custkey")
    return G.resolve_names(table(spark, sf, "customer").select(F.concat(F.lit("name"), k % 400).alias("key"), F.when(k % 5 == 0, k % 400).otherwise(k).alias("rid")))


@query("""WITH ix AS (SELECT 'a' || c_custkey AS key, c_custkey AS rid FROM customer),
tr AS (SELECT c_custkey AS person, c_custkey AS ordinal, 'a' || (c_custkey % 60) AS advisor, CASE WHEN c_custkey % 3 <> 0 THEN CAST(1990 + c_custkey % 30 AS INTEGER) END AS year_end FROM customer),
e AS (SELECT coalesce(CAST(rid AS VARCHAR), 'ext:' || advisor) AS src, CAST(person AS VARCHAR) AS dst, year_end FROM tr LEFT JOIN ix ON ix.key = advisor) SELECT src, dst, min(year_end) AS last_year FROM e WHERE src <> dst GROUP BY 1, 2""")
def advised_edges(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    index = G.resolve_names(c.select(F.concat(F.lit("a"), k).alias("key"), k.cast("string").alias("rid")))
    training = c.select(k.cast("string").alias("person"), k.alias("ordinal"), F.concat(F.lit("a"), k % 60).alias("advisor_key"), F.when(k % 3 != 0, (1990 + k % 30).cast("int")).alias("year_end"))
    return G.advised_edges(training, index)


@query("""WITH r AS (SELECT sha256(s_suppkey || chr(31) || s_name || chr(31) || s_nationkey) AS d FROM supplier),
a AS (SELECT substr(d, 1, 4) AS p, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM r GROUP BY 1), b AS (SELECT substr(p, 1, 2) AS p, sha256(string_agg(p || d, chr(10) ORDER BY p || d)) AS d FROM a GROUP BY 1)
SELECT sha256(string_agg(p || d, chr(10) ORDER BY p || d)) AS hash FROM b""")
def corpus_source_hash(spark, sf):
    return G.source_hash(table(spark, sf, "supplier"), "s_suppkey", "s_name", "s_nationkey")


@query("""SELECT n_nationkey, CASE WHEN t <= 1 THEN n_name END AS limited_view, CASE WHEN t = 0 THEN n_name END AS public_view, CASE greatest(t, n_regionkey % 3) WHEN 0 THEN 'public' WHEN 1 THEN 'limited' ELSE 'private' END AS most FROM (SELECT *, n_nationkey % 3 AS t FROM nation)""")
def tier_projection(spark, sf):
    tier = T.tier_name(F.col("n_nationkey") % 3)
    region = T.tier_name(F.col("n_regionkey") % 3)
    return table(spark, sf, "nation").select("n_nationkey", T.redact_above("n_name", tier, F.lit("limited")).alias("limited_view"), T.redact_above("n_name", tier, F.lit("public")).alias("public_view"), T.most_restrictive(tier, region).alias("most"))


ROLE_DEFAULT = "CASE role WHEN 'paper_fulltext' THEN 'private' WHEN 'cv' THEN 'private' WHEN 'trials' THEN 'limited' ELSE 'public' END"
EFF = f"""{ARTIFACTS}, {PTIERS}, ow AS (SELECT af.profile, url, paper_id, role, greatest(coalesce({ORD("profile_tier")}, 0), {ORD(f"coalesce(tier, {ROLE_DEFAULT})")}) AS n, derived_from FROM af LEFT JOIN pt ON pt.profile = af.profile),
RECURSIVE_PLACEHOLDER ed AS (SELECT a.profile, a.url, b.url AS source FROM (SELECT profile, url, unnest(derived_from) AS ref FROM af) a JOIN af b ON a.profile = b.profile AND (b.paper_id = a.ref OR b.role = a.ref)),
rc AS (SELECT profile, url, url AS at FROM ow UNION SELECT rc.profile, rc.url, ed.source FROM rc JOIN ed ON ed.profile = rc.profile AND ed.url = rc.at),
ef AS (SELECT rc.profile, rc.url, max(o.n) AS n FROM rc JOIN ow o ON o.profile = rc.profile AND o.url = rc.at GROUP BY 1, 2)""".replace("RECURSIVE_PLACEHOLDER ", "")


@query(f"WITH RECURSIVE {EFF} SELECT profile, url, {NAME('n')} AS tier, FALSE AS cyclic FROM ef")
def effective_tier_recursive(spark, sf):
    return P.effective_tiers(artifacts(spark, sf), profile_tiers(spark, sf))


@query(f"WITH {ARTIFACTS}, r AS (SELECT profile, url, unnest(derived_from) AS ref FROM af) SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM af WHERE af.profile = r.profile AND (af.paper_id = r.ref OR af.role = r.ref))")
def unresolved_derivations(spark, sf):
    return P.unresolved(artifacts(spark, sf))


CT = f"""{EFF}, ck AS (SELECT vec_id AS chunk_id, vec_id % 25 AS profile, CASE WHEN vec_id % 13 = 0 THEN '.cache/' ELSE '' END || 'f' || (vec_id % 250) AS url, CASE vec_id % 5 WHEN 0 THEN 'soul' WHEN 1 THEN 'cv' WHEN 2 THEN 'paper_summary' WHEN 3 THEN 'seed_abstract' ELSE 'odd' END AS source_type FROM embeddings),
ct AS (SELECT chunk_id, CASE WHEN source_type = 'odd' OR ck.url LIKE '.cache/%' THEN 2 ELSE greatest(coalesce({ORD("profile_tier")}, 0), CASE WHEN source_type IN ('cv', 'seed_abstract') THEN 2 WHEN source_type = 'soul' AND ck.profile % 3 = 0 THEN 1 ELSE 0 END, coalesce(ef.n, 0)) END AS n FROM ck LEFT JOIN pt ON pt.profile = ck.profile LEFT JOIN ef ON ef.profile = ck.profile AND ef.url = ck.url)"""


def _chunk_tiers(spark, sf):
    k = F.col("vec_id")
    kind = F.when(k % 5 == 0, "soul").when(k % 5 == 1, "cv").when(k % 5 == 2, "paper_summary").when(k % 5 == 3, "seed_abstract").otherwise("odd")
    ck = table(spark, sf, "embeddings").select(k.alias("chunk_id"), (k % 25).alias("profile"), F.concat(F.when(k % 13 == 0, ".cache/").otherwise(""), F.lit("f"), k % 250).alias("url"), kind.alias("source_type"))
    eff = P.effective_tiers(artifacts(spark, sf), profile_tiers(spark, sf))
    tiers = profile_tiers(spark, sf)
    return P.chunk_tiers(ck, eff, tiers, tiers.select("profile", F.when(F.col("profile") % 3 == 0, "limited").alias("soul_tier")))


@query(f"WITH RECURSIVE {CT} SELECT chunk_id, {NAME('n')} AS tier FROM ct")
def chunk_tiers(spark, sf):
    return _chunk_tiers(spark, sf).select("chunk_id", "tier")


@query(f"WITH RECURSIVE {CT} SELECT chunk_id FROM ct WHERE n <= 1")
def visible_chunks(spark, sf):
    return P.secure_view(_chunk_tiers(spark, sf), "limited").select("chunk_id")


@query(f"WITH RECURSIVE {EFF} SELECT ow.role, count(*) AS withheld FROM ef JOIN ow USING (profile, url) WHERE ef.n > 0 GROUP BY 1")
def withheld_by_role(spark, sf):
    own = artifacts(spark, sf)
    return P.withheld_by_role(own, P.effective_tiers(own, profile_tiers(spark, sf)))


@query(f"WITH RECURSIVE {EFF}, s AS (SELECT ef.url, ef.n AS t, CAST(strlen(html) AS BIGINT) AS b FROM ef JOIN pages ON 'f' || page_id = ef.url) SELECT url, CASE WHEN t > 0 THEN 'not_permitted' WHEN b = 0 THEN 'not_uploaded' END AS reason, CASE WHEN t = 0 THEN b // 4 END AS approx_tokens FROM s")
def size_index(spark, sf):
    body = table(spark, sf, "pages").select(F.concat(F.lit("f"), F.col("page_id")).alias("url"), F.octet_length("html").cast("long").alias("b"))
    own = artifacts(spark, sf)
    return P.size_index(own, P.effective_tiers(own, profile_tiers(spark, sf)), body)


RIGHT = "http://publications.europa.eu/resource/authority/access-right/"


@query(f"WITH RECURSIVE {EFF} SELECT url, '{RIGHT}' || CASE n WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'RESTRICTED' ELSE 'NON_PUBLIC' END AS access FROM ef")
def access_rights(spark, sf):
    own = artifacts(spark, sf)
    return P.access_rights(own, P.effective_tiers(own, profile_tiers(spark, sf))).select("url", "access")


@query(f"""WITH {PTIERS} SELECT profile, CASE WHEN greatest({ORD("profile_tier")}, CASE profile % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) <= 1 THEN 'p' || profile END AS email,
CASE WHEN greatest({ORD("profile_tier")}, CASE WHEN profile % 5 = 0 THEN 2 ELSE 0 END) <= 1 THEN ['a', 'b'] ELSE CAST([] AS VARCHAR[]) END AS interests, 'x' AS other FROM pt""")
def project_sections(spark, sf):
    k = F.col("profile")
    contact = F.when(k % 3 == 0, "private").when(k % 3 == 1, "limited").otherwise("public")
    own = profile_tiers(spark, sf).select("profile", "profile_tier", F.concat(F.lit("p"), k).alias("email"), F.array(F.lit("a"), F.lit("b")).alias("interests"), F.lit("x").alias("other"), F.create_map(F.lit("contact"), contact, F.lit("focus"), F.when(k % 5 == 0, "private").otherwise("public")).alias("section_tiers"))
    return P.project_sections(own, "limited").select("profile", "email", "interests", "other")


@query(f"""WITH RECURSIVE {EFF}, r AS (SELECT profile, url, role FROM ow WHERE length(url) % 2 = 0 UNION ALL SELECT profile, url || '.off', role FROM ow)
SELECT r.profile, r.url, coalesce(ef.n, greatest(coalesce({ORD("profile_tier")}, 0), {ORD(ROLE_DEFAULT)})) <= 1 AS visible FROM r LEFT JOIN ef ON ef.profile = r.profile AND ef.url = r.url LEFT JOIN pt ON pt.profile = r.profile""")
def artifact_visible(spark, sf):
    own = artifacts(spark, sf)
    refs = own.where(F.length("url") % 2 == 0).select("profile", "url", "role").union(own.select("profile", F.concat("url", F.lit(".off")), "role"))
    tiers = profile_tiers(spark, sf)
    return P.artifact_visible(refs, P.effective_tiers(own, tiers), tiers, "limited").select("profile", "url", "visible")


@query(f"WITH {PTIERS} SELECT profile, CASE profile_tier WHEN 'public' THEN ['expertise', 'paper_abstract', 'paper_summary', 'soul'] ELSE CAST([] AS VARCHAR[]) END AS types FROM pt")
def allowed_source_types(spark, sf):
    return P.allowed_source_types(profile_tiers(spark, sf), "public")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ror:r' || s_nationkey ELSE 'inst:supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS key FROM supplier")
def institution_keys(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", I.institution_key(F.when(k % 2 == 0, F.concat(F.lit("R"), F.col("s_nationkey"))), F.concat(F.lit("Supplier #"), F.lpad(k.cast("string"), 9, "0"))).alias("key"))
