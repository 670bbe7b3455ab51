"""Queries of records, evidence, citations and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import interests as N
from ..operators import records as R
from .standins import ARTIFACTS, EFFECTIVE, INTERESTS, PAPERS, artifacts, interests, papers, table

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id AS paper, list_slice(string_split(text, ' '), 1, 10) AS authors, list_slice(string_split(text, ' '), 1, 5) AS topics, left(text, 1500) AS abstract FROM documents")
def paper_rows(spark, sf):
    words = F.split("text", " ")
    return R.paper_rows(table(spark, sf, "documents").select(F.col("doc_id").alias("paper"), words.alias("authors"), words.alias("topics"), F.col("text").alias("abstract")))


@query(f"WITH {PAPERS} SELECT paper FROM pp WHERE NOT contaminated AND trim(coalesce(title, ''), ' ') <> ''")
def papers_listing(spark, sf):
    return R.papers_listing(papers(spark, sf), True, True).select("paper")


@query("WITH p AS (SELECT c_custkey AS profile, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS caps FROM customer) SELECT profile, coalesce(caps > 0, FALSE) OR profile IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) AS clinical FROM p")
def clinical_flag(spark, sf):
    k = F.col("c_custkey")
    caps = F.when(k % 3 == 1, F.array().cast("array<string>")).when(k % 3 == 2, F.array(F.lit("x")))
    parts = table(spark, sf, "orders").select(F.col("o_custkey").alias("profile"), F.when(F.col("o_orderkey") % 5 == 0, "trials").otherwise("cv").alias("role"))
    return R.clinical_flag(table(spark, sf, "customer").select(k.alias("profile"), caps.alias("capabilities")), parts)


@query(f"WITH {ARTIFACTS} SELECT profile, url, role FROM af WHERE (profile % 2 = 0 AND role = 'cv') OR (profile % 2 = 1 AND url = 'f' || (profile * 10)) ")
def select_parts(spark, sf):
    own = artifacts(spark, sf).select("profile", "url", "role")
    p = own.select("profile").distinct()
    nothing = F.lit(None).cast("string")
    asked = p.where("profile % 2 = 0").select("profile", F.lit("cv").alias("role"), nothing.alias("url")).union(p.where("profile % 2 = 1").select("profile", nothing, F.concat(F.lit("f"), F.col("profile") * 10)))
    return R.select_parts(own, asked)


@query("SELECT item_id AS doc, CASE WHEN item_id % 2 = 0 THEN 'odd' ELSE 'misspelt' END AS term FROM benchmark")
def undeclared_terms(spark, sf):
    fields = F.create_map(F.lit("name"), F.lit("1"), F.when(F.col("item_id") % 2 == 0, "odd").otherwise("misspelt"), F.lit("2"))
    return R.undeclared_terms(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), fields.alias("fields")), spark.createDataFrame([("name",), ("email",)], "term string"))


@query(f"WITH {ARTIFACTS} SELECT profile, role, count(*) AS n FROM af GROUP BY 1, 2")
def manifest_role_counts(spark, sf):
    return R.role_counts(artifacts(spark, sf))


@query("SELECT s_suppkey AS profile, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE FALSE END AS agrees FROM supplier")
def probe_agreement(spark, sf):
    k = F.col("s_suppkey")
    vec = F.when(k % 4 == 1, F.array(F.lit(0.5), F.lit(1.0))).when(k % 4 == 2, F.array(F.lit(0.5), F.lit(1.1))).when(k % 4 == 3, F.array(F.lit(0.5)))
    return R.probe_agreement(table(spark, sf, "supplier").select(k.alias("profile"), k.alias("ordinal"), F.lit("t").alias("text"), vec.cast("array<double>").alias("vector")))


@query("SELECT p_brand AS topic, list_sort(list(DISTINCT 'b' || l_suppkey % 3)) AS bases, count(DISTINCT l_suppkey) AS size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def merged_topics(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return R.merged_topics(li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.concat(F.lit("b"), F.col("l_suppkey") % 3).alias("base"), F.col("p_brand").alias("topic"), F.col("l_suppkey").alias("profile")))


@query("WITH e AS (SELECT o_custkey AS k, count(*) AS top FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT o_custkey AS k, o_orderkey AS id, coalesce(top, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ordinal FROM orders LEFT JOIN e ON e.k = o_custkey WHERE o_orderkey % 2 = 1")
def ordinals(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"))
    have = R.with_ordinals(o.where("id % 2 = 0"), o.where("false").withColumn("ordinal", F.lit(0)), "k", ["id"])
    return R.with_ordinals(o.where("id % 2 = 1"), have, "k", ["id"])


@query("""WITH s AS (SELECT o_custkey AS doc, 'h' || o_orderkey AS name, o_orderkey AS at FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS at FROM orders)
SELECT a.doc, a.at, (SELECT arg_max(s.name, s.at) FROM s WHERE s.doc = a.doc AND s.at <= a.at) AS section FROM a""")
def section_at(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("at"))
    return R.sections_at(o.where("at % 3 = 0").select("doc", F.concat(F.lit("h"), "at").alias("name"), F.col("at").alias("offset")), o)


@query("SELECT l_orderkey AS paper, max(l_quantity) AS score, arg_min(l_linenumber, (-l_quantity, l_linenumber)) AS span FROM (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS l_quantity, l_linenumber FROM lineitem) GROUP BY 1")
def citation_best(spark, sf):
    return R.citation_best(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_quantity").cast("double").alias("score"), F.col("l_linenumber").alias("span")))


@query("""WITH a AS (SELECT c_custkey AS q FROM customer) SELECT q, CASE q % 4 WHEN 0 THEN 'local:ann-roe-0123ab' WHEN 1 THEN 'rid' || (q % 50) WHEN 2 THEN 'nobody j' END AS node, CASE q % 4 WHEN 0 THEN 'profiled' WHEN 1 THEN 'profiled' WHEN 2 THEN 'external' ELSE 'error' END AS kind FROM a""")
def resolve_descriptor(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 1, F.concat(F.lit("Ann Fam"), k % 50)).when(k % 4 == 2, F.lit("Nobody, Jané"))
    asked = table(spark, sf, "customer").select(k.alias("q"), F.when(k % 4 == 0, "local:ann-roe-0123ab").when(k % 4 == 1, "bad").alias("rid"), F.lit(None).cast("string").alias("orcid"), name.alias("name"))
    return R.resolve_descriptor(asked, spark.range(50).select(F.concat(F.lit("fam"), "id", F.lit(" a")).alias("key"), F.concat(F.lit("rid"), "id").alias("rid")))


@query("SELECT 'W' || p_partkey AS openalex_id, '10.1/' || p_partkey AS doi, p_name AS title, 2000 + p_size AS year, p_brand AS venue, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS INTEGER) AS cited_by FROM part")
def work_lite(spark, sf):
    k = F.col("p_partkey")
    return R.work_lite(table(spark, sf, "part").select(F.concat(F.lit("https://x.org/W"), k).alias("id"), F.concat(F.lit("https://doi.org/10.1/"), k).alias("doi"), F.col("p_name").alias("title"), (2000 + F.col("p_size")).alias("year"), F.col("p_brand").alias("venue"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("cited_by")))


@query("""WITH a AS (SELECT l_orderkey AS work, bool_or(l_suppkey % 7 = 3) AS has, list('A' || l_suppkey ORDER BY l_linenumber, 'A' || l_suppkey) FILTER (l_suppkey % 7 <> 3) AS others, (list('N' || l_suppkey ORDER BY l_linenumber, 'A' || l_suppkey) FILTER (l_suppkey % 7 = 3))[-1] AS name FROM lineitem GROUP BY 1)
SELECT work, has AS orcid_present, coalesce(name, '') AS display_name, CASE WHEN has THEN ['aff'] ELSE CAST([] AS VARCHAR[]) END AS raw_affiliations, CASE WHEN has THEN ['I1'] ELSE CAST([] AS VARCHAR[]) END AS institution_ids, CASE WHEN has THEN ['Inst ' || substr(name, 2)] ELSE CAST([] AS VARCHAR[]) END AS institution_names, coalesce(others, CAST([] AS VARCHAR[])) AS coauthor_ids FROM a""")
def authorship_evidence(spark, sf):
    k = F.col("l_suppkey")
    one = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("A"), k).alias("id"), F.concat(F.lit("https://orcid.org/"), k % 7).alias("orcid"), F.concat(F.lit("N"), k).alias("name"), F.array(F.lit("aff"), F.lit("")).alias("affiliations"), F.array(F.lit("I1")).alias("institution_ids"), F.array(F.concat(F.lit("Inst "), k), F.lit("")).alias("institution_names"))
    works = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("work")).agg(F.array_sort(F.collect_list(one)).alias("authorships"))
    return R.authorship_evidence(works, F.lit("https://orcid.org/3"))


TM = f"{INTERESTS}, {EFFECTIVE}, wk AS (SELECT l_orderkey AS work, upper(p_brand) AS code, min(l_linenumber) AS ordinal FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"WITH {TM} SELECT profile, work, list(coalesce(label, ef.code) ORDER BY wk.ordinal, coalesce(label, ef.code)) AS topics FROM wk JOIN ef ON wk.code = upper(ef.code) WHERE ef.ordinal % 8 <> 0 AND CASE WHEN method = 'declared' AND weight IS NOT NULL THEN weight > 0 ELSE coalesce(share, 0) <> 0 END GROUP BY 1, 2")
def topic_matches(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    works = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("ordinal"), F.col("p_brand").alias("topic"))
    own = N.effective(interests(spark, sf)).where("code is not null").select("profile", "system", F.upper("code").alias("code"), "label", "weight", "method", "share", (F.col("ordinal") % 8 == 0).alias("unmapped"))
    return N.topic_matches(works, own, "sys")


@query(f"WITH {INTERESTS} SELECT a.profile, b.profile AS asked, list_sort(list(DISTINCT a.code)) AS topics FROM it a JOIN it b ON a.code = b.code AND a.profile <> b.profile GROUP BY 1, 2")
def shared_topics(spark, sf):
    own = interests(spark, sf).where("code is not null")
    return N.shared_topics(own.select("profile", "code"), own.select(F.col("profile").alias("asked"), "code")).where("profile <> asked")


@query("""WITH s AS (SELECT p_size AS profile, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS priority, p_partkey AS ordinal, CASE WHEN p_partkey % 3 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN 'T' || p_partkey ELSE p_type || p_partkey % 4 END AS term FROM part), t AS (SELECT * FROM s WHERE trim(term) <> ''),
f AS (SELECT profile, min(priority) AS priority FROM t GROUP BY 1), o AS (SELECT profile, priority, term, min(ordinal) AS ordinal, starts_with(term, 'T') AND regexp_full_match(term, 'T[0-9]+') AS id FROM t JOIN f USING (profile, priority) GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY profile, id ORDER BY ordinal, term) AS n FROM o) SELECT profile, 's' || priority AS source, list(term ORDER BY ordinal, term) AS topics FROM n WHERE id OR n <= 3 GROUP BY 1, 2""")
def query_terms(spark, sf):
    k = F.col("p_partkey")
    first = F.when(k % 2 == 0, 1).otherwise(2)
    term = F.when(k % 3 == 0, " ").when(k % 5 == 0, F.concat(F.lit("T"), k)).otherwise(F.concat("p_type", k % 4))
    return R.query_terms(table(spark, sf, "part").select(F.col("p_size").alias("profile"), first.alias("priority"), F.concat(F.lit("s"), first).alias("source"), k.alias("ordinal"), term.alias("term")), 3)


@query("SELECT p_partkey, 'a b ' || p_size AS clean, ['topics.id:T' || p_size, 'concepts.id:C' || p_partkey, 'title_and_abstract.search:x ' || p_size || '|y'] AS filters FROM part")
def filter_clauses(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    topics = F.array(F.concat(F.lit(" t"), size), F.concat(F.lit("https://openalex.org/C"), k), F.concat(F.lit("x:|"), size), F.lit("y "), F.lit(",:"))
    return table(spark, sf, "part").select("p_partkey", R.filter_text(F.concat(F.lit("a,|:b  "), size)).alias("clean"), R.topic_filters(topics).alias("filters"))


@query("""SELECT item_id AS file, n, CASE n WHEN 1 THEN 'k' || item_id WHEN 2 THEN 'm' ELSE 'entry-3' END AS key, CASE n WHEN 1 THEN '10.1234/A' || item_id WHEN 2 THEN '10.5555/u' END AS doi FROM benchmark, (SELECT unnest([1, 2, 3]) AS n)""")
def bibliography_dois(spark, sf):
    k = F.col("item_id")
    text = F.concat(F.lit("@article{k"), k, F.lit(",\n title={x}, doi = {https://doi.org/10.1234/A"), k, F.lit('}\n}\n@misc(m, url="https://dx.doi.org/10.5555/u")\n@book{ , title={z}}\n@comment{c, doi={10.1/x}}'))
    return R.bibliography_dois(table(spark, sf, "benchmark").select(k.alias("file"), text.alias("text")))


@query("""SELECT p_partkey AS paper, E'TY  - JOUR\\nTI  - ' || p_name || CASE WHEN p_partkey % 3 <> 0 THEN E'\\nAU  - ' || p_brand || E'\\nAU  - B' ELSE '' END || E'\\nPY  - ' || (2000 + p_size) || CASE WHEN p_partkey % 2 = 0 THEN E'\\nDO  - 10.1000/' || p_partkey || E'\\nUR  - https://doi.org/10.1000/' || p_partkey ELSE '' END || E'\\nER  - ' AS ris,
CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE 'Unknown' END || ' et al., n.d. (' || (2000 + p_size) || ')' AS plain,
'{"id":"' || p_partkey || '","type":"article-journal","title":"' || p_name || '"' || CASE WHEN p_partkey % 3 <> 0 THEN ',"author":[{"family":"' || p_brand || '"},{"family":"B"}]' ELSE '' END || ',"issued":{"date-parts":[[' || (2000 + p_size) || ']]}' || CASE WHEN p_partkey % 2 = 0 THEN ',"DOI":"10.1000/' || p_partkey || '","URL":"https://doi.org/10.1000/' || p_partkey || '"' ELSE '' END || '}' AS csl FROM part""")
def citation_formats(spark, sf):
    k = F.col("p_partkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://x.org/10.1000/"), k)).otherwise("https://x.org/a.pdf")
    own = table(spark, sf, "part").select(k.alias("paper"), F.col("p_name").alias("title"), F.when(k % 3 != 0, F.array("p_brand", F.lit("B"))).alias("authors"), (2000 + F.col("p_size")).alias("year"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("string").alias("doi"), url.alias("url"))
    return R.citations(own)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'https://doi.org/10.1/x' WHEN 2 THEN 'https://openalex.org/W' || p_partkey ELSE '#paper/' || p_partkey END AS node FROM part")
def node_ids(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", R.node_id(F.when(k % 4 == 0, "own"), F.when(k % 4 == 1, "doi:10.1/x"), F.when(k % 4 == 2, F.concat(F.lit(" W"), k)), k).alias("node"))


@query("SELECT doc_id, nullif(left(CASE WHEN regexp_matches(trim(text, ' '), '[.!?](\\s|$)') THEN regexp_extract(trim(text, ' '), '^((?s).*?[.!?])(\\s|$)', 1) ELSE trim(text, ' ') END, 240), '') AS sentence FROM documents")
def first_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.first_sentence("text").alias("sentence"))


@query("SELECT c_custkey AS person, CASE c_custkey % 4 WHEN 0 THEN 'postdoc' WHEN 1 THEN 'professor' ELSE 'unknown' END AS rank, c_custkey % 4 = 0 AS trainee, c_custkey % 2 = 0 AND c_custkey % 4 <> 3 AS self_reported, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 4 = 0 THEN 'trainee' WHEN c_custkey % 3 = 0 THEN 'given' ELSE 'unknown' END AS independence FROM customer")
def career_rules(spark, sf):
    k = F.col("c_custkey")
    rank = F.when(k % 4 == 0, "postdoc").when(k % 4 == 1, "professor").when(k % 4 == 2, "king")
    ranks = F.array(*[F.lit(x) for x in (*R.TRAINEE_RANKS, *R.FACULTY_RANKS)])
    return R.career(table(spark, sf, "customer").select(k.alias("person"), rank.alias("current_rank"), F.when(k % 2 == 0, "self_reported").otherwise("inferred").alias("source"), F.when(k % 3 == 0, "given").alias("independence"), ranks.alias("ranks")))


@query("SELECT p_partkey, substr(sha256(p_name), 1, 16) AS version FROM part")
def paper_versions(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.paper_version("p_name").alias("version"))


@query("SELECT p_partkey AS id, 'sys' AS system, CASE WHEN p_partkey % 2 = 0 THEN n_name END AS label FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 25")
def concept_lookup(spark, sf):
    k = F.col("p_partkey")
    asked = table(spark, sf, "part").select(k.alias("id"), F.lit("sys").alias("system"), F.when(k % 2 == 0, F.concat(F.lit(" c"), k % 25)).otherwise("none").alias("code"))
    return R.concepts(asked, table(spark, sf, "nation").select(F.lit("sys").alias("system"), F.concat(F.lit("C"), "n_nationkey").alias("code"), F.col("n_name").alias("label"))).drop("code")


@query("WITH p AS (SELECT c_custkey AS profile_id, 'r' || (c_custkey % 50) AS rid FROM customer), a AS (SELECT s_suppkey AS k, 'r' || s_suppkey AS rid, CASE WHEN s_suppkey % 3 = 0 THEN 'r' || (s_suppkey % 50) ELSE 'r' || s_suppkey END AS now FROM supplier) SELECT a.rid, row_number() OVER (PARTITION BY a.rid ORDER BY profile_id) AS n, profile_id FROM a JOIN p ON p.rid = a.now")
def records_about(spark, sf):
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    own = table(spark, sf, "customer").select(k.alias("profile_id"), F.concat(F.lit("r"), k % 50).alias("rid"))
    sup = table(spark, sf, "supplier")
    return R.records_about(own, sup.where("s_suppkey % 3 = 0").select(F.concat(F.lit("r"), s).alias("old"), F.concat(F.lit("r"), s % 50).alias("new")), sup.select(F.concat(F.lit("r"), s).alias("rid")))


@query("SELECT DISTINCT 'a' || (c_custkey % 20) || '@x.org' AS email, 'r' || c_custkey AS rid FROM customer WHERE c_custkey % 20 < 3")
def rids_with_email(spark, sf):
    k = F.col("c_custkey")
    own = table(spark, sf, "customer").select(F.concat(F.lit("r"), k).alias("rid"), F.concat(F.lit(" A"), k % 20, F.lit("@X.org ")).alias("email"))
    return R.rids_with_email(own, spark.createDataFrame([("A0@x.org",), (" a1@x.org",), ("a2@X.ORG",), (" ",)], "email string"))


@query("SELECT doc_id, embedding IS NOT NULL AS has FROM documents JOIN embeddings ON vec_id = doc_id")
def chunks_with_vectors(spark, sf):
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return R.join_vectors(table(spark, sf, "documents").select("doc_id"), vec, "doc_id").select("doc_id", F.col("embedding").isNotNull().alias("has"))


@query(f"WITH {PAPERS} SELECT paper, year, row_number() OVER (ORDER BY year DESC NULLS LAST, paper) AS place FROM pp QUALIFY place <= 25")
def papers_by_year(spark, sf):
    top = R.by_year(papers(spark, sf)).select("paper", "year").limit(25)
    from ..operators.lexical import ranked

    return ranked(top, F.col("year").desc_nulls_last(), "paper", out="place", top=25)
