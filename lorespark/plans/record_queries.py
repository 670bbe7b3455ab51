"""Interests, paging, listings, statistics, differences, identity and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import diffs as D
from ..operators import matching as M
from ..operators import identity as ID
from ..operators import interests as N
from ..operators import listings as LS
from ..operators import paging as PG
from ..operators import profiles as P
from .standins import ARTIFACTS, EFFECTIVE, INTERESTS, PAPERS, TOPICS, artifacts, interests, papers, table, topics

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


@query(f"WITH {TOPICS}, n AS (SELECT profile, count(DISTINCT paper) AS papers FROM tp GROUP BY 1), c AS (SELECT profile, topic, count(*) AS n FROM tp GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY profile ORDER BY n DESC, topic) AS INTEGER) AS rank FROM c) SELECT r.profile, topic, r.n, rank, papers, round(r.n / papers, 6) AS share FROM r JOIN n USING (profile) WHERE rank <= 15 AND r.n / papers >= 0.05")
def topic_prevalence(spark, sf):
    return N.topic_prevalence(topics(spark, sf)).select("profile", "topic", "n", "rank", "papers", F.round("share", 6).alias("share"))


@query("WITH t AS (SELECT l_suppkey AS profile, l_orderkey * 10 + l_linenumber AS ordinal, p_brand AS topic FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT profile, topic, count(*) AS n, min(ordinal) AS first FROM t GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile ORDER BY n DESC, first) AS INTEGER) AS rank FROM c) WHERE rank <= 10")
def top_seed_topics(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    own = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_suppkey").alias("profile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("p_brand").alias("topic"))
    return N.top_topics(own)


@query(f"WITH {INTERESTS}, {EFFECTIVE} SELECT profile, concept, position, ordinal, weight, method FROM ef")
def effective_interests(spark, sf):
    return N.effective(interests(spark, sf)).select("profile", "concept", "position", "ordinal", "weight", "method")


@query(f"WITH {INTERESTS}, {EFFECTIVE} SELECT profile, coalesce(list(label ORDER BY position) FILTER (weight > 0), []) AS interests, coalesce(list(label ORDER BY position) FILTER (weight < 0), []) AS not_interests FROM ef GROUP BY 1")
def interest_projection(spark, sf):
    return N.project(N.effective(interests(spark, sf)))


@query(f"WITH {INTERESTS} SELECT profile, CASE WHEN weight IS NULL THEN 'unrated' WHEN weight <= -1 THEN 'never' WHEN weight < 0 THEN 'lower' WHEN weight = 0 THEN 'neutral' WHEN weight >= 1 THEN 'core' ELSE 'interested' END AS band, count(*) AS n FROM it GROUP BY 1, 2")
def interest_bands(spark, sf):
    return interests(spark, sf).select("profile", N.band("weight").alias("band")).groupBy("profile", "band").agg(F.count(F.lit(1)).alias("n"))


TSC = f"{INTERESTS}, {EFFECTIVE}, wk AS (SELECT DISTINCT l_orderkey AS work, upper(p_brand) AS code FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"WITH {TSC} SELECT profile, work, CASE WHEN coalesce(bool_or(method = 'declared' AND weight <= -1), FALSE) THEN NULL ELSE round(sum(CASE WHEN method = 'declared' AND weight IS NOT NULL THEN weight ELSE 0.5 * coalesce(share, 0.0) END), 6) + 0.0 END AS topic_score FROM wk JOIN ef ON wk.code = upper(ef.code) AND ef.ordinal % 8 <> 0 GROUP BY 1, 2")
def topic_score(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    works = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("work"), F.concat(F.lit("https://x.org/T/"), F.lower("p_brand")).alias("topic"))
    own = N.effective(interests(spark, sf)).where("code is not null").select("profile", "system", F.upper("code").alias("code"), "weight", "method", "share", (F.col("ordinal") % 8 == 0).alias("unmapped"))
    return N.topic_score(works, own, "sys").withColumn("topic_score", F.round("topic_score", 6) + 0.0)


@query("WITH t AS (SELECT p_size AS profile, p_partkey AS ordinal, trim(p_type) AS label, p_partkey % 3 <> 0 AS positive FROM part) SELECT profile, ordinal, label, CASE WHEN positive THEN 0.5 ELSE -0.5 END::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY profile, lower(label) ORDER BY positive DESC, ordinal) AS r FROM t) WHERE r = 1")
def interests_from_text(spark, sf):
    k = F.col("p_partkey")
    return N.from_text(table(spark, sf, "part").select(F.col("p_size").alias("profile"), k.alias("ordinal"), F.concat(F.lit(" "), F.col("p_type")).alias("label"), (k % 3 != 0).alias("positive")))


@query("SELECT p_partkey AS id, 'old' AS batch FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey % 10 = 0")
def merge_generated_interests(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("id"), F.when(k % 3 == 0, "declared").otherwise("inferred").alias("method"), F.when(k % 2 == 0, "gen/1").otherwise("hand").alias("generator"), F.lit("old").alias("batch"))
    return N.replace_generated(rows, rows.where("id % 10 = 0").withColumn("batch", F.lit("new")), "gen/").select("id", "batch")


@query(f"WITH {INTERESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY coalesce(weight, 0) DESC, ordinal) AS r FROM it) SELECT profile, list(label ORDER BY r) FILTER (r <= 8) AS labels, count(*) AS total FROM r GROUP BY 1")
def record_view(spark, sf):
    return P.top_interests(interests(spark, sf))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE -year(o_orderdate) > -1997 OR (-year(o_orderdate) = -1997 AND o_orderkey > 500) ORDER BY -year(o_orderdate), o_orderkey LIMIT 20")
def keyset_page(spark, sf):
    filters = {"q": None}
    after = PG.read_token(PG.make_token([-1997, 500], filters), filters)
    return PG.keyset_page(table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), "year", "o_orderkey", 20, after)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50")
def number_page(spark, sf):
    return PG.number_page(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 2, 25)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS total_pages FROM customer")
def page_totals(spark, sf):
    return PG.total_pages(table(spark, sf, "customer"), 25)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) = 'building' AND c_nationkey IN (1, 2, 3) AND c_acctbal > 0")
def list_filter(spark, sf):
    own = LS.filter_profiles(table(spark, sf, "customer"), {"c_mktsegment": " Building"}, {"c_nationkey": [1, 2, 3]}, [F.col("c_acctbal") > 0])
    return own.select("c_custkey", "c_name", "c_mktsegment")


@query(f"WITH {PAPERS} SELECT paper, year, has_text FROM pp WHERE year >= 2015 AND has_text AND NOT contaminated")
def papers_filter(spark, sf):
    return LS.filter_papers(papers(spark, sf), since=2015, has_text=True)[0].select("paper", "year", "has_text")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 3, 9)")
def batch_read(spark, sf):
    return PG.batch_read(table(spark, sf, "customer").select("c_custkey", "c_name"), " 5,3 ,, 9,5", "c_custkey").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '1') ORDER BY n_name")
def inventory_search(spark, sf):
    return PG.text_search_sort(table(spark, sf, "nation").select("n_nationkey", "n_name"), "1", ["n_name"], "n_name")


@query("""WITH p AS (SELECT c_custkey AS profile_id, 'slug' || c_custkey AS slug, 'r' || (c_custkey % 1000) AS rid FROM customer), one AS (SELECT rid, min(profile_id) AS id FROM p GROUP BY 1 HAVING count(*) = 1),
a AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'slug' || s_suppkey WHEN 1 THEN 'was' || s_suppkey WHEN 2 THEN 'r' || (s_suppkey + 500) ELSE 'nobody' || s_suppkey END AS ref FROM supplier)
SELECT ref, CASE s_suppkey % 4 WHEN 2 THEN (SELECT id FROM one WHERE rid = ref) ELSE s_suppkey END AS profile_id, CAST(CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INTEGER) AS step FROM a WHERE s_suppkey % 4 < 2 OR (s_suppkey % 4 = 2 AND ref IN (SELECT rid FROM one))""")
def point_lookup(spark, sf):
    c, s = table(spark, sf, "customer"), F.col("s_suppkey")
    prof = c.select(F.col("c_custkey").alias("profile_id"), F.concat(F.lit("slug"), F.col("c_custkey")).alias("slug"), F.concat(F.lit("r"), F.col("c_custkey") % 1000).alias("rid"))
    sup = table(spark, sf, "supplier")
    asked = sup.select(F.when(s % 4 == 0, F.concat(F.lit("slug"), s)).when(s % 4 == 1, F.concat(F.lit("was"), s)).when(s % 4 == 2, F.concat(F.lit("r"), s + 500)).otherwise(F.concat(F.lit("nobody"), s)).alias("ref"))
    slugs = sup.select(F.concat(F.lit("was"), s).alias("old_slug"), s.alias("profile_id"))
    rids = spark.createDataFrame([("old", "r1")], "old_rid string, new_rid string")
    return PG.point_lookup(asked, prof, slugs, rids)


@query(f"WITH {PAPERS} SELECT profile, paper, year, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY year DESC, CASE WHEN corresponding THEN 0 WHEN position IN ('first', 'last') THEN 1 ELSE 2 END, paper) AS r FROM pp WHERE year >= 2023) WHERE r <= 10")
def recent_work(spark, sf):
    lead = F.when(F.col("corresponding"), 0).when(F.coalesce(F.col("position").isin("first", "last"), F.lit(False)), 1).otherwise(2)
    own = papers(spark, sf).where(F.col("year") >= T.parse_since("2y", "2025-06-30"))
    return PG.top_items(own, ["profile"], [F.desc("year"), lead, "paper"], 10).select("profile", "paper", "year", "rank")


@query(f"WITH {PAPERS} SELECT profile, count(*) AS papers, round(100 * avg(CAST(has_text AS INTEGER)), 1) AS fulltext_pct, CAST(coalesce(count_if(contaminated), 0) AS BIGINT) AS contaminated FROM pp GROUP BY 1")
def profile_summary(spark, sf):
    own = papers(spark, sf)
    return P.summary_rows(own.select("profile").distinct(), own)


@query(f"WITH {PAPERS} SELECT profile, count(*) AS total, CAST(coalesce(count_if(position = 'first'), 0) AS BIGINT) AS as_first, CAST(coalesce(count_if(position = 'last'), 0) AS BIGINT) AS as_last, CAST(coalesce(count_if(position = 'middle'), 0) AS BIGINT) AS as_middle, CAST(coalesce(count_if(position IS NULL), 0) AS BIGINT) AS unknown, CAST(coalesce(count_if(corresponding), 0) AS BIGINT) AS corresponding, min(year) AS first_year, max(year) AS last_year FROM pp GROUP BY 1")
def paper_stats(spark, sf):
    return P.paper_stats(papers(spark, sf))


@query("SELECT c_nationkey AS profile, count(*) AS total, CAST(coalesce(count_if(c_custkey % 4 = 0), 0) AS BIGINT) AS as_pi, CAST(coalesce(count_if(c_mktsegment = 'BUILDING'), 0) AS BIGINT) AS industry, CAST(coalesce(count_if(c_custkey % 3 = 0), 0) AS BIGINT) AS completed, CASE WHEN count(*) = count(CASE WHEN c_nationkey % 3 <> 0 OR c_custkey % 2 = 0 THEN c_custkey END) THEN CAST(sum(c_custkey) AS BIGINT) END AS enrollment FROM customer GROUP BY 1")
def trial_stats(spark, sf):
    k = F.col("c_custkey")
    return P.trial_stats(table(spark, sf, "customer").select(F.col("c_nationkey").alias("profile"), F.when(k % 4 == 0, "pi").otherwise("sub").alias("role"), F.when(F.col("c_mktsegment") == "BUILDING", "industry").alias("sponsor"), F.when(k % 3 == 0, "completed").alias("status"), F.when((F.col("c_nationkey") % 3 != 0) | (k % 2 == 0), k).alias("enrollment")))


COV = f"""{PAPERS}, up AS (SELECT DISTINCT profile, DATE '2006-01-01' + CAST(length(profile) * 1500 AS INTEGER) AS updated FROM pp),
st AS (SELECT profile, count(*) AS papers, min(year) AS first_year, max(year) AS last_year FROM pp GROUP BY 1),
sd AS (SELECT *, DATE '2024-12-31' - greatest(updated, make_date(CAST(last_year AS BIGINT), 1, 1)) AS d FROM up JOIN st USING (profile)),
sc AS (SELECT *, least(1.0, coalesce(DATE '2024-12-31' - make_date(CAST(last_year AS BIGINT), 1, 1), d) / 365.0) AS score FROM sd),
sl AS (SELECT *, CASE WHEN score < 0.25 THEN 'fresh' WHEN score < 0.75 THEN 'aging' ELSE 'stale' END AS label FROM sc)"""


@query(f"""WITH {COV} SELECT profile, papers, first_year, last_year, CAST(d AS INTEGER) AS days, round(CAST(score AS DOUBLE), 6) AS score, label,
CASE WHEN last_year IS NULL THEN '' ELSE 'Index covers ' || papers || ' papers from ' || first_year || '-' || last_year || '; preprints since then may be missing. ' END
|| 'Profile last refreshed ' || d || ' days ago (label: ' || label || ').' AS caveats FROM sl""")
def profile_coverage(spark, sf):
    own = papers(spark, sf)
    updated = own.select("profile").distinct().withColumn("updated", F.date_add(F.lit("2006-01-01").cast("date"), F.length("profile") * 1500))
    got = P.coverage(own, updated, "2024-12-31")
    return got.select("profile", "papers", "first_year", "last_year", F.col("days_since_update").alias("days"), F.round("score", 6).alias("score"), "label", F.array_join("caveats", " ").alias("caveats"))


@query(f"WITH {PAPERS}, y AS (SELECT *, min(year) OVER (PARTITION BY profile) AS lo, max(year) OVER (PARTITION BY profile) AS hi FROM pp), r AS (SELECT profile, paper, 1.5 * CASE WHEN position IN ('first', 'last') OR corresponding THEN 2 ELSE 1 END + ln(1 + cites) + coalesce((year - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 0) AS raw FROM y) SELECT profile, paper, round((raw - min(raw) OVER (PARTITION BY profile)) / (max(raw) OVER (PARTITION BY profile) - min(raw) OVER (PARTITION BY profile)), 6) AS score FROM r")
def export_scores(spark, sf):
    return P.export_scores(papers(spark, sf)).select("profile", "paper", F.round("score", 6).alias("score"))


@query()
def export_selection(spark, sf):
    return P.select_export(papers(spark, sf))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_summaries(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id AS url, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'stale' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def manifest_drift(spark, sf):
    return D.drift(table(spark, sf, "labels").withColumnRenamed("doc_id", "url"), table(spark, sf, "documents").withColumnRenamed("doc_id", "url"), "url")


OLDNEW = "o AS (SELECT doc_id AS k, sha256(source || '1') AS d FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT doc_id AS k, sha256(source || CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '1' END) AS d FROM documents WHERE doc_id % 5 <> 0)"


def _old_new(spark, sf):
    k, d = F.col("doc_id"), table(spark, sf, "documents")
    digest = lambda x: F.sha2(F.concat(F.col("source"), x).cast("binary"), 256).alias("d")
    return d.where(k % 4 != 0).select(k.alias("k"), digest(F.lit("1"))), d.where(k % 5 != 0).select(k.alias("k"), digest(F.when(k % 3 == 0, "2").otherwise("1")))


@query(f"WITH {OLDNEW} SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.d = n.d THEN 'kept' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.k = n.k")
def chunk_diff(spark, sf):
    old, new = _old_new(spark, sf)
    return D.diff(old, new, ["k"], "d")


@query(f"WITH {OLDNEW}, b AS (SELECT coalesce(o.k, n.k) AS url, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.d = n.d THEN 'kept' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.k = n.k) SELECT url, status, CASE WHEN status IN ('added', 'changed') THEN 'write' WHEN status = 'kept' THEN 'same' WHEN url % 7 = 0 THEN 'keep' ELSE 'remove' END AS action FROM b")
def push_plan(spark, sf):
    old, new = _old_new(spark, sf)
    old = old.select(F.col("k").alias("url"), (F.col("k") % 7).alias("cls"), F.col("d").alias("sha"))
    new = new.select(F.col("k").alias("url"), F.when(F.col("k") % 7 == 0, 1).otherwise(F.col("k") % 7).alias("cls"), F.col("d").alias("sha"))
    return D.push_plan(old, new, "replace")


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS card, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 6 END AS rid, c_custkey // 2 AS base FROM customer),
e AS (SELECT a.card AS x, b.card AS y FROM c a JOIN c b ON a.rid = b.rid OR a.base = b.base), w AS (SELECT x AS card, y AS peer FROM e UNION SELECT w.card, e.y FROM w JOIN e ON w.peer = e.x) SELECT card, min(peer) AS person FROM w GROUP BY 1""")
def card_dedup(spark, sf):
    k = F.col("c_custkey")
    cards = table(spark, sf, "customer").select(k.alias("card"), F.when(k % 3 == 0, F.floor(k / 6)).alias("rid"), F.floor(k / 2).alias("base"))
    return D.card_groups(cards).select("card", "person")


@query("SELECT label AS spec, min(vec_id) AS first FROM embeddings GROUP BY 1")
def centroid_set_merge(spark, sf):
    own = table(spark, sf, "embeddings").select(F.col("label").alias("spec"), "vec_id", "embedding")
    return LS.merge_sets(own, "spec", "vec_id", F.size("embedding")).select("spec", F.col("vec_id").alias("first"))


@query()
def paper_matching(spark, sf):
    k, d = F.col("p_partkey"), table(spark, sf, "part")
    title = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    p = d.select(k.alias("ordinal"), k.alias("paper"), title.alias("title"), F.col("p_size").alias("year"))
    w = d.select(k.alias("work_ordinal"), (-k).alias("work"), F.when(k % 2 == 0, F.upper(title)).otherwise(F.concat(title, F.lit("s"))).alias("work_title"), F.col("p_size").alias("work_year"))
    return M.match_papers(p, w)


@query("SELECT item_id, item_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) AS cited FROM benchmark")
def verify_citations(spark, sf):
    known = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"))
    return LS.verify_citations(table(spark, sf, "benchmark").select("item_id"), known, "item_id")


@query(f"WITH {TOPICS} SELECT DISTINCT profile FROM tp WHERE lower(trim(topic)) IN ('brand#11', 'brand#22')")
def required_topics(spark, sf):
    return LS.claim_topics(topics(spark, sf), ["Brand#11 ", "BRAND#22"])


@query(f"WITH {TOPICS} SELECT lower(trim(topic)) AS topic, count(DISTINCT profile) AS profiles FROM tp GROUP BY 1")
def topic_profiles(spark, sf):
    return LS.topic_profiles(topics(spark, sf))


@query("WITH c AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS behind FROM conversations) SELECT conv_id, turn FROM c WHERE behind <= 2000")
def history_trim(spark, sf):
    """Newest turns of a conversation whose texts fit the budget."""
    return LS.trim_history(table(spark, sf, "conversations"), 2000).select("conv_id", "turn")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'topic' WHEN event_id % 3 = 1 THEN 'text' ELSE 'cites' END AS kind, 'w' || (event_id % 700) AS work FROM events) SELECT work, list_sort(list(DISTINCT kind)) AS found_by, min(event_id) AS first FROM e GROUP BY 1""")
def works_by_query(spark, sf):
    """Union of query streams with provenance: one row a work."""
    k = F.col("event_id")
    own = table(spark, sf, "events").select(k, F.when(k % 3 == 0, "topic").when(k % 3 == 1, "text").otherwise("cites").alias("kind"), F.concat(F.lit("w"), k % 700).alias("work"))
    return LS.union_streams(own, "work", "kind", "event_id")


@query(f"WITH {ARTIFACTS}, a AS (SELECT profile, CASE WHEN page_id % 9 = 0 THEN 'http://x/' || af.url ELSE af.url END AS url, role, paper_id, CASE WHEN page_id % 11 = 0 THEN 'secret' ELSE tier END AS tier, derived_from FROM af JOIN pages ON 'f' || page_id = af.url), r AS (SELECT profile, url, unnest(derived_from) AS ref FROM a) SELECT profile, url AS pointer, 'relative_url' AS keyword FROM a WHERE url LIKE 'http://%' UNION ALL SELECT profile, url, 'enum' FROM a WHERE tier = 'secret' UNION ALL SELECT profile, url, 'derived_from' FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.profile = r.profile AND (a.paper_id = r.ref OR a.role = r.ref))")
def validation_rules(spark, sf):
    n = F.regexp_replace("url", "f", "").cast("long")
    own = artifacts(spark, sf).withColumn("n", n).withColumn("url", F.when(F.col("n") % 9 == 0, F.concat(F.lit("http://x/"), F.col("url"))).otherwise(F.col("url"))).withColumn("tier", F.when(F.col("n") % 11 == 0, "secret").otherwise(F.col("tier"))).drop("n")
    return P.violations(own)


@query("""WITH p AS (SELECT c_custkey AS id, 'rid' || c_custkey AS rid, c_custkey % 500 AS fam, c_custkey % 7 AS g, c_mktsegment AS aff FROM customer),
a AS (SELECT s_suppkey AS q, s_suppkey % 500 AS fam, s_suppkey % 5 AS g, 'BUILDING' AS aff FROM supplier WHERE s_suppkey % 4 <> 0),
j AS (SELECT a.q, p.rid, p.aff = a.aff AS agree FROM a JOIN p ON a.fam = p.fam AND a.g = p.g),
c AS (SELECT q, count(*) AS n, count(*) FILTER (agree) AS n_agree, count(*) FILTER (NOT agree) AS n_conf, min(rid) AS one, min(rid) FILTER (agree) AS one_agree FROM j GROUP BY 1)
SELECT a.q, CASE WHEN n IS NULL THEN 'mint' WHEN (n = 1 AND n_conf = 0) OR (n > 1 AND n_agree = 1) THEN 'bind' ELSE 'defer' END AS outcome, CASE WHEN n = 1 AND n_conf = 0 THEN one WHEN n > 1 AND n_agree = 1 THEN one_agree END AS bound, coalesce(n, 0) AS candidates FROM a LEFT JOIN c USING (q) UNION ALL SELECT s_suppkey, 'refuse', NULL, 0 FROM supplier WHERE s_suppkey % 4 = 0""")
def resolve_people(spark, sf):
    letters = F.array(*[F.lit(x) for x in ("Ada", "Bob", "Cyd", "Dan", "Eve", "Fay", "Gus")])
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    known = table(spark, sf, "customer").select(F.concat(F.lit("rid"), c).alias("rid"), F.concat(F.element_at(letters, (c % 7 + 1).cast("int")), F.lit(" Fam"), c % 500).alias("name"), F.col("c_mktsegment").alias("affiliation"), F.lit("public").alias("tier"))
    asked = table(spark, sf, "supplier").select(s.alias("q"), F.lit(None).cast("string").alias("rid"), F.when(s % 4 == 0, "Unknown Author").otherwise(F.concat(F.lit("FAM"), s % 500, F.lit(", "), F.element_at(letters, (s % 5 + 1).cast("int")))).alias("name"), F.lit("building ").alias("affiliation"))
    out = ID.resolve(asked, known)
    return out.select("q", "outcome", F.when(F.col("outcome") == "bind", F.col("resolved")).alias("bound"), F.when(F.col("outcome") == "refuse", 0).otherwise(F.col("candidates")).alias("candidates"))
