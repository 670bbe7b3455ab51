"""Keyword, chunking and identifier queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..functions import vectors as V
from ..operators import lexical as L
from ..operators import profiles as P
from .standins import table

Q, S = {}, {}
WORDS = "the pathetic for stupid erste que"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


TOK = "tk AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS t FROM documents)"
BM = f"""{TOK}, st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tk) WHERE term IN ('{"', '".join(WORDS.split())}') GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS bm25 FROM tf JOIN df USING (term), st GROUP BY 1)"""


@query(f"WITH {TOK}, tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tk) GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY 1 HAVING count(*) >= 20")
def tokens_df(spark, sf):
    return L.term_counts(table(spark, sf, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).where("df >= 20")


@query(f"WITH {BM} SELECT id, round(bm25, 6) AS bm25 FROM bm WHERE bm25 > 0")
def bm25_documents(spark, sf):
    return L.bm25(table(spark, sf, "documents"), WORDS).select("id", F.round("bm25", 6).alias("bm25"))


RRF = f"""{BM}, kw AS (SELECT id, row_number() OVER (ORDER BY round(bm25, 9) DESC, id) AS rank FROM bm), q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
se AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS rank FROM (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.q), 4) AS c FROM embeddings, q) WHERE c >= 0.05)"""


@query(f"WITH {RRF} SELECT coalesce(se.id, kw.id) AS id, round(coalesce(1.0 / (60 + se.rank), 0.0) + coalesce(1.0 / (60 + kw.rank), 0.0), 6) AS score, concat_ws('+', CASE WHEN kw.id IS NOT NULL THEN 'keyword' END, CASE WHEN se.id IS NOT NULL THEN 'semantic' END) AS matched_by FROM se FULL JOIN kw ON se.id = kw.id")
def rrf_hybrid(spark, sf):
    from .standins import query_vector

    kw = L.ranked(L.bm25(table(spark, sf, "documents"), WORDS).withColumn("b", F.round("bm25", 9)), F.desc("b"), "id").select("id", "rank")
    sem = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.round(V.cosine(V.doubles("embedding"), query_vector(spark, sf)), 4).alias("c")).where("c >= 0.05")
    return L.fuse(L.ranked(sem, F.desc("c"), "id").select("id", "rank"), kw).select("id", "score", "matched_by")


STOP = ", ".join(f"'{w}'" for w in L.PHRASE_STOPWORDS)
PH = f"""ws AS (SELECT doc_id AS id, list_transform(list_filter(list_transform(string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s-]+', ' | ', 'g'), E' \\n\\t'), '\\s+'), lambda w: regexp_replace(w, '^-+|-+$', '', 'g')), lambda w: w <> ''), lambda w: CASE WHEN w = '|' OR w IN ({STOP}) OR regexp_full_match(w, '[0-9]+') OR length(w) < 2 THEN '|' ELSE w END) AS w FROM documents),
gr AS (SELECT DISTINCT id, p FROM (SELECT id, w[i] || ' ' || w[i + 1] AS p FROM ws, LATERAL (SELECT unnest(range(1, len(w))) AS i) UNION ALL SELECT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM ws, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)) WHERE NOT contains(p, '|'))"""


@query(f"WITH {PH} SELECT p AS phrase, count(*) AS papers FROM gr GROUP BY 1 HAVING count(*) >= 5")
def phrase_counts(spark, sf):
    return L.phrases(table(spark, sf, "documents")).where("papers >= 5")


@query()
def key_phrases(spark, sf):
    return L.key_phrases(table(spark, sf, "documents"))


@query()
def chunk_markdown(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.chunk_markdown("text")).alias("c")).select("doc_id", "c.chunk_index", "c.section", F.length("c.text").alias("chars"), F.sha2("c.embed_text", 256).alias("digest"))


@query()
def passages(spark, sf):
    """Best window of each document for a query, by overlap of distinct query terms."""
    wanted = F.array(*[F.lit(w) for w in WORDS.split()])
    win = table(spark, sf, "documents").select("doc_id", "text", F.explode(T.windows_of("text")).alias("w")).select("doc_id", "w.start", F.expr("substring(text, w.start + 1, w.end - w.start)").alias("body"))
    scored = win.where(F.length(F.trim("body")) >= T.MIN_BODY).withColumn("hits", F.size(F.array_intersect(T.tokens("body"), wanted)))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("start", "body", "hits"), F.struct("hits", -F.col("start"))).alias("b"))
    return best.where("b.hits > 0").select("doc_id", "b.start", "b.hits", T.truncate_words("b.body").alias("snippet"))


@query()
def section_windows(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(T.sections_of(F.concat(F.lit("# Top\n"), F.regexp_replace("text", r"\n", "\n## Part\n")))).alias("s")).select("doc_id", "s.*")


@query("""SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(d), '(?i)^(https?://)?(dx\\.)?doi\\.org/', ''), '(?i)^doi:', ''), '^/+', '')), '') AS doi,
CASE WHEN regexp_full_match(trim(regexp_replace(trim(p), '(?i)^(https?://(www\\.)?ncbi\\.nlm\\.nih\\.gov/pubmed/|pmid:)', '')), '[0-9]+') THEN trim(regexp_replace(trim(p), '(?i)^(https?://(www\\.)?ncbi\\.nlm\\.nih\\.gov/pubmed/|pmid:)', '')) END AS pmid,
'PMC' || doc_id AS pmcid, '24' || (10 + doc_id % 3) || '.' || (10000 + doc_id) AS arxiv
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' https://doi.org/10.1/A' || doc_id WHEN 1 THEN 'DOI:10.2/' || doc_id WHEN 2 THEN 'dx.doi.org//10.3/x' ELSE ' ' END AS d, CASE doc_id % 3 WHEN 0 THEN 'PMID: ' || doc_id WHEN 1 THEN 'https://www.ncbi.nlm.nih.gov/pubmed/' || doc_id ELSE 'x' || doc_id END AS p FROM documents)""")
def normalize_ids(spark, sf):
    k = F.col("doc_id")
    d = F.when(k % 4 == 0, F.concat(F.lit(" https://doi.org/10.1/A"), k)).when(k % 4 == 1, F.concat(F.lit("DOI:10.2/"), k)).when(k % 4 == 2, F.lit("dx.doi.org//10.3/x")).otherwise(F.lit(" "))
    p = F.when(k % 3 == 0, F.concat(F.lit("PMID: "), k)).when(k % 3 == 1, F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pubmed/"), k)).otherwise(F.concat(F.lit("x"), k))
    return table(spark, sf, "documents").select("doc_id", I.normalize_doi(d).alias("doi"), I.normalize_pmid(p).alias("pmid"), I.normalize_pmcid(F.concat(F.lit("PMCID: pmcPMC"), k)).alias("pmcid"), I.normalize_arxiv(F.concat(F.lit("arXiv:24"), 10 + k % 3, F.lit("."), 10000 + k, F.lit("v2"))).alias("arxiv"))


@query("""WITH o AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 15, '0') AS d, c_custkey % 11 AS given FROM customer),
t AS (SELECT *, list_reduce(list_prepend(0, list_transform(string_split(d, ''), lambda x: CAST(x AS INTEGER))), lambda a, x: (a + x) * 2 % 11) AS r FROM o)
SELECT c_custkey, (12 - r) % 11 = given AS ok FROM t""")
def orcid_checksum(spark, sf):
    d = F.lpad((F.col("c_custkey") * 7919).cast("string"), 15, "0")
    last = F.when(F.col("c_custkey") % 11 == 10, "X").otherwise((F.col("c_custkey") % 11).cast("string"))
    orcid = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4), F.concat(F.substring(d, 13, 3), last))
    return table(spark, sf, "customer").select("c_custkey", I.orcid_valid(orcid).alias("ok"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM documents")
def normalize_title(spark, sf):
    return table(spark, sf, "documents").select("doc_id", I.normalize_title("text").alias("title"))


@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 100) AS head FROM documents), s AS (SELECT *, length(head) - strpos(reverse(head), ' ') AS sp FROM h)
SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN contains(head, ' ') AND sp > 50 THEN left(head, sp) ELSE head END AS snippet FROM s""")
def truncate_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_words("text", 100).alias("snippet"))


@query("SELECT p_partkey, 'surname' || p_size || ' ' || chr(CAST(97 + p_partkey % 26 AS INTEGER)) AS key FROM part")
def name_keys(spark, sf):
    k, first = F.col("p_partkey"), F.char((97 + F.col("p_partkey") % 26).cast("long"))
    last = F.concat(F.lit("Surname"), F.col("p_size"))
    name = F.when(k % 4 == 0, F.concat(first, F.lit(". A. "), last)).when(k % 4 == 1, F.concat(last, F.lit(", "), first, F.lit("ana"))).when(k % 4 == 2, F.concat(F.upper(first), F.lit("ana "), last, F.lit(" Jr. PhD"))).otherwise(F.concat(F.lit("  "), first, F.lit("o Q "), F.upper(last)))
    return table(spark, sf, "part").select("p_partkey", I.name_key(name).alias("key"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'doi:10.1/X' || p_partkey WHEN 1 THEN 'openalex:w' || p_partkey ELSE 'paperid:p' || p_partkey END AS key FROM part")
def work_keys(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", I.work_key(F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1/X"), k)), F.when(k % 3 == 1, F.concat(F.lit("https://openalex.org/W"), k)), F.concat(F.lit(" P"), k, F.lit(" "))).alias("key"))


@query("SELECT c_custkey, 'local:' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || '-customer-' || substr(sha256(lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' customer'), 1, 6) AS rid FROM customer")
def minted_rids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", I.minted_rid(I.name_identity(F.concat(F.lit("Customer #"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))["mint_key"]).alias("rid"))


@query("""WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM documents)
SELECT doc_id, array_to_string(w, ' ') AS abstract FROM w""")
def decode_inverted_index(spark, sf):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    own = table(spark, sf, "documents").select("doc_id", F.posexplode(words).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps"))
    index = own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return index.select("doc_id", T.decode_inverted_index("m").alias("abstract"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) AS openalex_id, event_type AS title, CAST(year(ts) AS INTEGER) AS year FROM events WHERE event_id % 5 <> 0""")
def parse_works(spark, sf):
    k = F.col("event_id")
    raw = F.to_json(F.struct(F.concat(F.lit("https://x.org/"), k).alias("id"), F.col("event_type").alias("title"), F.when(k % 5 != 0, F.year("ts")).alias("publication_year")))
    return P.parse_works(table(spark, sf, "events").select(raw.alias("json"))).select(F.col("openalex_id").cast("long").alias("event_id"), "openalex_id", "title", "year")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND length(text) < 49 THEN ['nul', 'control_characters'] WHEN doc_id % 4 = 0 THEN ['nul'] WHEN doc_id % 4 = 1 THEN ['pdf_header'] ELSE CAST([] AS VARCHAR[]) END AS problems FROM documents")
def text_problems(spark, sf):
    own = table(spark, sf, "documents")
    bad = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit("\x00"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("%PDF-1.4 "), F.col("text"))).otherwise(F.col("text"))
    return own.select("doc_id", T.artifact_problems(bad).alias("problems"))


@query("SELECT item_id, 'body ' || item_id AS clean, CASE WHEN item_id % 2 = 0 THEN ['10.1234/ab' || item_id, 'W' || item_id] ELSE ['W' || item_id] END AS refs FROM benchmark")
def citations_and_refs(spark, sf):
    k = F.col("item_id")
    text = F.concat(F.lit("---\nx: 1\n---\n\nbody "), k, F.lit(" [smith2020ab, doe2019cd]"))
    refs = F.concat(F.when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1234/ab"), k, F.lit(", "))).otherwise(""), F.lit("https://x.org/w"), k, F.lit(" ; w"), k)
    return table(spark, sf, "benchmark").select("item_id", T.strip_citations(T.strip_frontmatter(text)).alias("clean"), T.split_refs(refs).alias("refs"))


@query("SELECT c_custkey, lower(c_mktsegment) || '-a' AS slug, c_nationkey % 2 = 0 AS same FROM customer")
def backend_specs(spark, sf):
    spec = F.when(F.col("c_nationkey") % 2 == 0, "fastembed:org/mini").otherwise("remote:other/mini")
    return table(spark, sf, "customer").select("c_custkey", I.slugify_backend(F.concat(F.col("c_mktsegment"), F.lit(":/a"))).alias("slug"), I.same_space(F.lit("st:mini"), spec).alias("same"))


@query("SELECT p_partkey AS paper, '@article{' || p_partkey || E',\\n  title={' || p_name || E'},\\n  author={' || p_brand || ' and ' || p_type || E'},\\n  year={' || (2000 + p_size) || '}' || CASE WHEN p_partkey % 3 = 0 THEN E',\\n  journal={' || p_type || '}' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN E',\\n  doi={10.1/' || p_partkey || E'},\\n  url={https://doi.org/10.1/' || p_partkey || '}' WHEN p_partkey % 5 = 0 THEN E',\\n  url={https://x.org/' || p_partkey || '}' ELSE '' END || E'\\n}' AS bibtex FROM part")
def bibtex(spark, sf):
    k = F.col("p_partkey")
    return P.bibtex(table(spark, sf, "part").select(k.alias("paper"), F.col("p_name").alias("title"), (2000 + F.col("p_size")).alias("year"), F.array("p_brand", "p_type").alias("authors"), F.when(k % 3 == 0, F.col("p_type")).alias("venue"), F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k)).alias("doi"), F.when(k % 5 == 0, F.concat(F.lit("https://x.org/"), k)).alias("url")))


@query("""WITH r AS (SELECT p_partkey AS code, p_type AS label, CASE WHEN lower(p_type) = 'promo' THEN 0 WHEN starts_with(lower(p_type), 'promo') THEN 1 WHEN list_contains(string_split(lower(p_type), ' '), 'promo') THEN 2 WHEN lower(p_brand) = 'promo' THEN 3 WHEN contains(lower(p_type), 'promo') OR contains(lower(p_brand), 'promo') THEN 4 END AS rank FROM part)
SELECT code, label, CAST(rank AS INTEGER) AS rank FROM r WHERE rank IS NOT NULL ORDER BY rank, label, code LIMIT 20""")
def vocabulary_search(spark, sf):
    return P.vocabulary_search(table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("label"), F.array("p_brand").alias("synonyms")), "PROMO")
