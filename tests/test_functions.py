"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lorespark.functions import ids as I
from lorespark.functions import text as T
from lorespark.functions import tiers, vectors


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(
    ("name", "key"),
    [("Jane A. Doe", "doe j"), ("J. Doe", "doe j"), ("Doe, Jane", "doe j"), ("Jane Doe Jr", "doe j"), ("Plato", "plato"), ("", None), ("  ", None), ("Jane Doe PhD MD", "doe j")],
)
def test_name_key(spark, name, key):
    assert one(spark, I.name_key(F.lit(name)))[0] == key
    assert I._name_key(name) == key


def test_name_key_folds_marks():
    assert I._name_key("José Núñez") == "nunez j"


def test_identifiers(spark):
    r = one(
        spark,
        I.normalize_doi(F.lit(" https://doi.org/10.1/Ab")), I.normalize_doi(F.lit("doi:10.1/Ab"), True), I.normalize_doi(F.lit("  ")),
        I.normalize_pmid(F.lit("PMID: 12")), I.normalize_pmid(F.lit("x")), I.normalize_pmcid(F.lit("PMCPMC9")), I.normalize_arxiv(F.lit("arXiv:2401.1v2/")),
        I.orcid_valid(F.lit("0000-0002-1825-0097")), I.orcid_valid(F.lit("0000-0002-1825-0098")), I.orcid_valid(F.lit(None).cast("string")), I.is_rid(F.lit("local:a-b-00ff11")),
    )
    assert list(r) == ["10.1/Ab", "10.1/ab", None, "12", None, "PMC9", "2401.1", True, False, False, True]


def test_keys(spark):
    r = one(spark, I.work_key(F.lit(None), F.lit("https://x/W5"), F.lit("p")), I.work_key(F.lit(None), F.lit(None), F.lit(" P ")), I.institution_key(F.lit(None), F.lit("Ab C.")), I.slug(F.lit("--A  b!")), I.slug(F.lit("!!")))
    assert list(r) == ["openalex:w5", "paperid:p", "inst:abc", "a-b", "person"]


def test_inverted_index(spark):
    m = F.create_map(F.lit("b"), F.array(F.lit(0), F.lit(4)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, T.decode_inverted_index(m))[0] == "a a b"


def test_truncate(spark):
    assert one(spark, T.truncate_words(F.lit("abcd efgh ij"), 11), T.truncate_words(F.lit("a bcdefghijkl"), 8), T.truncate_words(F.lit("ab"), 8))[:] == ("abcd efgh", "a bcdefg", "ab")


def test_tiers(spark):
    r = one(spark, tiers.most_restrictive(F.lit("limited"), F.lit(None).cast("string"), F.lit("odd")), tiers.narrow_viewer(F.lit("private"), F.lit("limited")), tiers.allows(F.lit("public"), F.lit("limited")), tiers.role_tier(F.lit("cv")), tiers.role_tier(F.lit("x")))
    assert list(r) == ["limited", "limited", False, "private", "public"]


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    z = F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, vectors.norm(a), vectors.unit(a), vectors.cosine(a, z), vectors.hit_score(F.lit(-2.0)))
    assert list(r) == [5.0, [0.6, 0.8], 0.0, 0.0]


def test_chunks():
    text = "lead\n\n## A\n\nbody one [smith2020ab]\n\n## B\n\n[smith2020ab]\n"
    got = T.markdown_chunks(text)
    assert [(c["section"], c["embed_text"]) for c in got] == [(None, "lead"), ("A", "A\n\nbody one")]
    assert got[1]["text"].endswith("[smith2020ab]")
    assert T.markdown_chunks("") == []
    long = "## A\n\n" + "### X\n\n" + "a " * 1200 + "\n\n### Y\n\nb"
    assert [c["section"] for c in T.markdown_chunks(long)] == ["A / X", "A / Y"]


def test_windows():
    text = ("word " * 100).strip() + "\n\n" + "x" * 50 + "\n\n" + ("long " * 600).strip()
    spans = T.passage_windows(text)
    assert all(0 < e - s <= 1200 for s, e in spans)
    assert spans[0] == (0, 499)
    assert T.passage_windows("") == []


def test_sections_and_pages():
    got = T.sections("# A\nx\n## B\n# A\n")
    assert [(s["name"], s["offset"], s["length"]) for s in got] == [("A", 0, 6), ("B", 6, 5), ("A (2)", 11, 4)]
    page, nxt = T.text_page("aa\n\nbb\n\ncc", 0, 7)
    assert (page, nxt) == ("aa\n\n", 4)
    assert T.text_page("ab", 0, 7) == ("ab", None)
