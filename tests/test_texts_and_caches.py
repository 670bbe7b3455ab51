"""Export texts, FOAF nodes, kept graphs and centroids, listings."""

import json

import pytest
from pyspark.sql import functions as F

from lorespark.operators import caches, export_text, listings, ranking

PEOPLE = """profile int, name string, rid string, job_title string, affiliation string, url string, summary string, field string, subfields array<string>, expertise array<string>, interests array<string>, not_interests array<string>, commitments array<string>,
career array<struct<role:string,institution:string,start_year:int,end_year:int>>, training array<struct<degree:string,field:string,institution:string,year_end:int>>, expertise_doc string, soul string"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def people(spark):
    full = (1, "Ada", "0000-0002-1825-0097", "Professor", "Lab", "https://x.org", " Sums. ", "Maths", ["a", " ", "b "], ["engines"], ["notes (+1)"], ["noise (-0.5)"], ["rigour"], [("Chair", "Lab", 2001, None), ("Fellow", "Old", None, None), ("Guest", "Far", None, 1999)], [("PhD", None, "U", 1998), ("BA", " Arts", "V", None)], "Long.\r\n\r\n\r\n\r\nText.", None)
    return spark.createDataFrame([full, (2, "Bo", "local:bo-abc123", *[None] * 14)], PEOPLE)


def papers(spark):
    made = [(1, 2, "Second ", 2000, "J", "https://doi.org/10.1/B", None, "abstract two"), (1, 1, "First", None, None, None, "---\nx: 1\n---\n[Abstract-only] Its summary.\n", "unused"), (1, 3, "Third", 1999, "", None, "  ", None)]
    return spark.createDataFrame(made, "profile int, place int, title string, year int, journal string, doi string, summary string, abstract string")


TEXT = """# Ada

Professor, Lab
ORCID: 0000-0002-1825-0097
Profile: https://x.org

## Overview

Sums.

## Field

Maths
Subfields: a, b

## Expertise

- engines

## Interests

- notes (+1)

Not interested in: noise (-0.5)

## Methodological commitments

- rigour

## Career

- Chair, Lab (2001-present)
- Fellow, Old
- Guest, Far (-1999)

## Training

- PhD, U (1998)
- BA, Arts, V

## Research narrative

Long.

Text.

## Selected work

### First

Its summary.

### Second

2000 · J · doi:10.1/B

abstract two

### Third

1999
"""


def test_texts_are_whole_and_within_budget(spark):
    bodies = export_text.paper_bodies(papers(spark))
    assert {r["place"]: (r["body"], r["body_source"]) for r in bodies.collect()} == {1: ("Its summary.", "summary"), 2: ("abstract two", "abstract"), 3: (None, "abstract")}
    render = lambda budget: {r["profile"]: (r["text"], r["papers"]) for r in export_text.render(people(spark), bodies, budget).collect()}
    got = render(None)
    assert got[1] == (TEXT, 3) and got[2] == ("# Bo\n", 0)
    assert render(len(TEXT))[1] == (TEXT, 3)
    less = TEXT[: TEXT.index("\n\n### Third")] + "\n"
    assert render(len(TEXT) - 1)[1] == (less, 2) and render(len(less))[1] == (less, 2) and render(len(less) - 1)[1][1] == 1
    head = TEXT[: TEXT.index("\n\n## Selected work")] + "\n"
    assert render(5)[1] == (head, 0)


def test_signed_labels_and_hashes(spark):
    own = spark.createDataFrame([(1, 2, " b", 0.25), (1, 1, "a", 1.0), (1, 3, "c", -0.5), (1, 4, "d", 0.0), (1, 5, "e", None)], "profile int, position int, label string, weight double")
    assert rows(export_text.signed_labels(own)) == [(1, ["a (+1)", "b (+0.25)"], ["c (-0.5)"])]
    df = spark.createDataFrame([("x", 1)], "b string, a int")
    one, two = (df.select(export_text.content_hash(df, *c).alias("h")).first()["h"] for c in (("a", "b"), ("b", "a")))
    assert one == two and one.startswith("sha256:") and len(one) == 71


def test_foaf(spark):
    who = spark.createDataFrame([(1, "#me", 'A "q"'), (2, None, "B")], "profile int, iri string, name string")
    nodes = spark.createDataFrame([(1, 1, '{"@id":"y"}'), (1, 0, '{"@id":"x"}')], "profile int, position int, node string")
    got = {r["profile"]: json.loads(r["node"]) for r in export_text.foaf(who, nodes).collect()}
    assert got[1]["foaf:topic_interest"] == [{"@id": "x"}, {"@id": "y"}] and got[1]["foaf:name"] == 'A "q"' and got[1]["@id"] == "#me"
    assert got[2]["foaf:topic_interest"] == [] and got[2]["@id"] is None and got[2]["@type"] == "foaf:Person"


def test_a_graph_is_built_once(spark, tmp_path):
    path, built = str(tmp_path / "graph"), []

    def build(n):
        built.append(n)
        return spark.range(n).withColumnRenamed("id", "person"), spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))

    assert caches.load_graph(spark, path) is None
    assert caches.graph(spark, path, "h1", lambda: build(3))[1].count() == 3
    assert caches.graph(spark, path, "h1", lambda: build(4))[1].count() == 3 and built == [3]
    assert caches.graph(spark, path, "h2", lambda: build(5))[0].count() == 5 and built == [3, 5]
    assert caches.load_graph(spark, path, "h1") is None and caches.load_graph(spark, path)[0].count() == 5
    assert len([p for p in (tmp_path / "graph").iterdir() if not p.name.startswith(".")]) == 2
    # a build that fails leaves what is there
    with pytest.raises(Exception, match="lost"):
        caches.save_graph(spark.range(1).select(F.raise_error(F.lit("lost")).alias("person")), spark.range(1), path, "h3")
    assert caches.load_graph(spark, path, "h2")[0].count() == 5


def test_centroids_are_made_again_where_chunks_changed(spark):
    old = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [1.0, 1.0])], "profile int, chunk_id int, v array<double>")
    now = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (2, 2, [1.0, 0.0]), (4, 1, [0.0, -2.0])], old.schema)
    kept = ranking.centroids(old).join(caches.chunk_digests(old), "profile").withColumn("vec", F.array(F.lit(9.0), F.lit(9.0)))
    got = {r["profile"]: [round(x, 6) for x in r["vec"]] for r in caches.refresh_centroids(kept, now).collect()}
    assert got == {1: [9.0, 9.0], 2: [0.707107, 0.707107], 4: [0.0, -1.0]}
    assert rows(caches.chunk_digests(now.repartition(3))) == rows(caches.chunk_digests(now.orderBy(F.desc("chunk_id"))))


def test_listings(spark):
    p = spark.createDataFrame([(1, 2000, True, None), (2, None, False, True), (3, 2010, None, False)], "paper int, year int, has_text boolean, contaminated boolean")
    got = lambda **k: [rows(x.select("paper")) for x in listings.filter_papers(p, **k)]
    assert got() == [[(1,), (3,)], []] and got(since=2005)[0] == [(3,)] and got(until=2005, contaminated=None)[0] == [(1,)] and got(has_text=True)[0] == [(1,)]
    assert got(ids=[2, 3, 9, 9], contaminated=None) == [[(2,), (3,)], [(9,)]] and got(ids=[]) == [[], []]
    e = spark.createDataFrame([(1, 2, "x"), (3, 1, "y"), (4, 5, "z")], "src int, dst int, t string")
    who = lambda *xs: spark.createDataFrame([(x,) for x in xs], "person int")
    assert rows(listings.edges_between(e, who(1), who(2, 3, 4))) == [(1, 2, "x"), (3, 1, "y")] and listings.edges_between(e, who(9), who(1)).count() == 0
    v = spark.createDataFrame([("a", 2, [1.0]), ("a", 1, [2.0])], "k string, n int, v array<double>")
    assert rows(listings.merge_sets(v, "k", "n", F.size("v")).select("n")) == [(1,)]
    with pytest.raises(ValueError):
        listings.merge_sets(v.union(spark.createDataFrame([("b", 1, [1.0, 2.0])], v.schema)), "k", "n", F.size("v"))
    who = spark.createDataFrame([(" Bio ", 1), ("art", 2)], "field string, n int")
    assert listings.filter_profiles(who, {"field": "bio"}, {"n": [1, 3]}, [F.col("n") > 0]).count() == 1 and listings.filter_profiles(who).count() == 2
