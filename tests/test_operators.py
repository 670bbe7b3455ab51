"""Operators on small cases."""

import pytest
from pyspark.sql import functions as F

from lorespark.operators import clusters, diffs, graph, identity, interests, lexical, matching, paging, privacy, profiles, ranking
from lorespark.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("n_auth", "n_seed", "share"), [(2, 10, 0.4), (20, 5, 0.077), (100, 10, 0.032), (0, 10, 10 / 13)])
def test_seed_share(spark, n_auth, n_seed, share):
    got = spark.range(1).select(ranking.seed_share(F.lit(n_seed), F.lit(n_auth))).first()[0]
    assert got == pytest.approx(share, abs=1e-3)


def test_only_seeds(spark):
    ch = spark.createDataFrame([(1, 1, "seed_abstract", 7, [0.0, 2.0])], "profile int, chunk_id int, source_type string, source_id int, v array<double>")
    got = ranking.blended_centroids(ch).first()
    assert got["vec"] == [0.0, 1.0]


def test_mmr(spark):
    df = spark.createDataFrame([("a", 1.0, [1.0, 0.0]), ("b", 0.9, [1.0, 0.0]), ("c", 0.5, [0.0, 1.0]), ("d", 0.4, None)], "profile string, score double, vec array<double>")
    got = ranking.mmr(df, 3).orderBy("pick").select("profile").collect()
    assert [r[0] for r in got] == ["a", "c", "d"]


def test_lloyd(spark):
    df = spark.createDataFrame([(i, [float(i // 5 * 10), float(i % 5)]) for i in range(10)], "profile int, vec array<double>")
    got = clusters.lloyd(df, 2).collect()
    assert len({(r["profile"] // 5, r["cluster"]) for r in got}) == 2
    assert sum(r["exemplar"] for r in got) == 2
    assert {r["cluster"] for r in clusters.lloyd(df, 10).collect()} == set(range(10))


def test_bm25_ties_and_misses(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None), (4, "gamma")], "doc_id int, text string")
    got = {r["id"]: r["bm25"] for r in lexical.bm25(docs, "alpha alpha").collect()}
    assert set(got) == {1, 2} and got[2] > got[1]


def test_key_phrases(spark):
    docs = spark.createDataFrame([(1, "Single cell atac profiling"), (2, "single cell atac, profiling"), (3, "the single cell")], "doc_id int, text string")
    assert [tuple(r) for r in lexical.key_phrases(docs, 2).collect()] == [("single cell", 3), ("cell atac", 2)]


def test_effective_interests(spark):
    df = spark.createDataFrame(
        [(1, 0, "s", "A", "a", None, "inferred", 5), (1, 1, "s", "A", "a", 0.2, "declared", 1), (1, 2, None, None, "X", -1.0, "declared", 1), (1, 3, None, None, "x", 1.0, "declared", 1)],
        "profile int, ordinal int, system string, code string, label string, weight double, method string, asserted_at int",
    )
    got = {r["position"]: r["ordinal"] for r in interests.effective(df).collect()}
    assert got == {0: 1, 2: 2}


def test_topic_score_excludes(spark):
    works = spark.createDataFrame([("w", "t1"), ("w", "T1"), ("v", "t2")], "work string, topic string")
    own = spark.createDataFrame([(1, "T1", -1.0, "declared", None, None), (1, "t2", None, "inferred", 0.4, False), (1, "T2", 1.0, "declared", None, True)], "profile int, code string, weight double, method string, share double, unmapped boolean").withColumn("system", F.lit(interests.TOPICS))
    assert {r["work"]: r["topic_score"] for r in interests.topic_score(works, own).collect()} == {"w": None, "v": 0.2}
    other = own.withColumn("system", F.lit("another"))
    assert interests.topic_score(works, other).count() == 0 and interests.topic_matches(works.withColumn("ordinal", F.lit(1)), other.withColumn("label", F.lit("x"))).count() == 0


def test_a_set_of_topics_is_scored_once(spark):
    works = spark.createDataFrame([(w, f"https://x.org/{t}") for w in range(60) for t in ("t1", "T2", "t2", "t3")[w % 3 :]] + [(None, "t3"), (60, None), (61, "x/"), (62, "t9")], "work int, topic string").repartition(3)
    own = spark.createDataFrame(
        [(1, "s", "T1", 1.0, "declared", None), (1, "s", "t2", None, "declared", 0.4), (2, "s", "T3", -1.0, "declared", None), (2, "s", "T2", 0.5, "declared", None), (3, "s", "T3", -1.0, "inferred", 0.2), (3, "s", "T3", 0.25, "declared", None), (4, "s", "", 0.5, "declared", None), (5, "t", "T1", 1.0, "declared", None)],
        "profile int, system string, code string, weight double, method string, share double",
    )
    df = interests.topic_score(works, own, "s")
    want, entries = {}, own.collect()
    for w in [*range(60), None, 60, 61, 62]:
        has = {None: {"T3"}, 60: set(), 61: {""}, 62: {"T9"}}.get(w, {0: {"T1", "T2", "T3"}, 1: {"T2", "T3"}, 2: {"T2", "T3"}}.get((w or 0) % 3))
        for p in range(1, 5):
            met = [r for r in entries if r["profile"] == p and r["code"].upper() in has]
            if met:
                never = any(r["method"] == "declared" and r["weight"] is not None and r["weight"] <= -1 for r in met)
                want[p, w] = None if never else sum(r["weight"] if r["method"] == "declared" and r["weight"] is not None else 0.5 * (r["share"] or 0) for r in met)
    got = {(r["profile"], r["work"]): r["topic_score"] for r in df.collect()}
    assert len(got) == df.count() and got.keys() == want.keys() and all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_graph_trio(spark):
    parts = spark.createDataFrame([("doi:1", "alice", 2020, True, True), ("doi:1", "bob", 2020, True, True), ("doi:1", "x", 2020, False, False), ("doi:2", "carol", 2021, True, True)], "work string, person string, year int, profiled boolean, owns boolean")
    edges = graph.coauthor_edges(parts)
    assert rows(edges.select("src", "dst", "confidence")) == [("alice", "bob", 2), ("alice", "x", 0), ("bob", "x", 0)]
    assert rows(graph.neighbors(edges, "alice").select("dst", "hops")) == [("bob", 1), ("x", 1)]
    stays = spark.createDataFrame([("alice", "ror:1", 2000, None, 0), ("bob", "ror:1", None, None, 1), ("carol", "inst:2", 2000, 2001, 0)], "person string, inst string, lo int, hi int, ordinal int")
    inst = graph.institution_edges(stays)
    assert rows(inst.select("src", "dst", "overlap")) == [("alice", "bob", None)]
    authors = spark.createDataFrame([(1, "alice"), (1, "carol")], "paper int, person string")
    cand = spark.createDataFrame([(1, "bob"), (1, "carol")], "paper int, candidate string")
    assert rows(graph.conflicts(authors, cand, edges, stays, 2030).drop("reasons")) == [(1, "bob", True, 1, 1), (1, "carol", False, 0, 0)]


def test_cycles_fail_closed(spark):
    af = spark.createDataFrame([(1, "a", "r1", "p1", None, ["p2"]), (1, "b", "r2", "p2", None, ["p1"]), (1, "c", "r3", "p3", "limited", []), (1, "d", "r4", "p4", None, ["r3", "zz"])], "profile int, url string, role string, paper_id string, tier string, derived_from array<string>")
    pt = spark.createDataFrame([(1, "public")], "profile int, profile_tier string")
    assert rows(privacy.effective_tiers(af, pt)) == [(1, "a", "private", True), (1, "b", "private", True), (1, "c", "limited", False), (1, "d", "limited", False)]
    assert rows(privacy.unresolved(af)) == [(1, "d", "zz")]
    eff = privacy.effective_tiers(af, pt)
    chunks = spark.createDataFrame([(1, 1, "soul", "zz")], "profile int, chunk_id int, source_type string, url string")
    assert rows(privacy.chunk_tiers(chunks, eff, pt).select("tier")) == [("private",)]
    assert rows(privacy.access_rights(af, eff).select("access").distinct()) == [(None,)]
    long = spark.createDataFrame([(1, "a0", "cv", "a0", None, [])] + [(1, f"a{i}", "soul", f"a{i}", None, [f"a{i - 1}"]) for i in range(1, 6)], af.schema)
    assert {r["tier"] for r in privacy.effective_tiers(long, pt).collect()} == {"private"}


def test_tokens_are_bound():
    t = paging.make_token([-2000, "x"], {"q": 1})
    assert paging.read_token(t, {"q": 1}) == [-2000, "x"]
    with pytest.raises(ValueError):
        paging.read_token(t, {"q": 2})
    with pytest.raises(ValueError):
        paging.read_token("???", {})
    assert [paging.clamp(n, 5, 10) for n in (None, 0, -3, 99)] == [5, 5, 1, 10]


def test_resolve(spark):
    known = spark.createDataFrame([("r1", "Jane Doe", "MIT", "public"), ("r2", "John Doe", "ETH", "public"), ("r3", "Ann Roe", None, "private")], "rid string, name string, affiliation string, tier string")
    asked = spark.createDataFrame([(1, None, "Jane Doe", None), (2, None, "J. Doe", None), (3, None, "J. Doe", "mit "), (4, None, "Unknown Author", None), (5, None, "Ann Roe", None), (6, "r2", None, None), (7, None, "Jane Doe", "ETH")], "q int, rid string, name string, affiliation string")
    got = {r["q"]: (r["outcome"], r["resolved"]) for r in identity.resolve(asked, known).collect()}
    assert got[1] == ("bind", "r1")
    assert got[2] == ("defer", None) and got[3] == ("defer", None) and got[7] == ("defer", None)
    assert got[4] == ("refuse", None)
    marks = spark.createDataFrame([("r9", "José Núñez", "X", "public")], "rid string, name string, affiliation string, tier string")
    again = identity.resolve(spark.createDataFrame([(1, None, "Jose Nunez", None), (2, None, "NÚÑEZ, José", None)], "q int, rid string, name string, affiliation string"), marks)
    assert {(r["q"], r["outcome"], r["resolved"]) for r in again.collect()} == {(1, "bind", "r9"), (2, "bind", "r9")}
    assert got[5][0] == "mint" and got[5][1].startswith("local:roe-ann-")
    assert got[6] == ("exact", "r2")


def test_push_modes(spark):
    live = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1"), ("c", "y", "1")], "url string, cls string, sha string")
    arch = spark.createDataFrame([("a", "x", "2")], "url string, cls string, sha string")
    assert rows(diffs.push_plan(live, arch, "replace").select("url", "action")) == [("a", "write"), ("b", "remove"), ("c", "keep")]
    assert rows(diffs.push_plan(live, arch, "merge").select("url", "action")) == [("a", "write"), ("b", "keep"), ("c", "keep")]
    assert rows(diffs.push_plan(live, arch, "prune").select("url", "action")) == [("a", "write"), ("b", "remove"), ("c", "remove")]


def test_paper_matching_is_one_to_one(spark):
    p = spark.createDataFrame([(0, "p0", "A study of cells", 2000), (1, "p1", "A study of cell", 2000), (2, "p2", "漢字", 2000)], "ordinal int, paper string, title string, year int")
    w = spark.createDataFrame([(0, "w0", "A Study of Cells!", 2000), (1, "w1", "A study of cells.", 2000), (2, "w2", "漢字", 2000)], "work_ordinal int, work string, work_title string, work_year int")
    assert [tuple(r)[1:] for r in matching.match_papers(p, w).orderBy("ordinal").collect()] == [("p0", "w0", "exact"), ("p1", "w1", "fuzzy")]


def test_cards_chain(spark):
    cards = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None)], "card int, rid string, base string")
    assert rows(diffs.card_groups(cards).select("card", "person")) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_export_selection(spark):
    p = spark.createDataFrame([("s", 1, "alpha beta", 2000, "first", False, 10), ("s", 2, "alpha beta", 2001, "first", False, 9), ("s", 3, "gamma delta", None, None, False, 1), ("s", 4, "epsilon", 1999, None, False, 0)], "profile string, paper int, title string, year int, position string, corresponding boolean, cites int")
    got = profiles.select_export(p, 2, common=1.0).collect()
    assert len(got) == 2 and got[-1]["year"] is None or got[0]["year"] >= got[1]["year"]


def test_storage(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "profile.jsonld").write_text('{"name": "A", "x": null}')
    (tmp_path / ".b").mkdir()
    (tmp_path / ".b" / "profile.jsonld").write_text("{}")
    got = tables.read_profile_folders(spark, str(tmp_path)).select("slug", F.variant_get("document", "$.name", "string").alias("n")).collect()
    assert [tuple(r) for r in got] == [("a", "A")]
    assert tables.canonical_json({"b": 1, "name": "é", "a": [], "@id": "x"}) == '{\n  "@id": "x",\n  "name": "é",\n  "b": 1\n}\n'
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "rows array<array<float>>").select(tables.encode_vectors("rows").alias("b"))
    assert v.select(tables.decode_vectors("b", F.lit(2))).first()[0] == [[1.0, 2.0], [3.0, 4.0]]
    old = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    new = spark.createDataFrame([(2, "z")], "k int, v string")
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "x"), (2, "z")]
    al = spark.createDataFrame([("a", "b")], "old string, new string")
    assert rows(tables.merge_identity(al, spark.createDataFrame([("b", "c")], "old string, new string"))) == [("a", "c"), ("b", "c")]


def test_walk_pages():
    calls = []

    def fetch(page, size, token):
        calls.append((page, token))
        return {"items": [page], "total_pages": 3}

    assert list(tables.pages(fetch)) == [0, 1, 2]
