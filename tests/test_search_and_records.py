"""Search, passages and records on small cases."""

from pyspark.sql import functions as F

from lorespark.operators import lexical, privacy, records, search


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_hits_of_hidden_and_missing_texts_do_not_count(spark):
    papers = spark.createDataFrame([(1, "gene map", "s", None, "j"), (2, "other", None, "a", "j")], "id int, title string, summary string, abstract string, journal string")
    chunks = spark.createDataFrame(
        [(1, 1, "paper_summary", "public", [1.0, 0.0]), (2, 1, "paper_abstract", "public", [1.0, 0.0]), (3, 2, "paper_abstract", "private", [1.0, 0.0]), (4, 2, "seed_abstract", "public", [1.0, 0.0]), (5, 2, "paper_abstract", None, [1.0, 0.0])],
        "chunk_id int, source_id int, source_type string, tier string, v array<double>",
    )
    got = search.hybrid_papers(papers, chunks, "gene", vec(1, 0), "limited")
    assert rows(got) == [(1, round(2 / 61, 6), "keyword+semantic", "hybrid")]
    alone = search.hybrid_papers(papers, chunks, "gene", None, "limited")
    assert rows(alone) == [(1, round(1 / 61, 6), "keyword", "keyword")]


def test_stale_chunks_are_counted(spark):
    chunks = spark.createDataFrame([(i, "web", "public", 3 + i % 2, [1.0, i / 10]) for i in range(6)], "chunk_id int, source_type string, tier string, char_count int, v array<double>")
    texts = spark.createDataFrame([(i, "abc") for i in range(5)], "chunk_id int, text string")
    got = search.current_hits(chunks, texts, vec(1, 0), "public", 2)
    assert [(r["rank"], r["chunk_id"], r["stale"]) for r in got.orderBy("rank").collect()] == [(1, 0, 3), (2, 2, 3)]


def test_passages_leave_out_empty_bodies(spark):
    body = "a long enough body about gene maps and more than forty characters"
    cands = spark.createDataFrame([(1, body), (2, "gene"), (3, body.replace("gene", "cell")), (4, None)], "id int, body string")
    assert [r["id"] for r in search.passages(cands, "gene", None).collect()] == [1]


def test_paper_passages_are_verbatim(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * 120 + ("needle" if i == 3 else "") for i in range(6))
    got = search.paper_passages(spark.createDataFrame([(1, text), (2, "nothing here " * 50)], "paper int, text string"), "needle").collect()
    assert len(got) == 1 and got[0]["paper"] == 1 and text[got[0]["start"] :].startswith(got[0]["body"]) and "needle" in got[0]["body"]


def test_ranks_of_a_whole_list(spark):
    df = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(50)).alias("x"), "id").repartition(7)
    got = {r["id"]: r["rank"] for r in lexical.ranked(df, F.desc("x"), "id").collect()}
    want = {r["id"]: n for n, r in enumerate(sorted(df.collect(), key=lambda r: (-r["x"], r["id"])), 1)}
    assert got == want


def test_sections_and_source_types(spark):
    own = spark.createDataFrame([(1, "public", {"contact": "private"}, "a@b", ["x"]), (2, "limited", {}, "c@d", ["y"])], "profile int, profile_tier string, section_tiers map<string,string>, email string, interests array<string>")
    assert rows(privacy.project_sections(own, "public").select("profile", "email", "interests")) == [(1, None, ["x"]), (2, None, [])]
    types = privacy.allowed_source_types(own.select("profile", "profile_tier"), "private")
    assert rows(types) == [(1, None), (2, None)]


def test_bibliography_without_a_doi(spark):
    text = '@article{a, doi = "10.1000/x"}\n@string{s, doi={10.1/y}}\n@misc{b, title={t}}'
    got = records.bibliography_dois(spark.createDataFrame([(1, text), (2, None)], "file int, text string"))
    assert rows(got.select("key", "doi")) == [("a", "10.1000/x"), ("b", None)]


def test_first_sentence_and_career(spark):
    df = spark.createDataFrame([("One. Two",), ("v1.2 is it? Yes",), ("no end",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(records.first_sentence("t")).collect()] == ["One.", "v1.2 is it?", "no end", None, None]


def test_records_are_numbered_before_they_are_found(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK", 3, raising=False)
    own = [(i, "r" + "abbccccc"[i % 8]) for i in range(40)] + [(99, None), (7, "ra")]
    aliases = [("x", "rc"), ("y", "rb"), ("y", "ra"), ("z", "nobody")]
    asked = ["ra", "x", "y", "rb", "rb", "z", "w", None]
    want = []
    for rid in set(asked):
        at = [now for a in asked if a == rid and rid for now in ([n for o, n in aliases if o == rid] or [rid])]
        want += [(rid, n, p) for n, p in enumerate(sorted(p for now in at for p, r in own if r == now), 1)]
    p = spark.createDataFrame(own, "profile_id int, rid string").repartition(3)
    df = records.records_about(p, spark.createDataFrame(aliases, "old string, new string"), spark.createDataFrame([(a,) for a in asked], "rid string"))
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")
