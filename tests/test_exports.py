"""Manifests, interest nodes, vectors by kind, published folders, and the flagship by brute force."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import exports, profiles, ranking
from lorespark.operators.embedding import hash_encoder
from lorespark.sources import published


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_digests_are_carried_while_bytes_are_the_same(spark):
    files = spark.createDataFrame([(1, "sources/papers/b.md", 3, "x"), (1, "sources/papers/a.md", 3, "y"), (1, "SKILL.md", 1, None), (1, "personality/SOUL.md", 1, "s"), (1, "odd.bin", 1, "o")], "profile int, url string, size_bytes int, sha256 string")
    before = spark.createDataFrame([(1, 1, "sources/papers/b.md", "x", "old"), (1, 2, "sources/papers/b.md", "x", "new"), (1, 3, "sources/papers/a.md", "z", "d"), (1, 4, "SKILL.md", None, "d"), (2, 5, "personality/SOUL.md", "s", "d")], "profile int, ordinal int, url string, sha256 string, inputs_digest string")
    got = [(r["url"], r["slot"], r["paper_id"], r["inputs_digest"]) for r in exports.manifest(files, before).orderBy(F.desc("slot"), "place", "url").collect()]
    assert got == [("personality/SOUL.md", "subjectOf", None, None), ("SKILL.md", "hasPart", None, None), ("sources/papers/a.md", "hasPart", "a", None), ("sources/papers/b.md", "hasPart", "b", "new")]


def test_nodes_say_only_what_is_liked(spark):
    made = [(1, 0, "s", "c", "C", 0.5, "declared", None, "i"), (1, 1, "s", "d", 'say "D"', 0.5, "inferred", None, None), (1, 2, None, None, "free", 1.0, "declared", None, None), (1, 3, "s", "e", "E", -0.5, "declared", None, None), (1, 4, "s", "f", "F", None, "declared", None, None), (1, 5, "s", "c", "C", 0.9, "inferred", None, "i")]
    df = spark.createDataFrame(made, "profile int, ordinal int, system string, code string, label string, weight double, method string, asserted_at date, iri string")
    got = [json.loads(r["node"]) for r in exports.interest_nodes(df).orderBy("position").collect()]
    assert got == [{"@id": "i", "skos:prefLabel": "C"}, {"skos:inScheme": {"@id": "s"}, "skos:notation": "d", "skos:prefLabel": 'say "D"'}, {"skos:prefLabel": "free"}]


def test_vectors_by_kind(spark):
    chunks = spark.createDataFrame([(1, [2.0, 0.0]), (1, [0.0, 2.0])], "profile int, v array<double>")
    texts = spark.createDataFrame([(1, "a summary", " "), (2, None, "gene maps " * 100), (3, "", None)], "profile int, summary string, expertise string")
    got = {(r["profile"], r["kind"]): np.array(r["vec"]) for r in exports.profile_vectors(chunks, texts, hash_encoder).collect()}
    encode = hash_encoder()
    assert len(got) == 7 and np.allclose(got[1, "centroid"], [0.5**0.5] * 2)
    assert np.allclose(got[1, "summary"], encode(["a summary"])[0], atol=1e-6) and not got[1, "expertise"].any()
    assert np.allclose(got[2, "summary"], encode([("gene maps " * 100)[:500]])[0], atol=1e-6) and not got[3, "summary"].any()


def test_staleness_and_caveats(spark):
    papers = spark.createDataFrame([(1, 2024), (1, 2020), (2, None)], "profile int, year int")
    updated = spark.createDataFrame([(1, "2020-01-01"), (2, "2024-12-01"), (3, None)], "profile int, updated string")
    got = {r["profile"]: r for r in profiles.coverage(papers, updated, "2024-12-31").collect()}
    assert (got[1]["days_since_update"], got[1]["label"]) == (365, "stale")
    assert got[1]["caveats"] == ["Index covers 2 papers from 2020-2024; preprints since then may be missing.", "Profile last refreshed 365 days ago (label: stale)."]
    assert got[2]["caveats"] == ["Profile last refreshed 30 days ago (label: fresh)."] and got[3]["score"] == 1.0


def test_works_of_many_owners(spark):
    made = [(1, "10.1000/A", None, "p", "T", 2001), (2, "10.1000/A", None, None, "T", 0), (2, None, None, None, "My  Title!", 2003), (3, None, None, "", "My title", None), (3, None, None, "", "My title", None)]
    got = exports.paper_groups(spark.createDataFrame(made, "owner int, doi string, openalex_id string, paper_id string, title string, year int"))
    assert {(r["owners"], r["evidence"], r["first_year"], r["last_year"]) for r in got.collect()} == {(2, 1, 2001, 2001), (1, 0, 2003, 2003), (1, 0, None, None)}
    assert "local:2:my-title" in {r["work_key"] for r in got.collect()}


def test_reports(spark):
    who = spark.createDataFrame([(1,), (2,)], "profile int")
    bad = spark.createDataFrame([(1, "u", "enum")], "profile int, pointer string, keyword string")
    assert rows(exports.reports(who, bad)) == [(1, False, 1), (2, True, 0)]
    got = [r["line"] for r in exports.report_lines(who, bad).orderBy("profile", F.col("pointer").asc_nulls_first()).collect()]
    assert got == ["Validation: FAIL", "  u: enum", "Validation: PASS"]
    lines = [json.loads(r["line"]) for r in exports.report_lines(who, bad, as_json=True).collect()]
    assert {"profile": 1, "json_pointer": "u", "keyword": "enum"} in lines and {"profile": 2, "ok": True, "violations": 0} in lines


def _folder(root, vectors, **told):
    blob = np.asarray(vectors, "<f4").tobytes()
    head = {"file": "v.f32", "dim": len(vectors[0]), "count": len(vectors), "sha256": hashlib.sha256(blob).hexdigest(), "backend_spec": "hash"} | told
    root.mkdir()
    (root / "index.json").write_text(json.dumps(head))
    (root / "v.f32").write_bytes(blob)
    (root / "v.chunks.json").write_text(json.dumps([{"i": i} for i in range(len(vectors))]))
    return str(root)


def test_flat_embeddings(spark, tmp_path):
    a, b = _folder(tmp_path / "a", [[3.0, 4.0], [1.0, 0.0]]), _folder(tmp_path / "b", [[0.0, 0.0]])
    got = published.read_flat_embeddings(spark, a, b)
    assert sorted((r["path"][-1], r["row"], json.loads(r["chunk"])["i"], r["vec"]) for r in got.collect()) == [("a", 0, 0, [3.0, 4.0]), ("a", 1, 1, [1.0, 0.0]), ("b", 0, 0, [0.0, 0.0])]
    assert sorted(r["vec"] for r in published.unit_rows(got).collect()) == [[0.0, 0.0], [0.6, 0.8], [1.0, 0.0]]
    for name, told in (("c", {"sha256": "0" * 64}), ("d", {"count": 2})):
        with pytest.raises(Exception, match="v.f32"):
            published.read_flat_embeddings(spark, _folder(tmp_path / name, [[1.0, 0.0]], **told)).collect()


def test_kinds_and_rosters(spark, tmp_path):
    for i, text in enumerate(['["a"]', '{"cards": []}', '{"hasPart": []}', '{"name": "n", "subjectOf": null}', "{", '{"x": {"cards": 1}}']):
        (tmp_path / f"{i}.json").write_text(text)
    docs = published.read_documents(spark, str(tmp_path)).withColumn("slug", F.regexp_extract("path", r"(\d)\.json$", 1))
    assert [r["k"] for r in docs.orderBy("slug").select(published.source_kind("document").alias("k")).collect()] == ["list", "registry", "profile", "profile", "unrecognized", "unrecognized"]
    assert [r["slug"] for r in published.roster(docs).collect()] == ["3"] and published.malformed(docs).count() == 5


def test_match_against_brute_force(spark):
    rng = np.random.default_rng(7)
    made = [(int(p), i, "seed_abstract" if i % 5 == 0 else "paper_summary", i // 2, rng.normal(size=6).tolist()) for i, p in enumerate(rng.integers(0, 9, 120))]
    q, backs = rng.normal(size=6), rng.normal(size=(4, 6))
    lit = ranking.literal_vector(q)
    chunks = spark.createDataFrame(made, "profile int, chunk_id int, source_type string, source_id int, v array<double>")
    back = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(backs)], "query int, q array<double>")
    cents = ranking.centroids(chunks)
    got = ranking.match(cents, chunks, lit, ranking.calibration(cents, chunks, back), k=3, prefilter=6)

    unit = lambda x: x / np.linalg.norm(x)
    centre = {p: unit(np.mean([m[4] for m in made if m[0] == p], axis=0)) for p in {m[0] for m in made}}

    def raw(p, query, k, places):
        cos = sorted((float(unit(np.array(m[4])) @ unit(query)) for m in made if m[0] == p and m[2] != "seed_abstract"), reverse=True)[:k]
        hits = [round(max(0.0, (1 + c) / 2), places) for c in cos]
        return 0.5 * float(centre[p] @ query) + 0.5 * (float(np.mean(hits)) if hits else 0.0)

    kept = sorted(centre, key=lambda p: (-float(centre[p] @ q), p))[:6]
    score = {}
    for p in kept:
        over = [raw(p, b, 3, 4) for b in backs]
        score[p] = (1 + np.tanh((raw(p, q, 5, 4) - np.mean(over)) / max(np.std(over), 1e-6) / 2)) / 2
    chosen, left = [], sorted(kept, key=lambda p: (-score[p], p))
    while len(chosen) < 3:
        near = lambda p: max((float(centre[p] @ centre[c]) for c in chosen), default=None)
        best = max(left, key=lambda p: score[p] if not chosen else 0.5 * score[p] - 0.5 * near(p))
        left.remove(best)
        chosen.append(best)
    assert [r["profile"] for r in got.orderBy("pick").collect()] == chosen
    assert np.allclose([r["score"] for r in got.orderBy("pick").collect()], [score[p] for p in chosen], atol=1e-4)
