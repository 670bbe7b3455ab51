"""Chains, cards, merges, rebuilds, profiles of tables and validation of folders on small cases."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lorespark.operators import diffs, fleet, pointers, stores, validation
from lorespark.operators.embedding import hash_encoder
from lorespark.plans import fleet_queries
from lorespark.sources import bucketed


NEST = f"nest_{uuid.uuid4().hex[:10]}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ends_of_chains(spark):
    links = [(i, i + 1) for i in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2001), (3000, 3000)]
    got = {r["node"]: (r["end"], r["cyclic"]) for r in pointers.ends(spark.createDataFrame(links, "node int, next int")).collect()}
    assert got == {**{i: (1000, False) for i in range(1000)}, **{i: (None, True) for i in range(2000, 2004)}}
    assert pointers.ends(spark.createDataFrame([], "node int, next int")).collect() == []


def in_order(cards, builtin=()):
    """Cards taken one by one, each joined to a person already there by rid, else by base."""
    kept, by_rid, by_base = [], {}, {}
    full = lambda c: sum(bool(x) for x in c[4:])
    for c in cards:
        at = by_rid.get(c[1]) if c[1] else None
        at = by_base.get(c[2]) if at is None else at
        if at is None:
            at = len(kept)
            kept.append((c, c[0]))
        elif (c[3], full(c)) > (kept[at][0][3], full(kept[at][0])):
            kept[at] = (c, kept[at][1])
        if c[1]:
            by_rid.setdefault(c[1], at)
        by_base.setdefault(c[2], at)
    return sorted((c[0], first) for c, first in kept)


@pytest.mark.parametrize("seed", range(3))
def test_cards_are_joined_in_order(spark, seed):
    rnd = random.Random(seed)
    cards = [(i, rnd.choice([None, *[f"R{k}" for k in range(12)]]), f"b{rnd.randrange(14)}", rnd.random() < 0.2, rnd.choice([None, "x"]), rnd.choice(["", "f"]), rnd.randrange(2), 0, rnd.choice([0.0, 0.5]), None) for i in range(60)]
    df = spark.createDataFrame(cards, "n int, rid string, base string, builtin boolean, affiliation string, field string, paper_count int, summary_count int, fulltext_pct double, backend_spec string").repartition(3)
    df = df.withColumn("rid", F.when(F.col("n") % 2 == 0, F.concat(F.lit("HTTPS://orcid.org/"), F.lower("rid"))).otherwise(F.col("rid")))
    assert rows(diffs.dedupe_cards(df).select("n", "person")) == in_order(cards)


def test_chains_of_merges_end_in_one_hop(spark):
    profiles = spark.createDataFrame([(i, f"s{i}", f"r{i}") for i in range(1, 8)], "profile_id long, slug string, rid string")
    none = spark.createDataFrame([], "old_slug string, profile_id long")
    old = spark.createDataFrame([("r0", "r1")], "old_rid string, rid string")
    merges = spark.createDataFrame([(1, 2), (2, 3)], "retired_id long, survivor_id long")
    kept, slugs, rids = stores.merge_profiles(profiles, none, old, merges)
    assert {r["profile_id"] for r in kept.collect()} == {3, 4, 5, 6, 7}
    assert rows(slugs.select("old_slug", "profile_id")) == [("s1", 3), ("s2", 3)] and rows(rids.select("old_rid", "rid")) == [("r0", "r3"), ("r1", "r3"), ("r2", "r3")]
    bad = spark.createDataFrame([(1, 2), (2, 1), (4, 5), (4, 6), (7, 7), (9, 1), (5, 9), (6, 1)], "retired_id long, survivor_id long")
    assert {(r["retired_id"], r["survivor_id"]): r["refusal"] for r in stores.merge_refusals(profiles, bad).collect()} == {(1, 2): "cycle", (2, 1): "cycle", (4, 5): "twice", (4, 6): "twice", (7, 7): "same", (9, 1): "no_retired", (5, 9): "no_survivor", (6, 1): "cycle"}


CALLS = "profile int, source_type string, source_id string, chunk_index int, text_hash string, embed_text string"
INDEX = "profile int, source_type string, source_id string, chunk_index int, text_hash string, vector array<float>, backend_spec string"


def chunks_of(spark, texts):
    return spark.createDataFrame([(p, "soul", s, 0, f"h{t}", t) for p, s, t in texts], CALLS)


def choosy(path):
    def make():
        encode = hash_encoder(4)

        def run(texts):
            with open(path, "a") as f:
                f.write("".join(t + "\n" for t in texts))
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return encode(texts)

        return run

    return make


def test_a_broken_profile_costs_no_other(spark, tmp_path):
    asked = tmp_path / "asked"
    ch = chunks_of(spark, [(1, "a", "alpha"), (1, "b", "beta"), (2, "a", "gamma"), (2, "b", "bad one"), (3, "a", "delta")])
    empty = spark.createDataFrame([(2, "soul", "a", 0, "hold", [1.0], "e")], INDEX)
    index, report = fleet.rebuild(ch, empty, choosy(str(asked)), "e")
    got = {r["profile"]: (r["status"], r["embedded"], r["kept"], r["removed"], r["error"]) for r in report.collect()}
    assert got == {1: ("rebuilt", 2, 0, 0, None), 2: ("failed", 0, 0, 0, "ValueError: no"), 3: ("rebuilt", 1, 0, 0, None)}
    index = spark.createDataFrame(index.collect(), INDEX)
    assert {(r["profile"], r["source_id"], r["text_hash"]) for r in index.collect()} == {(1, "a", "halpha"), (1, "b", "hbeta"), (3, "a", "hdelta"), (2, "a", "hold")}
    # a second run embeds nothing of what is done, and tries the broken one again
    asked.write_text("")
    mended = chunks_of(spark, [(1, "a", "alpha"), (2, "a", "gamma"), (2, "b", "good one"), (3, "a", "delta")])
    again, report = fleet.rebuild(mended, index, choosy(str(asked)), "e")
    assert {r["profile"]: (r["status"], r["embedded"], r["removed"]) for r in report.collect()} == {1: ("rebuilt", 0, 1), 2: ("rebuilt", 2, 0), 3: ("current", 0, 0)}
    assert set(asked.read_text().split("\n")) == {"gamma", "good one", ""} and again.count() == 4


def test_an_encoder_that_does_not_load_fails_profiles_not_the_job(spark):
    def make():
        raise OSError("no model")

    index, report = fleet.rebuild(chunks_of(spark, [(1, "a", "x")]), spark.createDataFrame([], INDEX), make, "e")
    assert [(r["status"], r["error"]) for r in report.collect()] == [("failed", "OSError: no model")] and index.count() == 0


def test_work_is_dealt_by_bytes(spark):
    df = spark.createDataFrame([(i, "soul", "s", 0, "h", "x" * (5000 if i == 3 else 50)) for i in range(200)], CALLS)
    sizes = [r["b"] for r in fleet.dealt_by_bytes(df, task_bytes=1000).groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("embed_text")).alias("b")).collect()]
    assert len(sizes) >= 9 and sum(sizes) == 199 * 50 + 5000 and sorted(sizes)[-2] <= 1050
    assert fleet.dealt_by_bytes(df.where("false")).count() == 0


def test_contacts_of_a_nation_are_stored_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fleet_queries, "BUCKET_ROWS", 20, raising=False)
    sup = [(i, f"s{i}", None if i == 7 else 50 + i % 3) for i in range(30)]
    cus = [(i, f"c{i}", 50 + i % 2) for i in range(400)]
    lines = [(i % 40, i % 29, 1 + i % 4) for i in range(200)]
    spark.createDataFrame(sup, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(cus, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    try:
        got = {r["profile_id"]: (r["name"], r["works"], r["contacts"]) for r in fleet_queries.nested_profiles(spark, str(tmp_path)).collect()}
        assert got == {i: (name, sorted({o for o, p, _ in lines if p == i}), sum(c % 20 == 0 and n == nation for c, _, n in cus)) for i, name, nation in sup}
        assert sum(spark.table(t.name).count() for t in spark.catalog.listTables() if t.name.endswith("_contacts") and t.name.startswith("lore_")) == 20
    finally:
        for t in spark.catalog.listTables():
            if t.name.startswith("lore_nest") or t.name.startswith("lore_nations"):
                spark.sql(f"DROP TABLE {t.name}")


def test_profiles_of_tables(spark, tmp_path):
    root = spark.createDataFrame([(i, f"s{i}", f"r{i}") for i in range(20)], "profile_id long, slug string, rid string")
    works = spark.createDataFrame([(i % 20, -i, f"t{i}") for i in range(100) if i % 20 != 7] + [(99, 0, "nobody")], "profile_id long, place int, title string")
    al = spark.createDataFrame([("old3", 3), ("s4", 9)], "old_slug string, profile_id long")
    bucketed.store({"profiles": root, "works": works, "aliases": al}, NEST, 4)
    try:
        doc = bucketed.nested(spark, NEST, {"works": ("place",), "aliases": ("old_slug",)})
        got = {r["profile_id"]: r for r in doc.collect()}
        assert len(got) == 20 and got[7]["works"] == [] and [w["title"] for w in got[2]["works"]] == ["t82", "t62", "t42", "t22", "t2"] and got[3]["aliases"][0]["old_slug"] == "old3"
        assert "hashpartitioning" not in doc._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = bucketed.nested(spark, NEST, {"works": ("place",), "aliases": ("old_slug",)})._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        back = bucketed.shredded(doc, ("works", "aliases"))
        assert rows(back["profiles"]) == rows(root) and rows(back["works"]) == rows(works.where("profile_id <> 99"))
        one = bucketed.load(spark, NEST, "old3", aliases="aliases")
        assert one.root["slug"] == "s3" and [r["title"] for r in one.child("works", "place").collect()] == ["t83", "t63", "t43", "t23", "t3"]
        assert bucketed.load(spark, NEST, "s4", aliases="aliases").root["profile_id"] == 4 and bucketed.load(spark, NEST, "r5").root["slug"] == "s5" and bucketed.load(spark, NEST, "6").root["slug"] == "s6"
        with pytest.raises(LookupError):
            bucketed.load(spark, NEST, "nobody", aliases="aliases")
        read = one.child("works")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(profile_id,3)" in read and "Exchange" not in read
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("profiles", "works", "aliases"):
            spark.sql(f"DROP TABLE IF EXISTS {NEST}_{name}")


IRI = "https://example.org/context/v1.jsonld"


def folder(**changes):
    """A valid folder, and what a case changes of it: document keys, or files by their path."""
    entry = lambda url, role, **more: {"@type": "DigitalDocument", "contentUrl": url, "role": role, "visibility": "public", **more}
    doc = {"@context": IRI, "@id": "https://orcid.org/0000-0002-1825-0097", "@type": "Person", "conformsTo": IRI, "name": "A Person", "rid": "0000-0002-1825-0097", "provenance": "third_party", "level": "full"}
    doc["hasPart"] = [entry("sources/papers.jsonld", "works"), entry("sources/summaries/p1.summary.md", "paper_summary", paperId="p1", derivedFrom=["works"])]
    doc["subjectOf"] = [entry("personality/SOUL.md", "soul")]
    files = {"sources/papers.jsonld": json.dumps({"hasPart": [{"name": "One", "paper_id": "p1"}]}), "sources/summaries/p1.summary.md": "A summary.", "personality/SOUL.md": "Who I am."}
    for k, v in changes.pop("files", {}).items():
        files.pop(k, None) if v is None else files.update({k: v})
    doc = {k: v for k, v in {**doc, **changes}.items() if v is not ...}
    return {"profile.jsonld": json.dumps(doc), **files}


def part(**entry):
    return {"contentUrl": "sources/papers.jsonld", "role": "works", **entry}


LOGIN = {"kind": "orcid_login", "orcid": "0000-0002-1825-0097", "issuer": "x", "verifiedAt": "t"}
SUMMARY = {"contentUrl": "sources/summaries/p1.summary.md", "role": "paper_summary", "paperId": "p1"}
CASES = {
    "valid": (folder(), set()),
    "cited": (folder(hasCitationGraph=True, hasPart=[part(), SUMMARY, part(contentUrl="sources/citations.json", role="citations")], files={"sources/citations.json": "{}"}), set()),
    "self-report": (folder(provenance="self_published", provenanceNote="said so", hasPart=[part(), part(contentUrl="sources/interview.md", role="interview", visibility="private")], files={"sources/interview.md": "x", "sources/summaries/p1.summary.md": None, "sources/papers.jsonld": '{"hasPart": []}'}), set()),
    "login": (folder(proof=[LOGIN]), set()),
    "no-name": (folder(name=...), {("missing", "/name")}),
    "empty-name": (folder(name=""), {("string_too_short", "/name")}),
    "format": (folder(conformsTo="https://example.org/other"), {("value_error", "/conformsTo")}),
    "bad-node": (folder(files={"sources/papers.jsonld": json.dumps({"hasPart": [{"paper_id": "p1"}, {"title": "t"}]})}), {("missing", "/hasPart/0/name")}),
    "dangling": (folder(hasPart=[part(), SUMMARY, part(contentUrl="sources/papers/p1.md", role="paper_fulltext")]), {("manifest_stale", "/hasPart"), ("content_url_missing", "/hasPart/contentUrl")}),
    "garbled": (folder(hasPart=[part(), SUMMARY, part(contentUrl="sources/papers/p1.md", role="paper_fulltext")], files={"sources/papers/p1.md": "�" * 50 + "x" * 50}), {("text_content", "/")}),
    "other-login": (folder(proof=[{**LOGIN, "orcid": "0000-0001-5109-3700"}]), {("value_error", "/")}),
    "two-logins": (folder(proof=[LOGIN, LOGIN]), {("value_error", "/")}),
    "bad-rid": (folder(rid="x"), {("value_error", "/rid")}),
    "numbers": (folder(summary=5, hasPart="x"), {("string_type", "/summary"), ("list_type", "/hasPart"), ("manifest_unlisted", "/hasPart")}),
    "tier": (folder(hasPart=[part(), {**SUMMARY, "visibility": "secret"}]), {("literal_error", "/hasPart/1/visibility"), ("manifest_entry", "/hasPart"), ("manifest_unlisted", "/hasPart")}),
    "synthetic": (folder(provenance="synthetic"), {("value_error", "/")}),
    "verified": (folder(provenance="orcid_verified"), {("value_error", "/")}),
    "verified-well": (folder(provenance="orcid_verified", url="https://x.org/p", verifiedAt="2024-01-01"), set()),
    "retired": (folder(artifacts=[]), {("retired_term", "/artifacts")}),
    "unlisted": (folder(files={"sources/cv.md": "cv"}), {("manifest_unlisted", "/hasPart")}),
    "unknown-file": (folder(files={"notes.bin": None, "odd.txt": "x"}), set()),
    "absolute": (folder(hasPart=[part(), SUMMARY, part(contentUrl="https://x.org/a")]), {("relative_url", "/hasPart/contentUrl"), ("manifest_stale", "/hasPart")}),
    "index-elsewhere": (folder(hasPart=[part(), SUMMARY, part(contentUrl=".cache/embeddings.sqlite", role="embedding_index_sqlite")]), {("index_not_built", "/hasPart")}),
    "old-cache": (folder(hasPart=[part(), SUMMARY, part(contentUrl="cache/x.bin", role="x")], files={"cache/x.bin": "x"}), {("legacy_cache_dirname", "/hasPart")}),
    "lost-source": (folder(hasPart=[part(), {**SUMMARY, "derivedFrom": ["nothing"]}]), {("derivation", "/hasPart/derivedFrom")}),
    "round": (folder(hasPart=[part(derivedFrom=["p1", "nothing"]), {**SUMMARY, "derivedFrom": ["works"]}]), {("derivation", "/hasPart/derivedFrom")}),
    "orphan": (folder(files={"sources/papers.jsonld": '{"hasPart": []}'}), {("cross_artifact", "/sources/summaries")}),
    "no-document": ({"sources/papers.jsonld": '{"hasPart": []}'}, {("file", "/")}),
    "no-works": (folder(hasPart=[SUMMARY], files={"sources/papers.jsonld": None}), {("file", "/")}),
    "no-json": ({**folder(), "profile.jsonld": "{"}, {("parse", "/")}),
    "no-object": ({**folder(), "profile.jsonld": "[]"}, {("model_type", "/")}),
}


@pytest.fixture(scope="module")
def checked(spark):
    files = spark.createDataFrame([(name, url, text) for name, (made, _) in CASES.items() for url, text in made.items()], "profile string, url string, text string").repartition(3)
    found = validation.validate(files).cache()
    return files, found, found.collect()


@pytest.mark.parametrize("name", CASES)
def test_folders(checked, name):
    assert {(r["keyword"], r["json_pointer"]) for r in checked[2] if r["profile"] == name} == CASES[name][1]


def test_violations_say_what_and_how(checked):
    files, found, got = checked
    assert all(r["message"] and r["expected"] and r["fix"] and len(r["found"]) <= 120 for r in got)
    ok = {r["profile"]: r["ok"] for r in validation.verdicts(files, found).collect()}
    assert ok == {name: not want or name == "index-elsewhere" for name, (_, want) in CASES.items()}
    r = next(r for r in got if r["profile"] == "tier" and r["keyword"] == "literal_error")
    assert (r["found"], r["expected"]) == ("secret", "one of: 'public', 'limited' or 'private'")
    assert next(r for r in got if r["profile"] == "garbled")["artifact"] == "sources/papers/p1.md"


def test_folders_are_read(spark, tmp_path):
    for url, text in CASES["orphan"][0].items():
        at = tmp_path / "p.1" / url
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    files = validation.read_folders(spark, str(tmp_path))
    assert {(r["keyword"], r["profile"]) for r in validation.validate(files).collect()} == {("cross_artifact", "p.1")}
    assert validation.validate(files.where("false")).collect() == []
