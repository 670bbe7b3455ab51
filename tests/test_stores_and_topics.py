"""Store writes, chunkers, topic clusters, and lists that no bound cuts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import diffs, embedding, lexical, ranking, stores
from lorespark.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_put_outcomes(spark):
    profiles = spark.createDataFrame([(1, "ann", "r1"), (2, "bob", "r2")], "profile_id long, slug string, rid string")
    aliases = spark.createDataFrame([("anna", 1), ("bob", 1)], "old_slug string, profile_id long")
    retired = spark.createDataFrame([("r9",)], "rid string")
    staged = spark.createDataFrame([("ann", "r1"), ("anna", "r1"), ("anna", "r7"), ("bob", "r1"), ("new", "r9"), ("new", "r1"), ("new", "r8")], "slug string, rid string")
    got = {(r["slug"], r["rid"]): (r["outcome"], r["live_slug"]) for r in stores.put_outcomes(profiles, aliases, retired, staged, one_record=True).collect()}
    assert got == {
        ("ann", "r1"): ("replaced", "ann"), ("anna", "r1"): ("replaced", "ann"), ("anna", "r7"): ("former_slug", "ann"), ("bob", "r1"): ("rid_mismatch", "bob"),
        ("new", "r9"): ("retired_rid", None), ("new", "r1"): ("second_record", None), ("new", "r8"): ("created", None),
    }
    made = stores.new_ids(stores.put_outcomes(profiles, aliases, retired, staged), profiles)
    assert rows(made) == [("new", "r1", 3), ("new", "r8", 4)]
    assert rows(stores.put_outcomes(profiles, aliases, retired, staged.where("false"))) == []


def test_merge(spark):
    profiles = spark.createDataFrame([(1, "a", "ra"), (2, "b", "rb"), (3, "c", "ra")], "profile_id long, slug string, rid string")
    slugs = spark.createDataFrame([("a0", 1), ("c0", 3)], "old_slug string, profile_id long")
    rids = spark.createDataFrame([("older", "ra"), ("rb", "ra")], "old_rid string, rid string")
    kept, slugs, rids = stores.merge_profiles(profiles, slugs, rids, spark.createDataFrame([(1, 2)], "retired_id long, survivor_id long"))
    assert rows(kept) == [(2, "b", "rb"), (3, "c", "rb")]
    assert rows(slugs) == [("a", 2), ("a0", 2), ("c0", 3)]
    assert rows(rids) == [("older", "rb"), ("ra", "rb")]


def test_artifacts_and_edits(spark):
    asked = spark.createDataFrame([(1, "a/b.md"), (1, "a/../b.md"), (1, "/etc"), (1, "c:\\x"), (1, "a..b"), (1, None)], "profile int, url string")
    have = spark.createDataFrame([(1, "a/b.md"), (1, "/etc")], "profile int, url string")
    assert [r[2] for r in sorted(stores.artifact_lookup(asked, have).collect(), key=lambda r: r[1] or "")] == ["refused", "refused", "missing", "refused", "found", "refused"]
    papers = spark.createDataFrame([(1, "t", "2000"), (2, "u", "2001"), (3, "v", "2002")], "paper int, name string, datePublished string")
    patches = spark.createDataFrame([(1, "datePublished", None, None), (1, "name", "n", "t"), (2, "name", "x", None), (2, "paper", "y", None), (3, "name", "w", "old")], "paper int, field string, value string, version string")
    assert rows(stores.apply_patches(papers, patches, version=F.col("name"))) == [(1, "n", None), (2, "u", "2001"), (3, "v", "2002")]
    assert rows(stores.patch_refusals(patches, papers, version=F.col("name"))) == [(2, "paper", "field"), (3, "name", "version")]
    assert "doi" in stores.EDITABLE_WORK_FIELDS and "rid" not in stores.editable_metadata(spark.range(1).select(F.lit(1).alias("rid"), F.lit(1).alias("bio")))


def test_chunkers(spark):
    long = "\n\n".join(["a" * 7990, "[smith2020ab]", "b" * 7990])
    src = spark.createDataFrame([("p", "paper_summary", "s", "[abstract-only] ## Not a heading\nbody"), ("p", "grant", "g", long), ("p", "cv", "c", "## Work\nbody"), ("p", "seed_abstract", "e", None)], "profile string, source_type string, source_id string, text string")
    got = {(r["source_id"], r["chunk_index"]): (r["section"], r["embed_text"][:20]) for r in embedding.enumerate_chunks(src, "deep").collect()}
    assert got[("s", 0)] == (None, "## Not a heading\nbod") and got[("c", 0)] == ("Work", "Work\n\nbody")
    assert {k[1] for k in got if k[0] == "g"} in ({0, 1}, {0, 2}) and ("e", 0) not in got
    both = spark.createDataFrame([(" T ", None), ("T", " A"), (None, "")], "t string, a string").select(embedding.titled_text("t", "a"))
    assert [r[0] for r in both.collect()] == ["T", "T\n\nA", None]


def test_topic_clusters(spark):
    rng = np.random.default_rng(1)
    at = [(p, i, [float(x) for x in np.eye(3)[i % 3] * 9 + rng.normal(size=3) * 0.1]) for p in ("p", "q") for i in range(12)]
    df = spark.createDataFrame([(p, i, "paper_summary" if i % 2 else "grant", i // 4, f"# Part {i}\nbody", v) for p, i, v in at] + [("p", 99, "seed_abstract", 1, "seed", [50.0] * 3)], "profile string, chunk_id long, source_type string, source_id long, text string, v array<double>")
    topics, members = ranking.topic_clusters(df, 3)
    vectors = {(p, i): np.array(v) for p, i, v in at}
    own = {}
    for r in members.collect():
        own.setdefault((r["profile"], r["cluster"]), []).append((r["profile"], r["chunk_id"]))
    assert sorted(k for ks in own.values() for k in ks) == sorted(vectors)
    centers = {c: np.mean([vectors[k] for k in ks], axis=0) for c, ks in own.items()}
    # a fixed point: every chunk lies with the nearest mean of its profile
    for c, ks in own.items():
        for k in ks:
            assert min((((vectors[k] - m) ** 2).sum(), o[1]) for o, m in centers.items() if o[0] == k[0])[1] == c[1]
    for r in topics.collect():
        ks, m = own[(r["profile"], r["cluster"])], centers[(r["profile"], r["cluster"])]
        assert r["label"] == f"Part {max(ks, key=lambda k: (vectors[k] @ m, -k[1]))[1]}" and r["weight"] == pytest.approx(len(ks) / 12, abs=1e-4)
        assert r["papers"] == len({k[1] // 4 for k in ks if k[1] % 2})


def test_nothing_is_cut(spark):
    # one phrase nests in hundreds of longer ones, all ahead of the last
    docs = spark.createDataFrame([(i, ". ".join(f"alpha beta w{j}x" for j in range(300)) + ". gamma delta") for i in (1, 2)], "doc_id int, text string")
    assert ("gamma delta", 2) in [tuple(r) for r in lexical.key_phrases(docs, 400).collect()]
    nested = spark.createDataFrame([(i, "alpha beta. alpha beta. " + ". ".join(f"alpha beta w{j}x" for j in range(300))) for i in (1, 2)] + [(3, "alpha beta. gamma delta"), (4, "gamma delta"), (5, "alpha beta")], "doc_id int, text string")
    assert [tuple(r) for r in lexical.key_phrases(nested, 2).collect()] == [("alpha beta", 4), ("beta w0x", 2)]
    # a chain longer than any fixed number of rounds
    chain = spark.range(200).select(F.col("id").alias("card"), F.floor(F.col("id") / 2).cast("string").alias("rid"), F.floor((F.col("id") + 1) / 2).cast("string").alias("base"))
    assert {r["person"] for r in diffs.card_groups(chain).collect()} == {0}


@pytest.mark.parametrize("cap", [4, 200])
def test_add_seeds(spark, cap):
    rnd = random.Random(cap)
    work = lambda: (rnd.choice([None, f"https://openalex.org/w{rnd.randint(1, 9)}/"]), rnd.choice([None, f"doi:10.1/A{rnd.randint(1, 9)}"]))
    key = lambda o, d: {k for k in ((o and "oa:" + o.strip("/").split("/")[-1].upper()), (d and d.lower())) if k}
    lists = {w: [(p, i, *work()) for p in ("p", "q") for i in range(n)] for w, n in (("seeds", 2), ("papers", 2), ("records", 15))}
    want = []
    for p in ("p", "q"):
        held, size = set().union(*(key(o, d) for q, _, o, d in lists["seeds"] if q == p)), 2
        authored = set().union(*(key(o, d) for q, _, o, d in lists["papers"] if q == p))
        for q, i, o, d in lists["records"]:
            if q == p:
                k = key(o, d)
                word = "already_authored" if k & authored else "already_seed" if k & held else "over_cap" if size >= cap else "added"
                if word == "added":
                    held, size = held | k, size + 1
                want.append((p, i, word))
    df = {w: spark.createDataFrame(r, "profile string, ordinal int, openalex_id string, doi string") for w, r in lists.items()}
    assert rows(stores.add_seeds(df["seeds"], df["papers"], df["records"], cap)) == sorted(want, key=repr)


def test_publish_swaps(spark, tmp_path):
    path = str(tmp_path / "table")
    assert tables.publish(spark.range(3), path, None, "id") is None
    gone = tables.publish(spark.range(2, 5), path, spark.read.parquet(path), "id")
    assert rows(gone) == [(0,), (1,)] and rows(spark.read.parquet(path)) == [(2,), (3,), (4,)]
    with pytest.raises(Exception):  # noqa: B017
        tables.publish(spark.range(9).select(F.raise_error(F.lit("no")).alias("id")), path, None, "id")
    assert rows(spark.read.parquet(path)) == [(2,), (3,), (4,)]
