"""The pipeline's stages against brute force, and the registered queries' oracles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorespark.llm import decontamination, stages


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(1)
    path = str(tmp_path_factory.mktemp("tables"))
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "tiger", "ocean", "mellow", "stone"]) + str(rnd.randint(0, 99)) for _ in range(n))
    bench = [(i, words(25)) for i in range(3)]
    rows = [(i, words(60), "en", "s", 0) for i in range(20)]
    rows += [(20, rows[2][1], "en", "s", 0), (21, None, "en", "s", 0), (22, "123 456", "en", "s", 0), (23, words(20) + " " + bench[1][1], "en", "s", 0), (24, words(40) + " me@mail.org", "en", "s", 0), (None, words(50), "en", "s", 0), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = stages.language_stage(spark, docs, tables).cache()
    assert kept.columns == columns and {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()} == {21, 22}
    one = stages.near_dedup_stage(spark, kept, tables).cache()
    ids = [r[0] for r in one.select("doc_id").collect()]
    assert one.columns == columns and 20 not in ids and ids.count(5) == 1 and None in ids and len(ids) == 23
    clean = stages.decontamination_stage(spark, one, tables).cache()
    assert clean.columns == columns and {r[0] for r in one.select("doc_id").collect()} - {r[0] for r in clean.select("doc_id").collect()} == {23}
    redacted = stages.pii_stage(spark, clean, tables).cache()
    assert redacted.columns == columns and redacted.dtypes == docs.dtypes
    mail = redacted.where("doc_id = 24").first()
    assert mail["text"].endswith(" <EMAIL>") and mail["n_chars"] == len(mail["text"])
    packed = stages.packing_stage(spark, redacted, tables)
    assert packed.select("doc_id").distinct().count() == redacted.select("doc_id").distinct().count()


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert out.where(F.col("doc_id").isin(20, 21, 22, 23)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_empty_tables(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def _groups(rows):
    """Brute force: component of each row by exact Jaccard similarity of 0.8 or more; and its pairs below 1."""
    sets, label, near = [_shingles(t) for _, t in rows], list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            alike = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if alike >= 0.8:
                near += alike < 1
                label = [label[j] if x == label[i] else x for x in label]
    return label, near


def test_near_copies_by_exact_jaccard(spark, tables):
    rnd = random.Random(12)
    words = lambda n: [f"w{rnd.randint(0, 3000)}" for _ in range(n)]
    rows = []
    for _ in range(40):
        own = words(rnd.choice([30, 120, 400]))
        rows.append(" ".join(own))
        for _ in range(3):
            changed = list(own)
            for k in rnd.sample(range(len(own)), max(1, len(own) // rnd.choice([25, 40, 60, 90]))):
                changed[k] = "zzz"
            rows.append(" ".join(changed))
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    label, near = _groups(rows)
    assert near > 40
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted(r["doc_id"] for r in stages.near_dedup_stage(spark, df, tables).select("doc_id").collect())
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least.get(c, i), i)
    assert got == sorted(least.values())


def test_decontamination_judges_each_text(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    passage = spark.read.parquet(f"{tables}/benchmark.parquet").first()["text"]
    made = [(None, passage), (7, passage), (7, f"other words {passage}"), (None, "clean text"), (None, None), (7, "clean too")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in made], docs.schema).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in stages.decontamination_stage(spark, df, tables).collect()]
    assert sorted(got, key=str) == sorted(made[3:], key=str)


def test_overlaps_of_a_repeated_id(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    df = spark.createDataFrame([(1, a), (1, " ".join(b.split()[:-5])), (1, b), (None, a), (None, b)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, a), (5, b)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_match"], r["n_places"]) for r in decontamination.overlaps(df, bench).collect()}
    assert got == {1: (30, 3), None: (30, 2)}


def test_near_dedup_judges_each_row(spark, tables):
    rnd = random.Random(15)
    a, b, c, d = (" ".join(f"w{rnd.randint(0, 999)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (None, c), (None, c), (None, f"{c} end"), (None, d), (2, f"{d} end"), (3, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in stages.near_dedup_stage(spark, df, tables).collect()]
    assert len(got) == 4 and {(1, a), (1, b), (2, f"{d} end")} < set(got)
    assert [i for i, t in got if t.startswith(c)] == [None]
