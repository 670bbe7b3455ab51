"""Quality rules, the audit of filters and hard negatives against brute force."""

import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorespark.llm import filter_audit, hard_negatives, quality, queries

SCHEMA = "doc_id long, text string, source string, words string, score string, kept string, n string, mask string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=3):
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", "nation", "Éclair", "x1#", "$5", "können", "BIG", "naïve.", "a|b", "\x85", "ſ", " "]
    texts = [rnd.choice([" ", "\n", "\t "]).join(rnd.choices(vocab, k=rnd.randint(0, 70))) for _ in range(n)]
    line = "one two three four five six seven eight nine ten"
    texts += [texts[3], texts[3], None, None, "", " \n\t", "word " * 3000, f"{line}\n{line}\n \n \n{line} more", "\n".join([line] * 9), "a b c d e f g h", "a a a a a a a a a", f"\x0b{line} x {line}\r"]
    texts += [" ".join(f"w{i}" for i in range(5000)), " ".join(f"w{i % 977}" for i in range(3000)), *(["the of and nation " * 20] * 30)]
    rows = [(i, t, f"s{i % 3}", "c", "c", "c", "c", "c") for i, t in enumerate(texts)]
    return [*rows, (None, texts[3], None, "c", "c", "c", "c", "c"), (None, texts[3], None, "c", "c", "c", "c", "c"), rows[4], rows[4], (3, "another text", "s0", "c", "c", "c", "c", "c"), (3, texts[9], "s0", "c", "c", "c", "c", "c")]


LABELS = [(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(0, 120, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (999, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").cache()


def words(text):
    return WORD.findall(text or "")


def h64(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p.encode(), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def grams(text):
    w = words(text)
    return [h64(x) % quality.BUCKETS for x in w] + [h64(*x) % quality.BUCKETS for x in zip(w, w[1:])]


def judged(rows, trusted, threshold=quality.THRESHOLD):
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in trusted:
            target.update(grams(r[1]))
    t, n, b = target.total(), raw.total(), quality.BUCKETS
    weight = lambda g: round((math.log((target[g] + 1) / (t + b)) - math.log((raw[g] + 1) / (n + b))) * quality.SCALE) if t else 0
    out = []
    for r in rows:
        g, counts = grams(r[1]), base(r[1])
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        total = sum(weight(x) for x in g)
        out.append((r[0], *counts, failed, not failed and total >= int(threshold * quality.SCALE) * len(g), round(total / len(g) / quality.SCALE, 6) if g else 0.0))
    return out


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]


def taken(df):
    return sorted(((*[r[c] for c in NAMES[:-1]], round(r["score"], 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_quality_against_brute_force(spark, docs, labels, monkeypatch, few):
    monkeypatch.setattr(quality, "BROADCAST_IDS", few)
    good = {i for i, q, t in LABELS if q == 1 and t == 0 and i is not None}
    trusted = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    verdicts = set()
    for threshold in (quality.THRESHOLD, -1.1, -4.0):
        got = taken(quality.judge_quality(docs, trusted, threshold=threshold))
        assert got == sorted(judged(corpus(), good, threshold), key=repr)
        verdicts |= {r[7] for r in got if not r[6]}
    assert verdicts == {True, False}


def test_quality_without_trusted_texts_or_texts(spark, docs, labels):
    none = labels.where("false").select("doc_id")
    got = taken(quality.judge_quality(docs, none))
    assert got == sorted(judged(corpus(), set()), key=repr) and all(r[-1] == 0 for r in got)
    assert quality.judge_quality(docs.where("false"), labels.select("doc_id")).collect() == []


def test_quality_runs_in_the_jvm(docs, labels):
    plan = quality.quality_rules(docs, quality.ngram_weights(quality.ngram_counts(docs, labels.select("doc_id"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_quality_query_keeps_clean_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    clean, junk = (got.where(c).agg(F.avg(F.col("kept").cast("int"))).first()[0] for c in ("quality = 1 AND toxic = 0", "quality = 0"))
    assert clean > 0.99 and junk < 0.2
    assert queries.op11_quality_rules(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def fails(text, doc_id, first):
    t, w = text or "", words(text)
    mask = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
    return mask + "E" * (doc_id is not None and first[t] is not None and doc_id > first[t])


def audited(rows, labels):
    first = {}
    for r in rows:
        t = r[1] or ""
        first[t] = min((x for x in (first.get(t), r[0]) if x is not None), default=None)
    good, toxic = ({i for i, q, t in labels if i is not None and (q if k else t) == 1} for k in (1, 0))
    parts = {}
    for r in rows:
        parts.setdefault(r[2] or "", []).append((fails(r[1], r[0], first), r[0] in good, r[0] in toxic))
    out = []
    for part, texts in parts.items():
        gone, shapley = {}, Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = texts
            for step, f in enumerate(order, 1):
                bad = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(bad)
                gone[order, step] = (f, len(left), len(bad), sum(f in x[0] for x in texts) - len(bad), sum(x[0] == f for x in texts), sum(x[1] for x in bad), sum(x[2] for x in bad))
        out += [(part, order, step, *v[1:], shapley[v[0]]) for (order, step), v in gone.items()]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_brute_force(docs, labels):
    got = sorted(tuple(r[c] for c in AUDIT) for r in filter_audit.audit(filter_audit.mask_counts(docs, labels)).collect())
    assert got == audited(corpus(), LABELS)
    # efficiency: the shares of the filters add up to all that goes
    part = [r for r in got if r[0] == "s1" and r[1] == "ABCDE"]
    assert sum(r[-1] for r in part) == 120 * sum(r[4] for r in part)


def test_audit_of_clean_parts_and_of_nothing(spark, labels):
    rows = [(1, " ".join(f"w{i}" for i in range(60)), "p", *["c"] * 5)]
    got = filter_audit.audit(filter_audit.mask_counts(spark.createDataFrame(rows, SCHEMA), labels)).collect()
    assert len(got) == 600 and all(r["kept"] == 1 and not r["removed"] and not r["shapley"] for r in got)
    assert filter_audit.audit(filter_audit.mask_counts(spark.createDataFrame([], SCHEMA), labels)).collect() == []


def test_shapley_of_three_filters(spark):
    counts = {0b011: 6, 0b001: 1, 0b110: 4, 0b111: 3, 0: 2}
    got = filter_audit.audit(spark.createDataFrame([("p", m, n, 0, 0) for m, n in counts.items()], "part string, mask int, n long, good long, toxic long"), "XYZ")
    share = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in got.collect()}
    for i, f in enumerate("XYZ"):
        assert share[f] == 6 * sum(Fraction(n, bin(m).count("1")) for m, n in counts.items() if m >> i & 1)


def vectors(n=400, dim=6, seed=5):
    rnd = np.random.default_rng(seed)
    rows = [(i, rnd.normal(0, 1, dim).tolist(), int(rnd.integers(0, 4))) for i in range(n)]
    rows += [(n + i, rows[7][1], i % 3) for i in range(60)]
    rows += [(1000, None, 1), (1001, [None] * dim, 1), (1002, [math.inf] * dim, 1), (1003, [math.nan] * dim, 1), (1004, [1.0, 2.0], 1), (1005, [], 2), (1050, rows[3][1], None), (None, rows[3][1], 1), (1100, [0.0] * dim, 1), (1150, [5.0] * dim, 9), (1151, [4.9] * dim, 9), (1152, [4.0] * dim, 0)]
    return [*rows, rows[50], rows[50], rows[12], (100, rows[5][1], 2)]


def mined(rows, anchor=50, positives=5, negatives=3):
    kept = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = 1
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in kept:
        if i % anchor:
            continue
        others = sorted((-dot(v, c), j, l) for j, l, c in kept if j != i)
        for s, p, _ in [x for x in others if x[2] == label][:positives]:
            bad = [x for x in others if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, p, rank, x[1], -s, -x[0]) for rank, x in enumerate(bad, 1)]
    return sorted(out)


@pytest.mark.parametrize("lane,block,first,widen", [(16 << 20, 1024, 2, 8), (16 * 48, 5, 1, 2), (40 * 48, 16, 3, 4)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, lane, block, first, widen):
    for name, value in (("LANE_BYTES", lane), ("BLOCK", block), ("FIRST_LANES", first), ("WIDEN", widen), ("QUERIES", 7 if block < 100 else 256), ("PIVOTS", 6)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").withColumn("q", F.lit("clash")).withColumn("v", F.lit(1)).repartition(4)
    got = hard_negatives.hard_negatives(hard_negatives.labelled_vectors(df, noisy=F.col("vec_id") % 7 == 0), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == mined(vectors())


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(hard_negatives.labelled_vectors(df), F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(50, [1.0, 2.0], 1)], df.schema)
    assert hard_negatives.hard_negatives(hard_negatives.labelled_vectors(one), F.col("vec_id") % 50 == 0).collect() == []


def test_keys_bound_every_score():
    rnd = np.random.default_rng(2)
    rows, asked = rnd.integers(-300, 300, (500, 8)), rnd.integers(-300, 300, (40, 8))
    longest = math.sqrt((rows**2).sum(1).max())
    x = hard_negatives.augmented(rows, longest)
    pivots = x[:7]
    d = hard_negatives.distances(x, pivots)
    near = d.argmin(1)
    own = hard_negatives.distances(np.hstack([asked, np.zeros((40, 1))]), pivots)
    dist = d[np.arange(500), near]
    most, least = hard_negatives.Bounds(near, dist, dist, longest).of(own, (asked**2).sum(1).astype(float))
    score = asked @ rows.T
    assert (score <= most).all() and (score >= least).all()
