"""Every dealt operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lorespark.llm import decontamination, exact_topk, id_store, language, packing, pii, queries, simhash, suffix_dedup, tokenizing, toxicity
from lorespark.llm.common import connected_components, crc_mod3
from lorespark.llm.token_counts import token_counts
from lorespark.llm.tokenizing import SegmentEncoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, b string"
WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def corpus(n=60, seed=1):
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", "nation", "Éclair", "tion's", "x1", "<|endoftext|>", "können", "a@b.co", "\t", "  ", "naïve."]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    texts += [texts[3], texts[3], texts[5] + " end", None, "", "   \n", "word " * 30000, "y" * 5000, "\x02a\nb", texts[7][:40]]
    rows = [(i, t, "en", "s", 1, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, (None, texts[3], None, None, None, None, None, None), rows[4], rows[4], (3, "another text under a used id", "en", "s", 1, "c", "c", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_counts(docs, empty):
    t = library(BYTE)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, BYTE).collect())
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus())
    assert got == want
    assert token_counts(empty, BYTE).collect() == []


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_segments_encode_as_the_library(path):
    enc, t, rnd = SegmentEncoder(path, memo_entries=50), library(path), random.Random(4)
    parts = [" ", "\n", "a", "B", "'s", "1", ".", "\t", "  ", "é", "É", "<|endoftext|>", "́", "\xa0", "ß", "\x1c", "\x85", "\x02", "\0", "ſ", "İ"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many(texts)] == want
    assert enc.count_many(texts, [len(t.encode()) for t in texts], 200) == [len(w) for w in want]


@pytest.mark.parametrize("at_once", [1, 100, 8 << 20])
def test_columns_encode_as_the_library(monkeypatch, at_once):
    monkeypatch.setattr(tokenizing, "COLUMN_BYTES", at_once)
    t, rnd = library(WORD), random.Random(5)
    parts = [" ", " ", "\n", "a", "B", "'s", "1", ".", ",", "<", "|", "\t", "é", "É", "Ñ", "Þ", "ÿ", "×", "÷", "µ", "<|endoftext|>", "<|ENDOFTEXT|>", "\u0301", "\u0338", "\xa0", "ß", "\0", "İ", "Ω", "Ж", "中", "😀", "K"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1000)] + [None, "", " ", "a" * 5000, "Éa" * 400 + ".", None]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for kind, entries in ((pa.string(), 5), (pa.large_string(), 400_000)):
        enc, column = SegmentEncoder(WORD, memo_entries=entries), pa.array(texts, kind)
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_column(column)] == want
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_column(column.slice(700, 290))] == want[700:990]
        assert [list(enc.encode_column(pa.array(x, kind))) for x in ([], [None], ["", "\n"])] == [[], [b""], [b"", b""]]


def test_distinct_words_share_library_calls():
    class Counted:
        def __init__(self, inner):
            self.inner, self.calls = inner, 0

        def __getattr__(self, name):
            self.calls += 1
            return getattr(self.inner, name)

    enc, t, rnd = SegmentEncoder(WORD), library(WORD), random.Random(6)
    used = [enc.tokenizer]
    enc.tokenizer = used[0] = Counted(enc.tokenizer)
    if getattr(enc, "letters", None) is not None:
        enc.letters = Counted(enc.letters)
        used.append(enc.letters)
    words = ["".join(rnd.choice("abcdeé") for _ in range(9)) + rnd.choice(["", ",", "."]) for _ in range(5000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 5000, 100)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode_many(texts * 2)] == [t.encode(x, add_special_tokens=False).ids for x in texts * 2]
    assert sum(u.calls for u in used) <= 50  # 5000 when each word is looked up alone


def test_id_store_round_trip(spark, docs, empty):
    t = library(WORD)
    path = id_store.write_ids(docs, WORD, end_id=1, shard_ids=4000)
    got = id_store.read_digests(spark, path).orderBy("start").collect()
    ids = {}
    for r in corpus():
        a = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        ids.setdefault(r[0], []).append((len(a), zlib.crc32(a.tobytes())))
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in corpus()), key=lambda k: (k is not None, k))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in ids.items()}
    keys = spark.createDataFrame([(5,), (9999,), (None,)], "doc_id long")
    looked = {r["doc_id"]: r["ids"] for r in id_store.lookup(spark, path, keys).collect()}
    assert looked == {5: [*t.encode(corpus()[5][1], add_special_tokens=False).ids, 1], 9999: None, None: None}
    nothing = id_store.write_ids(empty, WORD)
    assert id_store.read_digests(spark, nothing).collect() == []
    assert [r["ids"] for r in id_store.lookup(spark, nothing, keys).collect()] == [None] * 3


def test_every_key_finds_its_ids(spark, docs):
    path = id_store.write_ids(docs, WORD, end_id=1, shard_ids=500)
    t, first = library(WORD), {}
    for r in corpus():
        first.setdefault(r[0], []).append([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])
    keys = docs.select("doc_id").where("doc_id IS NOT NULL").union(spark.createDataFrame([(-5,), (10**9,)], "doc_id long")).distinct()
    found = id_store.lookup(spark, path, keys)
    assert all(r["ids"] in first.get(r["doc_id"], [None]) for r in found.collect()) and found.where("ids IS NULL").count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "CoGroup" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_perfect_hash(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 300, n)).astype("<i8")
    hashed = id_store.hash_keys(keys, id_store.turns(keys))
    pilots, slots = id_store.build_hash(hashed)
    assert sorted(slots.tolist()) == list(range(n))
    assert (id_store.find_slots(hashed, pilots, n) == slots).all() if n else True


def test_toxicity_learns_and_tags(spark, empty):
    rnd = random.Random(2)
    words = ["calm", "river", "stone", "green", "walk", "music", "paper", "cloud"]
    rows = []
    for i in range(400):
        own = [rnd.choice(words) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            own[rnd.randrange(30)] = rnd.choice(["grumph", "grumpha", "grumphel"])
            own[rnd.randrange(30)] = "vlotz"
        rows.append((i, " ".join(own), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn_toxicity(df, df.where("doc_id % 2 = 0"))
    extra = spark.createDataFrame([(1000, None, 0), (1001, "", 0), (1002, "you GRUMPHIX vlotz", 1), (1002, "you GRUMPHIX vlotz", 1)], df.schema)
    got = toxicity.score_toxicity(df.where("doc_id % 2 = 1").union(extra).withColumn("spans", F.lit("clash")), model).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 204
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 200
    # every score by all paths of tags, however a text came to its row; a clashing name and a null id do no harm
    odd = spark.createDataFrame([(None, "you GRUMPHIX vlotz"), (7, "a vlotz b"), (8, None)], "doc_id long, text string").withColumn("__text__", F.lit("grumphix")).withColumn("total", F.lit(1))
    a, b, c = model.scale
    for r in [*toxicity.score_toxicity(odd.withColumn("own", F.col("text")), model).collect()]:
        words, weight, mass = toxicity.WORDS.findall((r["own"] or "").lower()), 0.0, np.zeros(0)
        if words:
            e, mass = model.emissions(words), np.zeros(len(words))
            for tags in np.ndindex(*[2] * len(words)):
                w = np.exp(model.start[tags[0]] + sum(model.transitions[x, y] for x, y in zip(tags, tags[1:])) + sum(e[i] for i, y in enumerate(tags) if y))
                weight, mass = weight + w, mass + w * np.array(tags)
            mass = mass / weight
        assert r["__text__"] == "grumphix" and abs(r["score"] - 1 / (1 + np.exp(-(a + b * np.log1p(mass.sum()) + c * mass.max(initial=0.0))))) < 1e-9
    hit = next(r for r in got if r["doc_id"] == 1002)
    assert hit["spans"] and hit["spans"][0]["start"] == 4
    assert toxicity.score_toxicity(empty, model).collect() == []
    nothing = toxicity.learn_toxicity(df, df.where("false"))
    assert len(toxicity.score_toxicity(df, nothing).collect()) == 400


def test_marginals_are_those_of_all_paths():
    m = toxicity.Crf({"=a": 1.5}, np.array([[0.3, -0.4], [0.1, 0.9]]), np.array([0.2, -0.1]), -0.7)
    for words in (["a"], ["a", "b"], ["b", "a", "a", "c"]):
        e, total, mass = m.emissions(words), 0.0, np.zeros(len(words))
        for tags in np.ndindex(*[2] * len(words)):
            w = np.exp(m.start[tags[0]] + sum(m.transitions[a, b] for a, b in zip(tags, tags[1:])) + sum(e[i] for i, y in enumerate(tags) if y))
            total += w
            mass += w * np.array(tags)
        assert np.allclose(m.marginals([words, [], ["b"] * 9])[0], mass / total)


def brute_components(rows):
    def fp(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r[1]) for r in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    label[i] = min(label[i], label[j])
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0, f"{f:016x}", least.get(c, -1)) for r, f, c in zip(rows, fps, label, strict=True)), key=str)


def test_simhash_components(docs, empty):
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in simhash.simhash_components(docs).collect()]
    short = [r for r in corpus() if len(r[1] or "") < 1000]
    want = brute_components(short)
    assert [x for x in sorted(got, key=str) if x in want] == want and len(got) == len(corpus())
    assert simhash.simhash_components(empty).collect() == []


def test_links_keep_components(spark):
    rnd, fps = random.Random(3), set()
    for _ in range(150):
        base = rnd.getrandbits(64)
        fps |= {base, base ^ (1 << rnd.randrange(64)), base ^ (7 << rnd.randrange(60)), base ^ (15 << rnd.randrange(60))}
    center = rnd.getrandbits(64)
    for _ in range(700):
        x = center
        for _ in range(rnd.randint(0, 6)):
            x ^= 1 << rnd.randrange(26)
        fps.add(x)
    a = np.array(sorted(fps), "<u8")
    parent = list(range(len(a)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= 3):
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(int(x),) for x in a.view("<i8")], "fp long")
    comp = {r["node"]: r["component"] for r in connected_components(simhash.near_links(df, block=64)).collect()}
    mine, theirs = {}, {}
    for i, x in enumerate(a.view("<i8").tolist()):
        mine.setdefault(comp.get(x, x), set()).add(x)
        theirs.setdefault(root(i), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
    assert connected_components(edges.where("false")).collect() == []


def test_packing(docs, empty):
    t, cap = library(WORD), 64
    got = packing.pack_documents(docs, WORD, cap).collect()
    want = []
    for r in corpus():
        a = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0] if r[0] is not None else -1, i // cap, i, len(a[i : i + cap]), zlib.crc32(a[i : i + cap].tobytes())) for i in range(0, len(a), cap)]
    assert sorted((r[0] if r[0] is not None else -1, *r[1:5]) for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= cap
    assert len(seqs) <= -(-sum(r["length"] for r in got) // cap) * 1.1 + 1
    assert packing.pack_documents(empty, WORD).collect() == []


def optimum(items, cap):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, cap - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_reduction_loses_no_bin():
    rnd = random.Random(6)
    for _ in range(150):
        cap = rnd.choice([10, 13, 20])
        items = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
        counts = packing._Counts({w: items.count(w) for w in set(items)})
        fixed = packing.reduce_dominated(counts, cap)
        rest = [w for w, c in counts.n.items() for _ in range(c)]
        assert sum(k for k, _ in fixed) + (optimum(rest, cap) if rest else 0) == optimum(items, cap)
        used = [w for k, s in fixed for w in s for _ in range(k)]
        assert sorted(used + rest) == sorted(items)


@pytest.mark.parametrize(("head", "lane", "group"), [(4096, 1024, 1 << 20), (3, 40, 2)])
def test_exact_topk(spark, monkeypatch, head, lane, group):
    # few long vectors first, many lanes, queries in groups; ties run across lanes
    for name, value in (("HEAD_ROWS", head), ("LANE_ROWS", lane), ("QUERY_GROUP", group)):
        monkeypatch.setattr(exact_topk, name, value)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=6) * rnd.integers(1, 5)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (550, [1.0, 2.0]), (600, []), (650, [-9.0] * 6), (700, [0.0] * 6), (None, [1.0] * 6), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = {}
    for r in exact_topk.exact_topk(exact_topk.scaled_vectors(df), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array([int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in good:
        if q % 50 == 0:
            best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
            want[q] = [(k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert exact_topk.exact_topk(exact_topk.scaled_vectors(df.where("false")), F.col("vec_id") % 50 == 0).collect() == []
    one = exact_topk.exact_topk(exact_topk.scaled_vectors(df.where("vec_id = 0")), F.col("vec_id") % 50 == 0)
    assert one.collect() == []


def out_of_place(text, profiles):
    """Brute force: ranks by falling count; an n-gram's rank is the number of more frequent ones; the first language by name wins."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = {}
    for w in words:
        for n in (1, 2, 3):
            for i in range(len(w) + 3 - n):
                g = f"_{w}_"[i : i + n]
                counts[g] = counts.get(g, 0) + 1
    if not counts:
        return "und"
    ranks = {g: r for g, n in counts.items() if (r := sum(m > n for m in counts.values())) < language.RANKS}
    away = {k: sum(abs(p.get(g, language.RANKS) - r) for g, r in ranks.items()) for k, p in profiles.items()}
    return min(sorted(away), key=away.get)


def test_language_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    profiles = language.learn_profiles(docs.where(crc_mod3(F.col("doc_id")) != 1), "text", "lang", F.col("doc_id"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = queries.op7_language_id(spark, sf).collect()
    assert len(rows) == len(texts) and list(rows[0].asDict()) == ["doc_id", "held_out", "lang_pred", "score"]
    for r in rows:
        assert r["lang_pred"] == out_of_place(texts[r["doc_id"]] or "", profiles)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_query_columns(spark):
    """The registered queries themselves: columns in order, a row a document, flags and thresholds."""
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    made = {k: q(spark, sf).collect() for k, q in queries.queries().items() if k.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op8", "op9")}
    want = {
        "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op2_token_id_store": ["doc_id", "start", "n_tokens", "ids_crc32"], "op3_toxicity": ["doc_id", "held_out", "score", "predicted", "spans"],
        "op4_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"], "op8_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_spans", "base_sha256", "spans"], "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    }
    for name, columns in want.items():
        assert list(made[name][0].asDict()) == columns and len(made[name]) == n, name
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in made["op1_token_counts"])
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in made["op3_toxicity"])
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in made["op3_toxicity"])
    starts = sorted((r["start"], r["n_tokens"]) for r in made["op2_token_id_store"])
    assert [s for s, _ in starts] == [sum(k for _, k in starts[:i]) for i in range(len(starts))]
    assert {r["doc_id"] for r in made["op5_best_fit_packing"]} == {r["doc_id"] for r in made["op1_token_counts"]}


def test_letters():
    assert language.letter_runs("² ½ Ⅳ ٣") == [] and language.letter_runs("ab²c Éé") == ["ab", "c", "éé"]


def test_language(spark, empty):
    rnd = random.Random(8)
    kinds = {"aa": ["papa", "tapa", "kapat", "taka"], "bb": ["mimo", "nimol", "limo", "ilom"]}
    rows = [(i, " ".join(rnd.choice(kinds[k]) for _ in range(20)), k, "clash") for i in range(200) for k in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa", "x"), (901, "12 !!", "aa", "x"), (902, "papa " * 20000, None, "x"), (None, "limo nimol", "bb", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = language.learn_profiles(df.where(crc_mod3(F.col("doc_id")) != 1), "text", "lang", F.col("doc_id"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_languages(df, profiles).collect()}
    assert all(got[r[0]][0] == r[2] for r in rows[:200])
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] == "aa" and got[None][0] == "bb"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.predict_languages(empty, profiles).collect() == []
    assert language.learn_profiles(empty, "text", "lang", F.col("doc_id")) == {}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def base_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_pii_spans():
    rnd, finder = random.Random(5), pii.Finder()
    parts = [*"0123456789", "@", ".", "a", "b", " ", "-", "+", "(", ")", "%", "_", "\n", "é", 'token = "', "://", "1.2.3.4", "a@b.c", "+1 (017) 555-7713", "4111111111111111", "𝒳"]
    for _ in range(6000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert [s for s in finder.spans(t) if s[0] in pii.BASE_KINDS] == base_spans(t), t
    long = "x" * 3000 + "@b.co " + "y@" * 30 + "q.r " + "9" * 4000
    assert [s for s in finder.spans(long) if s[0] in pii.BASE_KINDS] == base_spans(long)
    assert [s[0] for s in finder.spans("IBAN: GB82 WEST 1234 5698 7654 32 token = 'abcdefghijklmnop1' ftp://u:p@h.org/x")] == ["iban", "secret", "url", "email"]


def test_pii_query(spark, docs, empty):
    got = pii.pii_digest(docs).collect()
    assert len(got) == len(corpus())
    by = {r["doc_id"]: r for r in got}
    for r in corpus()[:60]:
        spans = base_spans(r[1])
        if r[0] not in (3, 4):
            assert by[r[0]]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
            assert by[r[0]]["n_email"] == sum(s[0] == "email" for s in spans)
            assert by[r[0]]["n_spans"] == len(list(filter(None, by[r[0]]["spans"].split(","))))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and "@" not in "".join(r["text"] or "" for r in clean.collect())
    assert pii.pii_digest(empty).collect() == []


def brute_repeats(rows, span):
    first, out = {}, []
    for r in rows:
        b, d = (r[1] or "").encode(), 1 << 62 if r[0] is None else r[0]
        for i in range(len(b) - span + 1):
            g = b[i : i + span]
            first[g] = min(first.get(g, d), d)
    for r in rows:
        b, d = (r[1] or "").encode(), 1 << 62 if r[0] is None else r[0]
        mark = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                mark[i : i + span] = b"\1" * span
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((str(r[0]), len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark, docs, empty):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.cut_repeats(docs).collect())
    assert got == brute_repeats(corpus(), 50)
    assert suffix_dedup.cut_repeats(empty).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_repeats_inside_a_document(spark, parts):
    rnd = random.Random(14)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    lines = [text(120) for _ in range(6)]
    rows = []
    for i in range(30):
        line, other = rnd.sample(lines, 2)
        cut = line[rnd.randint(0, 30) : 120 - rnd.randint(0, 30)]
        rows.append((i // 2 if i % 5 == 0 else i, text(30) + line + text(20) + line + text(9) + cut + text(5) + cut + other[:70]))
    rows += [(None, lines[0] * 2 + text(60) + lines[0]), (None, text(10) + lines[0] + text(10) + lines[0]), (3, lines[1] + lines[1][:60] + text(7) + lines[1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.cut_repeats(df).collect())
    assert got == brute_repeats(rows, 50)


@pytest.mark.parametrize(
    "sizes",
    [
        suffix_dedup.Sizes(segment=128, flush=600, bucket=200, merge=64, shards=3, crowd=3, key_rows=1 << 14),
        suffix_dedup.Sizes(segment=1 << 18, flush=4000, bucket=900, merge=1 << 20, shards=2, crowd=1 << 10, key_rows=4),
        suffix_dedup.Sizes(segment=200, flush=1 << 20, bucket=1 << 20, merge=1, shards=1, crowd=5, key_rows=2),
    ],
)
def test_crowded_windows_at_small_sizes(spark, sizes):
    rnd = random.Random(9)
    line = "".join(rnd.choice("abcdefgh ") for _ in range(70))
    rows = [(i, "".join(rnd.choice("xyzéw ") for _ in range(rnd.randint(0, 60))) + line[rnd.randint(0, 12) :] + "".join(rnd.choice("xyzw ") for _ in range(40))) for i in range(40)]
    rows += [(7, rows[3][1]), (2, rows[2][1]), (None, rows[1][1] + "z"), (None, None), (50, "long " * 300 + rows[8][1]), (51, rows[8][1] + "long " * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.cut_repeats(df, sizes=sizes).collect())
    assert got == brute_repeats(rows, 50)


def test_merge_groups_common_prefixes():
    rnd = random.Random(10)
    for _ in range(30):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 9))]
        docs = np.array([rnd.randint(0, 4) for _ in strings])
        s, at = suffix_dedup.repeated_grams(strings, docs, span=6, shards=3)
        first = {}
        for t, d in zip(strings, docs.tolist(), strict=True):
            for i in range(len(t) - 5):
                first[t[i : i + 6]] = min(first.get(t[i : i + 6], d), d)
        want = sorted((k, i) for k, t in enumerate(strings) for i in range(len(t) - 5) if first[t[i : i + 6]] < docs[k])
        assert sorted(zip(s.tolist(), at.tolist(), strict=True)) == want


@pytest.mark.parametrize("letters", [b"ab", bytes(range(1, 255))])
def test_merges_sort_each_suffix_a_third_as_often_as_it_has_bytes(monkeypatch, letters):
    rnd, sorted_ = random.Random(12), [0]
    pool = [bytes(rnd.choice(letters) for _ in range(90)) for _ in range(40)]
    strings = [pool[rnd.randrange(40)][rnd.randint(0, 30) :] for _ in range(120)] + [b"", b"a"]
    docs = np.array([rnd.randint(0, 50) for _ in strings])
    argsort = np.argsort

    def counted(a, *args, **kw):
        sorted_[0] += len(a)
        return argsort(a, *args, **kw)

    monkeypatch.setattr(suffix_dedup.np, "argsort", counted)
    s, at = suffix_dedup.repeated_grams(strings, docs)
    monkeypatch.undo()
    first = {}
    for t, d in zip(strings, docs.tolist(), strict=True):
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    assert sorted(zip(s.tolist(), at.tolist(), strict=True)) == sorted((k, i) for k, t in enumerate(strings) for i in range(len(t) - 49) if first[t[i : i + 50]] < docs[k])
    # four ranks of a shard's transform, and rounds of two bytes or more over blocks that several shards share
    assert sorted_[0] <= 30 * sum(len(t) + 1 for t in strings)


def test_known_windows_are_dealt_over_all_buckets(spark):
    rnd = random.Random(15)
    line = bytes(rnd.choice(b"abcdefgh ") for _ in range(400))
    rows = [(2 * i + j, 0, bytes(rnd.choice(b"abcdefgh ") for _ in range(60)) + line) for i in range(60) for j in range(2)]
    df = spark.createDataFrame(rows, "doc long, th long, b binary").repartition(2, "doc")
    known = suffix_dedup.spots(df, 16, sizes=suffix_dedup.Sizes(flush=900)).where("known").groupBy("bucket").count().collect()
    assert len(known) >= 8 and max(r["count"] for r in known) <= sum(r["count"] for r in known) / 2


def test_windows_are_dealt_evenly_over_buckets(spark):
    rnd = random.Random(16)
    rows = [(i, 0, bytes(rnd.choice(b"abcdefgh ") for _ in range(20000))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc long, th long, b binary")
    sizes = {r["bucket"]: r["n"] for r in suffix_dedup.spots(df, 20).groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("n")).collect()}
    assert len(sizes) == 20 and max(sizes.values()) <= 2 * min(sizes.values())


def test_blocks_of_one_shard_leave_a_merge():
    rnd = random.Random(13)
    for _ in range(30):
        shards = [[bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 5))] for _ in range(3)]
        raised = [suffix_dedup._raised(x) for x in shards]
        starts = np.cumsum([0] + [len(r) for r in raised])
        orders = [suffix_dedup.shard_transform(r, 5)[0] + a for r, a in zip(raised, starts, strict=False)]
        places, cuts = suffix_dedup.merge_transforms(np.concatenate(raised), orders, 5)
        text, of = np.concatenate(raised).tobytes(), lambda p: int(np.searchsorted(starts, p, side="right"))
        want = {}
        for p in range(len(text) - 4):
            if 0 not in text[p : p + 5]:
                want.setdefault(text[p : p + 5], []).append(p)
        want = sorted((g, sorted(ps)) for g, ps in want.items() if len({of(p) for p in ps}) > 1)
        blocks = [b.tolist() for b in np.split(places, cuts[1:])] if len(places) else []
        assert [(text[b[0] : b[0] + 5], sorted(b)) for b in blocks] == want
        assert all([of(p) for p in b] == sorted(of(p) for p in b) for b in blocks)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination(spark, empty, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", limit)
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(5)] + [(9, None), (10, "too short"), (0, None)]
    leaked = items[1][1].split()
    for k in (3, 11, 20, 28):
        leaked[k] = "zzz"
    rows = [(0, " ".join(words(80))), (1, " ".join(words(20) + items[0][1].upper().split() + words(20))), (2, "X, " + "; ".join(leaked)), (3, " ".join(items[2][1].split()[8:24])), (4, None), (5, ""), (6, items[4][1] + " " + items[4][1]), (6, items[4][1]), (7, "word " * 20000), (None, items[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(1)).withColumn("item", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): (r["n_match"], r["n_item"]) for r in decontamination.overlaps(df, bench).collect()}
    assert got == {(1, 0): (30, 30), (2, 1): (26, 30), (3, 2): (16, 30), (6, 4): (30, 30), (None, 3): (30, 30)}
    assert decontamination.overlaps(empty, bench).collect() == []
    assert decontamination.overlaps(df, bench.where("false")).collect() == []


@pytest.mark.parametrize("n", range(1, 20))
def test_seeds_hit_every_placing(n):
    """All ways to have 70 % of n tokens in place; a window's 11 of 13 are among those of 13."""
    masks = [m for m, least, most in decontamination.SEEDS if least <= n and (most is None or n <= most)]
    for on in itertools.combinations(range(n), -(-7 * n // 10)):
        assert any(all(at + i in on for i, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)), on


def test_decontamination_misses_no_placing(spark):
    rnd = random.Random(13)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(n, [rnd.choice(vocab) for _ in range(n)]) for n in (1, 2, 3, 4, 5, 7, 9, 10, 12, 13, 15, 20, 25, 40, 60)]
    rows = []
    for n, item in items:
        for every, at in [(4, 0), (4, 2), (6, 1), (6, 5), (10**9, 1)]:
            own = ["zzz" if i % every == at % every and every < n else w for i, w in enumerate(item)]
            rows.append([rnd.choice(vocab) for _ in range(5)] + own + [rnd.choice(vocab) for _ in range(5)])
        for share in (0.2, 0.25, 0.3):
            rows.append(["zzz" if rnd.random() < share else w for w in item])
        rows.append(item[n // 3 :])

    def laid(doc, item):
        best, width = None, min(13, len(item))
        for diag in range(-len(item), len(doc)):
            same = [0 <= i + diag < len(doc) and doc[i + diag] == w for i, w in enumerate(item)]
            window = max(sum(same[k : k + width]) for k in range(len(item) - width + 1))
            if sum(same) >= -(-7 * len(item) // 10) or window >= -(-4 * width // 5):
                best = max(best or (0, 0), (sum(same), window))
        return best and best[0]

    want = {(i, n): m for i, doc in enumerate(rows) for n, item in items if (m := laid(doc, item))}
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["n_match"] for r in decontamination.overlaps(df, bench).collect()} == want
