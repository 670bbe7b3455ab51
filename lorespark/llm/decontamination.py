"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a fixed mask over neighbouring tokens that ignores some of them. Hashes of the masked
tokens of test items and training texts are joined; around every hit the item is laid over the text
without gaps and its tokens are compared, so that substituted tokens do not hide an overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed masks (tokens marked 1 are hashed, those marked 0 ignored), and the fewest and most tokens of the items
#: that each is for. Every placing with 70 % of an item or 11 of 13 neighbours in place holds one: true of all
#: patterns of each length up to 19 (the tests enumerate them), and longer ones can be cut into lengths from 10 to 19.
SEEDS = (("11101", 10, None), ("100111", 10, None), ("11000011", 10, None), ("100001011", 10, None), ("111", 3, 9), ("1101", 4, 9), ("1011", 4, 9), ("11", 2, 2), ("1", 1, 1))
#: Largest number of distinct item hashes that is broadcast; more are joined by shuffle.
BROADCAST_SEEDS = 1_000_000


def token_hashes(text: F.Column) -> F.Column:
    """Hashes of the lower-case tokens (runs of letters and digits) of a whole text; null has none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda w: w != ""), lambda w: F.xxhash64(w))


def seed_hashes(tokens: F.Column, seeds: tuple[tuple[str, int, int | None], ...] = SEEDS) -> F.Column:
    """Struct (at, seed) of every place and mask that fits, of the masks for items of this length."""
    none = F.array().cast("array<struct<at:int,seed:bigint>>")
    for_length = lambda least, most: (F.size(tokens) >= least) & (F.lit(True) if most is None else F.size(tokens) <= most)
    return F.concat(*[F.when(for_length(least, most), _each_seed(tokens, mask, m)).otherwise(none) for m, (mask, least, most) in enumerate(seeds)])


def _each_seed(tokens: F.Column, mask: str, m: int) -> F.Column:
    on = [i for i, c in enumerate(mask) if c == "1"]
    return F.transform(_places(tokens, mask), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(m), *[F.get(tokens, i + o) for o in on]).alias("seed")))


def _places(tokens: F.Column, mask: str) -> F.Column:
    last = F.size(tokens) - len(mask)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def overlaps(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = 13, least_window: float = 0.8, least_item: float = 0.7, seeds: tuple[tuple[str, int, int | None], ...] = SEEDS) -> DataFrame:
    """Pairs of a training text and a test item that overlap, whatever else either holds.

    Returns ``doc_id, item_id, n_item`` (the item's tokens), ``n_match`` (most tokens in place at one
    placing), ``best_window`` (most tokens in place in ``window`` neighbours, or in the whole item if
    it is shorter) and ``n_places`` (placings that qualify). A placing qualifies with at least
    ``least_window`` of a window or ``least_item`` of the item in place. Every text is searched whole.
    Null or empty texts and items overlap nothing. Repeated rows count once; texts that share an id, null ids too, are each judged on their own; other columns are
    not read; empty tables give an empty result. The masks miss no placing that qualifies at these
    thresholds or higher ones; those for short items cost nothing where there are none.

    The item side is broadcast only up to BROADCAST_SEEDS seeds, counted first, and hits are reduced by (text,
    item, placing) before any shuffle. Beyond that both sides are shuffled by seed, a place being four numbers; hits are
    reduced to placings, and only then meet the tokens of their text.
    """
    found = placings(docs, items, doc_key, item_key, text, window, least_window, least_item, seeds)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.max("n_match").alias("n_match"), F.max("best_window").alias("best_window"), F.count(F.lit(1)).alias("n_places"))


def placings(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = 13, least_window: float = 0.8, least_item: float = 0.7, seeds: tuple[tuple[str, int, int | None], ...] = SEEDS) -> DataFrame:
    """The placings of ``overlaps`` that qualify, once a text: ``doc_id, th`` (the text's xxhash64), ``item_id`` and counts."""
    tests = items.select(F.col(f"`{item_key}`").alias("item_id"), token_hashes(F.col(f"`{text}`")).alias("item")).withColumn("ih", F.xxhash64("item")).distinct()
    item_seeds = tests.select("ih", F.size("item").alias("n_item"), F.explode(seed_hashes(F.col("item"), seeds)).alias("s")).select("ih", "n_item", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed")).distinct()
    sizes = tests.select(F.size("item").alias("n")).distinct()
    used = sizes.agg(*[F.max((F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most)) for _, least, most in seeds]).first()
    masks = [(m, mask) for m, (mask, _, _) in enumerate(seeds) if used[m]] or [(0, seeds[0][0])]
    few = item_seeds.count() <= BROADCAST_SEEDS
    tokens = docs.select(F.col(f"`{doc_key}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), token_hashes(F.col(f"`{text}`")).alias("tokens"))
    # places are exploded before they are hashed, so that hashing and looking up run in generated code
    placed = tokens.where(F.size("tokens") > 0).select("doc_id", "th", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("at"))
    placed = placed.select("doc_id", "th", "tokens", "at", F.explode(F.array(*[_seed(F.col("tokens"), F.col("at"), mask, m) for m, mask in masks])).alias("seed"))
    diag = F.col("at") - F.col("item_at")
    if few:
        hits = placed.join(F.broadcast(item_seeds), "seed").withColumn("diag", diag)
    else:
        # places meet seeds by key alone; the tokens of texts that were hit follow once for each placing
        keys = placed.select("doc_id", "th", "at", "seed").join(item_seeds, "seed").select("doc_id", "th", "ih", "n_item", diag.alias("diag")).distinct()
        own = tokens.dropDuplicates(["doc_id", "th"])
        hits = keys.join(own, (keys["th"] == own["th"]) & keys["doc_id"].eqNullSafe(own["doc_id"])).select(keys["doc_id"], keys["th"], "ih", "n_item", "diag", "tokens")
    skip = F.greatest(-F.col("diag"), F.lit(0))
    laid = hits.select("doc_id", "th", "ih", "diag", F.slice("tokens", F.greatest("diag", F.lit(0)) + 1, F.col("n_item") - skip).alias("own"))
    laid = laid.groupBy("doc_id", "th", "ih", "diag").agg(F.first("own").alias("own")).join(tests, "ih")
    same = F.transform("item", lambda t, i: F.coalesce((F.get("own", i - skip) == t) & (i >= skip), F.lit(False)).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    laid = laid.withColumn("same", same)
    width = F.least(F.lit(window), F.size("same"))
    starts = F.sequence(F.lit(1), F.size("same") - width + 1)
    scored = laid.select("doc_id", "th", "item_id", F.size("item").alias("n_item"), total("same").alias("n_match"), width.alias("width"), F.array_max(F.transform(starts, lambda s: total(F.slice("same", s, width)))).alias("best_window"))
    # a whole-item match of few tokens says little: the window decides there
    good = (F.col("best_window") >= F.ceil(F.lit(least_window) * F.col("width"))) | (F.col("n_match") >= F.ceil(F.lit(least_item) * F.col("n_item")))
    return scored.where(good)


def _seed(tokens: F.Column, at: F.Column, mask: str, m: int) -> F.Column:
    """Hash of the masked tokens from ``at`` on; null where the mask does not fit."""
    on = [i for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(tokens), F.xxhash64(F.lit(m), *[F.get(tokens, at + o) for o in on]))


def oracle(window: int = 13, least_window: float = 0.8, least_item: float = 0.7) -> str:
    """The same rows in DuckDB SQL without seeds: equal tokens of every text and item are counted by placing."""
    cut = "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {cut} AS t FROM documents), b AS (SELECT DISTINCT item_id, {cut} AS t FROM benchmark),
dt AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS at FROM d), bt AS (SELECT item_id, len(t) AS n_item, unnest(t) AS w, unnest(range(len(t))) AS at FROM b),
counted AS (SELECT doc_id, item_id, n_item, dt.at - bt.at AS diag, count(*) AS n_match, list(bt.at) AS places FROM dt JOIN bt USING (w)
  GROUP BY doc_id, item_id, n_item, diag HAVING count(*) >= least(ceil({least_window} * least({window}, n_item)), ceil({least_item} * n_item))),
scored AS (SELECT *, least({window}, n_item) AS width,
  CAST(list_max(list_transform(range(0, n_item - least({window}, n_item) + 1), lambda k: len(list_filter(places, lambda x: x >= k AND x < k + least({window}, n_item))))) AS BIGINT) AS best_window FROM counted)
SELECT doc_id, item_id, CAST(max(n_item) AS INTEGER) AS n_item, CAST(max(n_match) AS INTEGER) AS n_match, CAST(max(best_window) AS INTEGER) AS best_window, count(*) AS n_places
FROM scored WHERE best_window >= ceil({least_window} * width) OR n_match >= ceil({least_item} * n_item) GROUP BY doc_id, item_id
"""
