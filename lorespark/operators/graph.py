"""Co-author, institution and advisor edges; neighbours; conflicts of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def resolve_names(names: DataFrame) -> DataFrame:
    """``names(key, rid)``: the one rid of a folded name; names that two people share resolve to null."""
    return names.groupBy("key").agg(F.when(F.count_distinct("rid") == 1, F.min("rid")).alias("rid"))


#: Members of a side: a task of ``tiled_pairs`` meets two sides at most.
SIDE = 256


def tiled_pairs(rows: DataFrame, key: str, member: str, side: int | None = None) -> DataFrame:
    """Pairs of rows that share ``key``, once each: ``key, a, b`` with a's member before b's; rows of one member are no pair.

    A key with many rows is dealt into sides by hash, and every two sides meet under a key of their own:
    a row is copied once a side, so a group of n rows costs n * n / ``side`` copies for its n * n / 2 pairs, and no
    key holds more than two sides, however hot the group. Groups up to ``side`` rows are one side.
    """
    side = side or SIDE
    many = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / side).cast("int").alias("__s")).where("__s > 1")
    own = rows.select(key, F.struct("*").alias("__r")).join(many, key, "left").withColumn("__s", F.coalesce("__s", F.lit(1)))
    own = own.withColumn("__k", F.pmod(F.xxhash64(F.col("__r")[member]), F.col("__s")).cast("int"))
    left = own.select(key, F.col("__k").alias("__i"), F.explode(F.sequence("__k", F.col("__s") - 1)).alias("__j"), F.col("__r").alias("a"))
    right = own.select(key, F.explode(F.sequence(F.lit(0), "__k")).alias("__i"), F.col("__k").alias("__j"), F.col("__r").alias("b"))
    x, y = F.col("a")[member], F.col("b")[member]
    met = left.join(right, [key, "__i", "__j"]).where((x < y) | ((F.col("__i") < F.col("__j")) & (x > y)))
    turned = x > y
    return met.select(key, F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))


def _merged(pairs: DataFrame) -> DataFrame:
    """Edges of ``pairs(src, dst, year, oa, ob, pa, pb)``, one row a pair and work."""
    conf = F.when(F.col("oa") & F.col("ob"), 2).when(F.col("pa") & F.col("pb"), 1).otherwise(0)
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("paper_count"), F.min("year").alias("first_year"),
        F.max("year").alias("last_year"), F.max(conf).alias("confidence"))


def coauthor_edges(parts: DataFrame, evidence: int = 0) -> DataFrame:
    """``parts(work, person, year, profiled, owns)``, one row a person and work.

    Pairs of a work with a profiled endpoint: count, first and last year, best confidence. Pairs are tiled, so a
    work of thousands is many bounded tasks. ``evidence``: also the first so many works of each pair, in order; of
    a pair with more only those are kept from the first task on, and ``paper_count`` still counts all.
    """
    pairs = tiled_pairs(parts, "work", "person").where(F.col("a.profiled") | F.col("b.profiled"))
    pairs = pairs.select("work", F.col("a.person").alias("src"), F.col("b.person").alias("dst"), F.col("a.year").alias("year"),
        F.col("a.owns").alias("oa"), F.col("b.owns").alias("ob"), F.col("a.profiled").alias("pa"), F.col("b.profiled").alias("pb"))
    edges = _merged(pairs)
    if not evidence:
        return edges
    first = pairs.select("src", "dst", "work").withColumn("__n", F.row_number().over(Window.partitionBy("src", "dst").orderBy("work"))).where(F.col("__n") <= evidence)
    return edges.join(first.groupBy("src", "dst").agg(F.array_sort(F.collect_list("work")).alias("evidence")), ["src", "dst"])


def coauthors_of(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``coauthor_edges`` of the asked ``pairs(src, dst)`` alone: works are thinned to the people asked, and pairs to those asked before they are added up."""
    asked = pairs.select("src", "dst").distinct()
    who = asked.select(F.col("src").alias("person")).union(asked.select("dst")).distinct()
    made = tiled_pairs(parts.join(who, "person", "left_semi"), "work", "person").where(F.col("a.profiled") | F.col("b.profiled"))
    made = made.select(F.col("a.person").alias("src"), F.col("b.person").alias("dst"), F.col("a.year").alias("year"), F.col("a.owns").alias("oa"),
        F.col("b.owns").alias("ob"), F.col("a.profiled").alias("pa"), F.col("b.profiled").alias("pb"))
    return _merged(made.join(asked, ["src", "dst"], "left_semi"))


def spans_overlap(lo_a, hi_a, lo_b, hi_b):
    """Closed spans with open ends; null if either side has no year at all."""
    big = 10**9
    none = (lo_a.isNull() & hi_a.isNull()) | (lo_b.isNull() & hi_b.isNull())
    return F.when(~none, (F.coalesce(lo_a, F.lit(-big)) <= F.coalesce(hi_b, F.lit(big))) & (F.coalesce(lo_b, F.lit(-big)) <= F.coalesce(hi_a, F.lit(big))))


def institution_edges(stays: DataFrame) -> DataFrame:
    """``stays(person, inst, lo, hi, ordinal)``: profiled pairs that share an institution, tiled; the last one by ordinal names the edge.

    A row a person and institution carries what decides a pair: the person's spans there and, if there are several, all the person's
    institutions. So a pair that meets in several of them is told in one alone, and pairs are never shuffled.
    """
    here = stays.where("person IS NOT NULL AND inst IS NOT NULL").groupBy("person", "inst").agg(F.max("ordinal").alias("o"),
        F.collect_set(F.when(F.col("lo").isNotNull() | F.col("hi").isNotNull(), F.struct("lo", "hi"))).alias("spans"))
    at = F.collect_list(F.struct("o", "inst")).over(Window.partitionBy("person"))
    one = F.size("spans") <= 1
    rows = settled(here.withColumn("at", at).select("person", "inst", "o", F.get("spans", F.lit(0)).getField("lo").alias("lo"), F.get("spans", F.lit(0)).getField("hi").alias("hi"),
        F.when(~one, F.col("spans")).alias("spans"), F.when(F.size("at") > 1, F.col("at")).alias("at")))
    pairs = tiled_pairs(rows, "inst", "person")
    meet = spans_overlap(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))
    if not rows.where("spans IS NOT NULL OR at IS NOT NULL").isEmpty():
        of = lambda x: F.coalesce(F.col(f"{x}.spans"), F.filter(F.array(F.struct(F.col(f"{x}.lo").alias("lo"), F.col(f"{x}.hi").alias("hi"))), lambda s: s["lo"].isNotNull() | s["hi"].isNotNull()))
        some = F.exists(of("a"), lambda s: F.exists(of("b"), lambda t: spans_overlap(s["lo"], s["hi"], t["lo"], t["hi"])))
        many = F.when((F.size(of("a")) > 0) & (F.size(of("b")) > 0), some)
        meet = F.when(F.col("a.spans").isNull() & F.col("b.spans").isNull(), meet).otherwise(many)
        both = F.filter("a.at", lambda s: F.exists("b.at", lambda t: t["inst"] == s["inst"]))
        last = F.array_max(F.transform(both, lambda s: F.struct(F.greatest(s["o"], F.array_max(F.transform(F.filter("b.at", lambda t: t["inst"] == s["inst"]), lambda t: t["o"]))).alias("o"), s["inst"].alias("inst"))))
        pairs = pairs.where(F.when(F.col("a.at").isNull() | F.col("b.at").isNull(), F.lit(True)).otherwise(last["inst"] == F.col("inst")))
    return pairs.select(F.col("a.person").alias("src"), F.col("b.person").alias("dst"), F.col("inst").alias("institution"), meet.alias("overlap"),
        F.when(F.startswith("inst", F.lit("ror:")), "high").otherwise("medium").alias("confidence"))


def advised_edges(training: DataFrame, index: DataFrame) -> DataFrame:
    """``training(person, ordinal, advisor_key, year_end)``: advisor to student; unknown advisors are external."""
    own = training.join(index.withColumnRenamed("key", "advisor_key"), "advisor_key", "left")
    src = F.coalesce("rid", F.concat(F.lit("ext:"), F.col("advisor_key")))
    return own.select(src.alias("src"), F.col("person").alias("dst"), "ordinal", "year_end").where("src <> dst").groupBy("src",
        "dst").agg(F.min_by("year_end", F.when(F.col("year_end").isNotNull(), F.col("ordinal"))).alias("last_year"))


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select(F.col("dst"), F.col("src"), *rest))


def neighbors(edges: DataFrame, origin, max_hops: int = 3, types: tuple[str, ...] | None = None, since_year: int | None = None) -> DataFrame:
    """People within ``max_hops`` of ``origin``: least hops, strongest edge; both directions; origin apart.

    ``types``: edges of these ``type`` only; ``since_year``: edges whose ``last_year`` is not before it (unknown
    counts). Edges are written once, in both directions; each hop is one join of the frontier, which is kept distinct.
    """
    if types:
        edges = edges.where(F.col("type").isin(*types))
    if since_year is not None:
        edges = edges.where(F.col("last_year").isNull() | (F.col("last_year") >= since_year))
    two = settled(both_ways(edges.select("src", "dst", "paper_count", "last_year")))
    seen = None
    frontier = edges.sparkSession.createDataFrame([(origin,)], f"node {dict(edges.dtypes)['src']}")
    visited = frontier
    for hop in range(1, max_hops + 1):
        step = settled(two.join(frontier.withColumnRenamed("node", "src"),
            "src").where(F.col("dst") != F.lit(origin)).groupBy("dst").agg(F.max("paper_count").alias("paper_count"),
                F.max("last_year").alias("last_year")).withColumn("hops", F.lit(hop)))
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select(F.col("dst").alias("node")).join(visited, "node", "left_anti")
        visited = visited.union(frontier)
    return seen.groupBy("dst").agg(F.min("hops").alias("hops"), F.max("paper_count").alias("paper_count"), F.max("last_year").alias("last_year"))


def _asked_pairs(authors: DataFrame, candidates: DataFrame) -> DataFrame:
    return authors.select("paper", "person").join(candidates, "paper").where("person <> candidate").select("paper", "person", "candidate",
        F.least("person", "candidate").alias("src"), F.greatest("person", "candidate").alias("dst")).distinct()


def shared_stays(pairs: DataFrame, stays: DataFrame) -> DataFrame:
    """``pairs(paper, person, candidate)`` that were at one institution, by the stays of those asked alone."""
    left = stays.select("person", "inst").distinct()
    right = left.select(F.col("person").alias("candidate"), "inst")
    return pairs.join(left, "person").join(right, ["candidate", "inst"]).select("paper", "candidate", "person").distinct()


def conflicts(authors: DataFrame, candidates: DataFrame, coauthors: DataFrame | None, stays: DataFrame, as_of_year: int, years: int = 4,
    advisors: DataFrame | None = None, inline: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Verdict on each (paper, candidate), with its reasons: recent co-authorship (unknown year counts) or any other tie.

    ``authors(paper, person)``, ``candidates(paper, candidate)``; authors that are the candidate are skipped.
    ``stays(person, inst)`` give shared institutions, ``advisors(src, dst)`` advising either way, and
    ``inline(paper, inst)`` affiliations written on the paper, which count only where no shared institution does.
    ``coauthors`` are all edges, where most are asked for or they are stored; without them those of the asked pairs alone are
    made from ``parts`` (``coauthors_of``), and the pairs are written once.
    """
    pairs = _asked_pairs(authors, candidates)
    if coauthors is None:
        pairs = settled(pairs)
        coauthors = coauthors_of(pairs, parts)
    recent = F.col("last_year").isNull() | (F.col("last_year") >= as_of_year - years)
    co = pairs.join(coauthors, ["src", "dst"]).select("paper", "candidate", F.lit("coauthor").alias("type"), recent.alias("counts"))
    inst = shared_stays(pairs, stays).select("paper", "candidate", F.lit("institution").alias("type"), F.lit(True).alias("counts"))
    ties = co.unionByName(inst)
    if advisors is not None:
        tie = advisors.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        ties = ties.unionByName(pairs.join(tie, ["src", "dst"]).select("paper", "candidate", F.lit("advisor").alias("type"), F.lit(True).alias("counts")))
    if inline is not None:
        own = stays.select(F.col("person").alias("candidate"), "inst").distinct()
        written = candidates.join(inline, "paper").join(own, ["candidate", "inst"]).select("paper", "candidate").distinct().join(inst, ["paper", "candidate"], "left_anti")
        ties = ties.unionByName(written.select("paper", "candidate", F.lit("affiliation").alias("type"), F.lit(True).alias("counts")))
    reasons = ties.groupBy("paper", "candidate").agg(F.bool_or("counts").alias("has_coi"), F.count_if(F.col("type") == "coauthor").alias("coauthors"),
        F.count_if(F.col("type") == "institution").alias("institutions"), F.array_sort(F.collect_set("type")).alias("reasons"))
    none = F.lit(0).cast("long")
    return candidates.join(reasons, ["paper", "candidate"], "left").select("paper", "candidate", F.coalesce("has_coi", F.lit(False)).alias("has_coi"),
        F.coalesce("coauthors", none).alias("coauthors"), F.coalesce("institutions", none).alias("institutions"),
            F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def source_hash(rows: DataFrame, *cols: str) -> DataFrame:
    """One digest of an ordered projection: rows are sorted by ranges, each range has a digest, and one goes over those.

    Ranges are the first two digits of the rows' own digests, so the result does not depend on the partitions;
    equal rows count as often as they come.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    own = rows.select(F.sha2(line.cast("binary"), 256).alias("d"))
    digest = lambda part: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(part))).cast("binary"), 256)
    # four digits bound a group to a 65,536th of the rows, two more passes a digest to 256 values
    deep = own.groupBy(F.substring("d", 1, 4).alias("p")).agg(digest("d").alias("d"))
    mid = deep.groupBy(F.substring("p", 1, 2).alias("p")).agg(digest(F.concat("p", "d")).alias("d"))
    return mid.agg(digest(F.concat("p", "d")).alias("hash"))
