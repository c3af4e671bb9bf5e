"""Structural findings over a call graph, and clones of regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.operators import graph
from emberlane.session import materialize, spread

#: Weights and reporting bars of the findings.
TANGLED, CHOKE, COMPLEX, HUB, ORPHAN = 8, 12, 5, 2, 1
LINES, FAN_OUT, BRANCHES, HUB_DEGREE, ORPHANS = 12, 4, 4, 5, 8


def findings(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(kind, name, members, cost) of tangled cycles, chokes, complex regions, hubs and orphans.

    regions: (node, lines, branches) of every node; nodes on edges that are missing there count one line. A choke is an
    articulation point with callers and callees; it is not billed as a hub again. The first orphans by name are billed.
    """
    e = edges.select("src", "dst").distinct()
    every = regions.select("node").unionByName(graph.nodes_of(e)).distinct()
    deg = every.join(graph.degrees(e), "node", "left").join(regions, "node", "left").select(
        "node",
        F.coalesce("in_degree", F.lit(0)).alias("i"),
        F.coalesce("out_degree", F.lit(0)).alias("o"),
        F.coalesce("lines", F.lit(1)).alias("lines"),
        F.coalesce("branches", F.lit(0)).alias("branches"),
    )
    scc = materialize(graph.strong_components(e), "components")
    a, b = scc.select(F.col("node").alias("src"), F.col("component").alias("ca")), scc.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    inner = e.where("src <> dst").join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.count(F.lit(1)).alias("inner_edges"))
    size = scc.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.col("node").cast("string"))).alias("members")).where("n > 1")
    name = F.col("node").cast("string")
    one = lambda kind, cost: (F.lit(kind).alias("kind"), name.alias("name"), F.array(name).alias("members"), cost.cast("double").alias("cost"))
    tangled = size.join(inner, "component").select(F.lit("tangled").alias("kind"), F.col("component").cast("string").alias("name"), "members", (F.col("n") * F.col("inner_edges") * TANGLED).cast("double").alias("cost"))
    near = graph.symmetric(e).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("crossing"))
    chokes = graph.articulation_points(e).join(deg, "node").join(near, "node").where("dependent >= 1 AND i >= 1 AND o >= 1")
    choke = chokes.select(*one("choke", F.col("crossing") * F.col("dependent") * CHOKE))
    weight = F.col("lines") / LINES * F.col("o") * (1 + F.col("branches")) * COMPLEX
    tall = (F.col("lines") >= LINES) | (F.col("o") >= FAN_OUT) | (F.col("branches") >= BRANCHES)
    complex_ = deg.where((F.col("o") >= 1) & tall).select(*one("complex", weight))
    hub = deg.where(F.col("i") + F.col("o") >= HUB_DEGREE).join(chokes.select("node"), "node", "left_anti").select(*one("hub", (F.col("i") + F.col("o")) * HUB))
    orphan = deg.where("i = 0 AND o = 0").orderBy("node").limit(ORPHANS).select(*one("orphan", F.lit(ORPHAN)))
    return reduce(DataFrame.unionByName, [tangled, choke, complex_, hub, orphan])


def totals(found: DataFrame) -> DataFrame:
    """(kind, n, cost) with a row total."""
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).unionByName(found.agg(F.lit("total").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).select("kind", "n", "cost"))


def highlights(found: DataFrame) -> DataFrame:
    """(region, kind): the strongest claim on each region: choke, tangled, complex, hub."""
    rank = F.when(F.col("kind") == "choke", 0).when(F.col("kind") == "tangled", 1).when(F.col("kind") == "complex", 2).when(F.col("kind") == "hub", 3)
    return found.where(rank.isNotNull()).select(F.explode("members").alias("region"), "kind", rank.alias("r")).groupBy("region").agg(F.min_by("kind", "r").alias("kind"))


def near_links(rows: DataFrame, key: str, grams: str, least: float = 0.82) -> tuple[DataFrame, DataFrame]:
    """(key, rep) of rows with grams, where rows of equal gram sets share their least id as rep; and (a, b, similarity)
    of the different reps whose sets have at least this Jaccard similarity.

    grams: strings, which count as their XXH64, or hashes. Prefix filter: with grams in one total order (rare first),
    similar sets share one of their first n - ceil(least * n) + 1 grams, so only rows that share a prefix gram are
    compared, and of these only those whose grams from there on can be enough. Grams of one row alone come first and are
    never shuffled again, so a row with as many of them as its prefix is compared with none.
    """
    hashed = F.col(grams) if dict(rows.dtypes)[grams] == "array<bigint>" else F.transform(grams, lambda x: F.xxhash64(x))
    bare = rows.select(key, F.sort_array(F.array_distinct(hashed)).alias("s")).where(F.size("s") > 0)
    bare = materialize(bare.select(key, "s", F.sha2(F.to_json("s"), 256).alias("d")), "grams")
    named = materialize(bare.join(bare.groupBy("d").agg(F.min(key).alias("rep")), "d").select(key, "rep"), "reps")
    one = materialize(bare.join(named.where(F.col(key) == F.col("rep")), key, "left_semi").select(key, "s", F.size("s").alias("n")), "one")
    flat = one.select(key, F.explode("s").alias("g"))
    freq = materialize(spread(flat.select("g"), "g").groupBy("g").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "freq")
    sets = flat.join(freq, "g").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("s")).join(one.select(key, "n"), key)
    sets = materialize(sets.select(key, F.col("s.g").alias("s"), "n", (F.col("n") - F.size("s")).alias("alone")), "sets")
    ahead = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1 - F.col("alone")
    head = sets.where(ahead > 0).select(key, "n", "alone", F.posexplode(F.slice("s", F.lit(1), F.greatest(ahead, F.lit(1)))).alias("p", "g"))
    head = materialize(head.select(key, "n", "g", (F.col("n") - F.col("alone") - F.col("p")).alias("rest")), "head")
    other = head.select(F.col(key).alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), "g")
    pairs = head.select(F.col(key).alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), "g").join(other, "g").where(F.col("a") < F.col("b"))
    pairs = pairs.where((F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9))
    pairs = pairs.where(F.least("ra", "rb") >= least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-6)
    pairs = materialize(spread(pairs.select("a", "b"), "a", "b").distinct(), "pairs")
    end = lambda c: sets.select(F.col(key).alias(c), F.col("s").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return named, both.select("a", "b", (inter / (F.col("na") + F.col("nb") - inter)).alias("similarity")).where(F.col("similarity") >= least)


def near_pairs(rows: DataFrame, key: str, grams: str, least: float = 0.82) -> DataFrame:
    """(a, b, similarity) of rows whose distinct grams have at least this Jaccard similarity. Rows without grams are left
    out. Equal sets are compared once and their pairs written out at the end."""
    named, links = near_links(rows, key, grams, least)
    links = links.unionByName(named.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")).distinct())
    ends = lambda c: named.select(F.col("rep").alias(c), F.col(key).alias(f"_{c}"))
    full = links.join(ends("a"), "a").join(ends("b"), "b").where((F.col("a") != F.col("b")) | (F.col("_a") < F.col("_b")))
    return full.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity")


def clone_clusters(exact: DataFrame, near: DataFrame, key: str, digest: str, tokens: str) -> DataFrame:
    """(cluster, copies, kept, redundant_cost): equal digests and near pairs join; the least id is kept.

    exact: (key, digest, tokens). Links of equal digests are a star, not all pairs.
    """
    star = exact.groupBy(digest).agg(F.min(key).alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = exact.join(star, digest).select(F.col(key).alias("src"), "dst").where("src <> dst")
    links = links.unionByName(near.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()
    parts = graph.components(links).withColumnRenamed("node", key)
    joined = parts.join(exact.select(key, tokens), key)
    return joined.groupBy(F.col("component").alias("cluster")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("kept"), (F.min_by(tokens, key) * (F.count(F.lit(1)) - 1)).alias("redundant_cost")
    )
