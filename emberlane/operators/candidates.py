"""Candidate regions from several sources, graph expansion, ghosts, and the bundle built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_candidates(parts: dict[str, DataFrame], key: str, weight: str = "weight", by: list[str] | None = None) -> DataFrame:
    """One row a region: its sources in order of first appearance, the total weight and the weight by source."""
    by = by or []
    every = reduce(
        DataFrame.unionByName, [p.select(*by, key, F.col(weight).cast("double").alias("w")).withColumn("source", F.lit(s)).withColumn("rank", F.lit(i)) for i, (s, p) in enumerate(parts.items())]
    )
    each = every.groupBy(*by, key, "source", "rank").agg(F.sum("w").alias("w"))
    return each.groupBy(*by, key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"),
        F.sum("w").alias("weight"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "w")))).alias("source_weights"),
    )


def one_hop(actives: DataFrame, edges: DataFrame, key: str, src: str, dst: str, out_weight: float = 0.9, in_weight: float = 0.85) -> DataFrame:
    """Callees and callers of active regions: (key, source, weight); the actives are fixed before the expansion."""
    a = actives.select(F.col(key).alias("_a")).distinct()
    callees = edges.join(a, F.col(src) == F.col("_a")).select(F.col(dst).alias(key), F.lit("callee").alias("source"), F.lit(out_weight).alias("weight"))
    callers = edges.join(a, F.col(dst) == F.col("_a")).select(F.col(src).alias(key), F.lit("caller").alias("source"), F.lit(in_weight).alias("weight"))
    return callees.unionByName(callers)


def undirected_neighbours(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, neighbour) in both directions, distinct, without self-loops."""
    from emberlane.operators.graph import symmetric

    return symmetric(edges, src, dst).withColumnsRenamed({"src": "node", "dst": "neighbour"})


def ghosts(seen: DataFrame, index: DataFrame, key: str, hints: DataFrame | None = None) -> DataFrame:
    """Ids that are used but no longer indexed, with what hints tell of them."""
    out = seen.select(key).distinct().join(index.select(key), key, "left_anti")
    return out.join(hints, key, "left") if hints is not None else out


def prefetch_targets(parents: DataFrame, edges: DataFrame, regions: DataFrame, seen: DataFrame, key: str, src: str, dst: str, kinds: list[str]) -> DataFrame:
    """Unseen callees of the parents that are indexed and of one of the kinds: (parent, key, ...)."""
    hop = edges.join(parents.withColumnRenamed(key, src), src).select(F.col(src).alias("parent"), F.col(dst).alias(key), *[c for c in parents.columns if c != key])
    hop = hop.join(seen.select(key).distinct(), key, "left_anti")
    return hop.join(regions, key).where(F.col("kind").isin(kinds))


def labels_for(ids: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Ids with their label; an unknown id is its own label."""
    return ids.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.col(key).cast("string")))


def bundle(candidates: DataFrame, session: str, key: str, score: Column, tokens: str, admit: Column, pinned: Column, budget: int) -> DataFrame:
    """Score, admit, then keep greedily under the budget: (session, key, score, kept). What is scored is written before it
    is grouped: scores are long expressions, which a filter and a list would each compute again."""
    from emberlane.operators.budget import greedy
    from emberlane.session import materialize, spread

    scored = candidates.withColumn("score", score).select(session, key, "score", tokens, (admit | pinned).alias("_ok"), pinned.alias("_pinned"))
    ready = spread(materialize(scored, "scored").where("_ok"), session)
    return greedy(ready, session, [F.round("score", 9)], key, tokens, budget, F.col("_pinned"), carry=["score"]).select(session, key, "score", tokens, "kept")


def annotate(entries: DataFrame, key: str, tags: dict[str, DataFrame]) -> DataFrame:
    """Entries with the names of the node sets that hold them, in the order given; entries are never re-ranked."""
    out = entries
    for name, nodes in tags.items():
        out = out.join(nodes.select(F.col("node").alias(key)).distinct().withColumn(f"_{name}", F.lit(name)), key, "left")
    return out.select(*entries.columns, F.array_compact(F.array(*[F.col(f"_{n}") for n in tags])).alias("graph_tags"))
