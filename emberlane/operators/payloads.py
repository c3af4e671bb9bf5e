"""Composite views: graph payload, memory hierarchy, file rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_payload(kinds: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(src, dst, kind, weight): edges of all kinds, each kind's weights scaled; the heaviest of equal edges."""
    parts = [e.select("src", "dst", F.lit(kind).alias("kind"), (F.col("weight") * scale).alias("weight")) for kind, (e, scale) in kinds.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst", "kind").agg(F.max("weight").alias("weight"))


def file_rollup(regions: DataFrame, path: str, tokens: str, heat: str, level: str, stale: str) -> DataFrame:
    """Tokens, regions, heat, stale count and a count for each level of every file."""
    n = lambda x: F.sum((F.col(level) == x).cast("int")).alias(x.lower())
    return regions.groupBy(path).agg(
        F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("regions"), F.sum(heat).alias("heat"), F.sum(F.col(stale).cast("int")).alias("stale"), *[n(x) for x in ("L0", "L1", "L2", "backing")]
    )


def hierarchy(regions: DataFrame, level: str, tokens: str, capacity: dict[str, int]) -> DataFrame:
    """Residents and occupancy of each memory level: (level, residents, tokens, utilization, free)."""
    out = regions.groupBy(F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("residents"), F.sum(tokens).alias("tokens"))
    cap = F.lit(None).cast("long")
    for k, v in capacity.items():
        cap = F.when(F.col("level") == k, F.lit(v).cast("long")).otherwise(cap)
    return out.select("*", (F.col("tokens") / cap).alias("utilization"), F.greatest(cap - F.col("tokens"), F.lit(0)).alias("free"))


def execution_path(working_set: DataFrame, execution: str, access: str, bar: float = 0.2) -> DataFrame:
    """Rows that a program trace reached (execution above the bar), with joined: whether the agent read them too. Missing
    scores count as 0."""
    reached = lambda name: F.coalesce(F.col(name), F.lit(0.0)) > bar
    return working_set.where(reached(execution)).withColumn("joined", reached(access))
