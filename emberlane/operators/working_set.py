"""Working set and co-access graph as aggregates of the touches in a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions.scoring import DECAY
from emberlane.session import spread


def decayed_frequency(touches: DataFrame, keys: list[str], rho: float = DECAY) -> DataFrame:
    """f <- rho * f + 1 at every touch of the row: (1 - rho^n) / (1 - rho)."""
    return touches.groupBy(*keys).agg(F.count(F.lit(1)).alias("touches")).withColumn("frequency", (1 - F.pow(F.lit(rho), F.col("touches"))) / (1 - rho))


def max_merge(touches: DataFrame, keys: list[str], scores: list[str], order: list[str], turn: str = "turn") -> DataFrame:
    """Largest value of each score so far, the turn of the last touch, and the decayed frequency."""
    out = touches.groupBy(*keys).agg(
        *[F.max(s).alias(s) for s in scores], F.max_by(turn, F.struct(*order)).alias("last_access_turn"), F.count(F.lit(1)).alias("touches")
    )
    return out.withColumn("access_frequency", (1 - F.pow(F.lit(DECAY), F.col("touches"))) / (1 - DECAY))


def calls_of(rows: DataFrame, session: str, call: str, region: str, most: int | None = None, order: str | None = None) -> DataFrame:
    """Co-access calls: (session, call, regions, ordinal, n_calls); calls of fewer than two distinct ids are dropped
    before calls are numbered in the session. Sessions are dealt over all partitions, so that a task has few of the pairs
    that its calls hold."""
    ids = F.array_sort(F.collect_set(region)) if most is None else F.slice(F.array_sort(F.collect_set(region)), 1, most)
    calls = spread(rows.select(session, call, region), session).groupBy(session, call).agg(ids.alias("regions")).where(F.size("regions") >= 2)
    per = Window.partitionBy(session)
    return calls.withColumn("ordinal", F.row_number().over(per.orderBy(order or call))).withColumn("n_calls", F.count(F.lit(1)).over(per))


def pairs_in_calls(calls: DataFrame, keep: list[str]) -> DataFrame:
    """Unordered pairs a < b of each call's regions; a call's list is short by construction."""
    left = calls.select(*keep, "regions", F.posexplode("regions").alias("i", "a"))
    return left.select(*keep, "a", F.explode(F.slice("regions", F.col("i") + 2, F.greatest(F.size("regions") - F.col("i") - 1, F.lit(0)))).alias("b"))


def co_access(calls: DataFrame, session: str, rho: float = DECAY, top: int | None = None) -> DataFrame:
    """Decayed weight sum(rho^(N - n)) and saturating score min(1, 0.12 k) of each pair; the heaviest top of each a."""
    pairs = pairs_in_calls(calls, [session, "ordinal", "n_calls"])
    out = pairs.groupBy(session, "a", "b").agg(F.sum(F.pow(F.lit(rho), F.col("n_calls") - F.col("ordinal"))).alias("weight"), F.least(F.lit(1.0), F.lit(0.12) * F.count(F.lit(1))).alias("score"))
    if top is None:
        return out
    w = Window.partitionBy(session, "a").orderBy(F.round("weight", 9).desc(), "b")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def neighbours(graph: DataFrame, actives: DataFrame, session, most: int = 40, own: float = 1.0, other: float = 0.45, cap: float = 1.5) -> DataFrame:
    """Co-access neighbours of active regions on either side, own session first; two equi-joins instead of an OR."""
    a = graph.join(actives.select(F.col("region").alias("a")), "a").select("session", F.col("b").alias("region"), "weight")
    b = graph.join(actives.select(F.col("region").alias("b")), "b").select("session", F.col("a").alias("region"), "weight")
    both = a.unionAll(b).withColumn("own", (F.col("session") == session).cast("int"))
    picked = both.orderBy(F.col("own").desc(), F.round("weight", 9).desc(), "region", "session").limit(most)
    return picked.withColumn("scaled", F.least(F.lit(cap), F.col("weight") * F.when(F.col("own") == 1, own).otherwise(other)))
