"""Shared parts of the near-duplicate operators: tiles of hot buckets, and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.session import materialize, release


class Forest:
    """Trees over 0..n-1 that join what the added links join; least index of a tree as its root."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, q: np.ndarray, v: np.ndarray) -> None:
        while len(q):  # hook roots to roots until these links join nothing new
            a, b = self.label[q], self.label[v]
            new = a != b
            q, v, a, b = q[new], v[new], a[new], b[new]
            if not len(q):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            _, one = np.unique(high, return_index=True)
            self.edges.append(np.stack([high[one], low[one]], axis=1))
            target = np.arange(len(self.label))
            target[high[one]] = low[one]
            while True:
                shorter = target[target]
                if (shorter == target).all():
                    break
                target = shorter
            self.label = target[self.label]

    def links(self) -> np.ndarray:
        return np.concatenate(self.edges) if self.edges else np.zeros((0, 2), dtype=np.int64)


def tiles(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """Deal the rows of each bucket so that every two of its rows meet in some tile of about 2 * most rows.

    Buckets of up to most rows are one tile. A larger bucket is cut into chunks by a hash of its members, and each row
    goes to the tile of its chunk with every other chunk, so a hot bucket becomes many tasks and nothing is dropped.
    Adds tile (a string of key and chunks) and chunk; two rows of different chunks meet in exactly one tile, rows of one
    chunk meet in the tile (c, c). Only counts of large buckets are joined back.
    """
    large = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("bucket_rows")).where(F.col("bucket_rows") > most), "large")
    marked = rows.join(large, key, "left")
    chunks = F.coalesce(F.ceil(F.col("bucket_rows") / most).cast("int"), F.lit(1))
    marked = marked.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64(member, F.lit(7)), F.col("chunks")).cast("int"))
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    out = marked.withColumn("other", F.explode(others))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    return out.withColumn("tile", F.concat_ws(":", F.col(key).cast("string"), low.cast("string"), high.cast("string"))).drop("bucket_rows", "chunks", "other")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) links between long ids -> (node, component): every linked node with the least id it can reach.

    Large-star and small-star rounds in turn; each is an aggregate with partial sums and a join that splits hot nodes,
    and is written to the shared folder. Ends when a round changes nothing.
    """
    edges = edges.where(F.col("a") != F.col("b"))
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node is linked to the node's least neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where(F.col("u") != F.col("v")).distinct(), "star")
        release(now, least)
        # small star: a node and its smaller neighbours are linked to the least of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.*").where(F.col("u") != F.col("v")).distinct(), "links")
        release(large, least)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
