"""Global minimum cuts of components that no task holds with their edges."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.operators import graph
from emberlane.operators.graph import min_cut_of
from emberlane.session import materialize

#: Forests of one pass, and edges that are dealt with at once.
FORESTS, EDGES_AT_ONCE = 32, 4_000_000


def numbered(nodes: DataFrame) -> DataFrame:
    """Rows (node, ..) with an id: their place in the order of nodes, from 0."""
    rows = materialize(nodes.orderBy("node").withColumn("m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("m", 33)
    start, offsets = 0, []
    for p, n in sorted(map(tuple, rows.groupBy(part.alias("p")).count().collect())):  # a row for each partition
        offsets += [F.lit(p), F.lit(start)]
        start += n
    return rows.withColumn("id", (F.element_at(F.create_map(*offsets), part) + F.col("m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("m")


def _flat(label: np.ndarray) -> None:
    """Every label becomes its root, in place."""
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return
        label[:] = up


def _hook(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Join the labels of edges; which edges joined two trees. Larger roots are hung below smaller ones."""
    took = np.zeros(len(u), bool)
    left = np.flatnonzero(label[u] != label[v])
    while len(left):
        a, b = label[u[left]], label[v[left]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        roots, first = np.unique(high, return_index=True)
        label[roots] = low[first]
        took[left[first]] = True
        _flat(label)
        left = left[label[u[left]] != label[v[left]]]
    return took


class Forests:
    """Edge-disjoint forests over nodes 0..n-1, filled edge by edge. An edge goes to the first forest that does not join its
    ends yet, once for each of its units; ends that all forests join cannot be parted by fewer than all units and are
    merged. Memory is that of the nodes for each forest, whatever the number of edges."""

    def __init__(self, n: int, k: int):
        self.merged = np.arange(n, dtype=np.int32)
        self.trees = [np.arange(n, dtype=np.int32) for _ in range(k)]

    def add(self, u: np.ndarray, v: np.ndarray, units: np.ndarray) -> None:
        keep = (self.merged[u] != self.merged[v]) & (units > 0)
        u, v, units = u[keep], v[keep], units[keep]
        for i, tree in enumerate(self.trees):
            took = _hook(tree, u, v)
            units = units - took
            if i + 1 < len(self.trees):
                go = units > 0
                u, v, units = u[go], v[go], units[go]
        _hook(self.merged, u, v)


def contract(edges: DataFrame, n: int, k: int) -> DataFrame:
    """(id, root): nodes that are merged, of edges (u, v, units) over ids below n, where k units cannot be parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, held, rows = Forests(n, k), [], 0

        def put():
            if held:
                forests.add(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3)))
                held.clear()

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= EDGES_AT_ONCE:
                put()
                rows = 0
        put()
        ids = np.flatnonzero(forests.merged != np.arange(n, dtype=np.int32))
        for at in range(0, len(ids), 100_000):
            some = ids[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"id": some.astype(np.int64), "root": forests.merged[some].astype(np.int64)})

    return edges.select(F.col("u").cast("int"), F.col("v").cast("int"), F.col("units").cast("int")).coalesce(1).mapInArrow(run, "id long, root long")


def _between(edges: DataFrame) -> DataFrame:
    """One edge (component, u, v, weight) of each unordered pair of ends."""
    e = edges.where("u <> v").select("component", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")
    return e.groupBy("component", "u", "v").agg(F.sum("weight").alias("weight"))


def min_cuts(edges: DataFrame) -> DataFrame:
    """(component, nodes, weight, side) of (component, src, dst, weight), component being its least node.

    The least weight of all edges of one node is a cut. Nodes that no cheaper cut parts, by a pass of edge-disjoint
    forests over all edges, are merged, and the merged nodes are cuts again, until a component's edges fit a task, which
    ends as graph.min_cut_of does. Where passes no longer merge, a task takes what is left: at most as many edges for each
    node as the cut has units.
    """
    kind = dict(edges.dtypes)["src"]
    ids = numbered(edges.select("component", F.col("src").alias("node")).unionByName(edges.select("component", F.col("dst").alias("node"))).distinct())
    n = ids.count()
    left = edges.join(ids.select(F.col("node").alias("src"), F.col("id").alias("u")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("v")), "dst")
    left = materialize(_between(left), "cut-edges")
    at = materialize(ids.select("component", "node", F.col("id").alias("g")), "at")  # the merged node of each node
    best, size, tries = None, left.count(), []
    while True:
        ends = left.select("component", F.col("u").alias("g"), "weight").unionByName(left.select("component", F.col("v").alias("g"), "weight"))
        one = ends.groupBy("component", "g").agg(F.sum("weight").alias("cut")).groupBy("component").agg(F.min(F.struct("cut", "g")).alias("c"))
        tries.append(at)
        found = one.select("component", "c.cut", F.lit(len(tries) - 1).alias("n"), F.array("c.g").alias("gs"))
        best = found if best is None else best.unionByName(found).groupBy("component").agg(F.min(F.struct("cut", "n", "gs")).alias("c")).select("component", "c.*")
        best = materialize(best, "best")
        large = left.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > graph.EDGES_A_TASK)
        rest = materialize(left.join(large.select("component"), "component", "left_semi").join(best.select("component", "cut"), "component"), "rest")
        top = rest.agg(F.max(F.least(F.ceil("cut"), F.lit(FORESTS)))).first()[0]
        if top is None:
            break
        # a cut has as many units as there are forests
        merged = materialize(contract(rest.withColumn("units", F.least(F.floor(F.col("weight") / F.col("cut") * top), F.lit(top))), n, int(top)), "merged")
        turn = lambda df, c: df.join(merged.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        left = materialize(_between(turn(turn(left, "u"), "v")), "cut-edges")
        at = materialize(turn(at, "g").select("component", "node", "g"), "at")
        was, size = size, left.count()
        if size > 0.9 * was:
            break

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        w: dict = defaultdict(dict)
        for u, v, x in zip(pdf["u"], pdf["v"], pdf["weight"]):
            w[u][v] = w[v][u] = x
        cut, side = min_cut_of(w)
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "cut": [cut], "gs": [side]})

    last = left.groupBy("component").applyInPandas(fold, f"component {kind}, cut double, gs array<long>").select("component", "cut", F.lit(len(tries)).alias("n"), "gs")
    tries.append(at)
    best = best.unionByName(last).groupBy("component").agg(F.min(F.struct("cut", "n", "gs")).alias("c")).select("component", "c.*")
    best = materialize(best, "best")
    pick = best.select("component", "n", F.explode("gs").alias("g")).withColumn("in", F.lit(True))
    used = None
    for k, where in enumerate(tries):
        mine = where.join(best.where(F.col("n") == k).select("component"), "component", "left_semi").withColumn("n", F.lit(k))
        used = mine if used is None else used.unionByName(mine)
    used = used.join(pick, ["component", "n", "g"], "left").select("component", "node", F.coalesce("in", F.lit(False)).alias("in"))
    # the side with the component's least node
    own = used.where("node = component").select("component", F.col("in").alias("want"))
    sides = used.join(own, "component").groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("in") == F.col("want"), F.col("node")))).alias("side"))
    return sides.join(best.select("component", F.col("cut").cast("double").alias("weight")), "component").select("component", "nodes", "weight", "side")
