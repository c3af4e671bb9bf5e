"""Registered queries take every row of their tables."""

import random
from collections import defaultdict

import pytest

from emberlane.operators import graph
from emberlane.plans import registry

registry.load()
LINE = "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double"


def run(spark, sf_dir, name):
    return registry.QUERIES[name](spark, str(sf_dir)).collect()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Order keys, parts and quantities that row filters would leave out, in a graph with cycles and a tail."""
    at = tmp_path_factory.mktemp("lines")
    rng = random.Random(9)
    pairs = [(s, p) for s in range(100, 112) for p in rng.sample([7 * k for k in range(100, 112)], 2)] + [(100, 1403), (112, 700), (90, 3001)]
    rows = [(i * 97 + 1, s, p, 1, float(rng.randint(1, 40))) for i, (s, p) in enumerate(pairs)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(p, 1 + p % 50) for p in (5, 700, 1403, 9000)], "p_partkey long, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(s, s % 3) for s in {s for s, _ in pairs}], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    return at, rows


def test_graph_queries_take_all_lines(spark, lines):
    at, rows = lines
    edges = {(7 * r[1], r[2]) for r in rows if 7 * r[1] != r[2]}
    nodes = {x for e in edges for x in e}
    ahead = {u: {u} for u in nodes}
    while any(not ahead[v] <= ahead[u] for u, v in edges):
        for u, v in edges:
            ahead[u] |= ahead[v]
    lists = defaultdict(list)
    for u, v in sorted(edges):
        lists[u].append(str(v))
    assert {r.node: r.successors for r in run(spark, at, "call_graph")} == {n: ",".join(lists[n]) for n in nodes | {5, 700, 1403, 9000}}
    assert {r.node: (r.in_degree, r.out_degree) for r in run(spark, at, "degrees")} == {n: (sum(v == n for _, v in edges), len(lists[n])) for n in nodes}
    scc = {u: min(v for v in ahead[u] if u in ahead[v]) for u in nodes}
    assert len(set(scc.values())) < len(nodes)
    for name in ("scc", "scc_grouped", "scc_giant"):
        assert {r.node: r.component for r in run(spark, at, name)} == scc
    assert {r.node for r in run(spark, at, "reverse_bfs")} == {u for u in nodes if min(v for _, v in edges) in ahead[u]}
    assert {(r.node, r.neighbour) for r in run(spark, at, "neighbor_lists")} == edges | {(v, u) for u, v in edges}
    assert {r.name for r in run(spark, at, "debt_findings") if r.kind == "orphan"} == {"5", "9000"}
    assert {r.component: r.weight for r in run(spark, at, "min_cut")}[630] == 1.0


def test_min_cut_of_a_large_sparse_graph():
    """Two rings with chords, joined by two edges: quick although it has thousands of nodes."""
    n, w = 1500, defaultdict(dict)
    for base in (0, n):
        for i in range(n):
            for step in (1, 7):
                u, v = base + i, base + (i + step) % n
                w[u][v] = w[v][u] = 1.0
    for u, v in ((3, n + 5), (900, n + 40)):
        w[u][v] = w[v][u] = 1.0
    best, side = graph.min_cut_of(w)
    assert best == 2.0 and side == list(range(n))


def test_clone_queries_take_all_documents(spark, tmp_path):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randint(0, 500)}" for _ in range(700))
    short = " ".join(f"v{rng.randint(0, 500)}" for _ in range(60))
    rows = [(1, text, "de"), (2, text, "de"), (3, text + " tail", "fr"), (4, short, None), (5, short.replace(" ", ", "), "en"), (6, short, "es"), (7, "other words here", "en"), (8, "", "en"), (9, "", "de"), (10, None, "en")]
    spark.createDataFrame([(*r, len(r[1]) if r[1] else None) for r in rows], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def grams(t):
        w = (t or "").replace(",", "").split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets = {i: grams(t) for i, t, _ in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b]}
    got = {(r.a, r.b): r.similarity for r in run(spark, tmp_path, "clone_near_jaccard")}
    assert got == {k: round(v, 6) for k, v in want.items() if v >= 0.82} and len(got) == 6
    assert {r.cluster: (r.copies, r.kept) for r in run(spark, tmp_path, "clone_clusters")} == {1: (3, 1), 4: (3, 4), 8: (2, 8)}


def test_interval_edge_and_line_queries_take_all_rows(spark, lines, tmp_path):
    at, rows = lines
    spans = defaultdict(list)
    for _, s, p, _, q in rows:
        spans[s, p].append(q)
    spans = {k: (min(v), max(v)) for k, v in spans.items()}
    want = {(k, a, b) for (k, a), x in spans.items() for (j, b), y in spans.items() if j == k and a < b and x[0] <= y[1] and y[0] <= x[1]}
    assert {(r.k, r.a, r.b) for r in run(spark, at, "interval_overlap_binned")} == want
    kept = set()
    for g in range(3):
        count, deg = defaultdict(int), defaultdict(int)
        for _, s, p, _, _ in rows:
            count[s, -1 - p] += s % 3 == g
        for (u, v), n in sorted(count.items(), key=lambda x: (-x[1], x[0])):
            if n and not (deg[u] >= 2 and deg[v] >= 2):
                kept.add((g, u, v))
                deg[u] += 1
                deg[v] += 1
    assert {(r.g, r.u, r.v) for r in run(spark, at, "edge_cap")} == kept
    spark.createDataFrame([(i, "en") for i in (1, 2, 3, 5)], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n for r in run(spark, tmp_path, "jsonl_count")] == [4]
