import random

from pyspark.sql import functions as F

from emberlane.operators import budget, debt, graph, incremental, intervals, lake, working_set


def test_decay_closed_forms_equal_a_replay(spark):
    rng = random.Random(3)
    calls = [(1, c, r) for c in range(12) for r in rng.sample(range(8), rng.randint(1, 5))]
    weights, freq = {}, {}
    for c in range(12):
        ids = sorted({r for _, k, r in calls if k == c})
        for r in ids:
            freq[r] = 0.92 * freq.get(r, 0) + 1
        if len(ids) < 2:
            continue
        weights = {k: 0.92 * v for k, v in weights.items()}
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                weights[a, b] = weights.get((a, b), 0) + 1
    df = spark.createDataFrame(calls, "s int, call int, region int")
    got = {(r.a, r.b): r.weight for r in working_set.co_access(working_set.calls_of(df, "s", "call", "region"), "s").collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-9 for k in got)
    got = {r.region: r.frequency for r in working_set.decayed_frequency(df, ["region"]).collect()}
    assert all(abs(got[k] - freq[k]) < 1e-9 for k in freq)


def test_stop_and_skip_rules(spark):
    rows = spark.createDataFrame([(1, k, c, 10 - k) for k, c in enumerate((5, 9, 3, 4))], "g int, k int, cost int, score int")
    assert [r.cost for r in budget.prefix_cut(rows, "g", [F.desc("score")], "cost", 12).collect()] == [5]
    kept = budget.greedy(rows, "g", [F.col("score")], "k", "cost", 12).where("kept").collect()
    assert sorted(r.cost for r in kept) == [3, 4, 5]
    big = spark.createDataFrame([(1, 0, 20, 2), (1, 1, 3, 1)], "g int, k int, cost int, score int")
    assert [r.cost for r in budget.greedy(big, "g", [F.col("score")], "k", "cost", 12).where("kept").collect()] == [20]


EDGES = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 6), (6, 5)]


def test_strong_components(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert {r.node: r.component for r in graph.strong_components(e).collect()} == want
    assert {r.node: r.component for r in graph.strong_components_grouped(e).collect()} == want


def test_reverse_reach_and_path(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "B")], "src string, dst string")
    start = spark.createDataFrame([("C",)], "node string")
    assert {r.node: r.depth for r in graph.reach(e, start, reverse=True).collect()} == {"C": 0, "B": 1, "A": 2, "D": 2}
    assert graph.shortest_reverse_path(e, "C", "A").first().path == ["C", "B", "A"]
    assert graph.shortest_reverse_path(e, "A", "C").count() == 0


def test_min_cut_against_brute_force():
    rng = random.Random(5)
    for _ in range(25):
        n = rng.randint(2, 7)
        w = {u: {} for u in range(n)}
        for u in range(n):
            for v in range(u):
                if rng.random() < 0.7 or v == u - 1:
                    w[u][v] = w[v][u] = rng.randint(1, 5)
        best = min(sum(x for u in range(n) for v, x in w[u].items() if (m >> u & 1) and not m >> v & 1) for m in range(1, 2**n - 1))
        got, side = graph.min_cut_of(w)
        assert got == best
        assert sum(x for u in side for v, x in w[u].items() if v not in side) == best


def test_barbell(spark):
    clique = lambda p: [(p + "1", p + "2"), (p + "2", p + "3"), (p + "1", p + "3")]
    e = spark.createDataFrame([*clique("a"), *clique("b"), ("a1", "b1")], "src string, dst string")
    cut = graph.min_cuts(e).first()
    assert (cut.weight, sorted(cut.side)) == (1.0, ["a1", "a2", "a3"])
    points = {r.node: (r.pieces, r.largest, r.dependent) for r in graph.articulation_points(e).collect()}
    assert points == {"a1": (2, 3, 2), "b1": (2, 3, 2)}
    between = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    assert between["a1"] == 6.0 and between["a2"] == 0.0


def test_findings(spark):
    e = spark.createDataFrame([("x", "y"), ("y", "z"), ("z", "x"), ("p", "fat"), ("fat", "x")], "src string, dst string")
    regions = spark.createDataFrame([(n, 48 if n == "fat" else 2, 3 if n == "fat" else 0) for n in ("x", "y", "z", "p", "fat", "lonely")], "node string, lines int, branches int")
    got = {(r.kind, r.name): r.cost for r in debt.findings(e, regions).collect()}
    assert got[("tangled", "x")] == 3 * 3 * 8
    assert got[("complex", "fat")] == 48 / 12 * 1 * 4 * 5
    assert got[("orphan", "lonely")] == 1
    assert got[("choke", "fat")] == 2 * 1 * 12


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    base = [[f"g{rng.randint(0, 60)}" for _ in range(20)] for _ in range(6)]
    rows = [(i, [g if rng.random() > 0.06 else f"n{rng.randint(0, 99)}" for g in base[i % 6]]) for i in range(40)]
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.82}
    got = {(r.a, r.b) for r in debt.near_pairs(spark.createDataFrame(rows, "id int, grams array<string>"), "id", "grams").collect()}
    assert got == want and want


def test_sync_equals_rebuild(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, h string")
    assert sorted(map(tuple, incremental.sync(old, new, "k", "h").collect())) == sorted(map(tuple, new.collect()))
    assert {r.k: r.change for r in incremental.diff(old, new, "k", "h").collect()} == {1: "removed", 3: "changed", 4: "added"}


def test_migration(spark):
    state = spark.createDataFrame([(1, 10, 0.5, 0.2, False, True)], "session int, region int, execution double, edit double, stale boolean, admitted boolean")
    got = {r.region: (r.execution, r.edit, r.stale, r.admitted) for r in incremental.migrate(state, spark.createDataFrame([(10, 11)], "region int, successor int")).collect()}
    assert got == {10: (0.5, 0.2, True, False), 11: (0.4, 0.7, False, False)}


def test_bronze_never_changes_rows(spark):
    old = spark.createDataFrame([(1, "x", 5)], "event_id int, v string, ts int")
    new = spark.createDataFrame([(1, "y", 6), (2, "b", 8), (2, "a", 7)], "event_id int, v string, ts int")
    assert [tuple(r) for r in lake.append_bronze(old, new).collect()] == [(2, "a", 7)]


def test_intervals(spark):
    spans = spark.createDataFrame([("f", "m", 1, 100), ("f", "a", 2, 10), ("f", "b", 3, 5), ("g", "c", 1, 2)], "path string, id string, low int, high int")
    points = spark.createDataFrame([(1, "f", 4), (2, "f", 9), (3, "f", 50), (4, "g", 7)], "p int, path string, line int")
    got = {r.p: r.id for r in intervals.narrowest_cover(points, spans, "path", "p", "line", "low", "high", "id").collect()}
    assert got == {1: "b", 2: "a", 3: "m"}
    both = [{(r.id, r.other_id) for r in f.collect()} for f in (intervals.overlaps(spans, spans, "path"), intervals.binned_overlaps(spans, spans, "path", 4.0))]
    assert both[0] == both[1]
