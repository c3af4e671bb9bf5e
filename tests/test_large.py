"""Distributed forms of what one task does for small components, and counts that no task may hold."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberlane.operators import budget, graph, lexical, working_set


@pytest.fixture
def no_task(monkeypatch):
    """Every component is taken as too large for a task, and tasks as unable to take any."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", 0)


def sparse(seed):
    """Trees with chords and a clique on a stalk, in three components."""
    rng = random.Random(seed)
    edges = []
    for base in (0, 100, 200):
        edges += [(base + k, base + rng.randrange(max(0, k - 6), k)) for k in range(1, 30)]
        edges += [(base + rng.randrange(30), base + rng.randrange(30)) for _ in range(8)]
        edges += [(base + 40 + i, base + 40 + j) for i in range(4) for j in range(i)] + [(base + 40, base + 17)]
    return edges


def pieces_of(edges):
    """Articulation points with what they leave, by taking out every node."""
    near = {}
    for u, v in edges:
        if u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    out = {}
    for node in near:
        seen, sizes = {node}, []
        for start in near[node]:
            if start not in seen:
                seen.add(start)
                todo, n = [start], 0
                while todo:
                    n += 1
                    for v in near[todo.pop()] - seen:
                        seen.add(v)
                        todo.append(v)
                sizes.append(n)
        if len(sizes) > 1:
            out[node] = (len(sizes), max(sizes), sum(sizes) - max(sizes))
    return out


def points(spark, edges):
    rows = graph.articulation_points(spark.createDataFrame(edges, "src long, dst long")).collect()
    return {r.node: (r.pieces, r.largest, r.dependent) for r in rows}


def test_articulation_points_of_components_beyond_a_task(spark, no_task, monkeypatch):
    edges = sparse(7)
    want = pieces_of(edges)
    monkeypatch.setattr(graph, "articulation_of", None)
    assert points(spark, edges) == want and len(want) > 10


def test_articulation_points_of_a_task(spark):
    edges = sparse(8)
    assert points(spark, edges) == pieces_of(edges)
    n = 20_000  # a path: a walk from each of its points would take the square
    got = graph.articulation_of({k: [j for j in (k - 1, k + 1) if 0 <= j < n] for k in range(n)})
    assert len(got) == n - 2 and got[1] == [n - 2, 1]


def test_strong_components_of_a_component_beyond_a_task(spark, no_task, monkeypatch):
    edges = [(k, k + 1) for k in range(1, 9)] + [(4, 2), (9, 6), (20, 21)]
    monkeypatch.setattr(graph, "strong_components_of", None)
    got = {r.node: r.component for r in graph.strong_components_grouped(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6, 20: 20, 21: 21}


def test_betweenness_ships_only_components_it_answers(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(10)] + [(20, 21), (21, 22)]
    sizes = spark.sparkContext.accumulator(0)
    real = graph._lists
    monkeypatch.setattr(graph, "_lists", lambda pdf: (sizes.add(len(pdf)), real(pdf))[1])
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "src long, dst long"), most=5).collect()}
    assert got == {**dict.fromkeys(range(11)), 20: 0.0, 21: 1.0, 22: 0.0}
    assert sizes.value == 4


def test_symmetric_deals_edges_over_all_partitions(spark):
    got = graph.symmetric(spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (5, 2)], "src int, dst int"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 1), (2, 5), (5, 2)]
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def cuts_of(spark, edges):
    rows = graph.min_cuts(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()
    return {r.component: (r.nodes, r.weight, r.side) for r in rows}


def test_min_cuts_of_components_beyond_a_task(spark, monkeypatch):
    """Two dense halves joined by few light edges, a ring, and two nodes; the halves are merged by forests before a task
    sees them."""
    rng, edges = random.Random(2), []
    for base in (0, 50):
        edges += [(base + i, base + j, float(rng.randint(1, 3))) for i in range(19) for j in range(i) if rng.random() < 0.8]
        edges += [(base + 19, base + j, 1.0) for j in (2, 5, 11)]
    edges += [(3, 55, 1.0), (9, 60, 1.5)] + [(200 + k, 200 + (k + 1) % 12, 1.0) for k in range(12)] + [(300, 301, 4.0), (301, 300, 2.0)]
    whole = cuts_of(spark, edges)
    assert whole[0] == (40, 2.5, list(range(20))) and whole[300] == (2, 6.0, [300])
    monkeypatch.setattr(graph, "EDGES_A_TASK", 15)
    from emberlane.operators import cuts

    real, seen = cuts.min_cut_of, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(cuts, "min_cut_of", lambda w: (seen.add(sum(map(len, w.values())) // 2), real(w))[1])
    got = cuts_of(spark, edges)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in whole.items()} and got[0] == whole[0]
    assert 0 < seen.value < 40


def test_forests_never_merge_what_a_cheaper_cut_parts():
    import numpy as np

    from emberlane.operators import cuts

    rng = random.Random(6)
    for n, k in ((12, 3), (25, 4), (40, 5)):
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(n * k)})
        rng.shuffle(edges)
        forests = cuts.Forests(n, k)
        for at in range(0, len(edges), 17):
            part = np.array(edges[at : at + 17], np.int32)
            forests.add(part[:, 0], part[:, 1], np.ones(len(part), np.int32))
        groups = {}
        for u in range(n):
            groups.setdefault(int(forests.merged[u]), []).append(u)
        for group in groups.values():
            for v in group[1:]:
                assert flow(n, edges, group[0], v) >= k
        assert len(groups) < n


def flow(n, edges, s, t):
    """Edge-disjoint paths from s to t."""
    room = {}
    for u, v in edges:
        room[u, v] = room[v, u] = 1
    total = 0
    while True:
        back, todo = {s: None}, [s]
        while todo and t not in back:
            u = todo.pop()
            for v in range(n):
                if v not in back and room.get((u, v), 0) > 0:
                    back[v] = u
                    todo.append(v)
        if t not in back:
            return total
        total, v = total + 1, t
        while back[v] is not None:
            room[back[v], v] -= 1
            room[v, back[v]] += 1
            v = back[v]


def partitions(df):
    """Rows of each task that ends df's plan."""
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_pairs_of_calls_are_dealt_over_all_partitions(spark):
    rows = spark.createDataFrame([(s, c, 10 * s + r) for s in range(40) for c in range(3) for r in range(6)], "s int, call int, region int")
    calls = working_set.calls_of(rows, "s", "call", "region")
    pairs = working_set.co_access(calls, "s")
    assert pairs.count() == 40 * 15
    assert len(partitions(calls)) == len(partitions(pairs)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edge_cap_needs_no_task_for_a_group(spark):
    rng = random.Random(4)
    for _ in range(3):
        edges = [(rng.randrange(2), rng.randrange(9), rng.randrange(5, 14), rng.randrange(3)) for _ in range(90)]
        want = []
        for g in (0, 1):
            deg = {}
            for _, u, v, w in sorted((e for e in edges if e[0] == g), key=lambda e: (-e[3], e[1], e[2])):
                if deg.get(u, 0) < 2 or deg.get(v, 0) < 2:
                    want.append((g, u, v))
                    for end in {u, v}:
                        deg[end] = deg.get(end, 0) + 1
        df = budget.cap_edges(spark.createDataFrame(edges, "g int, u int, v int, w int"), "g", [F.col("w")], "u", "v", 2)
        assert sorted(map(tuple, df.collect())) == sorted(want)
    assert "InPandas" not in df._jdf.queryExecution().toString()


def test_vectors_meet_in_blocks(spark, monkeypatch):
    """Every query's best rows, with ties, in parts of queries and blocks of rows; odd vectors are left out."""
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(lexical, "ROWS_AT_ONCE", 3)
    rng = random.Random(5)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100, None), (101, [1.0]), (102, [None, 1.0, 1.0]), (103, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 5 == 0 or i > 99], "q long, f array<float>")
    length = lambda v: sum(x * x for x in v) ** 0.5
    good = [(i, v) for i, v in enumerate(vectors) if length(v) > 0]
    want = set()
    for q, f in good:
        if q % 5 == 0:
            near = sorted((-round(sum(x * y for x, y in zip(v, f)) / (length(v) * length(f)), 9), i) for i, v in good)
            want |= {(q, i) for _, i in near[:4]}
    got = lexical.vector_topk(df, asked, "id", "v", "q", "f", 4)
    assert {(r.q, r.id) for r in got.collect() if r.q < 100} == want
    assert {(r.q, r.id) for r in got.collect() if r.q >= 100} == {(101, 101)}
    assert lexical.vector_topk(df, asked.limit(0), "id", "v", "q", "f", 4).count() == 0
    assert "zip_with" not in got._jdf.queryExecution().toString()


def test_bm25_counts_words_once(spark):
    """Counted in Python and in columns alike, with stems and without; only rows with a query term leave the count."""
    from emberlane.functions.stems import stem_words

    rng = random.Random(3)
    texts = [" ".join(rng.choice(["running", "runs", "Cats", "cat", "x1", "sky", "\u212aite", "e\u0301t"]) for _ in range(rng.randint(0, 12))) for _ in range(40)] + [None]
    rows = spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in enumerate(texts)], "id long, text string, source string")
    asked = spark.createDataFrame([(1, "running cats"), (2, "kite sky src1"), (3, "nothing")], "q int, query string")
    plain = lambda c: stem_words(c)  # noqa: E731 (has no word-level form)
    ask = lambda stem: sorted((r.q, r.id, round(r.score, 9)) for r in lexical.bm25(rows, asked, "id", "q", "query", {"text": 1.0, "source": 2.0}, 5, stem=stem).collect())
    assert ask(stem_words) == ask(plain) and len(ask(plain)) == 10
    assert ask(None) == ask(lambda c: c) != ask(plain)
    plan = lexical.bm25(rows, asked, "id", "q", "query", {"text": 1.0}, 5)._jdf.queryExecution().toString()
    assert "Generate explode(e" not in plan


def test_working_set_stream_needs_no_python(spark, tmp_path):
    from emberlane.streaming import event_streams

    spark.createDataFrame([(u, i, u % 2) for i, u in enumerate([1, 1, 2, 1, 3, 2])], "user_id long, event_id long, region int").write.parquet(f"{tmp_path}/e.parquet")
    stream = spark.readStream.schema("user_id long, event_id long, region int").parquet(f"{tmp_path}/e.parquet")
    kept = event_streams.working_set(stream)
    assert "InPandas" not in kept._jdf.queryExecution().analyzed().toString()
    got = event_streams.latest(event_streams.drain(kept, "update", "test"), ["user_id", "region"]).collect()
    assert {(r.user_id, r.region): (r.touches, round(r.frequency, 9), r.last_seq) for r in got} == {(1, 1): (3, round((0.92 + 1) * 0.92 + 1, 9), 3), (2, 0): (2, 1.92, 5), (3, 1): (1, 1.0, 4)}


def test_gram_hashes_equal_windows_of_words(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "one two", "A b_c, d! é a B_C d", "x" * 3000 + " y z", *(" ".join(rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(40))]
    words = [re.findall("[a-z0-9_]+", (t or "").lower()) for t in texts]
    want = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    for most in (10**7, 40):
        monkeypatch.setattr(lexical, "TEXT_AT_ONCE", most)
        rows = spark.createDataFrame([(i, t, -i) for i, t in enumerate(texts)], "id long, text string, n int")
        got = sorted(map(tuple, lexical.gram_hashes(rows, "id", "text", 3, ("n",)).collect()))
        assert [(i, n, len(g)) for i, n, g in got] == [(i, -i, len(w)) for i, w in enumerate(want)]
        for i, _, g in got:
            assert g == sorted(g)
            for j, _, h in got:
                assert len(set(g) & set(h)) == len(want[i] & want[j])


def test_rows_whose_first_grams_are_theirs_alone_are_not_compared(spark, monkeypatch):
    from emberlane.operators import debt

    written = {}
    real = debt.materialize
    monkeypatch.setattr(debt, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    base = [f"g{i}" for i in range(20)]
    rows = [(1, base), (2, [*base[:19], "z"])] + [(10 + k, [f"r{k}{i}" for i in range(10)] + base[:10]) for k in range(30)]
    links = debt.near_links(spark.createDataFrame(rows, "id int, grams array<string>"), "id", "grams")[1].collect()
    assert [(r.a, r.b, round(r.similarity, 6)) for r in links] == [(1, 2, round(19 / 21, 6))]
    assert {r.id for r in written["head"].collect()} <= {1, 2}


def test_bundle_scores_before_it_groups(spark):
    from emberlane.operators import candidates

    rows = spark.createDataFrame([(s, k, k * 7 % 5, 3) for s in range(6) for k in range(5)], "s int, k int, x int, tokens long")
    out = candidates.bundle(rows, "s", "k", F.exp("x"), "tokens", F.col("score") > 1, F.col("k") == 0, 7)
    assert sorted((r.s, r.k, r.kept) for r in out.collect()) == [(s, k, k in (0, 2)) for s in range(6) for k in range(5)]
    assert "EXP(" not in out._jdf.queryExecution().optimizedPlan().toString()
