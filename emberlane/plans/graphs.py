"""Queries over a call-style graph of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.operators import debt, graph
from emberlane.plans.registry import query
from emberlane.session import materialize
from emberlane.sources.tables import table


def edges_of(spark, sf_dir):
    """Distinct edges src -> dst of all line items, without self-loops."""
    e = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7).alias("src"), F.col("l_partkey").alias("dst"))
    return e.where("src <> dst").distinct()


EDGES = "SELECT DISTINCT l_suppkey * 7 AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey * 7 <> l_partkey"


@query(
    "call_graph",
    f"WITH e AS ({EDGES}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT p_partkey FROM part), s AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS l FROM e GROUP BY 1) SELECT node, coalesce(l, '') AS successors FROM n LEFT JOIN s ON src = node",
)
def call_graph(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.adjacency(edges_of(spark, sf_dir), nodes).select("node", F.array_join("successors", ",").alias("successors"))


@query("degrees", f"WITH e AS ({EDGES}) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1")
def degrees(spark, sf_dir):
    return graph.degrees(edges_of(spark, sf_dir))


@query(
    "reverse_bfs",
    f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT (SELECT min(dst) FROM e) AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 30) SELECT node, min(depth) AS depth FROM r GROUP BY 1",
)
def reverse_bfs(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return graph.reach(e, e.agg(F.min("dst").alias("node")), reverse=True)


@query(
    "reach_from_seed",
    f"WITH RECURSIVE e AS ({EDGES}), r AS (SELECT DISTINCT src AS node, 0 AS depth FROM e WHERE src % 50 = 7 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 25) SELECT node, min(depth) AS depth FROM r GROUP BY 1",
)
def reach_from_seed(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return graph.reach(e, e.where("src % 50 = 7").select(F.col("src").alias("node")))


@query(
    "shortest_reverse_path",
    f"""WITH RECURSIVE e AS ({EDGES}), d AS (SELECT (SELECT min(dst) FROM e) AS node, 0 AS depth UNION SELECT e.src, d.depth + 1 FROM d JOIN e ON e.dst = d.node WHERE d.depth < 12),
    m AS (SELECT node, min(depth) AS depth FROM d GROUP BY 1), t AS (SELECT max(node) AS node FROM m WHERE depth = (SELECT max(depth) FROM m))
    SELECT m.node, m.depth FROM m JOIN t USING (node)""",
)
def shortest_reverse_path(spark, sf_dir):
    e = materialize(edges_of(spark, sf_dir), "edges")
    target = e.agg(F.min("dst")).first()[0]
    cone = graph.reach(e, e.agg(F.min("dst").alias("node")), reverse=True)
    far = cone.agg(F.max(F.struct("depth", "node")).alias("far")).first()[0]["node"]
    return graph.shortest_reverse_path(e, target, far).select("node", F.col("depth").cast("int").alias("depth"))


SCC_SQL = """WITH RECURSIVE e AS ({edges}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT x.a AS node, min(x.b) AS c FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)
SELECT node, least(node, coalesce(c, node)) AS component FROM n LEFT JOIN m USING (node)"""


@query("scc", SCC_SQL.format(edges=EDGES))
def scc(spark, sf_dir):
    return graph.strong_components(edges_of(spark, sf_dir))


@query("scc_grouped", SCC_SQL.format(edges=EDGES))
def scc_grouped(spark, sf_dir):
    return graph.strong_components_grouped(edges_of(spark, sf_dir))


@query("scc_giant", SCC_SQL.format(edges=EDGES))
def scc_giant(spark, sf_dir):
    return graph.strong_components(edges_of(spark, sf_dir))


@query(
    "connected_component",
    f"WITH RECURSIVE e AS ({EDGES}), s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a, a AS b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a) SELECT a AS node, min(b) AS component FROM r GROUP BY 1",
)
def connected_component(spark, sf_dir):
    return graph.components(edges_of(spark, sf_dir))


@query("min_cut")
def min_cut(spark, sf_dir):
    return graph.min_cuts(edges_of(spark, sf_dir)).select("component", "nodes", "weight", F.size("side").alias("side"))


@query("articulation_points")
def articulation_points(spark, sf_dir):
    return graph.articulation_points(edges_of(spark, sf_dir))


@query("betweenness")
def betweenness(spark, sf_dir):
    return graph.betweenness(edges_of(spark, sf_dir))


@query(
    "crossing_edges",
    f"WITH e AS ({EDGES}) SELECT count(DISTINCT (least(src, dst), greatest(src, dst))) AS crossing FROM e WHERE src % 3 <> dst % 3",
)
def crossing_edges(spark, sf_dir):
    e = edges_of(spark, sf_dir)
    return graph.crossing_edges(e, graph.nodes_of(e).withColumn("part", F.col("node") % 3))


@query(
    "node_pruning",
    f"""WITH e AS ({EDGES}), s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), d AS (SELECT a AS node, count(*) AS deg FROM s GROUP BY 1),
    c AS (SELECT node FROM d WHERE node % 40 = 0), n AS (SELECT DISTINCT a AS node FROM s WHERE b IN (SELECT node FROM c))
    SELECT node FROM d ORDER BY CASE WHEN node IN (SELECT node FROM c) THEN 0 WHEN node IN (SELECT node FROM n) THEN 1 ELSE 2 END, deg DESC, node LIMIT 60""",
)
def node_pruning(spark, sf_dir):
    e = materialize(edges_of(spark, sf_dir), "edges")
    nodes = graph.nodes_of(e)
    return graph.prune_nodes(nodes, e, nodes.where("node % 40 = 0"), 60, ["node"])


def regions_of(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("lines"), (F.col("p_partkey") % 4).cast("int").alias("branches"))


@query("debt_findings")
def debt_findings(spark, sf_dir):
    found = debt.findings(edges_of(spark, sf_dir), regions_of(spark, sf_dir))
    return found.select("kind", "name", F.size("members").alias("members"), F.round("cost", 2).alias("cost"))


@query("debt_local_findings")
def debt_local_findings(spark, sf_dir):
    found = debt.findings(edges_of(spark, sf_dir), regions_of(spark, sf_dir)).where("kind IN ('complex', 'hub', 'orphan')")
    return found.select("kind", "name", F.round("cost", 2).alias("cost"))


@query("debt_totals")
def debt_totals(spark, sf_dir):
    found = materialize(debt.findings(edges_of(spark, sf_dir), regions_of(spark, sf_dir)), "findings")
    return debt.totals(found).select("kind", "n", F.round("cost", 2).alias("cost"))


@query("debt_highlights")
def debt_highlights(spark, sf_dir):
    found = materialize(debt.findings(edges_of(spark, sf_dir), regions_of(spark, sf_dir)), "findings")
    return debt.highlights(found)


@query("clone_exact", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS kept, ((count(*) - 1) * arg_min(n_chars // 4, doc_id))::BIGINT AS redundant_cost FROM documents GROUP BY 1 HAVING count(*) > 1")
def clone_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    out = d.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("kept"), F.min_by("tokens", "doc_id").alias("t")).where("copies > 1")
    return out.select("digest", "copies", "kept", ((F.col("copies") - 1) * F.col("t")).alias("redundant_cost"))


GRAMS_SQL = """
WITH d AS (SELECT doc_id, n_chars, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n_chars, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d),
x AS (SELECT doc_id, unnest(g) AS t FROM g), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
j AS (SELECT a, b, n / (len(u.g) + len(v.g) - n) AS s FROM p JOIN g u ON u.doc_id = a JOIN g v ON v.doc_id = b)
"""


def gram_rows(spark, sf_dir):
    from emberlane.operators.lexical import gram_hashes

    return gram_hashes(table(spark, sf_dir, "documents"), "doc_id", "text", 3, ("n_chars",))


@query("clone_near_jaccard", GRAMS_SQL + "SELECT a, b, round(s, 6) AS similarity FROM j WHERE s >= 0.82")
def clone_near_jaccard(spark, sf_dir):
    return debt.near_pairs(gram_rows(spark, sf_dir), "doc_id", "grams").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    "clone_clusters",
    GRAMS_SQL.replace("WITH d", "WITH RECURSIVE d")
    + """, l AS (SELECT a, b FROM j WHERE s >= 0.82 UNION SELECT x.doc_id, y.doc_id FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id),
    s AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, a AS b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), c AS (SELECT a AS node, min(b) AS cluster FROM r GROUP BY 1)
    SELECT cluster, count(*) AS copies, min(node) AS kept, ((count(*) - 1) * arg_min(n_chars // 4, node))::BIGINT AS redundant_cost FROM c JOIN documents ON doc_id = node GROUP BY 1""",
)
def clone_clusters(spark, sf_dir):
    named, near = debt.near_links(gram_rows(spark, sf_dir), "doc_id", "grams")
    # copies are linked to their representative only
    near = near.select("a", "b").unionByName(named.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    exact = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.floor(F.col("n_chars") / 4).alias("tokens"))
    return debt.clone_clusters(exact, near, "doc_id", "digest", "tokens")


@query(
    "bundle_tags",
    f"""WITH RECURSIVE e AS ({EDGES}), r AS (SELECT (SELECT min(dst) FROM e) AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 30),
    t AS (SELECT src AS a, dst AS b FROM e UNION SELECT t.a, e.dst FROM t JOIN e ON t.b = e.src), c AS (SELECT DISTINCT a AS node FROM t WHERE a = b),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT node, concat_ws(',', CASE WHEN node IN (SELECT node FROM r) THEN 'reverse_bfs' END, CASE WHEN node IN (SELECT node FROM c) THEN 'tarjan' END) AS tags FROM n""",
)
def bundle_tags(spark, sf_dir):
    from emberlane.operators.candidates import annotate

    e = materialize(edges_of(spark, sf_dir), "edges")
    cone = graph.reach(e, e.agg(F.min("dst").alias("node")), reverse=True)
    scc = materialize(graph.strong_components_grouped(e), "components")
    scc = scc.join(scc.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "component")
    return annotate(graph.nodes_of(e), "node", {"reverse_bfs": cone, "tarjan": scc}).select("node", F.array_join("graph_tags", ",").alias("tags"))
