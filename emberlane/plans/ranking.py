"""Queries for scores, admission, budgets and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.functions import scoring
from emberlane.operators import budget, candidates
from emberlane.plans.registry import query
from emberlane.session import spread
from emberlane.sources.tables import table


def features_of(spark, sf_dir):
    """Customers' parts as regions of a working set."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session"))
    w = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").groupBy("session", F.col("l_partkey").alias("region")).agg(
        F.max("l_linenumber").alias("last"), F.count(F.lit(1)).cast("double").alias("frequency"), F.max("l_discount").alias("disc"), F.max("l_quantity").alias("qty"), F.max("l_tax").alias("tax")
    )
    return w.select(
        "*",
        (F.col("qty") / 50).alias("execution"),
        (F.col("disc") * 10).alias("edit"),
        (F.col("tax") * 10).alias("co"),
        (F.floor("qty").cast("long") * 20).alias("tokens"),
        (F.col("region") % 13 == 0).alias("stale"),
        F.when(F.col("region") % 17 == 0, "module").otherwise("function").alias("kind"),
        F.array_compact(
            F.array(
                F.when(F.col("region") % 2 == 0, "lexical"), F.when(F.col("region") % 3 == 0, "callee"), F.when(F.col("region") % 5 == 0, "caller"), F.when(F.col("region") % 11 == 0, "symbol"), F.when(F.col("region") % 7 == 0, "co_access"), F.when(F.col("region") % 19 == 0, "diagnostic")
            )
        ).alias("sources"),
    )


def scored(spark, sf_dir):
    w = features_of(spark, sf_dir)
    c = {
        "lexical_weight": F.when(F.array_contains("sources", "lexical"), 1.0).otherwise(0.0),
        "overlap": F.lit(0.25),
        "execution_score": F.col("execution"),
        "co_access_score": F.col("co"),
        "last_access_turn": F.col("last"),
        "access_frequency": F.col("frequency"),
        "edit_likelihood": F.col("edit"),
        "token_count": F.col("tokens"),
        "staleness": F.lit(0.0),
        "stale": F.col("stale"),
        "kind": F.col("kind"),
        "semantic": F.lit(None).cast("double"),
    }
    f = scoring.features(c, F.col("sources"), F.lit(8))
    w = w.select("*", *[v.alias(f"f_{k}") for k, v in f.items()])
    return w.withColumn("score", scoring.score({k: F.col(f"f_{k}") for k in f}))


SCORE_SQL = """
WITH w AS (SELECT o_custkey AS session, l_partkey AS region, max(l_linenumber) AS last, count(*)::DOUBLE AS frequency, max(l_discount) AS disc, max(l_quantity) AS qty, max(l_tax) AS tax
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
f AS (SELECT *, floor(qty)::BIGINT * 20 AS tokens, region % 13 = 0 AS stale,
  greatest(least(1, least(1, CASE WHEN region % 2 = 0 THEN 0.4 ELSE 0 END) + 0.125), CASE WHEN region % 11 = 0 THEN 0.75 ELSE 0 END)::DOUBLE AS fl,
  greatest(0, least(1, qty / 50)) AS fx,
  (CASE WHEN region % 15 = 0 THEN 1.0 WHEN region % 3 = 0 OR region % 5 = 0 THEN 0.8 ELSE 0.1 END)::DOUBLE AS fg,
  greatest(greatest(0, least(1, tax * 10)), CASE WHEN region % 7 = 0 THEN 0.6 ELSE 0 END)::DOUBLE AS fh,
  greatest(0, least(1, 0.6 * CASE WHEN last = 0 THEN 0 ELSE exp(-0.35 * greatest(0, 8 - last)) END + 0.4 * greatest(0, least(1, frequency / 6)))) AS fr,
  greatest(greatest(0, least(1, disc * 10)), CASE WHEN region % 19 = 0 THEN 0.9 ELSE 0 END)::DOUBLE AS fd,
  (CASE WHEN region % 17 = 0 THEN least(1, least(1, floor(qty) * 20 / 2400) + 0.3) ELSE least(1, floor(qty) * 20 / 2400) END)::DOUBLE AS fc,
  (CASE WHEN region % 13 = 0 THEN 1 ELSE 0 END)::DOUBLE AS fs FROM w),
s AS (SELECT *, 0.24 * fl + 0.26 * fx + 0.14 * fg + 0.12 * fh + 0.08 * fr + 0.22 * fd - 0.08 * fc - 0.3 * fs AS score FROM f),
p AS (SELECT *, 1 / (1 + exp(-6 * (score - 0.3))) AS p FROM s),
v AS (SELECT *, 600 + least(greatest(tokens * 3, tokens + 400), 6000) AS miss, tokens + 30 AS admit, 400 * (1 - p) * tokens / 2400 AS pollution FROM p),
e AS (SELECT *, p * miss - admit - pollution AS ev FROM v)
"""


@query("score_region", SCORE_SQL + "SELECT session, region, round(score, 6) AS score FROM s")
def score_region(spark, sf_dir):
    return scored(spark, sf_dir).select("session", "region", F.round("score", 6).alias("score"))


@query("p_used_soon", SCORE_SQL + "SELECT session, region, round(p, 6) AS p FROM p")
def p_used_soon(spark, sf_dir):
    return scored(spark, sf_dir).select("session", "region", F.round(scoring.p_used_soon("score"), 6).alias("p"))


@query(
    "admission_ev",
    SCORE_SQL
    + """SELECT session, region, round(ev, 4) AS ev, CASE WHEN fs >= 1 THEN 'stale' WHEN score < 0.28 AND fx < 0.5 AND fd < 0.8 THEN 'score' WHEN ev <= 0 THEN 'value' ELSE 'admit' END AS verdict FROM e""",
)
def admission_ev(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("p", scoring.p_used_soon("score"))
    s = s.withColumn("ev", scoring.expected_value("p", "tokens")["ev"])
    return s.select("session", "region", F.round("ev", 4).alias("ev"), scoring.admission("score", "f_staleness", "f_execution", "f_diagnostic", "ev").alias("verdict"))


@query(
    "keep_score",
    SCORE_SQL
    + """SELECT session, region, round(CASE WHEN region % 29 = 0 THEN 1e9 ELSE (frequency + 0.1) * CASE WHEN last = 0 THEN 0.35 ELSE exp(-0.25 * greatest(0, 8 - last)) END
      * (0.15 + 0.4 * (qty / 50) + 0.3 * 0.2 + 0.2 * (disc * 10) + 0.1 * (tax * 10)) / greatest(tokens, 1) * 100 END, 6) AS keep FROM f""",
)
def keep_score(spark, sf_dir):
    w = features_of(spark, sf_dir)
    keep = scoring.keep_value(F.col("region") % 29 == 0, "frequency", "last", F.lit(8), "execution", F.lit(0.2), "edit", "co", "tokens")
    return w.select("session", "region", F.round(keep, 6).alias("keep"))


@query(
    "why_text",
    SCORE_SQL
    + """SELECT session, region, CASE WHEN len(b) = 0 THEN 'weak union candidate' ELSE array_to_string(b, '; ') END AS why FROM (SELECT session, region, list_filter([
      CASE WHEN fx >= 0.9 THEN 'executed only by the failing test' WHEN fx > 0.4 THEN 'executed by targeted test' END,
      CASE WHEN region % 19 = 0 THEN 'in failing-test traceback' WHEN disc * 10 >= 0.85 THEN 'edited this session' END,
      CASE WHEN region % 11 = 0 THEN 'exact symbol match' WHEN fl > 0.45 THEN 'intent/lexical match' END,
      CASE WHEN region % 3 = 0 THEN 'call successor of active region' END, CASE WHEN region % 5 = 0 THEN 'caller of active region' END,
      CASE WHEN region % 7 = 0 OR fh > 0.5 THEN 'co-accessed this session' END, CASE WHEN fr > 0.5 THEN 'read this session' END,
      CASE WHEN fs > 0.5 THEN 'STALE — content hash mismatch' END], lambda x: x IS NOT NULL) AS b FROM f)""",
)
def why_text(spark, sf_dir):
    s = scored(spark, sf_dir)
    f = {k[2:]: F.col(k) for k in s.columns if k.startswith("f_")}
    return s.select("session", "region", scoring.why(f, F.col("sources"), F.lit(1.0), F.col("edit")).alias("why"))


@query(
    "memory_level",
    SCORE_SQL
    + """SELECT session, region, CASE WHEN stale THEN CASE WHEN qty > 45 THEN 'L1' WHEN region % 29 = 0 THEN 'L0' ELSE 'L2' END WHEN region % 29 = 0 OR disc > 0.09 THEN 'L0'
      WHEN frequency > 1 OR qty > 45 THEN 'L1' ELSE 'L2' END AS level FROM f""",
)
def memory_level(spark, sf_dir):
    w = features_of(spark, sf_dir)
    level = scoring.memory_level(F.lit(True), "stale", F.col("region") % 29 == 0, F.col("frequency") > 1, F.col("qty") > 45, F.col("disc") > 0.09, F.lit(False))
    return w.select("session", "region", level.alias("level"))


@query(
    "representation_choice",
    SCORE_SQL
    + """SELECT CASE WHEN region % 29 = 0 OR score >= 0.55 THEN 'exact' WHEN score >= 0.42 AND tokens < 120 THEN 'exact' WHEN score >= 0.3 THEN 'signature' ELSE 'summary' END AS level, count(*) AS n FROM s GROUP BY 1""",
)
def representation_choice(spark, sf_dir):
    level = scoring.representation("score", "tokens", F.col("region") % 29 == 0)
    return scored(spark, sf_dir).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("prefetch_blend", SCORE_SQL + "SELECT session, region, round(greatest(p, 0.72 * fx + 0.2 * p), 6) AS p FROM p")
def prefetch_blend(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("p", scoring.p_used_soon("score"))
    return s.select("session", "region", F.round(scoring.prefetch_blend("p", "f_execution"), 6).alias("p"))


def priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("cost"), (F.col("o_orderkey") % 31 == 0).alias("pinned"), F.col("o_totalprice").alias("score"))


@query(
    "budget_prefix_cut",
    """
    WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS cost, row_number() OVER w AS n, sum(floor(o_totalprice / 1000)::BIGINT) OVER w AS used FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING))
    SELECT o_custkey, o_orderkey, used::BIGINT AS used FROM o WHERE (used <= 900 OR n = 1) AND n <= 8
    """,
)
def budget_prefix_cut(spark, sf_dir):
    return budget.prefix_cut(priced(spark, sf_dir), "o_custkey", [F.desc("score"), F.col("o_orderkey")], "cost", 900).select("o_custkey", "o_orderkey", "used")


def greedy_sql(order: str, limit: int) -> str:
    return f"""
    WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS cost, o_orderkey % 31 = 0 AS pinned,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 31 <> 0, {order}, o_orderkey) AS n FROM orders),
    g AS (SELECT o_custkey, o_orderkey, n, true AS kept, cost AS used, 1 AS c FROM o WHERE n = 1
      UNION ALL SELECT o.o_custkey, o.o_orderkey, o.n, o.pinned OR g.used + o.cost <= {limit} OR g.c = 0, g.used + CASE WHEN o.pinned OR g.used + o.cost <= {limit} OR g.c = 0 THEN o.cost ELSE 0 END,
        g.c + CASE WHEN o.pinned OR g.used + o.cost <= {limit} OR g.c = 0 THEN 1 ELSE 0 END FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.n = g.n + 1)
    SELECT o_custkey, o_orderkey, kept FROM g
    """


@query("greedy_evict", greedy_sql("o_totalprice DESC", 700))
def greedy_evict(spark, sf_dir):
    return budget.greedy(priced(spark, sf_dir), "o_custkey", [F.col("score")], "o_orderkey", "cost", 700, F.col("pinned")).select("o_custkey", "o_orderkey", "kept")


@query("lru_evict", greedy_sql("o_orderdate DESC", 500))
def lru_evict(spark, sf_dir):
    o = priced(spark, sf_dir).drop("score").join(table(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at")), "o_orderkey")
    return budget.greedy(o, "o_custkey", [F.col("at")], "o_orderkey", "cost", 500, F.col("pinned")).select("o_custkey", "o_orderkey", "kept")


@query(
    "fit_budget_downgrade",
    """
    WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS a, floor(o_totalprice / 3000)::BIGINT AS b, floor(o_totalprice / 9000)::BIGINT AS c, o_orderkey % 31 = 0 AS pin,
      (o_orderkey % 2)::INTEGER AS lv, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
    x AS (SELECT *, CASE WHEN lv = 0 THEN a ELSE b END AS own FROM o),
    g AS (SELECT o_custkey, o_orderkey, n, lv AS level, own AS cost, own AS used FROM x WHERE n = 1
      UNION ALL SELECT y.o_custkey, y.o_orderkey, y.n, y.pick, y.cc, y.u + CASE WHEN y.pick >= 0 THEN y.cc ELSE 0 END FROM (
        SELECT x.o_custkey, x.o_orderkey, x.n, g.used AS u,
          CASE WHEN g.used + own <= 600 THEN lv WHEN lv < 1 AND g.used + b <= 600 THEN 1 WHEN g.used + c <= 600 THEN 2 WHEN pin THEN 2 ELSE -1 END AS pick,
          CASE WHEN g.used + own <= 600 THEN own WHEN lv < 1 AND g.used + b <= 600 THEN b ELSE c END AS cc
        FROM g JOIN x ON x.o_custkey = g.o_custkey AND x.n = g.n + 1) y)
    SELECT o_custkey, o_orderkey, level, cost FROM g WHERE level >= 0
    """,
)
def fit_budget_downgrade(spark, sf_dir):
    p = priced(spark, sf_dir).withColumns({"b": F.floor(F.col("score") / 3000).cast("long"), "c": F.floor(F.col("score") / 9000).cast("long")})
    return budget.fit_levels(p, "o_custkey", [F.col("score")], "o_orderkey", ["cost", "b", "c"], 600, F.col("o_orderkey") % 2, F.col("pinned"))


@query(
    "prefetch_caps",
    """
    WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS s, l_orderkey AS parent, l_partkey AS k, floor(l_quantity)::BIGINT AS cost, l_extendedprice AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    u AS (SELECT s, parent, k, min(cost) AS cost, max(p) AS p FROM l GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p DESC, k, parent, cost) AS n FROM u),
    g AS (SELECT s, n, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 60 THEN [parent] ELSE []::BIGINT[] END AS ps, CASE WHEN cost <= 60 THEN [k] ELSE []::BIGINT[] END AS ks FROM o WHERE n = 1
      UNION ALL SELECT y.s, y.n, y.used + CASE WHEN y.t THEN y.cost ELSE 0 END, CASE WHEN y.t THEN list_append(ps, parent) ELSE ps END, CASE WHEN y.t THEN list_append(ks, k) ELSE ks END FROM (
        SELECT o.s, o.n, g.used, g.ps, g.ks, o.parent, o.k, o.cost, len(ks) < 3 AND NOT list_contains(ps, o.parent) AND NOT list_contains(ks, o.k) AND g.used + o.cost <= 60 AS t FROM g JOIN o ON o.s = g.s AND o.n = g.n + 1) y),
    f AS (SELECT s, arg_max(ks, n) AS ks FROM g GROUP BY 1)
    SELECT s AS session, unnest(ks) AS region, (generate_subscripts(ks, 1) - 1)::INTEGER AS place FROM f
    """,
)
def prefetch_caps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_custkey").alias("session"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("region"), F.floor("l_quantity").cast("long").alias("cost"), F.col("l_extendedprice").alias("p"))
    u = spread(line.join(o, "parent"), "session").groupBy("session", "parent", "region").agg(F.min("cost").alias("cost"), F.max("p").alias("p"))
    return budget.capped(u, "session", "parent", "region", [F.col("p")], "cost", 60, 3).select("session", "region", "place")


@query(
    "edge_cap",
    """
    WITH RECURSIVE e AS (SELECT s_nationkey AS g, l_suppkey AS u, -1 - l_partkey AS v, count(*) AS w FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, u, v) AS n FROM e),
    r AS (SELECT g, n, [u] AS us, [v] AS vs FROM o WHERE n = 1
      UNION ALL SELECT y.g, y.n, CASE WHEN t THEN list_append(us, u) ELSE us END, CASE WHEN t THEN list_append(vs, v) ELSE vs END FROM (
        SELECT o.g, o.n, o.u, o.v, us, vs, NOT (len(list_filter(us, lambda x: x = o.u)) >= 2 AND len(list_filter(vs, lambda x: x = o.v)) >= 2) AS t FROM r JOIN o ON o.g = r.g AND o.n = r.n + 1) y),
    f AS (SELECT g, arg_max(us, n) AS us, arg_max(vs, n) AS vs FROM r GROUP BY 1)
    SELECT g, unnest(us) AS u, unnest(vs) AS v FROM f
    """,
)
def edge_cap(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("g"))
    # parts have negative ids, so that no part is a supplier
    e = table(spark, sf_dir, "lineitem").join(s, "l_suppkey").groupBy("g", F.col("l_suppkey").alias("u"), (-1 - F.col("l_partkey")).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    return budget.cap_edges(e, "g", [F.col("w")], "u", "v", 2)


@query(
    "candidate_union",
    """
    WITH a AS (SELECT DISTINCT l_partkey AS region, 1.0 AS w, 'lexical' AS s, 0 AS r FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_partkey, 0.9, 'callee', 1 FROM lineitem WHERE l_discount > 0.08),
    c AS (SELECT DISTINCT l_partkey, 0.5, 'co_access', 2 FROM lineitem WHERE l_tax > 0.07), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
    SELECT region, string_agg(s, ',' ORDER BY r) AS sources, round(sum(w)::DOUBLE, 6) AS weight FROM u GROUP BY 1
    """,
)
def candidate_union(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    part = lambda cond, w: line.where(cond).select(F.col("l_partkey").alias("region")).distinct().withColumn("weight", F.lit(w))
    out = candidates.union_candidates({"lexical": part("l_quantity > 48", 1.0), "callee": part("l_discount > 0.08", 0.9), "co_access": part("l_tax > 0.07", 0.5)}, "region")
    return out.select("region", F.array_join("sources", ",").alias("sources"), F.round("weight", 6).alias("weight"))


EDGES = "SELECT DISTINCT l_suppkey * 7 AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey * 7 <> l_partkey"


@query(
    "one_hop_neighbors",
    f"WITH e AS ({EDGES}), a AS (SELECT DISTINCT src AS k FROM e WHERE src % 9 = 0) SELECT dst AS region, 'callee' AS source, 0.9::DOUBLE AS weight FROM e JOIN a ON src = k UNION ALL SELECT src, 'caller', 0.85 FROM e JOIN a ON dst = k",
)
def one_hop_neighbors(spark, sf_dir):
    from emberlane.plans.graphs import edges_of

    e = edges_of(spark, sf_dir)
    return candidates.one_hop(e.where("src % 9 = 0").select(F.col("src").alias("region")), e, "region", "src", "dst")


@query("neighbor_lists", f"WITH e AS ({EDGES}) SELECT src AS node, dst AS neighbour FROM e UNION SELECT dst, src FROM e")
def neighbor_lists(spark, sf_dir):
    from emberlane.plans.graphs import edges_of

    return candidates.undirected_neighbours(edges_of(spark, sf_dir), "src", "dst")


@query(
    "ghost_regions",
    "SELECT DISTINCT k * 40 AS region, p_name AS hint FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_size > 25) ON p_partkey = k * 40 WHERE k * 40 NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)",
)
def ghost_regions(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select((F.get_json_object("props", "$.k").cast("long") * 40).alias("region"))
    p = table(spark, sf_dir, "part").withColumnsRenamed({"p_partkey": "region", "p_name": "hint"})
    return candidates.ghosts(seen, p.where("p_size <= 25"), "region", p.where("p_size > 25").select("region", "hint"))


@query(
    "prefetch_targets",
    f"WITH e AS ({EDGES}), h AS (SELECT DISTINCT src AS parent FROM e WHERE src % 4 = 0) SELECT src AS parent, dst AS region FROM e JOIN h ON src = parent JOIN part ON p_partkey = dst WHERE dst NOT IN (SELECT parent FROM h) AND p_size > 10",
)
def prefetch_targets(spark, sf_dir):
    from emberlane.plans.graphs import edges_of

    e = edges_of(spark, sf_dir)
    parents = e.where("src % 4 = 0").select(F.col("src").alias("region")).distinct()
    regions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region"), F.when(F.col("p_size") > 10, "function").otherwise("module").alias("kind"))
    return candidates.prefetch_targets(parents, e, regions, parents, "region", "src", "dst", ["function"]).select("parent", "region")


@query("label_lookup", "SELECT DISTINCT l_suppkey AS id, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, l_suppkey::VARCHAR) AS label FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey")
def label_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")).distinct()
    names = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return candidates.labels_for(ids, names, "id", "label")


@query(
    "bundle_end_to_end",
    SCORE_SQL
    + """, x AS (SELECT *, region % 29 = 0 AS pin, CASE WHEN fs >= 1 THEN false WHEN score < 0.28 AND fx < 0.5 AND fd < 0.8 THEN false WHEN ev <= 0 THEN false ELSE true END AS ok FROM e),
    o AS (SELECT session, region, tokens, pin, score, row_number() OVER (PARTITION BY session ORDER BY NOT pin, round(score, 9) DESC, region) AS n FROM x WHERE ok OR pin),
    g AS (WITH RECURSIVE r AS (SELECT session, region, n, true AS kept, tokens AS used FROM o WHERE n = 1
      UNION ALL SELECT o.session, o.region, o.n, o.pin OR r.used + o.tokens <= 2400, r.used + CASE WHEN o.pin OR r.used + o.tokens <= 2400 THEN o.tokens ELSE 0 END FROM r JOIN o ON o.session = r.session AND o.n = r.n + 1) SELECT * FROM r)
    SELECT session, region, kept FROM g""",
)
def bundle_end_to_end(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("p", scoring.p_used_soon("score"))
    s = s.withColumn("ev", scoring.expected_value("p", "tokens")["ev"]).withColumn("pin", F.col("region") % 29 == 0)
    admit = scoring.admission("score", "f_staleness", "f_execution", "f_diagnostic", "ev") == "admit"
    return candidates.bundle(s, "session", "region", F.col("score"), "tokens", admit, F.col("pin"), 2400).select("session", "region", "kept")
