"""Queries over orders read as co-access calls, and over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.operators import intervals, lake, working_set
from emberlane.plans.registry import query
from emberlane.session import spread
from emberlane.sources.tables import table


def touches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_suppkey")
    return line.join(o, "o_orderkey")


CALLS_SQL = """
WITH c AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT l_partkey)) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) >= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM c),
x AS (SELECT o_custkey, o_orderkey, i, m, unnest(r) AS a FROM n),
p AS (SELECT u.o_custkey, u.i, u.m, u.a AS a, v.a AS b FROM x u JOIN x v ON u.o_orderkey = v.o_orderkey AND u.o_custkey = v.o_custkey AND u.a < v.a),
w AS (SELECT o_custkey, a, b, sum(pow(0.92, m - i)) AS weight, least(1.0, 0.12 * count(*)) AS score FROM p GROUP BY 1, 2, 3)
"""


@query("lfu_decay_frequency", "SELECT o_custkey, l_partkey, count(*) AS touches, round((1 - pow(0.92, count(*))) / (1 - 0.92), 6) AS frequency FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def lfu_decay_frequency(spark, sf_dir):
    out = working_set.decayed_frequency(touches_of(spark, sf_dir), ["o_custkey", "l_partkey"])
    return out.withColumn("frequency", F.round("frequency", 6))


@query(
    "working_set_max_merge",
    """
    SELECT o_custkey, l_partkey, max(l_quantity) AS execution, max(l_discount) AS edit, count(*) AS touches,
      arg_max(l_linenumber, (o_orderkey, l_linenumber, l_suppkey)) AS last_access_turn FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2
    """,
)
def working_set_max_merge(spark, sf_dir):
    t = touches_of(spark, sf_dir).withColumnsRenamed({"l_quantity": "execution", "l_discount": "edit", "l_linenumber": "turn"})
    out = working_set.max_merge(t, ["o_custkey", "l_partkey"], ["execution", "edit"], ["o_orderkey", "turn", "l_suppkey"])
    return out.select("o_custkey", "l_partkey", "execution", "edit", "touches", "last_access_turn")


@query(
    "co_access_decay_topn",
    CALLS_SQL + "SELECT o_custkey, a, b, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, a ORDER BY round(weight, 9) DESC, b) AS n FROM w) WHERE n <= 4",
)
def co_access_decay_topn(spark, sf_dir):
    calls = working_set.calls_of(touches_of(spark, sf_dir), "o_custkey", "o_orderkey", "l_partkey")
    return working_set.co_access(calls, "o_custkey", top=4).select("o_custkey", "a", "b", F.round("weight", 6).alias("weight"))


@query("co_access_saturating", CALLS_SQL + "SELECT a, b, least(1.0, 0.12 * sum(round(score / 0.12)))::DOUBLE AS score FROM w GROUP BY 1, 2")
def co_access_saturating(spark, sf_dir):
    calls = working_set.calls_of(touches_of(spark, sf_dir), "o_custkey", "o_orderkey", "l_partkey")
    return spread(working_set.pairs_in_calls(calls, []), "a", "b").groupBy("a", "b").agg(F.least(F.lit(1.0), F.lit(0.12) * F.count(F.lit(1))).alias("score"))


@query(
    "pair_max_top",
    CALLS_SQL + "SELECT a, b, round(max(weight), 6) AS weight FROM w GROUP BY 1, 2 ORDER BY round(max(weight), 6) DESC, a, b LIMIT 300",
)
def pair_max_top(spark, sf_dir):
    calls = working_set.calls_of(touches_of(spark, sf_dir), "o_custkey", "o_orderkey", "l_partkey")
    pairs = spread(working_set.co_access(calls, "o_custkey").select("a", "b", "weight"), "a", "b").groupBy("a", "b").agg(F.round(F.max("weight"), 6).alias("weight"))
    return pairs.orderBy(F.desc("weight"), "a", "b").limit(300)


@query(
    "co_access_neighbors",
    CALLS_SQL
    + """, act AS (SELECT DISTINCT l_partkey AS r FROM lineitem WHERE l_partkey % 40 = 0),
    e AS (SELECT o_custkey AS session, b AS region, weight FROM w JOIN act ON a = r UNION ALL SELECT o_custkey, a, weight FROM w JOIN act ON b = r)
    SELECT session, region, round(weight, 6) AS weight, round(least(1.5, weight * CASE WHEN session = 5 THEN 1.0 ELSE 0.45 END), 6) AS scaled FROM
    (SELECT * FROM e ORDER BY session = 5 DESC, round(weight, 9) DESC, region, session LIMIT 40)""",
)
def co_access_neighbors(spark, sf_dir):
    t = touches_of(spark, sf_dir)
    calls = working_set.calls_of(t, "o_custkey", "o_orderkey", "l_partkey")
    graph = working_set.co_access(calls, "o_custkey").withColumnRenamed("o_custkey", "session")
    actives = t.where("l_partkey % 40 = 0").select(F.col("l_partkey").alias("region")).distinct()
    out = working_set.neighbours(graph, actives, 5)
    return out.select("session", "region", F.round("weight", 6).alias("weight"), F.round("scaled", 6).alias("scaled"))


def spans_of(spark, sf_dir):
    """Price ranges of each (nation, segment) of customers; a whole-nation range stands for the module row."""
    c = table(spark, sf_dir, "customer")
    part = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    whole = c.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high")).withColumn("c_mktsegment", F.lit("~all"))
    return part.unionByName(whole).withColumn("module", F.col("c_mktsegment") == "~all")


SPANS_SQL = """
WITH spans AS (SELECT c_nationkey AS k, c_mktsegment AS id, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1, 2
  UNION ALL SELECT c_nationkey, '~all', min(c_acctbal), max(c_acctbal) FROM customer GROUP BY 1)
"""


@query(
    "narrowest_covering",
    SPANS_SQL
    + """, h AS (SELECT s_suppkey, id, high - low AS w, low, s_acctbal BETWEEN low AND high AS ok FROM supplier JOIN spans ON k = s_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY w, low, id) AS n FROM h WHERE ok AND id <> '~all')
    SELECT s_suppkey, id AS span, w AS width FROM r WHERE n = 1
    UNION ALL SELECT s_suppkey, id, w FROM h WHERE id = '~all' AND s_suppkey NOT IN (SELECT s_suppkey FROM r)""",
)
def narrowest_covering(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    spans = spans_of(spark, sf_dir)
    hit = intervals.narrowest_cover(s, spans.where("NOT module"), "c_nationkey", "s_suppkey", "s_acctbal", "low", "high", "c_mktsegment")
    rest = intervals.narrowest_cover(s.join(hit, "s_suppkey", "left_anti"), spans.withColumn("low", F.when(F.col("module"), F.col("low"))), "c_nationkey", "s_suppkey", "s_acctbal", "low", "high", "c_mktsegment")
    missing = s.join(hit.unionByName(rest), "s_suppkey", "left_anti").join(spans.where("module"), "c_nationkey").select("s_suppkey", "c_mktsegment", (F.col("high") - F.col("low")).alias("width"))
    return hit.unionByName(rest).unionByName(missing).select("s_suppkey", F.col("c_mktsegment").alias("span"), "width")


@query(
    "interval_overlap",
    SPANS_SQL + "SELECT a.k AS nation, a.id AS a, b.id AS b FROM spans a JOIN spans b ON a.k = b.k AND a.low <= b.high AND b.low <= a.high AND a.id < b.id",
)
def interval_overlap(spark, sf_dir):
    s = spans_of(spark, sf_dir).drop("module")
    return intervals.overlaps(s, s, "c_nationkey").where("c_mktsegment < other_c_mktsegment").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("a"), F.col("other_c_mktsegment").alias("b"))


@query(
    "interval_overlap_binned",
    """
    WITH s AS (SELECT l_suppkey AS k, l_partkey AS id, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1, 2)
    SELECT a.k, a.id AS a, b.id AS b FROM s a JOIN s b ON a.k = b.k AND a.low <= b.high AND b.low <= a.high AND a.id < b.id
    """,
)
def interval_overlap_binned(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    return intervals.binned_overlaps(s, s, "k", 10.0).where("id < other_id").select("k", F.col("id").alias("a"), F.col("other_id").alias("b"))


@query(
    "failing_only_lines",
    "SELECT DISTINCT l_suppkey AS path, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' EXCEPT SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 49",
)
def failing_only_lines(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    out = intervals.only_in(line.where("l_returnflag = 'R' AND l_linestatus = 'F'"), line.where("l_returnflag = 'A' AND l_quantity > 49"), ["l_suppkey", "l_linenumber"])
    return out.select(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"))


@query(
    "trace_tiers",
    """
    SELECT region, min(tier) AS tier FROM (SELECT l_partkey AS region, 1 AS tier FROM lineitem WHERE l_quantity > 49 UNION ALL
      SELECT l_partkey, 2 FROM lineitem WHERE l_quantity > 47 UNION ALL SELECT l_partkey, 3 FROM lineitem) GROUP BY 1
    """,
)
def trace_tiers(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("region", F.col("l_partkey"))
    return intervals.tiers([line.where("l_quantity > 49"), line.where("l_quantity > 47"), line], "region")


@query(
    "coverage_regions",
    """
    WITH spans AS (SELECT l_suppkey AS k, l_returnflag || l_linestatus AS id, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem GROUP BY 1, 2),
    lines AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS line FROM lineitem WHERE l_quantity > 45),
    h AS (SELECT k, line, id, row_number() OVER (PARTITION BY k, line ORDER BY high - low, low, id) AS n FROM lines JOIN spans USING (k) WHERE line BETWEEN low AND high)
    SELECT id, min((k, line))[1] AS first_key, min((k, line))[2] AS first_line FROM h WHERE n = 1 GROUP BY 1
    """,
)
def coverage_regions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "k", "l_linenumber": "line"})
    spans = line.groupBy("k", F.concat("l_returnflag", "l_linestatus").alias("id")).agg(F.min("line").alias("low"), F.max("line").alias("high"))
    return intervals.lines_to_regions(line.where("l_quantity > 45").select("k", "line").distinct(), spans, "k", "line", "low", "high", "id")


@query("coverage_union", "SELECT l_suppkey AS path, l_linenumber AS line, count(DISTINCT l_orderkey) AS hits FROM lineitem GROUP BY 1, 2")
def coverage_union(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line")).agg(F.count_distinct("l_orderkey").alias("hits"))


@query(
    "as_of_join",
    """
    SELECT e.event_id, p.event_id AS prior_event_id, p.value AS prior_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts
    """,
)
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    out = intervals.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", "ts", ["event_id", "value"])
    return out.select("event_id", "prior_event_id", "prior_value")


@query("bundle_entries", "SELECT o_orderkey, i - 1 AS pos, p[i] AS part FROM (SELECT l_orderkey AS o_orderkey, list_sort(list(l_partkey)) AS p, unnest(range(1, count(*) + 1)) AS i FROM lineitem GROUP BY 1)")
def bundle_entries(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part")))).alias("entries"))
    return lake.flatten_entries(b)
