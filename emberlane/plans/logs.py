"""Queries over the event log: lake tables, metrics, order-aware windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.identity import pct_change, token_estimate
from emberlane.operators import lake, metrics, windows
from emberlane.plans.registry import query
from emberlane.sources.tables import table


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a trace: users are sessions, k is the region, ids are the log order."""
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        F.when(t == "view", "agent_tool").when((t == "error") & (F.col("value") > 200), "program_trace").otherwise("controller").alias("source"),
        F.when((t == "view") & (k % 5 == 0), "grep")
        .when(t == "view", "read")
        .when(t == "click", "admit")
        .when(t == "signup", "prefetch")
        .when(t == "purchase", F.when(k % 4 == 0, "miss").otherwise("hit"))
        .when(F.col("value") > 200, "test")
        .otherwise("bundle_served")
        .alias("operation"),
        F.floor("value").cast("long").alias("tokens"),
        F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(k.cast("string"))).alias("regions"),
        k.alias("region"),
    )


LOG_SQL = """
WITH e AS (SELECT user_id AS session, event_id AS seq, event_type AS t, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (SELECT session, seq,
  CASE WHEN t = 'view' THEN 'agent_tool' WHEN t = 'error' AND value > 200 THEN 'program_trace' ELSE 'controller' END AS source,
  CASE WHEN t = 'view' AND k % 5 = 0 THEN 'grep' WHEN t = 'view' THEN 'read' WHEN t = 'click' THEN 'admit' WHEN t = 'signup' THEN 'prefetch'
    WHEN t = 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'miss' ELSE 'hit' END WHEN value > 200 THEN 'test' ELSE 'bundle_served' END AS operation,
  CAST(floor(value) AS BIGINT) AS tokens, k AS region, k % 7 = 0 AS none FROM e)
"""


@query(
    "bronze_dedup_append",
    """
    WITH incoming AS (SELECT * FROM events WHERE event_id % 3 <> 1 UNION ALL SELECT * FROM events WHERE event_id % 5 = 0)
    SELECT DISTINCT event_id, user_id, event_type FROM incoming WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 4 = 0)
    """,
)
def bronze_dedup_append(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    incoming = e.where("event_id % 3 <> 1").unionAll(e.where("event_id % 5 = 0"))
    return lake.append_bronze(e.where("event_id % 4 = 0"), incoming).select("event_id", "user_id", "event_type")


@query(
    "lake_counts",
    "SELECT 'bronze' AS name, count(*) AS n FROM events UNION ALL SELECT 'regions', count(*) FROM documents UNION ALL SELECT 'turns', count(*) FROM conversations",
)
def lake_counts(spark, sf_dir):
    return lake.counts({"bronze": table(spark, sf_dir, "events"), "regions": table(spark, sf_dir, "documents"), "turns": table(spark, sf_dir, "conversations")})


@query(
    "silver_redacted",
    r"""
    WITH r AS (SELECT doc_id AS region, source || '/' || CASE WHEN doc_id % 11 = 0 THEN 'secrets.yaml' ELSE 'page' || doc_id || '.txt' END AS path, text FROM documents),
    a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS region FROM events WHERE event_type <> 'error'),
    t AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS region FROM events WHERE event_type = 'error' AND value > 100)
    SELECT event_id, region, path, sha256(array_to_string(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)),
      lambda x: CASE WHEN regexp_matches(lower(x), 'token\s*=|api_key|password') THEN '[redacted]' ELSE x END), chr(10))) AS digest
    FROM a JOIN r USING (region) WHERE region IN (SELECT region FROM t) AND NOT contains(path, 'secret')
    """,
)
def silver_redacted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 11 == 0, "secrets.yaml").otherwise(F.concat(F.lit("page"), F.col("doc_id"), F.lit(".txt")))
    regions = d.select(F.col("doc_id").alias("region"), F.concat_ws("/", "source", name).alias("path"), "text")
    e = table(spark, sf_dir, "events").withColumn("region", F.get_json_object("props", "$.k").cast("long"))
    traced = e.where("event_type = 'error' AND value > 100")
    out = lake.silver(e.where("event_type <> 'error'").select("event_id", "region"), traced, regions, text="text", pattern=r"token\s*=|api_key|password")
    return out.select("event_id", F.col("region").cast("int").alias("region"), "path", F.sha2("text", 256).alias("digest"))


@query(
    "gold_working_set",
    """
    SELECT c.user_id, c.region, c.touches, p_name, coalesce(p_partkey IS NULL, true) AS stale
    FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) * 37 AS region, count(*) AS touches FROM events GROUP BY 1, 2) c
    LEFT JOIN part ON p_partkey = c.region
    """,
)
def gold_working_set(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.get_json_object("props", "$.k").cast("int") * 37).alias("region")).agg(F.count(F.lit(1)).alias("touches"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region"), "p_name", F.lit(False).alias("gone"))
    out = lake.gold_working_set(e, parts, "region", "p_name")
    return out.select("user_id", "region", "touches", "p_name", F.coalesce("gone", F.lit(True)).alias("stale"))


@query(
    "gold_metrics_union",
    """
    WITH r AS (SELECT l_suppkey AS s, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS b, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS a FROM lineitem GROUP BY 1)
    SELECT 'ab' AS metric, b AS before, a AS after, CASE WHEN b IS NULL OR b = 0 THEN NULL ELSE (a - b) / b * 100 END AS change, NULL::BIGINT AS scc FROM r WHERE s % 3 <> 0
    UNION ALL SELECT 'audit', NULL, NULL, NULL, count(DISTINCT s) FROM r
    """,
)
def gold_metrics_union(spark, sf_dir):
    q = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    r = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(q("F").alias("b"), q("O").alias("a")).withColumn("fixture", F.col("l_suppkey") % 3 == 0)
    audit = r.agg(F.count_distinct("l_suppkey").alias("scc")).withColumn("metric", F.lit("audit"))
    return lake.union_metrics(lake.gold_metric(r, "b", "a", "ab"), audit)


@query(
    "session_metrics",
    LOG_SQL
    + """
    , b AS (SELECT *, min(CASE WHEN source = 'controller' AND operation = 'bundle_served' THEN seq END) OVER (PARTITION BY session) AS fb FROM log),
    base AS (SELECT session,
      count_if(source = 'agent_tool' AND operation IN ('read', 'grep', 'glob'))::BIGINT AS repo_tool_calls,
      sum(CASE WHEN source = 'agent_tool' THEN tokens ELSE 0 END)::BIGINT AS agent_tokens,
      sum(CASE WHEN source = 'program_trace' THEN tokens ELSE 0 END)::BIGINT AS test_tokens,
      count_if(operation = 'hit')::BIGINT AS hits, count_if(operation = 'miss')::BIGINT AS misses,
      count_if(operation = 'bundle_served')::BIGINT AS bundles,
      count_if(source = 'agent_tool' AND operation = 'grep' AND seq > fb)::BIGINT AS fallbacks FROM b GROUP BY session),
    x AS (SELECT * FROM log WHERE NOT none),
    life AS (SELECT session, region, min(CASE WHEN operation IN ('prefetch', 'admit') THEN seq END) AS o,
      max(CASE WHEN operation IN ('read', 'grep', 'hit') THEN seq END) AS u,
      max(CASE WHEN operation = 'prefetch' THEN 1 ELSE 0 END) AS pre, max(CASE WHEN operation = 'admit' THEN 1 ELSE 0 END) AS adm FROM x GROUP BY 1, 2),
    l2 AS (SELECT session, sum(pre)::BIGINT AS prefetches, sum(CASE WHEN coalesce(u > o, false) THEN pre ELSE 0 END)::BIGINT AS prefetch_used,
      sum(adm)::BIGINT AS admitted, sum(CASE WHEN NOT coalesce(u > o, false) THEN adm ELSE 0 END)::BIGINT AS pollution FROM life GROUP BY 1)
    SELECT session, repo_tool_calls, agent_tokens, test_tokens, hits, misses, bundles, fallbacks, coalesce(prefetches, 0) AS prefetches,
      coalesce(prefetch_used, 0) AS prefetch_used, coalesce(admitted, 0) AS admitted, coalesce(pollution, 0) AS pollution,
      coalesce(round(CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 0 END, 6), 0) AS hit_rate
    FROM base LEFT JOIN l2 USING (session)
    """,
)
def session_metrics(spark, sf_dir):
    out = metrics.session_metrics(log_of(spark, sf_dir))
    return out.select(
        "session", "repo_tool_calls", "agent_tokens", "test_tokens", "hits", "misses", "bundles", "fallbacks", "prefetches", "prefetch_used", "admitted", "pollution", F.round("hit_rate", 6).alias("hit_rate")
    )


@query("operation_counts", LOG_SQL + "SELECT session, operation, count(*) AS n FROM log GROUP BY 1, 2")
def operation_counts(spark, sf_dir):
    return metrics.operation_counts(log_of(spark, sf_dir), "session", "operation")


@query(
    "suite_aggregate",
    "SELECT l_linestatus AS condition, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, count(*) AS n FROM lineitem GROUP BY 1",
)
def suite_aggregate(spark, sf_dir):
    out = metrics.suite_aggregate(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_quantity")
    return out.select(F.col("l_linestatus").alias("condition"), "total", F.round("mean", 6).alias("mean"), "median", "n")


@query(
    "pct_change",
    """
    WITH r AS (SELECT l_partkey AS task, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS before, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS after FROM lineitem GROUP BY 1)
    SELECT task, before, after, round(CASE WHEN before IS NULL OR before = 0 THEN NULL ELSE (after - before) / before * 100 END, 6) AS change FROM r
    """,
)
def pct_change_query(spark, sf_dir):
    out = metrics.paired_change(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linestatus", "l_quantity", "F", "O")
    return out.select(F.col("l_partkey").alias("task"), "before", "after", F.round("change", 6).alias("change"))


@query(
    "baseline_vs_treated",
    """
    WITH s AS (SELECT quality, toxic, sum(n_chars)::BIGINT AS chars, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
    SELECT a.quality, a.chars AS baseline, b.chars AS treated, round((b.chars - a.chars) / a.chars * 100, 6) AS change FROM s a JOIN s b USING (quality) WHERE a.toxic = 0 AND b.toxic = 1
    """,
)
def baseline_vs_treated(spark, sf_dir):
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("quality", "toxic").agg(F.sum("n_chars").alias("chars"))
    a, b = s.where("toxic = 0").select("quality", F.col("chars").alias("baseline")), s.where("toxic = 1").select("quality", F.col("chars").alias("treated"))
    return a.join(b, "quality").withColumn("change", F.round(pct_change("baseline", "treated"), 6))


@query(
    "kind_counts",
    "SELECT lang AS kind, count(*) AS n, count(DISTINCT source) AS paths, coalesce(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END), 0)::BIGINT AS tokens FROM documents GROUP BY 1",
)
def kind_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("lang").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("paths"), F.coalesce(F.sum(token_estimate("text")), F.lit(0)).cast("long").alias("tokens"))


@query(
    "cross_session_rollup",
    LOG_SQL + "SELECT region, count(*) AS n, count(DISTINCT session) AS sessions, max(tokens) AS most, sum(tokens)::BIGINT AS total, max(seq) AS last_seq FROM log GROUP BY 1",
)
def cross_session_rollup(spark, sf_dir):
    return log_of(spark, sf_dir).groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("sessions"), F.max("tokens").alias("most"), F.sum("tokens").alias("total"), F.max("seq").alias("last_seq")
    )


@query(
    "first_use_after_admit",
    LOG_SQL
    + """, o AS (SELECT session, region, min(seq) AS opened_at FROM log WHERE operation = 'admit' GROUP BY 1, 2),
    u AS (SELECT session, region, max(seq) AS m FROM log WHERE operation IN ('read', 'grep') GROUP BY 1, 2)
    SELECT session, region, opened_at, coalesce(m > opened_at, false) AS used FROM o LEFT JOIN u USING (session, region)""",
)
def first_use_after_admit(spark, sf_dir):
    return metrics.used_after(log_of(spark, sf_dir), "session", "region", "seq", F.col("operation") == "admit", F.col("operation").isin("read", "grep"))


@query(
    "fallback_after_first",
    LOG_SQL
    + """, b AS (SELECT *, min(CASE WHEN operation = 'bundle_served' THEN seq END) OVER (PARTITION BY session) AS fb FROM log)
    SELECT session, seq, region FROM b WHERE operation = 'grep' AND seq > fb""",
)
def fallback_after_first(spark, sf_dir):
    return windows.first_after(log_of(spark, sf_dir), "session", "seq", F.col("operation") == "bundle_served").where("operation = 'grep'").select("session", "seq", "region")


@query(
    "turn_counter",
    "SELECT conv_id, turn AS row_turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM conversations",
)
def turn_counter(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "row_turn")
    return windows.turn_counter(c, "conv_id", ["row_turn", "role", "text"], F.col("role") == "user").select("conv_id", "row_turn", "turn")


@query(
    "broad_search_ordinal",
    LOG_SQL
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS ordinal FROM log WHERE operation = 'grep')
    SELECT session, seq, ordinal, ordinal >= 2 AS advise FROM o""",
)
def broad_search_ordinal(spark, sf_dir):
    return windows.broad_search_ordinal(log_of(spark, sf_dir), "session", ["seq"], F.col("operation") == "grep").select("session", "seq", "ordinal", "advise")


@query(
    "exec_path_edges",
    """
    WITH l AS (SELECT l_orderkey, l_partkey AS src, lead(l_partkey) OVER w AS dst, row_number() OVER w AS hop FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
    SELECT l_orderkey, src, dst, hop FROM l WHERE dst IS NOT NULL
    """,
)
def exec_path_edges(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return windows.consecutive_edges(table(spark, sf_dir, "lineitem"), "l_orderkey", order, "l_partkey")


@query(
    "rank_weight",
    "SELECT doc_id, round(greatest(0.4, 1 - 0.04 * (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1)), 6) AS weight FROM documents",
)
def rank_weight(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("o", F.struct((-F.col("n_chars")).alias("n"), "doc_id"))
    return d.select("doc_id", F.round(windows.rank_weight(F.col("o"), "source"), 6).alias("weight"))


@query(
    "first_target_in_trajectory",
    "SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS first_target, arg_min(value, event_id) FILTER (event_type = 'purchase') AS value_there FROM events GROUP BY 1",
)
def first_target_in_trajectory(spark, sf_dir):
    hit = F.col("event_type") == "purchase"
    at = F.when(hit, F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(at).alias("first_target"), F.min_by("value", at).alias("value_there"))


@query(
    "latest_row",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
)
def latest_row(spark, sf_dir):
    return lake.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["ts", "event_id"], ["user_id"]).select("user_id", "event_id", "event_type")


@query("event_list", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 50")
def event_list(spark, sf_dir):
    """The first 50 events of every session, oldest first."""
    from emberlane.operators.windows import top_per_key

    return top_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 50).select("event_id", "user_id")


@query("tail_reversed", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1500)")
def tail_reversed(spark, sf_dir):
    from pyspark.sql import Window

    tail = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1500)
    return tail.select("event_id", F.row_number().over(Window.orderBy("ts", "event_id")).alias("n"))


@query(
    "json_decode",
    "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50, FALSE) AS high FROM events",
)
def json_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = lake.json_field("props", "$.k", "int", -1)
    return e.select("event_id", k.alias("k"), lake.json_field("props", "$.missing", "string", "none").alias("other"), (k >= 50).alias("high"))


@query(
    "heat_by_path",
    "SELECT event_type AS path, round(sum(value + 0.15 * CAST(json_extract_string(props, '$.k') AS INTEGER)), 4) AS heat, count(*) AS regions FROM events GROUP BY 1",
)
def heat_by_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("path")).agg(F.round(F.sum(F.col("value") + 0.15 * k), 4).alias("heat"), F.count(F.lit(1)).alias("regions"))


@query(
    "latest_sessions_semi",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 12) AND user_id <> 3",
)
def latest_sessions_semi(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("m")).orderBy(F.desc("m"), "user_id").limit(12)
    return e.where("user_id <> 3").join(last, "user_id", "left_semi").select("event_id", "user_id")


@query(
    "session_events_left",
    "SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1",
)
def session_events_left(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
