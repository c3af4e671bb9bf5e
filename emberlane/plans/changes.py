"""Queries over two snapshots of documents, payloads and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.functions.identity import content_hash
from emberlane.operators import incremental, payloads
from emberlane.plans.registry import query
from emberlane.plans.ranking import SCORE_SQL, features_of
from emberlane.sources.tables import table
from emberlane.streaming import event_streams as streams


def snapshots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    old = d.where("doc_id % 7 <> 0").withColumn("digest", content_hash("text"))
    new = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("digest", content_hash("text"))
    return old, new


SNAP = """
WITH old AS (SELECT doc_id, source, text, substr(sha256(text), 1, 16) AS digest FROM documents WHERE doc_id % 7 <> 0),
new AS (SELECT doc_id, source, t AS text, substr(sha256(t), 1, 16) AS digest FROM (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS t FROM documents WHERE doc_id % 11 <> 0))
"""


@query("snapshot_diff", SNAP + "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old o FULL JOIN new n USING (doc_id) WHERE o.digest IS DISTINCT FROM n.digest")
def snapshot_diff(spark, sf_dir):
    return incremental.diff(*snapshots(spark, sf_dir), "doc_id", "digest")


@query("incremental_sync", SNAP + "SELECT doc_id, digest FROM new")
def incremental_sync(spark, sf_dir):
    return incremental.sync(*snapshots(spark, sf_dir), "doc_id", "digest").select("doc_id", "digest")


@query("removed_files", SNAP + "SELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def removed_files(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return old.select("doc_id").join(new.select("doc_id"), "doc_id", "left_anti")


@query("region_upsert", SNAP + "SELECT doc_id, digest FROM new UNION ALL SELECT doc_id, digest FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def region_upsert(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return incremental.upsert(old, new.unionAll(new), ["doc_id"]).select("doc_id", "digest")


@query("insert_ignore", SNAP + "SELECT doc_id, digest FROM old UNION ALL SELECT doc_id, digest FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)")
def insert_ignore(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return incremental.insert_ignore(old, new, ["doc_id"]).select("doc_id", "digest")


@query("delete_cascade", "SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT 'events', count(*) FROM events WHERE user_id % 3 <> 0")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey").unionAll(table(spark, sf_dir, "events").where("user_id % 3 = 0").select("user_id")).distinct()
    out = incremental.delete_cascade({"orders": (table(spark, sf_dir, "orders"), "o_custkey"), "events": (table(spark, sf_dir, "events"), "user_id")}, gone, "c_custkey")
    parts = [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("t"), "n") for k, v in out.items()]
    return parts[0].unionByName(parts[1])


@query(
    "stale_detection",
    """
    WITH r AS (SELECT doc_id, 1 AS s, least(2, len(string_split(text, chr(10)))) AS e, substr(sha256(array_to_string(string_split(text, chr(10))[1:2], chr(10))), 1, 16) AS h FROM documents),
    f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '#' || text ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)
    SELECT r.doc_id, coalesce(substr(sha256(array_to_string(string_split(f.text, chr(10))[s:e], chr(10))), 1, 16) = h, false) AS fresh FROM r LEFT JOIN f USING (doc_id)
    """,
)
def stale_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    lines = F.split("text", "\n")
    regions = d.select("path", F.lit(1).alias("start_line"), F.least(F.lit(2), F.size(lines)).alias("end_line"), content_hash(F.array_join(F.slice(lines, 1, 2), "\n")).alias("content_hash"))
    i = F.col("path").cast("long")
    files = d.where(i % 11 != 0).withColumn("text", F.when(i % 5 == 0, F.concat(F.lit("#"), "text")).otherwise(F.col("text")))
    return incremental.stale_regions(regions, files).select(F.col("path").cast("long").alias("doc_id"), "fresh")


@query(
    "successor_map",
    "SELECT p_partkey AS old, m AS successor FROM part LEFT JOIN (SELECT p_brand, p_size, min(p_partkey) AS m FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2) USING (p_brand, p_size) WHERE p_partkey % 3 <> 0",
)
def successor_map(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return incremental.successors(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), ["p_brand", "p_size"], "p_partkey").withColumnRenamed("p_partkey", "old")


@query(
    "state_migration",
    SCORE_SQL
    + """, st AS (SELECT session, region, qty / 50 AS execution, disc * 10 AS edit, stale, frequency > 1 AS admitted FROM f),
    mv AS (SELECT DISTINCT region, CASE WHEN region % 20 = 0 THEN region + 1 END AS successor FROM st WHERE region % 10 = 0),
    u AS (SELECT * FROM st WHERE region NOT IN (SELECT region FROM mv) UNION ALL SELECT session, region, execution, edit, true, false FROM st WHERE region IN (SELECT region FROM mv)
      UNION ALL SELECT session, successor, execution * 0.8, greatest(edit, 0.7), false, false FROM st JOIN mv USING (region) WHERE successor IS NOT NULL)
    SELECT session, region, round(max(execution), 6) AS execution, round(max(edit), 6) AS edit, bool_or(stale) AS stale, bool_or(admitted) AS admitted FROM u GROUP BY 1, 2""",
)
def state_migration(spark, sf_dir):
    s = features_of(spark, sf_dir).select("session", "region", "execution", "edit", "stale", (F.col("frequency") > 1).alias("admitted"))
    moves = s.where("region % 10 = 0").select("region").distinct().withColumn("successor", F.when(F.col("region") % 20 == 0, F.col("region") + 1))
    out = incremental.migrate(s, moves)
    return out.select("session", "region", F.round("execution", 6).alias("execution"), F.round("edit", 6).alias("edit"), "stale", "admitted")


@query("session_reattach", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN user_id + 1000 ELSE user_id END AS user_id FROM events")
def session_reattach(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    m = e.where("user_id % 10 = 0").select(F.col("user_id").alias("old"), (F.col("user_id") + 1000).alias("new")).distinct()
    return incremental.remap(e, m, "user_id")


@query(
    "graph_payload",
    """
    WITH e AS (SELECT l_suppkey % 50 AS src, l_partkey % 50 AS dst, 'call' AS kind, 1.0::DOUBLE AS weight FROM lineitem UNION ALL SELECT l_suppkey % 50, l_linenumber, 'co_access', l_quantity FROM lineitem
      UNION ALL SELECT l_partkey % 50, l_linenumber, 'co_access_history', l_quantity * 0.5 FROM lineitem)
    SELECT src, dst, kind, max(weight) AS weight FROM e GROUP BY 1, 2, 3
    """,
)
def graph_payload(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    e = lambda a, b, w: line.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), w.cast("double").alias("weight"))
    s, p, n, q = F.col("l_suppkey") % 50, F.col("l_partkey") % 50, F.col("l_linenumber"), F.col("l_quantity")
    return payloads.graph_payload({"call": (e(s, p, F.lit(1)), 1.0), "co_access": (e(s, n, q), 1.0), "co_access_history": (e(p, n, q), 0.5)})


LEVEL = "CASE WHEN stale THEN CASE WHEN qty > 45 THEN 'L1' WHEN region % 29 = 0 THEN 'L0' ELSE 'L2' END WHEN region % 29 = 0 THEN 'L0' WHEN frequency > 1 OR qty > 45 THEN 'L1' ELSE 'L2' END"


def levelled(spark, sf_dir):
    from emberlane.functions.scoring import memory_level

    w = features_of(spark, sf_dir)
    return w.withColumn("level", memory_level(F.lit(True), "stale", F.col("region") % 29 == 0, F.col("frequency") > 1, F.col("qty") > 45, F.lit(False), F.lit(False)))


@query(
    "file_rollup",
    SCORE_SQL
    + f"SELECT session, sum(tokens)::BIGINT AS tokens, count(*) AS regions, round(sum(qty + 0.15 * frequency), 4) AS heat, sum(stale::INTEGER)::BIGINT AS stale, sum(({LEVEL} = 'L0')::INTEGER)::BIGINT AS l0, sum(({LEVEL} = 'L1')::INTEGER)::BIGINT AS l1, sum(({LEVEL} = 'L2')::INTEGER)::BIGINT AS l2, 0::BIGINT AS backing FROM f GROUP BY 1",
)
def file_rollup(spark, sf_dir):
    w = levelled(spark, sf_dir).withColumn("heat", F.col("qty") + 0.15 * F.col("frequency"))
    return payloads.file_rollup(w, "session", "tokens", "heat", "level", "stale").withColumn("heat", F.round("heat", 4))


@query(
    "hierarchy_payload",
    SCORE_SQL + f"SELECT {LEVEL} AS level, count(*) AS residents, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / CASE {LEVEL} WHEN 'L0' THEN 100000 WHEN 'L1' THEN 5000000 END, 6) AS utilization, greatest(0, CASE {LEVEL} WHEN 'L0' THEN 100000 WHEN 'L1' THEN 5000000 END - sum(tokens))::BIGINT AS free FROM f GROUP BY {LEVEL}",
)
def hierarchy_payload(spark, sf_dir):
    out = payloads.hierarchy(levelled(spark, sf_dir), "level", "tokens", {"L0": 100000, "L1": 5000000})
    return out.withColumn("utilization", F.round("utilization", 6))


def event_stream(spark, sf_dir):
    return streams.read_events(spark, sf_dir)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    s = event_stream(spark, sf_dir).withColumn("id", F.concat_ws(":", "user_id", "event_type"))
    return streams.drain(streams.dedup(s, "id"), name="dedup").select("user_id", "event_type")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = streams.drain(streams.tumbling(event_stream(spark, sf_dir), "1 hour", ["event_type"]), "update", "tumbling")
    return streams.latest(out, ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_session",
    """
    WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT min(ts) AS start, user_id, count(*) AS n FROM y GROUP BY user_id, s
    """,
)
def stream_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query(
    "stream_working_set",
    "SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS region, count(*) AS touches, round((1 - pow(0.92, count(*))) / 0.08, 6) AS frequency, max(event_id) AS last_seq FROM events GROUP BY 1, 2",
)
def stream_working_set(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("region"))
    out = streams.latest(streams.drain(streams.working_set(s), "update", "working-set"), ["user_id", "region"])
    return out.select("user_id", "region", "touches", F.round("frequency", 6).alias("frequency"), "last_seq")
