"""Queries over source text, exports and replays, hook payloads and traces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlane.operators import debt
from emberlane.plans.registry import query
from emberlane.session import shared_dir
from emberlane.sources import files, parser
from emberlane.sources.tables import table

#: A small tree: two modules with a cycle, a class with a typed attribute, clones, and one file that does not parse.
SOURCES = (
    ("shop/cart.py", "from shop.tax import rate\n\n\nclass Cart:\n    def __init__(self, store: Store):\n        self.store = store\n\n    def total(self):\n        return self.subtotal() * rate(self)\n\n    def subtotal(self):\n        return self.store.load(self)\n"),
    ("shop/tax.py", '"""Rates."""\n\n\ndef rate(cart):\n    """Rate of a cart."""\n    if cart:\n        return lookup(cart)\n    return 0\n\n\ndef lookup(cart):\n    return rate(None) or len(cart)\n'),
    ("shop/store.py", "class Store:\n    @staticmethod\n    def load(key):\n        return Cart(key).total()\n"),
    ("shop/broken.py", "def nope(:\n"),
    ("shop/a.py", "def alpha(x):\n    y = x + 1\n    z = y * 2\n    return z\n"),
    ("shop/b.py", "def beta(p):\n    q = p + 1\n    r = q * 2\n    return r\n"),
)


def parsed(spark):
    return parser.parse_files(spark.createDataFrame(SOURCES, "path string, text string"))


@query("parse_sources")
def parse_sources(spark, sf_dir):
    return parser.part(parsed(spark), "regions").select("path", "symbol", "kind", "start_line", "end_line", "token_count", "signature")


@query("resolve_calls")
def resolve_calls(spark, sf_dir):
    p = parsed(spark)
    r = parser.part(p, "regions")
    out = parser.resolve(r, parser.part(p, "calls"), parser.part(p, "imports"), parser.part(p, "attrs"))
    a, b = r.select(F.col("region_id").alias("caller_id"), F.col("symbol").alias("caller")), r.select(F.col("region_id").alias("callee_id"), F.col("symbol").alias("callee"))
    return out.join(a, "caller_id").join(b, "callee_id", "left").select("caller", "callee_name", "callee")


@query("function_clones")
def function_clones(spark, sf_dir):
    rows = spark.createDataFrame(SOURCES, "path string, text string").withColumn("id", F.col("path"))
    prints = parser.fingerprints(rows, "id", "text")
    near = debt.near_pairs(prints, "id", "grams")
    exact = prints.join(rows.select("id", F.floor(F.length("text") / 4).alias("tokens")), "id").select("id", "digest", "tokens")
    return debt.clone_clusters(exact, near, "id", "digest", "tokens")


@query("jsonl_roundtrip", "SELECT event_id, event_type, user_id FROM events")
def jsonl_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/emberlane/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, user_id long")


@query("jsonl_count", "SELECT count(*) AS n FROM documents")
def jsonl_count(spark, sf_dir):
    path = f"{shared_dir(spark)}/emberlane/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang"), path)
    return files.count_jsonl(spark, path)


def exported(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id = 7").select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_type", "props")
    session = spark.range(1).select(F.lit("s7").alias("session_id"), F.lit("baseline").alias("condition"))
    w = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("touches"))
    return files.export_session(session, spark.range(0).select("id"), w, e)


@query("session_export", "SELECT 'event' AS kind, count(*) AS n FROM events WHERE user_id = 7 UNION ALL SELECT '_session', 1 UNION ALL SELECT '_working_set', count(DISTINCT event_type) FROM events WHERE user_id = 7")
def session_export(spark, sf_dir):
    return exported(spark, sf_dir).groupBy(F.get_json_object("value", "$._kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_replay",
    """
    WITH e AS (SELECT event_id AS seq, epoch_ms(ts) AS t FROM events WHERE user_id = 7), g AS (SELECT seq, least(coalesce((t - lag(t) OVER (ORDER BY seq)) / 2.0, 0), 60000) AS gap FROM e)
    SELECT seq, floor(1000 + sum(gap) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS ts_ms, 'evt_' || substr(sha256('again|' || seq), 1, 12) AS event_id FROM g
    """,
)
def session_replay(spark, sf_dir):
    return files.replay(exported(spark, sf_dir), "again", 1000, 2.0, 60000).select("seq", "ts_ms", "event_id")


@query(
    "hook_fields",
    "SELECT event_id, coalesce(json_extract_string(props, '$.pattern'), json_extract_string(props, '$.k')) AS query_key, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'grep' ELSE lower(event_type) END AS operation FROM events",
)
def hook_fields(spark, sf_dir):
    op = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "grep").otherwise(F.lower("event_type"))
    key = F.coalesce(F.get_json_object("props", "$.pattern"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", key.alias("query_key"), op.alias("operation"))


@query("trace_frames", "SELECT doc_id, 2 AS frames, lang || '/m.py' AS path, doc_id::INTEGER AS line, source AS message FROM documents")
def trace_frames(spark, sf_dir):
    from emberlane.functions import commands

    i = F.col("doc_id").cast("string")
    log = F.concat(F.lit("Traceback\n"), "lang", F.lit("/m.py:"), i, F.lit(": "), "source", F.lit("\n  other.py:1\nx.py:y\nlast.py:7\n"))
    f = table(spark, sf_dir, "documents").select("doc_id", commands.frames(log).alias("f"))
    return f.select("doc_id", F.size("f").alias("frames"), F.col("f")[0]["path"].alias("path"), F.col("f")[0]["line"].alias("line"), F.col("f")[0]["message"].alias("message"))


@query(
    "test_args_whitelist",
    "SELECT page_id, len(list_filter(string_split(url, '/'), lambda x: regexp_matches(x, '^[A-Za-z0-9_.-]+$') AND NOT starts_with(x, '-')))::INTEGER AS allowed FROM pages",
)
def test_args_whitelist(spark, sf_dir):
    ok = F.filter(F.split("url", "/"), lambda x: x.rlike("^[A-Za-z0-9_.-]+$") & ~x.startswith("-"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(ok).alias("allowed"))
