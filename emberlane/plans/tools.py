"""Queries over commands, tool payloads, reports and whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlane.functions import commands, stems
from emberlane.operators import jobs, lexical, payloads
from emberlane.plans.catalogue import SOURCES
from emberlane.plans.registry import query
from emberlane.session import shared_dir
from emberlane.sources import reports
from emberlane.sources.tables import table


@query(
    "command_args",
    r"""
    WITH c AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'make ' || url WHEN 1 THEN 'cd src && pytest -x ' || url || ' -k a --tb=short && echo pytest' ELSE 'pytest -vv tests/t' || page_id || '.py| tee log' END AS c FROM pages),
    s AS (SELECT page_id, regexp_split_to_array(string_split_regex(substr(c, strpos(c, 'pytest') + 6), '&&|\||;')[1], '\s+') AS a FROM c WHERE contains(c, 'pytest'))
    SELECT page_id, array_to_string(list_concat(['-q'], list_filter(a, lambda x: x NOT IN ('', '-q', '-x', '-s', '-v', '-vv', '--tb=short', '--tb=long', '--tb=no'))), ' ') AS args FROM s
    """,
)
def command_args(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    first = F.concat(F.lit("cd src && pytest -x "), "url", F.lit(" -k a --tb=short && echo pytest"))
    second = F.concat(F.lit("pytest -vv tests/t"), F.col("page_id").cast("string"), F.lit(".py| tee log"))
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("make "), "url")).when(F.col("page_id") % 3 == 1, first).otherwise(second)
    out = p.select("page_id", commands.pytest_arguments(made).alias("args")).where("args IS NOT NULL")
    return out.select("page_id", F.array_join("args", " ").alias("args"))


@query(
    "allowed_args",
    r"""
    WITH a AS (SELECT page_id, list_concat(string_split(regexp_replace(url, '^https?://', ''), '/'), ['-x', '--evil', '../up.py', '/abs.py', 'tests/t' || page_id || '.py::test_a[1]', ' -q ']) AS a FROM pages),
    k AS (SELECT page_id, list_filter(list_transform(a, lambda x: trim(x)), lambda x: x IN ('-q', '-x', '--tb=short', '--tb=line', '--lf', '--ff', '-rA') OR (regexp_matches(x, '^[A-Za-z0-9_./-]+\.py(::[A-Za-z0-9_\[\],.-]+)*$') AND NOT contains(x, '..') AND NOT starts_with(x, '/') AND NOT starts_with(x, '-'))) AS k FROM a)
    SELECT page_id, array_to_string(k, ' ') AS kept FROM k
    """,
)
def allowed_args(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    extra = F.array(*[F.lit(x) for x in ("-x", "--evil", "../up.py", "/abs.py")], F.concat(F.lit("tests/t"), F.col("page_id").cast("string"), F.lit(".py::test_a[1]")), F.lit(" -q "))
    a = F.concat(F.split(F.regexp_replace("url", "^https?://", ""), "/"), extra)
    return p.select("page_id", F.array_join(commands.allowed_arguments(a), " ").alias("kept"))


@query(
    "tool_payloads",
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'execute' ELSE event_type END AS operation,
      coalesce(json_extract_string(props, '$.k'), event_type) AS asked, CASE event_id % 4 WHEN 0 THEN 'out' || event_id || chr(10) || 'err' WHEN 1 THEN 'body' || event_id WHEN 2 THEN 'a' || chr(10) || 'b' || event_id ELSE 'plain' END AS answer FROM events
    """,
)
def tool_payloads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "MultiEdit").when(F.col("event_type") == "purchase", "Bash").otherwise(F.col("event_type"))
    asked = F.to_json(F.struct(F.lit("").alias("pattern"), F.get_json_object("props", "$.k").alias("path")))
    i = F.col("event_id").cast("string")
    answer = (
        F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.concat(F.lit("out"), i).alias("stdout"), F.lit("err").alias("stderr"))))
        .when(F.col("event_id") % 4 == 1, F.to_json(F.struct(F.lit("text").alias("type"), F.struct(F.lit("p").alias("filePath"), F.concat(F.lit("body"), i).alias("content")).alias("file"))))
        .when(F.col("event_id") % 4 == 2, F.to_json(F.struct(F.array(F.to_json(F.struct(F.lit("a").alias("text"))), F.concat(F.lit("b"), i)).alias("content"))))
        .otherwise("plain")
    )
    return e.select("event_id", commands.operation_of(tool).alias("operation"), commands.query_of("event_type", asked).alias("asked"), commands.response_text(answer).alias("answer"))


@query("number_texts", "SELECT c_custkey, CASE WHEN round(c_acctbal, 2) = floor(round(c_acctbal, 2)) THEN floor(round(c_acctbal, 2))::BIGINT::VARCHAR ELSE round(c_acctbal, 2)::VARCHAR END AS shown FROM customer")
def number_texts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", commands.number_text("c_acctbal").alias("shown"))


@query("skipped_paths", "SELECT page_id, url, starts_with(url, 'https://a') OR starts_with(url, 'https://site1') OR starts_with(url, 'http://') AS skipped FROM pages")
def skipped_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", commands.skipped_path("url", ["https://a", "https://site1", "http://"]).alias("skipped"))


@query("redacted_values", "SELECT event_id, cardinality(m) AS n, '[redacted]' AS shown FROM (SELECT event_id, map([event_type], ['x']) AS m FROM events)")
def redacted_values(spark, sf_dir):
    m = commands.redact_values(F.create_map("event_type", F.get_json_object("props", "$.k")))
    return table(spark, sf_dir, "events").select("event_id", F.size(m).cast("long").alias("n"), F.element_at(m, F.col("event_type")).alias("shown"))


@query("coverage_report", "SELECT DISTINCT l_partkey::VARCHAR AS path, l_linenumber::INTEGER AS line FROM lineitem")
def coverage_report(spark, sf_dir):
    """Executed lines from JSON reports, one report for each supplier."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_partkey").cast("string").alias("path")).agg(F.collect_set("l_linenumber").alias("executed_lines"))
    whole = one.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("executed_lines").alias("file")))).alias("files"))
    return reports.coverage_lines(whole.select(F.to_json(F.struct("files")).alias("value")))


@query(
    "lake_build",
    """
    SELECT 'bronze' AS layer, 'events' AS name, count(DISTINCT event_id) AS rows FROM events UNION ALL SELECT 'silver', 'observations', count(*) FROM events WHERE event_type <> 'error'
    UNION ALL SELECT 'gold', 'sessions', count(DISTINCT user_id) FROM events
    """,
)
def lake_build(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    layers = {
        "bronze": {"events": e.dropDuplicates(["event_id"])},
        "silver": {"observations": e.where("event_type <> 'error'").select("event_id", "user_id", "event_type")},
        "gold": {"sessions": e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))},
    }
    root = f"{shared_dir(spark)}/emberlane/lake-{uuid.uuid4().hex}"
    return jobs.build_lake(spark, root, layers, 0).select("layer", "name", "rows")


@query("bm25_stemmed")
def bm25_stemmed(spark, sf_dir):
    """BM25 over Porter stems; all benchmark items against all documents."""
    d = table(spark, sf_dir, "documents")
    q = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "query")
    out = lexical.bm25(d, q, "doc_id", "item_id", "query", {"text": 1.0, "source": 2.0}, 5, stem=stems.stem_words)
    return out.select("item_id", "doc_id", F.round("score", 5).alias("score"))


@query("reindex")
def reindex(spark, sf_dir):
    """Rows of each table of a full reindex of the demo sources."""
    root = f"{shared_dir(spark)}/emberlane/index-{uuid.uuid4().hex}"
    return jobs.reindex(spark, root, spark.createDataFrame(SOURCES, "path string, text string"), 0).select("layer", "name", "rows")


@query(
    "execution_path",
    """
    WITH w AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS region, max(value) FILTER (event_type = 'error') / 500 AS execution,
      count(*) FILTER (event_type = 'view') / 4 AS access FROM events GROUP BY 1, 2)
    SELECT user_id, region, execution, access > 0.2 AS joined FROM w WHERE execution > 0.2
    """,
)
def execution_path(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("region", F.get_json_object("props", "$.k").cast("int"))
    of = lambda kind, x: F.when(F.col("event_type") == kind, x)
    w = e.groupBy("user_id", "region").agg((F.max(of("error", F.col("value"))) / 500).alias("execution"), (F.count(of("view", F.lit(1))) / 4).alias("access"))
    return payloads.execution_path(w, "execution", "access").select("user_id", "region", "execution", "joined")
