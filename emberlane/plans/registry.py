"""All registered queries of the core library with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query(
    "silver_dual_trace",
    """
    WITH e AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS region FROM events)
    SELECT event_id, user_id, event_type, region FROM e
    WHERE event_type <> 'error' AND region IN (SELECT region FROM e WHERE event_type = 'error' AND value > 200)
    """,
)
def silver_dual_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent-trace rows whose region the program trace also reached."""
    from pyspark.sql import functions as F

    from emberlane.sources.tables import table

    e = table(spark, sf_dir, "events").withColumn("region", F.get_json_object("props", "$.k").cast("int"))
    traced = e.where((F.col("event_type") == "error") & (F.col("value") > 200)).select("region")
    return e.where(F.col("event_type") != "error").join(traced, "region", "left_semi").select("event_id", "user_id", "event_type", "region")


def load() -> None:
    """Import every module of queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"emberlane.plans.{name}")


MODULES = ("logs", "working_sets", "search", "ranking", "graphs", "changes", "catalogue", "tools")
