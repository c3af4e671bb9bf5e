"""Source trees, JSON lines, exports and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold no sources.
EXCLUDED = (".git", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", "dist", "build", ".mypy_cache", ".ruff_cache", "htmlcov")


def source_tree(spark: SparkSession, root: str, glob: str = "*.py", excluded=EXCLUDED) -> DataFrame:
    """(path, text) of all files under root that match the glob, without excluded folders; bytes that are no UTF-8 are
    replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    path = F.regexp_replace(F.substring("path", len(base.rstrip("/")) + 2, 1 << 20), "^/+", "")
    parts = F.split(path, "/")
    ok = ~F.exists(parts, lambda p: p.isin(list(excluded)))
    return files.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).where(ok)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; broken lines give nulls."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def count_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(n): lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").agg(F.count(F.lit(1)).alias("n"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Overwrite with one object a row, keys in order of name."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)


def report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports that are whole and no fixtures; a missing file gives none."""
    try:
        rows = read_jsonl(spark, path, schema + ", fixture boolean")
        rows.schema
        return rows.where(~F.coalesce("fixture", F.lit(False)))
    except Exception as e:  # only a missing path is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + ", fixture boolean")


def export_session(session: DataFrame, bundles: DataFrame, working_set: DataFrame, events: DataFrame) -> DataFrame:
    """One JSON object a line: the session, its bundles, its working set, then its events in order."""
    part = lambda df, kind, rank: df.select(F.lit(rank).alias("rank"), F.to_json(F.struct(F.lit(kind).alias("_kind"), F.struct(*df.columns).alias("row"))).alias("value"))
    head = part(session, "_session", 0).unionByName(part(bundles, "_bundle", 1)).unionByName(part(working_set, "_working_set", 2)).withColumn("seq", F.lit(0).cast("long"))
    tail = part(events, "event", 3).withColumn("seq", F.get_json_object("value", "$.row.seq").cast("long"))
    return head.unionByName(tail)


def replay(exported: DataFrame, session: str, start_ms: int, speed: float = 1.0, max_gap_ms: int | None = None) -> DataFrame:
    """Events of an export under a new session: new ids, times shifted to start_ms and sped up, gaps bounded, marked as
    replayed."""
    from pyspark.sql import Window

    e = exported.where("rank = 3").select("seq", F.get_json_object("value", "$.row.ts_ms").cast("long").alias("ts"), F.get_json_object("value", "$.row").alias("row"))
    w = Window.partitionBy(F.lit(session)).orderBy("seq")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w)) / speed, F.lit(0.0))
    gap = F.least(gap, F.lit(float(max_gap_ms))) if max_gap_ms is not None else gap
    e = e.withColumn("gap", gap)
    at = (F.lit(start_ms) + F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    return e.select(F.lit(session).alias("session"), F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", F.lit(session), "seq"), 256), 1, 12)).alias("event_id"), "seq", at.alias("ts_ms"), "row", F.lit(True).alias("replay"))
