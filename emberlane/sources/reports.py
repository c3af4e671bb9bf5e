"""Reports of test runs: coverage by file and line, outcomes by test."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.sources.files import read_jsonl


def coverage_lines(reports: DataFrame, text: str = "value") -> DataFrame:
    """(path, line) of executed lines in whole JSON coverage reports, one report a row; broken reports give nothing."""
    kind = "struct<files:map<string,struct<executed_lines:array<int>>>>"
    each = reports.select(F.explode(F.from_json(text, kind)["files"]).alias("path", "file"))
    return each.select("path", F.explode("file.executed_lines").alias("line")).distinct()


def load_coverage(spark: SparkSession, path: str) -> DataFrame:
    """coverage_lines of a JSON file or a folder of them."""
    return coverage_lines(spark.read.text(path, wholetext=True))


def load_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(nodeid, outcome) of a report with one JSON object a line; blank and broken lines give nothing."""
    return read_jsonl(spark, path, "nodeid string, outcome string").where("nodeid IS NOT NULL")


def failing_tests(outcomes: DataFrame) -> DataFrame:
    """(nodeid) of tests with a failed outcome."""
    return outcomes.where("outcome = 'failed'").select("nodeid").distinct()
