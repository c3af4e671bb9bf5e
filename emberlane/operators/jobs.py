"""Whole jobs over the operators: the lake with its manifest, and a full reindex."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.session import materialize, release
from emberlane.sources import parser


def build_lake(spark: SparkSession, root: str, layers: dict[str, dict[str, DataFrame]], built_ms: int) -> DataFrame:
    """Write every table of every layer as root/layer/name, then root/manifest with one row a table, which is returned:
    (layer, name, path, rows, built_ms). A table is replaced whole; the manifest comes last, so a job that dies leaves the
    old one. Rows are counted from what was written."""
    done = []
    for layer, tables in layers.items():
        for name, rows in tables.items():
            path = f"{root}/{layer}/{name}"
            rows.write.mode("overwrite").parquet(path)
            done.append((layer, name, path))
    counts = None
    for layer, name, path in done:
        one = spark.read.parquet(path).agg(F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.lit(path).alias("path"), F.count(F.lit(1)).alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    counts.withColumn("built_ms", F.lit(built_ms).cast("long")).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.schema("layer string, name string, path string, rows long, built_ms long").json(f"{root}/manifest")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a lake, empty where none was built."""
    schema = "layer string, name string, path string, rows long, built_ms long"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).json(f"{root}/manifest") if there else spark.createDataFrame([], schema)


def reindex(spark: SparkSession, root: str, files: DataFrame, indexed_ms: int) -> DataFrame:
    """Full reindex of (path, text) files: every table under root/index is replaced whole by what the files hold now, the
    calls bound anew. Files are parsed once. Returns the manifest rows; each file has one region of kind module, so a
    file that does not parse counts too, and no files give empty tables."""
    parsed = materialize(parser.parse_files(files), "parsed")
    regions, calls, imports, attrs = (parser.part(parsed, name) for name in ("regions", "calls", "imports", "attrs"))
    tables = {"regions": regions, "calls": parser.resolve(regions, calls, imports, attrs), "imports": imports}
    done = build_lake(spark, root, {"index": tables}, indexed_ms)
    release(parsed)
    return done
