"""Bronze, silver and gold tables from an event log and a region catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions.identity import pct_change
from emberlane.functions.text import is_secret_path, redact_lines


def append_bronze(existing: DataFrame, new: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rows to append: those of new whose key is not there yet, the first of equal keys. Existing rows never change."""
    w = Window.partitionBy(key).orderBy(*order)
    return new.join(existing.select(key), key, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dual_trace(agent: DataFrame, traced: DataFrame, region: str = "region") -> DataFrame:
    """Agent rows (one a listed region) whose region the program trace reached too; duplicates in a list stay."""
    return agent.join(traced.select(region).distinct(), region, "left_semi")


def silver(agent: DataFrame, traced: DataFrame, regions: DataFrame, region: str = "region", path: str = "path", text: str | None = None, pattern: str | None = None) -> DataFrame:
    """Dual-trace rows with their region's columns; secret paths are dropped, text is redacted."""
    out = dual_trace(agent, traced, region).join(regions, region).where(~is_secret_path(path))
    return out.withColumn(text, redact_lines(text, pattern=pattern)) if text else out


def gold_working_set(working_set: DataFrame, regions: DataFrame, key: str = "region_id", path: str = "path") -> DataFrame:
    """Working set with what is known of its regions; a region that is gone is stale. Secret paths are dropped."""
    out = working_set.join(regions, key, "left")
    return out.where(F.col(path).isNull() | ~is_secret_path(path))


def gold_metric(reports: DataFrame, before: str, after: str, name: str) -> DataFrame:
    """One row a report with its change in percent; fixtures and broken reports carry no row."""
    return reports.where(~F.coalesce(F.col("fixture"), F.lit(False))).select(
        F.lit(name).alias("metric"), F.col(before).alias("before"), F.col(after).alias("after"), pct_change(before, after).alias("change")
    )


def union_metrics(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def latest(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The last row of each group (of all rows without by) by the order columns."""
    every = [c for c in rows.columns if not by or c not in by]
    pick = F.max_by(F.struct(*every), F.struct(*order)).alias("r")
    out = rows.groupBy(*by).agg(pick) if by else rows.agg(pick)
    return out.where("r IS NOT NULL").select(*(by or []), "r.*")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def flatten_entries(bundles: DataFrame, entries: str = "entries") -> DataFrame:
    """One row for each entry of a bundle, with its place."""
    keep = [c for c in bundles.columns if c != entries]
    return bundles.select(*keep, F.posexplode(entries).alias("pos", "entry")).select(*keep, "pos", "entry.*")


def json_field(column: str, path: str, kind: str = "string", default=None) -> Column:
    """A field of a JSON column; broken JSON gives the default."""
    got = F.get_json_object(column, path).cast(kind)
    return got if default is None else F.coalesce(got, F.lit(default))
