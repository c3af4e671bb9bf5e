"""Order-aware columns over an event log. The order must be total: give a sequence number or break ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_count(session: str, order: list[str], condition: Column) -> Column:
    """How many of the session's rows up to this one meet the condition."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(condition.cast("int")).over(w)


def turn_counter(log: DataFrame, session: str, order: list[str], bump: Column, name: str = "turn") -> DataFrame:
    """Turn of each row: rows that bump raise it by one from there on."""
    return log.withColumn(name, running_count(session, order, bump).cast("long"))


def broad_search_ordinal(log: DataFrame, session: str, order: list[str], broad: Column) -> DataFrame:
    """Broad searches with their ordinal in the session; from the second on, advise."""
    out = log.withColumn("ordinal", running_count(session, order, broad).cast("long")).where(broad)
    return out.withColumn("advise", F.col("ordinal") >= 2)


def consecutive_edges(rows: DataFrame, group: str, order: list[str], node: str) -> DataFrame:
    """(group, src, dst, hop) of neighbouring rows in order."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.select(group, F.col(node).alias("src"), F.lead(node).over(w).alias("dst"), F.row_number().over(w).alias("hop")).where("dst IS NOT NULL")


def rank_weight(order: Column, by: str, step: float = 0.04, least: float = 0.4) -> Column:
    """max(least, 1 - step * rank), ranks from 0."""
    w = Window.partitionBy(by)
    return F.greatest(F.lit(least), 1 - step * (F.row_number().over(w.orderBy(order)) - 1))


def top_per_key(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def first_after(log: DataFrame, session: str, order: str, start: Column) -> DataFrame:
    """Rows strictly after the session's first row that meets the condition."""
    first = F.min(F.when(start, F.col(order))).over(Window.partitionBy(session))
    return log.withColumn("_first", first).where(F.col(order) > F.col("_first")).drop("_first")
