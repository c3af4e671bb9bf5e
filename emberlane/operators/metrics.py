"""Session metrics, suite aggregates and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.functions.identity import pct_change


def first_in_session(session: str, condition: Column, value: Column) -> Column:
    """Least value among a session's rows that meet a condition."""
    return F.min(F.when(condition, value)).over(Window.partitionBy(session))


def used_after(log: DataFrame, session: str, region: str, seq: str, opens: Column, uses: Column) -> DataFrame:
    """(session, region) that were opened, with the first opening and whether a use came later in log order."""
    opened = log.where(opens).groupBy(session, region).agg(F.min(seq).alias("opened_at"))
    use = log.where(uses).groupBy(session, region).agg(F.max(seq).alias("last_use"))
    return opened.join(use, [session, region], "left").select(
        session, region, "opened_at", F.coalesce(F.col("last_use") > F.col("opened_at"), F.lit(False)).alias("used")
    )


def session_metrics(log: DataFrame, session: str = "session", source: str = "source", op: str = "operation", tokens: str = "tokens", regions: str = "regions", seq: str = "seq") -> DataFrame:
    """Counts, rates and the ordered measures of each session.

    hits and misses count listed regions, an empty list as one. fallback: searches after the first served bundle.
    prefetch_used and pollution look at uses strictly later in log order than the first prefetch or admission.
    """
    agent, ctl = F.col(source) == "agent_tool", F.col(source) == "controller"
    repo = F.col(op).isin("read", "grep", "glob")
    size = F.greatest(F.size(F.coalesce(regions, F.array().cast("array<string>"))), F.lit(1))
    t = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    marked = log.withColumn("_bundle", first_in_session(session, ctl & (F.col(op) == "bundle_served"), F.col(seq)))
    total = lambda cond, v=F.lit(1): F.sum(F.when(cond, v).otherwise(0)).cast("long")
    base = marked.groupBy(session).agg(
        total(agent & repo).alias("repo_tool_calls"),
        total(ctl & F.col(op).isin("bundle_served", "grep")).alias("controller_calls"),
        total(agent, t).alias("agent_tokens"),
        total(ctl & F.col(op).isin("bundle_served", "grep"), t).alias("injected_tokens"),
        total(F.col(source) == "program_trace", t).alias("test_tokens"),
        total(ctl & (F.col(op) == "hit"), size).alias("hits"),
        total(ctl & (F.col(op) == "miss"), size).alias("misses"),
        total(ctl & (F.col(op) == "evict")).alias("evictions"),
        total(ctl & (F.col(op) == "invalidate")).alias("invalidations"),
        total(ctl & (F.col(op) == "stale_blocked")).alias("stale_blocked"),
        total(F.col(op) == "bundle_served").alias("bundles"),
        total(agent & F.col(op).isin("grep", "glob") & (F.col(seq) > F.col("_bundle"))).alias("fallbacks"),
    )
    each = log.select(session, source, op, seq, F.explode(regions).alias("region"))
    use = (agent & F.col(op).isin("read", "grep")) | (ctl & (F.col(op) == "hit"))
    # a region counts as used if a use follows its first prefetch or admission, whichever came first
    opens = ctl & F.col(op).isin("prefetch", "admit")
    life = each.groupBy(session, "region").agg(
        F.min(F.when(opens, F.col(seq))).alias("open"),
        F.max(F.when(use, F.col(seq))).alias("use"),
        F.max((ctl & (F.col(op) == "prefetch")).cast("int")).alias("pre"),
        F.max((ctl & (F.col(op) == "admit")).cast("int")).alias("adm"),
    )
    later = F.coalesce(F.col("use") > F.col("open"), F.lit(False))
    life = life.groupBy(session).agg(
        F.sum("pre").alias("prefetches"),
        F.sum(F.when(later, F.col("pre")).otherwise(0)).alias("prefetch_used"),
        F.sum("adm").alias("admitted"),
        F.sum(F.when(~later, F.col("adm")).otherwise(0)).alias("pollution"),
    )
    out = base.join(life, session, "left").fillna(0, ["prefetches", "prefetch_used", "admitted", "pollution"])
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(
        "*",
        F.coalesce(F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), F.lit(0.0)).alias("hit_rate"),
        rate("prefetch_used", "prefetches").alias("prefetch_precision"),
        rate("pollution", "admitted").alias("pollution_rate"),
        rate("fallbacks", "bundles").alias("fallback_rate"),
        F.lit(0).alias("stale_served"),
    )


def operation_counts(log: DataFrame, session: str, op: str) -> DataFrame:
    return log.groupBy(session, op).agg(F.count(F.lit(1)).alias("n"))


def suite_aggregate(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Sum, mean, exact median and count of a measure for each condition; non-numbers are left out."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(by).agg(F.sum(v).alias("total"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("n"))


def paired_change(rows: DataFrame, task: str, condition: str, value: str, before, after) -> DataFrame:
    """One row a task with its sums under two conditions and the change in percent."""
    pick = lambda c: F.sum(F.when(F.col(condition) == c, F.col(value)))
    wide = rows.groupBy(task).agg(pick(before).alias("before"), pick(after).alias("after"))
    return wide.select(task, "before", "after", pct_change("before", "after").alias("change"))
