"""Points and intervals: narrowest cover, overlaps, coverage lines, trace tiers. All joins have an equality key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def narrowest_cover(points: DataFrame, spans: DataFrame, key: str, point_id: str, point: str, low: str, high: str, span_id: str, fallback: str | None = None) -> DataFrame:
    """For each point the span of its key that covers it with the least width (then the least start, then id).

    A point without a cover gets the span of its key that is marked by the boolean column fallback, if there is one.
    """
    s = spans.select(key, F.col(span_id).alias("_id"), F.col(low).alias("_low"), F.col(high).alias("_high"))
    hit = points.join(s, key).where((F.col(point) >= F.col("_low")) & (F.col(point) <= F.col("_high")))
    best = hit.groupBy(point_id).agg(F.min(F.struct((F.col("_high") - F.col("_low")).alias("w"), "_low", "_id")).alias("b"))
    out = best.select(point_id, F.col("b._id").alias(span_id), F.col("b.w").alias("width"))
    if fallback is None:
        return out
    rest = points.join(best, point_id, "left_anti").join(spans.where(F.col(fallback)), key).select(point_id, F.col(span_id), (F.col(high) - F.col(low)).alias("width"))
    return out.unionByName(rest)


def overlaps(a: DataFrame, b: DataFrame, key: str, low: str = "low", high: str = "high") -> DataFrame:
    """Pairs of intervals of one key that share a point; columns of b are prefixed by other_."""
    other = b.select(*[F.col(c).alias(c if c == key else f"other_{c}") for c in b.columns])
    return a.join(other, key).where((F.col(low) <= F.col(f"other_{high}")) & (F.col(f"other_{low}") <= F.col(high)))


def binned_overlaps(a: DataFrame, b: DataFrame, key: str, width: float, low: str = "low", high: str = "high") -> DataFrame:
    """overlaps, where a key may have very many intervals: both sides are dealt to bins, each pair counts in the bin of
    the later start."""
    bins = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    other = bins(b.select(*[c for c in b.columns]))
    other = other.select(*[F.col(c).alias(c if c in (key, "_bin") else f"other_{c}") for c in other.columns])
    hit = bins(a).join(other, [key, "_bin"]).where((F.col(low) <= F.col(f"other_{high}")) & (F.col(f"other_{low}") <= F.col(high)))
    return hit.where(F.col("_bin") == F.floor(F.greatest(F.col(low), F.col(f"other_{low}")) / width)).drop("_bin")


def lines_to_regions(lines: DataFrame, spans: DataFrame, key: str, line: str, low: str, high: str, span_id: str) -> DataFrame:
    """Distinct regions that covered lines fall in, in the order in which they are first met."""
    ids = lines.withColumn("_row", F.struct(key, line))
    got = narrowest_cover(ids, spans, key, "_row", line, low, high, span_id)
    return got.groupBy(span_id).agg(F.min("_row").alias("_first")).select(span_id, F.col(f"_first.{key}").alias("first_key"), F.col(f"_first.{line}").alias("first_line"))


def only_in(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_anti")


def tiers(parts: list[DataFrame], region: str) -> DataFrame:
    """Each region in the first of the parts that holds it; tier counts from 1."""
    ranked = [p.select(region).withColumn("tier", F.lit(i + 1)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked).groupBy(region).agg(F.min("tier").alias("tier"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """Left rows with the last right values at or before their time: one union and one window, no range join."""
    r = right.select(by, F.col(at), F.lit(0).alias("_side"), F.struct(*values).alias("_v"), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in (by, at)])
    l = left.select(by, F.col(at), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *[c for c in left.columns if c not in (by, at)])  # noqa: E741
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = r.unionByName(l).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *[F.col(f"_v.{v}").alias(f"prior_{v}") for v in values])
