"""Hashed text vectors and cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions.identity import col

DIM = 256


def hash_slot(term: str | Column) -> Column:
    """Slot of a term: the first byte of its SHA-256 (of 256 slots)."""
    return F.conv(F.substring(F.sha2(col(term), 256), 1, 2), 16, 10).cast("int")


def hash_sign(term: str | Column) -> Column:
    """+1 if the fifth byte of the SHA-256 is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(col(term), 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def hash_embed_sparse(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, slot, value): unit signed feature-hash vectors, without zero slots; no terms: slot 0 is 1.

    One digest a term; terms are summed per slot before the shuffle, and a row's slots (at most 256) meet once for the norm.
    """
    digest = F.sha2("term", 256)
    t = rows.select(key, F.explode_outer(terms).alias("term")).select(key, F.substring(digest, 1, 10).alias("h"))
    byte = lambda at: F.conv(F.substring("h", at, 2), 16, 10).cast("int")
    slots = t.groupBy(key, F.coalesce(byte(1), F.lit(0)).alias("slot")).agg(F.sum(F.coalesce(1 - 2 * (byte(9) % 2), F.lit(1))).alias("raw"))
    whole = slots.groupBy(key).agg(F.collect_list(F.struct("slot", "raw")).alias("s"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return whole.select(key, "norm", F.explode("s").alias("s")).where("s.raw <> 0").select(key, F.col("s.slot").alias("slot"), (F.col("s.raw") / F.col("norm")).alias("value"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where a length is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, None).otherwise(dot(a, b) / n)
