"""Snapshots of a catalogue: hash-diff sync, cascades, staleness, migration of state to successors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, changed or removed; keys that are the same are left out."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def sync(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """The catalogue after a sync: unchanged rows as they were, changed and added ones from the new snapshot."""
    changes = diff(old, new, key, digest).select(key, "change")
    kept = old.join(changes.select(key), key, "left_anti")
    return kept.unionByName(new.join(changes.where("change <> 'removed'").select(key), key, "left_semi"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """new wins over old by key; of equal keys within new the last by order."""
    if order:
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Set semantics: rows of new whose key is there already are ignored."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows that refer to a gone key; tables: name -> (rows, its column with the key)."""
    return {name: rows.join(gone.select(F.col(key).alias(column)), column, "left_anti") for name, (rows, column) in tables.items()}


def successors(old: DataFrame, new: DataFrame, on: list[str], key: str) -> DataFrame:
    """(old id, successor): the new region of the same path and symbol, the least id of several; null if there is none."""
    b = new.groupBy(*on).agg(F.min(key).alias("successor"))
    return old.join(b, on, "left").select(F.col(key), "successor")


def stale_regions(regions: DataFrame, files: DataFrame, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """Regions with fresh: whether lines start..end of their file still hash to what was indexed; a missing file is stale."""
    lines = F.split(F.regexp_replace("text", "\r\n?|[\u000b\u000c\u001c\u001d\u001e\u0085  ]", "\n"), "\n")
    part = F.array_join(F.slice(lines, F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    out = regions.join(files.select(path, "text"), path, "left")
    return out.withColumn("fresh", F.coalesce(F.substring(F.sha2(part, 256), 1, 16) == F.col(digest), F.lit(False))).drop("text")


def migrate(state: DataFrame, moves: DataFrame, session: str = "session", key: str = "region") -> DataFrame:
    """Working set after an edit: moved regions go stale, and their state passes to the successor, merged by max.

    moves: (key, successor). Execution is passed on by 0.8, the edit likelihood is at least 0.7, the successor starts
    fresh and not admitted. A region without a successor just goes stale.
    """
    hit = state.join(moves, key, "left_semi").withColumns({"stale": F.lit(True), "admitted": F.lit(False)})
    rest = state.join(moves, key, "left_anti")
    carried = state.join(moves.where("successor IS NOT NULL"), key).select(
        session, F.col("successor").alias(key), (F.col("execution") * 0.8).alias("execution"), F.greatest("edit", F.lit(0.7)).alias("edit"), F.lit(False).alias("stale"), F.lit(False).alias("admitted")
    )
    every = rest.select(session, key, "execution", "edit", "stale", "admitted").unionByName(carried).unionByName(hit.select(session, key, "execution", "edit", "stale", "admitted"))
    return every.groupBy(session, key).agg(F.max("execution").alias("execution"), F.max("edit").alias("edit"), F.max("stale").alias("stale"), F.max("admitted").alias("admitted"))


def remap(rows: DataFrame, mapping: DataFrame, column: str, old: str = "old", new: str = "new") -> DataFrame:
    """Replace ids by a mapping; ids without an entry stay."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("_new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(rows.columns)
