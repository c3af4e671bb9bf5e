"""The corpus pipeline: quality classifier, toxicity, near-duplicates, substring dedup, packing.

All stages take null and empty texts (as texts without a word), texts of any length, rows that repeat an id, rows without
one, tables without a row and extra columns of any name; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm import packing, quality_model, shingles, substrings, toxicity
from emberlane.session import materialize
from emberlane.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the labelled documents of the stage's input.
    Every row is judged by its text alone. Without labels of two grades all rows stay."""
    return quality_model.keep(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic. Every row is judged by its text alone. Without labels of both classes all
    rows stay."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that links of five-word Jaccard similarity 0.8 or more join; texts
    without a word are one group. doc_id should be unique: where a copy goes, all rows with its id go. Rows without doc_id
    stay, as no id tells them apart; the least doc_id stays with all its rows."""
    groups = shingles.near_duplicates(docs)
    gone = groups.where((F.col("doc_id") != F.col("component_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents hold; emptied ones go, texts that had no word stay.
    Rows that repeat a doc_id all get the first one's verdict, rows without doc_id stay whole."""
    return substrings.drop_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens; a null or empty text is its end token alone, and every row is packed, repeated ones too."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("substrings", repeats), ("packing", pack)]

#: Trained models, hashing and tokenization cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
