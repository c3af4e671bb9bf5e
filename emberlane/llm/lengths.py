"""Token counts: an exact histogram of encoded lengths, with suffix sums for every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.llm import bpe
from emberlane.llm.text import blocks, buffers
from emberlane.session import materialize

#: Lengths that share a bucket of the two-level sums.
BUCKET = 512


def document_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encoded length of every whole text (null: 0), one row per document."""
    path = path or bpe.vocabulary_path()

    def measure(batches):
        encoder = bpe.library_encoder(path)
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for i, j in blocks(offsets):
                _, row = encoder.block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(row), pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(measure, "n_tokens long")


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per length that occurs, with what answers any question about totals, quantiles and context limits.

    n_tokens, n_docs; docs_le / tokens_le: documents and tokens of at most that length; docs_ge: of at least that
    length; quantile: share of documents at or below it; truncated_total: tokens left if every document were cut at
    n_tokens; truncated_docs: documents that this cuts. An empty table gives no rows; a null or empty text has length 0;
    repeated rows count each. Documents are summed per length before the shuffle, and lengths per bucket before the
    sums run over buckets, so no task sees more than the buckets. Texts are encoded once: the counts are written out
    before the sums read them twice.
    """
    counts = materialize(document_lengths(docs, path).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    counts = counts.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    buckets = counts.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    up = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    buckets = buckets.select("bucket", zero(F.sum("b_docs").over(up)).alias("d0"), zero(F.sum("b_tokens").over(up)).alias("t0"), zero(F.sum("b_docs").over(down)).alias("d1"))
    inside = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(buckets, "bucket").select(
        "n_tokens",
        "n_docs",
        (F.col("d0") + F.sum("n_docs").over(inside)).alias("docs_le"),
        (F.col("t0") + F.sum("tokens").over(inside)).alias("tokens_le"),
        (F.col("d1") + F.sum("n_docs").over(above)).alias("docs_ge"),
    )
    longer = F.col("docs_ge") - F.col("n_docs")
    return out.select(
        "*",
        (F.col("docs_le") / (F.col("docs_le") + longer)).alias("quantile"),
        (F.col("tokens_le") + longer * F.col("n_tokens")).alias("truncated_total"),
        longer.alias("truncated_docs"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, kept_tokens, cut_docs): tokens kept and documents cut at any context limits, whether or not a document
    has that length, read off the sums: those of the longest length within the limit, or of the shortest beyond it. An
    empty histogram gives zeros."""
    h = histogram.select("n_tokens", "docs_le", "tokens_le", "docs_ge", "n_docs")
    limit = lambda x: F.lit(int(x)).cast("long")
    # one pass with partial maxima: a row for each limit leaves each task
    picked = h.agg(*[y for i, x in enumerate(limits) for y in (
        F.max(F.when(F.col("n_tokens") <= limit(x), F.struct("n_tokens", "tokens_le", (F.col("docs_ge") - F.col("n_docs")).alias("longer")))).alias(f"below{i}"),
        F.min(F.when(F.col("n_tokens") > limit(x), F.struct("n_tokens", F.lit(0).cast("long").alias("tokens_le"), F.col("docs_ge").alias("longer")))).alias(f"above{i}"),
    )])
    rows = []
    for i, x in enumerate(limits):
        best = F.coalesce(F.col(f"below{i}"), F.col(f"above{i}"))
        longer, tokens = F.coalesce(best["longer"], F.lit(0)), F.coalesce(best["tokens_le"], F.lit(0))
        rows.append(F.struct(F.lit(int(x)).alias("context"), (tokens + longer * limit(x)).alias("kept_tokens"), longer.alias("cut_docs")))
    return picked.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The least length at which at least each share of the documents is reached."""
    each = histogram.select("n_tokens", "quantile", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return each.where(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
