"""Ordinal cumulative-link regression on hashed text for graded quality ratings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.text import U64, blocks, buffers, slice_hashes, word_bounds, word_hashes

BITS = 16
#: Most labelled documents that a fit sees, taken in the order of a hash of doc_id.
FIT_ROWS = 6000
#: Runs of one class shrink to one sign in a word's shape: upper-case A, other letters a, digits 9, the rest itself.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91] = 65
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[48:58] = 57


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two hashed features a word, [words, 2]: the word itself and its shape."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    word = word_hashes(raw, starts, ends)
    shape = SHAPE[raw]
    new = np.ones(len(raw), dtype=bool)
    new[1:] = shape[1:] != shape[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    # whitespace runs lie between words and are never inside a slice
    shapes = slice_hashes(shape[at], np.searchsorted(at, starts), np.searchsorted(at, ends), 1)
    half = U64((1 << (BITS - 1)) - 1)
    return np.stack([word & half, (shapes & half) + U64(1 << (BITS - 1))], axis=1).astype(np.int64)


def averages(batch_column):
    """Blocks of a text column with each row's features: (i, j, row of each word, features, words of each row)."""
    raw, offsets = buffers(batch_column)
    for i, j in blocks(offsets):
        part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_bounds(part, rows)
        count = np.diff(first)
        yield i, j, np.repeat(np.arange(j - i), count), features(part, starts, ends), count


class CumulativeLink:
    """P(grade <= k) = sigmoid(threshold_k - w.x), one weight vector shared by all ordered thresholds.

    x holds a document's shares of each hashed feature; fitted by full-batch Adagrad with a penalty on the weights.
    Thresholds are a first one and positive steps, so they stay in order.
    """

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, steps: int = 120, rate: float = 0.5, penalty: float = 1e-5):
        n = len(grade)
        w = np.zeros(1 << BITS)
        share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
        theta = np.log(share / (1 - share))
        raw = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
        gw2, gt2 = np.full(len(w), 1e-8), np.full(len(raw), 1e-8)
        for _ in range(steps):
            theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
            eta = np.bincount(rows, weights=w[index] * value, minlength=n)
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            with np.errstate(over="ignore"):
                up, down = (1 / (1 + np.exp(-np.clip(edge[grade + k] - eta, -40, 40))) for k in (1, 0))
            p = np.maximum(up - down, 1e-9)
            d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
            d_eta = (d_up - d_down) / n  # of the negative log-likelihood
            gw = np.bincount(index, weights=d_eta[rows] * value, minlength=len(w)) + penalty * w
            g_edge = np.zeros(grades + 1)
            np.add.at(g_edge, grade + 1, -d_up / n)
            np.add.at(g_edge, grade, d_down / n)
            g_theta = g_edge[1:-1]
            g_raw = np.cumsum(g_theta[::-1])[::-1] * np.concatenate([[1.0], np.exp(raw[1:])])
            gw2 += gw**2
            gt2 += g_raw**2
            w -= rate * gw / np.sqrt(gw2)
            raw -= 0.2 * g_raw / np.sqrt(gt2)
        return CumulativeLink(w.astype(np.float32), np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))

    def tails(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold, [rows, grades - 1]."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -40, 40)))


def held_out(doc_id):
    """Rows that a fit leaves out; a row without doc_id is none of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", rows: int = FIT_ROWS) -> CumulativeLink | None:
    """Fit on at most so many labelled documents outside the held-out fold; None where there are no two grades to tell apart.

    A doc_id that labels repeat counts once, with its least grade. Rows of documents that repeat a sampled doc_id are all
    used, so documents should hold each id once. The sample is sorted by its features: the order of rows does not matter.
    """
    known = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(F.col(grade).cast("int")).alias("grade"))
    # the sample is drawn from the labels alone; at most so many of them are broadcast to the documents
    sample = docs.select("doc_id", "text").join(F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)), "doc_id")

    def compact(batches):
        for batch in batches:
            for i, j, row, found, count in averages(batch.column(0)):
                index, value, marks = [], [], []
                ends = np.cumsum(count)
                for k in range(j - i):
                    ids, n = np.unique(found[ends[k] - count[k] : ends[k]].ravel(), return_counts=True)
                    index.append(ids.astype(np.int32))
                    value.append((n / max(1, count[k])).astype(np.float32))
                    marks.append(xxhash.xxh3_64_intdigest(index[-1].tobytes() + value[-1].tobytes()) >> 1)
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), batch.column(1)[i:j], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["mark", "grade", "at", "x"])

    got = sample.select("text", "grade").mapInArrow(compact, "mark long, grade int, at array<int>, x array<float>").toArrow().combine_chunks()
    got = got.sort_by([("mark", "ascending"), ("grade", "ascending")]).combine_chunks()
    names = sorted(set(got["grade"].to_pylist()))
    if len(names) < 2:
        return None
    grades = np.searchsorted(names, got["grade"].to_numpy())
    at, x = (got[c].combine_chunks() for c in ("at", "x"))
    count = np.diff(at.offsets.to_numpy())
    return CumulativeLink.fit(np.repeat(np.arange(len(grades)), count), at.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy(), grades, len(names))


def score(docs: DataFrame, model: CumulativeLink | None, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade (0 to grades - 1), tail_probability (of the top grade), kept (tail_probability >= least).

    Whole texts; null and empty texts score by the thresholds alone. Without a model (no two grades) every row has
    expected_grade and tail_probability null and is kept. Rows stay as they come.
    """
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))

    def rate(batches):
        for batch in batches:
            for i, j, row, found, count in averages(batch.column(1)):
                each = model.weights[found].sum(axis=1) if len(found) else np.zeros(0)
                eta = np.bincount(row, weights=each, minlength=j - i) / np.maximum(1, count)
                tails = model.tails(eta)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)],
                    names=["doc_id", "expected_grade", "tail_probability", "kept"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def tails_of(model: CumulativeLink, column) -> np.ndarray:
    """Tail probability of the top grade of each text of an Arrow column."""
    out = [np.zeros(0)]
    for i, j, row, found, count in averages(column):
        each = model.weights[found].sum(axis=1) if len(found) else np.zeros(0)
        out.append(model.tails(np.bincount(row, weights=each, minlength=j - i) / np.maximum(1, count))[:, -1])
    return np.concatenate(out)


def keep(docs: DataFrame, model: CumulativeLink | None, least: float = 0.5) -> DataFrame:
    """The rows whose tail probability is at least so high, with all their columns and without a shuffle."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def choose(batches):
        for batch in batches:
            yield batch.filter(pa.array(tails_of(model, batch.column(at)) >= least))

    return docs.mapInArrow(choose, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, grade: str = "quality", least: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled rows and score every document; see fit and score."""
    return score(docs, fit(docs, labels, grade, rows), least)
