"""Substring dedup by a Relative Lempel-Ziv parse of every document against an index of the whole corpus.

The index holds word windows by where they first stand, dealt over blocks by their anchors: the least hash of the short
word runs in a window. Equal windows have equal anchors wherever they stand, so a shuffle by anchor brings a piece of a
document to the one block that can hold its match: the same as a parse against every block, without the quadratic work.

* A phrase is a run of a document's windows that share one anchor at one place. Phrases whose anchor stands once anywhere
  are literals; most of a corpus ends here, by counts alone.
* An anchor with one phrase text: the phrase is copied whole from the first place of that text.
* An anchor with several phrase texts is where factors begin or end: each window is looked up by itself, so that matches
  which straddle a boundary are found.

Each copied piece points at its first place in the corpus. The parse goes over a document's pieces from left to right
and lets each factor grow as long as the next piece goes on at the source's next word; a jump ends the factor. Sources
are first places, so a factor is the longest one from its source, and all factors together cover every window that
stands earlier. Factors have a window's length at least; their words go.

Words and phrases compare by two 64-bit hashes, whose seeds are drawn anew for every run: no input can be made to collide.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.text import U64, WORDS, blocks, buffers, gram_hashes, signed, word_bounds, word_hashes
from emberlane.session import materialize, release

GRAM = 6


def least_ahead(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each width consecutive values and the place of its first occurrence there, by doubling."""
    out, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        later = out[step:] < out[: len(out) - step]
        out, at = np.where(later, out[step:], out[: len(out) - step]), np.where(later, at[step:], at[: len(at) - step])
        have += step
    return out, at


def phrases(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Of all rows' words: the phrases' row, start (from the row's first word), windows and anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < window:
        return none, none, none, none.view(U64)
    grams = gram_hashes(words, GRAM)
    anchor, place = least_ahead(grams, window - GRAM + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + window <= first[row + 1])
    if not len(at):
        return none, none, none, none.view(U64)
    row, anchor, place = row[at], anchor[at], place[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    return row[begin], at[begin] - first[row[begin]], size, anchor[begin]


def hashed_blocks(batch, column: int = 1):
    """Blocks of a batch: row range, bytes, word bounds and both word hashes."""
    raw, offsets = buffers(batch.column(column))
    for i, j in blocks(offsets):
        part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = word_bounds(part, rows)
        yield i, j, part, starts, ends, first


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values' struct array and each row's count, null as none."""
    count = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    return column.flatten(), count


def parse(row: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, ...]:
    """Greedy factors of copied pieces (row, first window, windows, source document and first window there): row, first
    window, windows, source document, source window. A factor goes on while its source does."""
    order = np.lexsort((begin, row))
    row, begin, size, doc, source = (x[order] for x in (row, begin, size, doc, source))
    new = np.ones(len(row), dtype=bool)
    if len(row):
        new[1:] = (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + size[:-1]) | (doc[1:] != doc[:-1]) | (source[1:] != source[:-1] + size[:-1])
    at = np.flatnonzero(new)
    total = np.add.reduceat(size, at) if len(at) else size
    return row[at], begin[at], total, doc[at], source[at]


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing is removed), removed: word spans [from, to),
    factors: the copied spans that cover them, which may overlap, with the document and word they are first found at.

    Every word that is covered by a window of so many words whose sequence also starts earlier (smaller doc_id, or same
    document and earlier start) goes; windows are judged on the input. Null and empty texts and texts of fewer words
    keep all. doc_id should be unique; rows that repeat one with the same text all get the verdict of the first, and rows
    without doc_id are returned whole. Extra columns are ignored, whatever they are called. A hot passage costs one row
    for each of its phrases in the partial sums; joins back to its rows are plain equi-joins, which adaptive execution
    splits by size (spark.sql.adaptive.skewJoin must be on, as it is by default). Nothing is collected.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seeds = secrets.randbits(38), secrets.randbits(38) | 1 << 39

    def anchors_of(batches):
        for batch in batches:
            for i, j, part, starts, ends, first in hashed_blocks(batch):
                row, start, size, anchor = phrases(word_hashes(part, starts, ends, seeds[0]), first, window)
                doc = batch.column(0)[i:j].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), doc, pa.array(start, pa.int32())], names=["h", "doc_id", "s"])

    found = docs.where(F.col("doc_id").isNotNull()).mapInArrow(anchors_of, "h long, doc_id long, s int")
    repeated = materialize(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors")
    marked = found.join(repeated, "h").groupBy("doc_id").agg(F.collect_list("s").alias("at"))
    marked = materialize(marked, "marked")
    release(repeated)

    # one shuffle of the texts: documents without a repeated anchor are done, the others go on with their phrases
    def settle(batches):
        for batch in batches:
            for i, j, part, starts, ends, first in hashed_blocks(batch):
                data = part.tobytes()
                a, b = starts.tolist(), ends.tolist()
                shas = []
                for p, q in zip(first[:-1].tolist(), first[1:].tolist()):
                    shas.append(hashlib.sha256(b" ".join([data[x:y] for x, y in zip(a[p:q], b[p:q])])).hexdigest())
                at = batch.column(2)[i:j]
                text = batch.column(1).take(pa.array(np.arange(i, j), mask=~np.asarray(at.is_valid())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(np.diff(first)), pa.array(shas, pa.string()), text, at],
                    names=["doc_id", "n_words", "sha", "text", "at"],
                )

    settled = docs.join(marked, "doc_id", "left").select("doc_id", "text", "at")
    settled = materialize(settled.mapInArrow(settle, "doc_id long, n_words long, sha string, text string, at array<int>"), "settled")
    release(marked)

    def phrases_of(batches):
        for batch in batches:
            for i, j, part, starts, ends, first in hashed_blocks(batch):
                words = word_hashes(part, starts, ends, seeds[0])
                row, start, size, anchor = phrases(words, first, window)
                values, count = lists(batch.column(2)[i:j])
                wanted = (np.repeat(np.arange(j - i), count) << 32) | np.asarray(values, dtype=np.int64)
                ok = np.isin((row << 32) | start, wanted)
                row, start, size, anchor = row[ok], start[ok], size[ok], anchor[ok]
                other = word_hashes(part, starts, ends, seeds[1])
                begin = first[row] + start
                roll = [_slices(w, begin, begin + size + window - 1, k) for k, w in enumerate((words, other))]
                doc = batch.column(0)[i:j].take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(roll[0])), pa.array(signed(roll[1])), doc, pa.array(start, pa.int32()), pa.array(size, pa.int32())],
                    names=["h", "p", "q", "doc_id", "s", "n"],
                )

    going = settled.where(F.col("at").isNotNull())
    parsed = materialize(
        going.select("doc_id", "text", "at").mapInArrow(phrases_of, "h long, p long, q long, doc_id long, s int, n int"), "phrases"
    )
    index = parsed.groupBy("h").agg(
        F.min(F.struct("doc_id", "s")).alias("first"),
        F.min(F.struct("p", "q")).alias("low"),
        F.max(F.struct("p", "q")).alias("high"),
    )
    index = materialize(index.select("h", F.col("first.doc_id").alias("d0"), F.col("first.s").alias("s0"), (F.col("low") != F.col("high")).alias("edge")), "index")
    verdict = parsed.join(index, "h").where("edge OR doc_id != d0 OR s != s0")
    edges = verdict.where("edge").groupBy("doc_id").agg(F.collect_list(F.struct("s", "n")).alias("look"))
    copied = verdict.where("NOT edge").select("doc_id", "s", "n", "d0", "s0")

    # factor boundaries: single windows by a hash of 128 bits
    def windows_of(batches):
        for batch in batches:
            for i, j, part, starts, ends, first in hashed_blocks(batch):
                values, count = lists(batch.column(2)[i:j])
                row = np.repeat(np.arange(j - i), count)
                begin, size = (np.asarray(values.field(k), dtype=np.int64) for k in ("s", "n"))
                at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                row = np.repeat(row, size)
                roll = [_slices(word_hashes(part, starts, ends, seeds[k]), first[row] + at, first[row] + at + window, k) for k in (0, 1)]
                doc = batch.column(0)[i:j].take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(signed(roll[0])), pa.array(signed(roll[1])), doc, pa.array(at, pa.int32())], names=["p", "q", "doc_id", "s"])

    looked = going.select("doc_id", "text").join(edges, "doc_id").select("doc_id", "text", "look")
    windows = materialize(looked.mapInArrow(windows_of, "p long, q long, doc_id long, s int"), "windows")
    starts_at = windows.groupBy("p", "q").agg(F.min(F.struct("doc_id", "s")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    starts_at = materialize(starts_at.select("p", "q", F.col("first.doc_id").alias("d0"), F.col("first.s").alias("s0")), "firsts")
    late = windows.join(starts_at, ["p", "q"]).where("doc_id != d0 OR s != s0").select("doc_id", "s", F.lit(1).alias("n"), "d0", "s0")
    pieces = materialize(copied.unionByName(late).groupBy("doc_id").agg(F.collect_list(F.struct("s", "n", "d0", "s0")).alias("cut")), "pieces")
    release(parsed, index, windows, starts_at)

    def clean(batches):
        for batch in batches:
            for i, j, part, starts, ends, first in hashed_blocks(batch):
                values, count = lists(batch.column(2)[i:j])
                row = np.repeat(np.arange(j - i), count)
                begin, size, doc, source = (np.asarray(values.field(k), dtype=np.int64) for k in ("s", "n", "d0", "s0"))
                row, begin, size, doc, source = parse(row, begin, size, doc, source)
                depth = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(depth, first[row] + begin, 1)
                np.add.at(depth, first[row] + begin + size + window - 1, -1)
                gone = np.cumsum(depth)[:-1] > 0
                data = part.tobytes()
                removed, kept, gaps = [], [], []
                for p, q in zip(first[:-1].tolist(), first[1:].tolist()):
                    g = gone[p:q]
                    keep = np.flatnonzero(~g) + p
                    removed.append(int(g.sum()))
                    kept.append(b" ".join([data[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]))
                    change = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                    gaps.append([{"from": int(x), "to": int(y)} for x, y in zip(change[::2], change[1::2])])
                spans = [pa.array(x, pa.int32()) for x in (begin, begin + size + window - 1)] + [pa.array(doc, pa.int64()), pa.array(source, pa.int32())]
                places = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array(removed, pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
                        pa.array(gaps, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
                        pa.ListArray.from_arrays(places, pa.StructArray.from_arrays(spans, names=["from", "to", "doc_id", "word"])),
                    ],
                    names=["doc_id", "n_removed", "kept_sha256", "kept_text", "removed", "factors"],
                )

    cleaned = going.join(pieces, "doc_id").select("doc_id", "text", "cut").mapInArrow(
        clean, "doc_id long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<from:int,to:int>>, factors array<struct<from:int,to:int,doc_id:long,word:int>>"
    )
    # rows that repeat a doc_id agree; one row a document answers for them
    cleaned = cleaned.dropDuplicates(["doc_id"])
    return settled.select("doc_id", "n_words", "sha").join(cleaned, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "kept_text",
        "removed",
        "factors",
    )


def _slices(words: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return WORDS[which].slices(WORDS[which].prefix(words), begin, end)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """The documents with repeated words taken out; documents of which nothing is left go. Columns as in documents.

    Only documents that lose words are joined back; others pass as they are, whatever their columns are called. n_chars,
    where there is one, is set to the new length.
    """
    cut = free_name(docs, "_cut")
    hit = remove_repeats(docs, window).where("n_removed > 0").dropDuplicates(["doc_id"])
    hit = hit.select("doc_id", F.struct(F.col("kept_text").alias("text"), (F.col("n_removed") == F.col("n_words")).alias("gone")).alias(cut))
    joined = docs.join(hit, "doc_id", "left")
    cleaned = F.col(f"`{cut}`")
    text = F.coalesce(cleaned["text"], F.col("text"))
    size = F.when(cleaned.isNotNull(), F.length(text).cast("long"))
    columns = [text.alias(c) if c == "text" else F.coalesce(size, F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return joined.where(cleaned.isNull() | ~cleaned["gone"]).select(*columns)
