"""Packing of token sequences into windows: best-fit decreasing with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm import bpe
from emberlane.llm.text import blocks, buffers
from emberlane.session import materialize

#: Pieces that one task packs together.
GROUP = 4096


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that holds a piece."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves < size + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest window of at least this capacity, and its capacity; the latest of equals."""
        node = length + self.leaves
        if not self.count[node]:
            while True:  # up until a right sibling holds something
                if node <= 1:
                    return None
                if not node & 1 and self.count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths must be at most size and come in falling order."""
    open_windows, made = OpenWindows(size), 0
    window, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        got = open_windows.take(n)
        if got is None:
            got, made = (made, size), made + 1
        window[i], offset[i] = got[0], size - got[1]
        if got[1] > n:
            open_windows.put(got[1] - n, got[0])
    return window, offset


def cut_pieces(docs: DataFrame, size: int, path: str, end_id: int = 0) -> DataFrame:
    """Full windows of every document and what is left of it: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches):
        encoder = bpe.library_encoder(path)
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets):
                ids, row = encoder.block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids.astype("<u4"), row[1:], end_id)
                row = row + np.arange(len(row))
                total = np.diff(row)
                pieces = -(-total // size)
                owner = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size
                length = np.minimum(size, total[owner] - start)
                data, at = ids.tobytes(), (row[owner] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                doc = batch.column(0)[i:j].take(pa.array(owner))
                yield pa.RecordBatch.from_arrays(
                    [doc, *(pa.array(x, pa.int64()) for x in (start, length, crc, total[owner]))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, size: int = 1024, path: str | None = None, group: int = GROUP) -> DataFrame:
    """Pack all documents into windows of size tokens; one row per piece, with its window and place in it.

    A document is the ids of its whole text (null: empty) and an end id. Documents longer than a window are first cut
    into full windows; the rest of each document stays in one piece, and pieces go to the tightest open window, longest
    first. Pieces are packed in groups of about so many, dealt by a hash of document, start, length and ids; every id is in exactly
    one piece and offsets in a window have no gaps. Repeated rows are packed each; an empty table gives no rows.
    The result depends on the rows alone, not on their order or partitions, but for rows without doc_id.
    """
    pieces = materialize(cut_pieces(docs, size, path or bpe.vocabulary_path()), "pieces")
    groups = max(1, -(-pieces.count() // group))
    # rows without doc_id may be many and alike, so they are dealt by their place in the written pieces
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", place), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = best_fit_decreasing(table["length"].to_numpy(), size)
        base = table["deal"][0].as_py() << 32
        return table.drop_columns(["deal"]).append_column("sequence_id", pa.array(window + base, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return dealt.groupBy("deal").applyInArrow(
        pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
