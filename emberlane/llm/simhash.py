"""SimHash near-duplicates: exact search by shared bit groups, distances by bit-sliced counters."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.groups import Forest, components, tiles
from emberlane.llm.text import U64, blocks, buffers, word_bounds
from emberlane.session import materialize

SEED = 42


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed long) of every whole text.

    Words after lower-casing A-Z, shingles with repeats, joined by one space; texts of fewer words are one shingle, texts
    without words (null too) get 0. A bit is 1 if it is set in over half of the shingles' XXH64.
    """

    def hashed(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets):
                part, rows = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
                starts, ends, first = word_bounds(part, rows)
                # words one space apart, so that a shingle is one slice
                sizes = ends - starts
                place = np.cumsum(sizes + 1) - (sizes + 1)
                joined = np.full(int((sizes + 1).sum()), 32, dtype=np.uint8)
                total = int(sizes.sum())
                inner = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                joined[inner + np.repeat(place, sizes)] = part[inner + np.repeat(starts, sizes)]
                words = np.diff(first)
                count = np.where(words == 0, 0, np.maximum(1, words - shingle + 1))
                owner = np.repeat(np.arange(len(words)), count)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
                last = np.minimum(at + shingle, first[owner + 1]) - 1
                text, of = memoryview(joined), xxhash.xxh64_intdigest
                h = np.fromiter((of(text[a:b], SEED) for a, b in zip(place[at].tolist(), (place[last] + sizes[last]).tolist())), dtype=U64, count=len(at))
                out = np.zeros(len(words), dtype=U64)
                full = np.flatnonzero(count)
                if len(full):
                    begin = (np.cumsum(count) - count)[full]
                    for b in range(64):
                        ones = np.add.reduceat((h >> U64(b)) & U64(1), begin).astype(np.int64)
                        out[full] |= (2 * ones > count[full]).astype(U64) << U64(b)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fp long")


def bit_groups(radius: int, keep: int) -> list[int]:
    """Masks of all choices of keep out of radius + keep runs of bits: of any two fingerprints within the radius, at
    least keep runs are equal, so they share the bits of some mask."""
    runs = radius + keep
    edges = [64 * i // runs for i in range(runs + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, keep)]


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all values, 64 values to a word."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, dtype=U64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, ::-1].T  # [64, n], bit 0 first
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(U64)


def within(plane: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, value) index pairs at distance <= radius."""
    alive_q, near = near_values(plane, queries, radius)
    q, v = np.nonzero(near)
    return alive_q[q], v


def near_values(plane: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries that may have a value at distance <= radius, and for each of them 1 at such values, 0 at others.

    All distances of a query grow together: each plane's differing bits are added to bitwise counters by carry-save
    steps, and counters that pass the radius stick. A query's block ends once all its values have passed.
    """
    width = max(1, int(radius).bit_length())
    lanes = plane.shape[1]
    alive_q = np.arange(len(queries))
    counters = np.zeros((width, len(queries), lanes), dtype=U64)
    over = np.zeros((len(queries), lanes), dtype=U64)
    flips = U64(0) - ((queries[:, None] >> np.arange(64, dtype=U64)) & U64(1))  # all ones where a query's bit is 1
    for b in range(64):
        carry = plane[b][None, :] ^ flips[alive_q, b][:, None]
        spare = np.empty_like(carry)
        for k in range(width):
            np.bitwise_and(counters[k], carry, out=spare)
            counters[k] ^= carry
            carry, spare = spare, carry
        over |= carry
        # counters that hold more than the radius
        if b % 8 == 7 or b == 63:
            over |= _above(counters, radius)
            live = (over != ~U64(0)).any(axis=1)
            if not live.all():
                alive_q, over, counters = alive_q[live], over[live], counters[:, live]
            if not len(alive_q):
                break
    if not len(alive_q):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 64 * lanes), dtype=np.uint8)
    return alive_q, np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")


def _above(counters: np.ndarray, radius: int) -> np.ndarray:
    more = np.zeros(counters.shape[1:], dtype=U64)
    same = np.full(counters.shape[1:], ~U64(0), dtype=U64)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same &= counters[k]
        else:
            more |= same & counters[k]
            same &= ~counters[k]
    return more


def links(values: np.ndarray, radius: int, block: int = 256) -> np.ndarray:
    """A forest over indexes of values that joins exactly those that links within the radius join."""
    n = len(values)
    plane, forest = planes(values), Forest(n)
    for i in range(0, n, block):
        q, v = within(plane, values[i : i + block], radius)
        q = q + i
        ok = (v < q) & (v < n)
        forest.add(q[ok], v[ok])
    return forest.links()


#: Tiles of up to so many fingerprints are compared together, pair by pair.
SMALL = 12


def whole_tiles(batches):
    """(tile, value) arrays of complete tiles from batches that are sorted by tile."""
    t, v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        t, v = np.concatenate([t, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()])
        done = np.flatnonzero(t != t[-1])[-1] + 1 if len(t) and (t != t[-1]).any() else 0
        if done:
            yield t[:done], v[:done]
            t, v = t[done:], v[done:]
    if len(t):
        yield t, v


def tile_links(t: np.ndarray, v: np.ndarray, radius: int) -> np.ndarray:
    """Links [n, 2] that join what is within the radius in each tile. Pairs of small tiles of all kinds share bit planes
    of their differing bits; a large tile has planes of its own and gives a forest."""
    begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    size = np.diff(np.append(begin, len(t)))
    small = np.repeat(size <= SMALL, size)
    out = [np.zeros((0, 2), dtype=np.int64)]
    for step in range(1, SMALL):
        i = np.flatnonzero(small[:-step] & (t[:-step] == t[step:])) if step < len(t) else begin[:0]
        for k in range(0, len(i), 1 << 16):
            part = i[k : k + (1 << 16)]
            _, near = within(planes((v[part] ^ v[part + step]).view(U64)), np.zeros(1, dtype=U64), radius)
            part = part[near[near < len(part)]]
            out.append(np.stack([v[part], v[part + step]], axis=1))
    for k in np.flatnonzero(size > SMALL):
        values = np.unique(v[begin[k] : begin[k] + size[k]])
        pairs = links(values.view(U64), radius)
        out.append(values[pairs])
    return np.concatenate(out)


#: Up to so many different fingerprints share buckets by three equal runs of bits, beyond it by four.
FEW = 1 << 24


def near_duplicates(docs: DataFrame, radius: int = 4, keep: int | None = None, shingle: int = 4, tile: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable by links of at most radius bits.

    Equal fingerprints are one node, so groups of copies cost one row. Every pair of fingerprints within the radius
    shares the bits of one of the masks; buckets of equal masked bits are compared by bit planes, hot buckets in tiles,
    and each gives a forest instead of its pairs. keep: how many runs of bits a bucket shares; every choice is exact, more
    runs make buckets smaller and rows more (None: by the number of fingerprints). Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows stay. A row with a null doc_id stays too; its component is that of the others with its links.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    if keep is None:
        keep = 3 if distinct.count() <= FEW else 4
    masks = bit_groups(radius, keep)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("key"),
    )
    repeated = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    dealt = tiles(keyed.join(repeated, "key", "left_semi"), "key", "fp", tile).select(F.xxhash64("tile").alias("tile"), "fp")

    def compare(batches):
        for t, v in whole_tiles(batches):
            pairs = tile_links(t, v, radius)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    edges = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "a long, b long").distinct()
    # components over fingerprints, then the least document of each
    found = materialize(components(edges), "components")
    classes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    classes = materialize(classes, "classes")
    least = classes.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = materialize(classes.join(least, "c").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
