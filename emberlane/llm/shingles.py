"""Near-duplicates by Jaccard similarity of word shingles: SimHash fingerprints of the shingle sets within a radius, found
by shared bits and bit-sliced counters, give candidates; exact sets verify them."""

from __future__ import annotations

from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.groups import Forest, components, tiles
from emberlane.llm.simhash import near_values, planes
from emberlane.llm.text import U64, WORDS, blocks, buffers, mix, stream, word_bounds, word_hashes
from emberlane.session import materialize, release

#: Words of a fingerprint: 256 bits tell a similarity of 0.8 from chance where 64 do not.
LANES = 4
BITS = 64 * LANES
#: Pairs at the least similarity that the shared bits may miss.
MISS = 3e-5
#: Fingerprints share as few bits as keep a bucket of unrelated ones below this.
BUCKET = 4096
PRINT = [f"f{i}" for i in range(LANES)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int):
    """The sorted distinct hashes of each row's shingles of k words after lower-casing A-Z; fewer words are one shingle,
    no words are none."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends)
    prefix = WORDS[0].prefix(words)
    for i, j in zip(first[:-1], first[1:]):
        at = np.arange(i, max(i + 1, j - k + 1)) if j > i else np.zeros(0, dtype=np.int64)
        yield np.unique(WORDS[0].slices(prefix, at, np.minimum(at + k, j)))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash [sets, LANES] of sets of hashes: a bit is 1 if it is set in over half of the set's hashes, which each lane
    mixes anew; 0 for an empty set."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((len(sets), LANES), dtype=U64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    values, size = np.concatenate(sets), size[full]
    # a byte counts one bit of up to 255 hashes, so eight bits are summed in a word
    pieces = -(-size // 255)
    first = np.cumsum(pieces) - pieces
    begin = np.repeat(np.cumsum(size) - size, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for lane, seed in enumerate(stream(51, LANES)):
        h = mix(values ^ seed)
        for b in range(8):
            counts = np.add.reduceat((h >> U64(b)) & U64(0x0101010101010101), begin)
            ones = np.add.reduceat((counts[:, None] >> np.arange(0, 64, 8, dtype=U64)) & U64(255), first, axis=0)
            major = (2 * ones > size[:, None].astype(U64)).astype(U64)
            out[full, lane] |= (major << np.arange(b, 64, 8, dtype=U64)).sum(axis=1, dtype=U64)
    return out


def chance(least: float) -> float:
    """Chance that two sets of this Jaccard similarity differ in a bit: by the angle between sets of equal size, the widest."""
    return acos(2 * least / (1 + least)) / pi


def radii(least: float) -> tuple[int, int]:
    """Most differing bits of the first lane, 4.5 deviations above the mean, and of all, 4 above the mean of a chance
    raised by a quarter, since sums of few shingles differ more often than the angle says (4 and 5 shingles: 3/16)."""
    p = chance(least)
    return tuple(ceil(n * q + by * sqrt(n * q * (1 - q))) for n, q, by in ((64, p, 4.5), (BITS, 1.25 * p, 4)))


def tables(bits: int, least: float) -> int:
    """How many choices of so many bits it takes for a pair at the least similarity to agree on one, but for MISS."""
    p, n = chance(least), 1
    odds = [(comb(BITS, d) * p**d * (1 - p) ** (BITS - d), comb(BITS - d, bits) / comb(BITS, bits)) for d in range(BITS + 1)]
    while sum(w * (1 - hit) ** n for w, hit in odds) > MISS:
        n += 1
    return n


def choices(bits: int, least: float) -> np.ndarray:
    """Masks [tables, LANES] of so many bits each; those of one shuffling of the bits are disjoint."""
    n, rng, out = tables(bits, least), np.random.default_rng(53), []
    while len(out) < n:
        order = rng.permutation(BITS)
        out += [order[i * bits : (i + 1) * bits] for i in range(BITS // bits if bits else 1)]
    masks = np.zeros((n, LANES), dtype=U64)
    for mask, places in zip(masks, out):
        np.bitwise_or.at(mask, places // 64, U64(1) << (places % 64).astype(U64))
    return masks


def keys_of(prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Bucket keys [prints, tables]."""
    out = np.zeros((len(prints), len(masks)), dtype=U64)
    with np.errstate(over="ignore"):
        for t, mask in enumerate(masks):
            key = np.full(len(prints), t + 1, dtype=U64)
            for lane in range(LANES):
                key = mix(key * U64(0x9E3779B97F4A7C15) + (prints[:, lane] & mask[lane]))
            out[:, t] = key
    return out


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, digest of the shingle set, and the lanes of its fingerprint (null for no words)."""

    def hashed(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for i, j in blocks(offsets):
                sets = list(shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k))
                digests = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=U64)
                none, prints = np.array([not len(s) for s in sets]), fingerprints(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(digests.view(np.int64))] + [pa.array(np.ascontiguousarray(p), mask=none) for p in prints.T],
                    names=["doc_id", "digest"] + PRINT,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, digest long, " + ", ".join(f"{p} long" for p in PRINT))


def bucketed(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """A row for each node and table: key, digest and fingerprint."""

    def keyed(batches):
        for batch in batches:
            prints = np.stack([batch.column(1 + i).to_numpy() for i in range(LANES)], axis=1).view(U64)
            keys = keys_of(prints, masks).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * len(masks), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [lists], names=["digest"] + PRINT + ["keys"])

    made = nodes.select("digest", *PRINT).mapInArrow(keyed, "digest long, " + ", ".join(f"{p} long" for p in PRINT) + ", keys array<long>")
    return made.select(F.explode("keys").alias("key"), "digest", *PRINT)


def whole_groups(batches):
    """Rows [n, columns] of one value of the first column each, from batches of longs that are sorted by it."""
    held = None
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        cuts = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1])
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield rows[a:b]
        held = rows[cuts[-1] :]
    if held is not None and len(held):
        yield held


def chained(prints: np.ndarray, first: int, radius: int, block: int = 256, step: int = 512) -> Forest:
    """What links of at most radius bits join. Bit-sliced counters over the first lane leave the pairs within its own
    radius; the others' bits are counted for those that nothing joins yet."""
    n, lanes = len(prints), np.ascontiguousarray(prints.T)
    plane, forest = planes(lanes[0]), Forest(n)
    for i in range(0, n, block):
        most = min(i + block, n)
        q, near = near_values(plane[:, : -(-most // 64)], lanes[0, i:most], first)
        q = q + i
        for at in range(0, most if len(q) else 0, step):
            upto = min(at + step, most)
            new = near[:, at:upto].view(bool) & (forest.label[q][:, None] != forest.label[None, at:upto])
            a, b = np.divmod(np.flatnonzero(new), upto - at)
            a, b = q[a], b + at
            a, b = a[b < a], b[b < a]
            ok = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in lanes) <= radius
            forest.add(a[ok], b[ok])
    return forest


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """digest, set (bytes of the sorted hashes)."""

    def hashed(batches):
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for i, j in blocks(offsets):
                sets = [s.tobytes() for s in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)]
                digests = np.array([xxhash.xxh64_intdigest(s) for s in sets], dtype=U64)
                yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), pa.array(sets, pa.binary())], names=["digest", "set"])

    return docs.select("text").mapInArrow(hashed, "digest long, set binary")


def similar(ids: np.ndarray, sets: list[np.ndarray], least: float) -> np.ndarray:
    """Links [n, 2] of ids that join exactly what chains of pairs of at least this similarity join. Pairs that are joined
    already are not compared."""
    n = len(ids)
    size = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begin, forest, mark = np.cumsum(size) - size, Forest(n), np.zeros(codes.max() + 1, dtype=bool)
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero((forest.label[i + 1 :] != forest.label[i]) & (np.minimum(size[i + 1 :], size[i]) >= least * np.maximum(size[i + 1 :], size[i]) - 1e-9))
        if len(rest):
            mine = codes[begin[i] : begin[i] + size[i]]
            mark[mine] = True
            span = np.repeat(begin[rest] - (np.cumsum(size[rest]) - size[rest]), size[rest]) + np.arange(size[rest].sum())
            both = np.add.reduceat(mark[codes[span]].astype(np.int64), np.cumsum(size[rest]) - size[rest])
            mark[mine] = False
            near = rest[both >= least * (size[i] + size[rest] - both) - 1e-9]
            forest.add(np.full(len(near), i), near)
    return ids[forest.links()]


def near_duplicates(docs: DataFrame, least: float = 0.8, k: int = 5, tile: int = 512, radius: int | None = None, bits: int | None = None) -> DataFrame:
    """doc_id, component_id: the least doc_id reachable by links of at least this Jaccard similarity of k-word shingles.

    Equal sets are one node, so copies cost one row. Fingerprints that agree on a choice of bits are compared, hot
    buckets in tiles, and what chains of at most radius differing bits join (None: by the similarity) are candidates;
    each group of candidates is compared exactly, large ones in tiles, and each tile gives a forest instead of its pairs.
    bits: how many bits a bucket shares (None: by the number of nodes; up to 4,096 nodes none, so all meet); more bits
    take more choices. Texts without words, null too, are one group. Rows that repeat a doc_id each keep their text's
    group; rows without doc_id link, but name a group only if it has no other. Extra columns are ignored, whatever they
    are called; an empty table gives no rows.
    """
    first, wide = radii(least)
    radius = wide if radius is None else radius
    made = materialize(profiles(docs, k), "profiles")
    nodes = materialize(made.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(p).alias(p) for p in PRINT]), "nodes")
    worded = nodes.where(F.col(PRINT[0]).isNotNull()).select("digest", *PRINT)
    if bits is None:
        bits = max(0, ceil(log2(max(1, worded.count()) / BUCKET)))

    def link(batches):
        for rows in whole_groups(batches):
            pairs = rows[:, 1][chained(rows[:, 2:].view(U64), first, radius).links()]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def gather(batches):
        for rows in whole_groups(batches):
            root = chained(rows[:, 2:].view(U64), first, radius).label
            alike = np.bincount(root, minlength=len(rows))[root] > 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[alike, 0]), pa.array(rows[root[alike], 1]), pa.array(rows[alike, 1])], names=["tile", "root", "digest"])

    def dealt(rows, key, most):
        out = tiles(rows, key, "digest", most).select(F.xxhash64("tile").alias("tile"), "digest", *PRINT)
        return out.repartition("tile").sortWithinPartitions("tile")

    near = dealt(bucketed(worded, choices(bits, least)), "key", 16 * tile).mapInArrow(link, "a long, b long").distinct()
    near = materialize(components(near), "near")
    # groups of candidates; in a group of many tiles only what has a candidate in the tile is compared
    grouped = worded.join(near.withColumnRenamed("node", "digest"), "digest")
    grouped = dealt(grouped, "component", tile).mapInArrow(gather, "tile long, root long, digest long")
    grouped = materialize(grouped.select(F.xxhash64("tile", "root").alias("tile"), "digest"), "grouped")
    release(near)
    # sets are made again for one document of each node that is compared; repeated ids may bring others, which no digest meets
    met = nodes.join(grouped.select("digest").distinct(), "digest", "left_semi").select(F.col("rep").alias("_rep")).distinct()
    sets = materialize(sets_of(docs.select("doc_id", "text").join(met, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi"), k).dropDuplicates(["digest"]), "sets")
    grouped = grouped.join(sets, "digest").select("tile", "digest", "set")

    def compare(batches):
        held, ids, sets = None, [], []
        for batch in batches:
            for t, d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if t != held and ids:
                    yield linked(ids, sets)
                    ids, sets = [], []
                held = t
                ids.append(d)
                sets.append(np.frombuffer(s.as_py(), dtype=U64))
        if ids:
            yield linked(ids, sets)

    def linked(ids, sets):
        pairs = similar(np.array(ids, dtype=np.int64), sets, least)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    edges = grouped.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "a long, b long").distinct()
    found = components(edges)
    classes = nodes.select("digest", "rep").join(found.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "rep", F.coalesce("component", "digest").alias("c"))
    classes = materialize(classes, "classes")
    least_of = classes.groupBy("c").agg(F.min("rep").alias("component_id"))
    return made.select("doc_id", "digest").join(classes.join(least_of, "c").select("digest", "component_id"), "digest").select("doc_id", "component_id")
