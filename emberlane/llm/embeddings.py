"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.llm.groups import Forest, components, tiles
from emberlane.llm.text import U64, mix, stream
from emberlane.session import materialize

#: Tables, hashes joined to a table's key, and how many further buckets of each table a vector looks into.
TABLES, JOINED, PROBES = 8, 2, 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation up to scale: three rounds of sign flips and the transform."""
    for k in range(3):
        signs = (stream(1000 + 3 * seed + k, x.shape[1]) >> U64(63)).astype(np.float32) * 2 - 1
        x = hadamard(x * signs) / np.float32(np.sqrt(x.shape[1]))
    return x


def hashes(unit: np.ndarray, tables: int = TABLES, joined: int = JOINED, probes: int = PROBES) -> np.ndarray:
    """Keys [vectors, tables, 1 + probes]: the vector's own bucket, then those that it would fall in next.

    A hash is the nearest of the axes' two ends. A probe takes the second nearest end in one of the joined hashes, least
    loss first, then in all of them.
    """
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size), dtype=np.float32)
    x[:, :d] = unit
    out = np.zeros((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        best, second, loss = [], [], []
        for k in range(joined):
            y = rotate(x, t * joined + k)
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.take_along_axis(y, top, axis=1)
            flip = np.abs(value[:, 1]) > np.abs(value[:, 0])
            top[flip], value[flip] = top[flip][:, ::-1], value[flip][:, ::-1]
            end = 2 * top + (value < 0)
            best.append(end[:, 0])
            second.append(end[:, 1])
            loss.append(np.abs(value[:, 0]) - np.abs(value[:, 1]))
        best, second, loss = np.stack(best, 1), np.stack(second, 1), np.stack(loss, 1)
        order = np.argsort(loss, axis=1, kind="stable")
        changes = [np.zeros((n, joined), dtype=bool)]
        for p in range(probes):
            change = np.zeros((n, joined), dtype=bool)
            if p < joined:
                np.put_along_axis(change, order[:, p : p + 1], True, axis=1)
            else:
                change[:] = True
            changes.append(change)
        for p, change in enumerate(changes):
            code = np.zeros(n, dtype=U64)
            for k in range(joined):
                code = code * U64(2 * size) + np.where(change, second, best)[:, k].astype(U64)
            out[:, t, p] = mix(code + stream(t + 77 + 1000 * d, 1)).view(np.int64)
    return out


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as doubles of length 1, and as they are hashed."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scale = np.abs(values).max(axis=1, keepdims=True)
    values = values / scale
    unit = values / np.sqrt((values * values).sum(axis=1, keepdims=True))
    return unit, unit.astype(np.float32)


def by_length(batch: pa.RecordBatch, column: int):
    """Parts of a batch whose vectors have one length."""
    size = np.asarray(pc.list_value_length(batch.column(column)))
    for d in np.unique(size):
        yield batch.take(pa.array(np.flatnonzero(size == d)))


#: Tiles of up to so many rows are compared together, pair by pair; larger ones as matrices.
SMALL = 24


def whole_tiles(batches):
    """Tables of complete tiles from batches that are sorted by tile."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([held, part]).combine_chunks() if held is not None else part
        tile = part["tile"].to_numpy()
        other = np.flatnonzero(tile != tile[-1])
        done = int(other[-1]) + 1 if len(other) else 0
        if done:
            yield part.slice(0, done)
        held = part.slice(done)
    if held is not None:
        yield held


def first_meeting(x: np.ndarray, y: np.ndarray, t: np.ndarray, own_x: np.ndarray, own_y: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) of rows meet in table t for the first time.

    Pairs by their own keys come before those by a probe, and tables in order; if both probe each other's bucket in one
    table, the one of the smaller id counts. Pairs of two probes do not count.
    """
    swap = own_x & ~own_y
    x, y = np.where(swap, y, x), np.where(swap, x, y)  # y looks by its own key
    both = own_x & own_y
    ok = own_x | own_y
    for k in range(keys.shape[1]):
        ok &= ~((keys[x, k, 0] == keys[y, k, 0]) & ((k < t) | ~both))
    probe = np.flatnonzero(ok & ~both)
    a, b, at = x[probe], y[probe], t[probe]
    seen = np.zeros(len(probe), dtype=bool)
    for k in range(keys.shape[1]):
        back = (keys[b, k, 1:] == keys[a, k, 0][:, None]).any(axis=1)
        ahead = (keys[a, k, 1:] == keys[b, k, 0][:, None]).any(axis=1)
        seen |= ((back | ahead) & (k < at)) | (back & (k == at) & (ids[b] < ids[a]))
    ok[probe[seen]] = False
    return ok


def matches(rows: pa.Table, least: float):
    """(ids, links, pairs) of tables of tiles of vectors of one length: link counts by row and linking index pairs."""
    tile, ids, weight, t = (rows[c].to_numpy() for c in ("tile", "rep", "n", "table"))
    own, cross = (rows[c].to_numpy(zero_copy_only=False) for c in ("own", "cross"))
    chunk = rows["chunk"].to_numpy()
    unit, small_unit = units(rows["embedding"].combine_chunks())
    known, first, where = np.unique(ids, return_index=True, return_inverse=True)
    keys = hashes(small_unit[first])[where]
    links, pairs = np.zeros(len(ids), dtype=np.int64), [np.zeros((0, 2), dtype=np.int64)]

    def count(x, y):
        ok = (ids[x] != ids[y]) & (~cross[x] | (chunk[x] != chunk[y]))
        x, y = x[ok], y[ok]
        ok = first_meeting(x, y, t[x], own[x], own[y], ids, keys)
        x, y = x[ok], y[ok]
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        return x, y

    begin = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    size = np.diff(np.append(begin, len(tile)))
    little = np.repeat(size <= SMALL, size)
    for step in range(1, min(SMALL, len(tile))):
        x = np.flatnonzero(little[:-step] & (tile[:-step] == tile[step:]))
        if len(x):
            x = x[np.einsum("ij,ij->i", unit[x], unit[x + step]) >= least]
            pairs.append(np.stack(count(x, x + step), axis=1))
    for k in np.flatnonzero(size > SMALL):
        at = np.arange(begin[k], begin[k] + size[k])
        bases = at[own[at]]
        forest = Forest(len(at))
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            near = unit[part] @ unit[bases].T >= least
            near &= (part[:, None] < bases[None, :]) | ~own[part][:, None]
            # the cheap half of first_meeting for all at once: by own keys
            for j in range(keys.shape[1]):
                if not near.any():
                    break
                near &= ~((keys[part, j, 0][:, None] == keys[bases, j, 0][None, :]) & ((j < t[part[0]]) | ~own[part][:, None]))
            q, v = np.nonzero(near)
            x, y = count(part[q], bases[v])
            forest.add(x - begin[k], y - begin[k])
        pairs.append(forest.links() + begin[k])
    return ids, links, np.concatenate(pairs)


def near_duplicates(rows: DataFrame, least: float = 0.95, tile: int = 1024) -> DataFrame:
    """vec_id, n_links (other vectors at cosine >= least), component_id (least vec_id reachable), kept.

    All rows against all, whatever their labels. Vectors that are null, empty, zero or hold null or non-finite parts, and
    rows without vec_id, link with nothing; vectors of different lengths do not meet. Equal vectors are one node with a
    count. Vectors that share a bucket of some table, by their own key or a probe, are compared in double precision, hot
    buckets in tiles; each linked pair is counted in the first bucket where it meets, and a tile returns counts and a
    forest instead of pairs. Repeated rows count as vectors of their own.
    """
    rows = rows.select("vec_id", "embedding")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    valid = rows.where(usable)
    nodes = materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vectors")

    def buckets(batches):
        for batch in batches:
            for part in by_length(batch, 0):
                keys = hashes(units(part.column(0))[1])
                n, tables, each = keys.shape
                at = np.repeat(np.arange(n), tables * each)
                role = np.tile(np.arange(tables * each), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(role // each, pa.int32()), pa.array(role % each == 0), part.column(1).take(pa.array(at))], names=["key", "table", "own", "rep"]
                )

    dealt = nodes.select("embedding", "rep").mapInArrow(buckets, "key long, table int, own boolean, rep long")
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("o")).where("c > 1 AND o").select("key")
    dealt = dealt.join(materialize(shared, "buckets"), "key", "left_semi")
    placed = materialize(tiles(dealt, "key", "rep", tile), "tiles")
    met = placed.join(nodes, "rep").select(
        F.xxhash64("tile").alias("tile"), F.expr("element_at(split(tile, ':'), -1) <> element_at(split(tile, ':'), -2)").alias("cross"), "chunk", "table", "own", "rep", "n", "embedding"
    )

    def compare(batches):
        for part in whole_tiles(batches):
            size = np.asarray(pc.list_value_length(part["embedding"]))
            for d in np.unique(size):
                ids, links, pairs = matches(part.take(pa.array(np.flatnonzero(size == d))).combine_chunks(), least)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[some], ids[pairs[:, 0]]])),
                        pa.array(np.concatenate([ids[some], ids[pairs[:, 1]]])),
                        pa.array(np.concatenate([links[some], np.zeros(len(pairs), dtype=np.int64)])),
                    ],
                    names=["a", "b", "links"],
                )

    sorted_tiles = met.repartition("tile").sortWithinPartitions("tile")
    found = materialize(sorted_tiles.mapInArrow(compare, "a long, b long, links long"), "matches")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    parts = components(found.where("a != b").select("a", "b")).withColumnRenamed("node", "rep")
    named = nodes.join(counts, "rep", "left").join(parts, "rep", "left").select(
        "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    named = materialize(named, "named")
    linked = valid.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
