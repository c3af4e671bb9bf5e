"""Vectorised words and hashes over Arrow string columns, shared by the corpus operators.

A word is a maximal run of characters other than space and \\t..\\r. All functions take whole texts;
null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


class Rolling:
    """Polynomial hashes mod 2^64 of short slices of an array of hashes, by prefix sums. One instance serves many arrays.

    For slices of some dozen entries that are well mixed themselves; long runs over few values can collide.
    """

    def __init__(self, seed: int):
        base = int(stream(seed, 1)[0]) | 5
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = -(-n // 4096) * 4096
            with np.errstate(over="ignore"):
                for name, by in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(n, by, dtype=U64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=U64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.up[: len(values)], dtype=U64, out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (prefix[ends] - prefix[starts]) * self.down[starts]
            return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


WORDS = [Rolling(31), Rolling(32)]
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK = 256 << 10
#: Slices of more bytes are hashed one by one.
LONG = 256


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column, without a copy of the bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK):
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of slices of bytes, eight bytes a step, each step mixed in full: not linear in the bytes, so no
    family of texts collides under every seed."""
    size = ends - starts
    padded = np.zeros(len(raw) + 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    lanes = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + stream(seed + 101, 1))
        at = np.arange(len(size))
        step = 0
        while len(at):
            rest = size[at] - 8 * step
            lane = lanes[starts[at] + 8 * step]
            short = rest < 8
            lane[short] &= (U64(1) << (rest[short] * 8).astype(U64)) - U64(1)
            h[at] = mix((h[at] ^ lane) + U64(0x9E3779B97F4A7C15))
            step += 1
            at = at[(size[at] > 8 * step) & (size[at] <= LONG)] if step == 1 else at[rest > 8]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed=(seed * 0x9E3779B1 + 7) & 0xFFFFFFFFFFFFFFFF)
    return h


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (one entry more than rows)."""
    if not len(raw):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    solid = ~WHITE[raw]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    return slice_hashes(raw, starts, ends, seed)


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries; fewer entries: none."""
    if len(words) < k:
        return np.zeros(0, dtype=U64)
    rolling = WORDS[which]
    at = np.arange(len(words) - k + 1)
    return rolling.slices(rolling.prefix(words), at, at + k)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
