import random

import numpy as np

from emberlane.llm import shingles
from emberlane.llm.text import U64, mix, stream


def test_fingerprints_against_their_definition():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(U64)) for n in (0, 1, 2, 5, 255, 256, 1000, 0)]
    got = shingles.fingerprints(sets)
    for s, mine in zip(sets, got):
        for lane, seed in enumerate(stream(51, shingles.LANES)):
            hashes = mix(s ^ seed).tolist()
            assert int(mine[lane]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert shingles.fingerprints([]).shape == (0, shingles.LANES)


def test_chains_within_the_radius_against_brute_force():
    rng = random.Random(5)
    values = []
    for _ in range(60):
        base = rng.getrandbits(256)
        for far in (0, 10, 30, 70, 90):
            values.append(base ^ sum(1 << b for b in rng.sample(range(256), far)))
    rng.shuffle(values)
    lanes = np.array([[v >> 64 * k & (1 << 64) - 1 for k in range(4)] for v in values], dtype=U64)
    for first, radius in ((64, 74), (16, 74), (20, 30), (0, 0)):
        root = list(range(len(values)))
        for a in range(len(values)):
            for b in range(a):
                bits = values[a] ^ values[b]
                if (bits & (1 << 64) - 1).bit_count() <= first and bits.bit_count() <= radius:
                    x, y = sorted((root[a], root[b]))
                    root = [x if r == y else r for r in root]
        assert shingles.chained(lanes, first, radius, block=64, step=48).label.tolist() == root


def test_shared_bits_miss_no_more_than_stated():
    rng = np.random.default_rng(6)
    draw = [rng.integers(0, 1 << 63, 100).astype(U64) for _ in range(2000)]
    a, b = shingles.fingerprints([d[:90] for d in draw]), shingles.fingerprints([d[10:] for d in draw])  # similarity 0.8
    far = np.bitwise_count(a ^ b)
    first, radius = shingles.radii(0.8)
    assert (far[:, 0] <= first).all() and (far.sum(axis=1) <= radius).all()
    for bits in (1, 6, 9, 12):
        masks = shingles.choices(bits, 0.8)
        assert (np.bitwise_count(masks).sum(axis=1) == bits).all()
        assert (shingles.keys_of(a, masks) == shingles.keys_of(b, masks)).any(axis=1).all()


def test_stage_takes_its_candidates_from_fingerprints(spark):
    rng = random.Random(7)
    rows, near = [], {}
    for i in range(0, 60, 3):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
        rows += [(i, " ".join(w)), (i + 1, " ".join(w).upper()), (i + 2, " ".join(w[:100] + ["x"] + w[101:]))]
        near |= {i: i, i + 1: i, i + 2: i}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (None, 6):
        assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, bits=bits).collect()} == near
    # no differing bit allowed: only equal sets are left
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, radius=0).collect()}
    assert got == {d: d if d % 3 == 2 else d - d % 3 for d in got} and len(got) == 60
