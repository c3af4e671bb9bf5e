"""Searches by hashing against brute force: embeddings with planted near pairs, licenses, and the ordinal model."""

import random

import numpy as np

from emberlane.llm import embeddings, licenses, packing, quality_model, simhash
from tests.llm.test_llm import labelled


def test_embedding_recall_of_planted_pairs(spark):
    """Two thousand pairs at cosines from 0.95 to 1 among vectors that resemble nothing: recall as shipped."""
    rng, d = np.random.default_rng(0), 64
    base = rng.normal(size=(2000, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.9999, size=(2000, 1))
    near = cosine * base + np.sqrt(1 - cosine**2) * side
    vectors = np.concatenate([base, near])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found, there = sum(r.n_links for r in got.values()), int(close.sum())
    assert there >= 4000 and found <= there and found / there > 0.99
    assert all(r.n_links <= close[i].sum() and r.component_id <= i for i, r in got.items())


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and c.isalnum() or ord(c) > 127:
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out


def test_licenses_equal_brute_force(spark):
    """Which templates stand in a text: each run of a template's length is tried for each template."""
    rng = random.Random(6)
    filler = [f"word{i}" for i in range(50)]
    texts = [None, "", "MIT License", "short"]
    for name, body in licenses.TEMPLATES:
        words = body.split()
        texts.append(" ".join(rng.choices(filler, k=9) + words + rng.choices(filler, k=7)))
        broken = list(words)
        for k in range(0, len(broken), 3):  # too broken to be the notice
            broken[k] = "zzz"
        texts.append(" ".join(rng.choices(filler, k=3) + broken))
        if len(words) > 30:  # one changed word of many
            changed = list(words)
            changed[2] = "zzz"
            texts.append(" ".join(changed))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    sets = [(n, set(grams(plain_words(b)))) for n, b in licenses.TEMPLATES]
    want = set()
    for i, t in enumerate(texts):
        g = grams(plain_words(t))
        for name, s in sets:
            width = 2 * len(s) + 5
            if any(len(set(g[k : k + width]) & s) >= 0.8 * len(s) for k in range(max(1, len(g)))):
                want.add((i, name))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # of notices that overlap one stays, so each found one is right, and each text with a notice has one
    assert got <= want and {i for i, _ in got} == {i for i, _ in want} and len({n for _, n in got}) > 10


def test_link_equals_plain_sums(spark):
    """Scores of the ordinal model against a sum over words in plain Python, and a likelihood that its fit lowers."""
    docs, labels = labelled(spark)
    model = quality_model.fit(docs, labels)
    for r in quality_model.score(docs, model).join(docs, "doc_id").limit(40).collect():
        eta, n = 0.0, 0
        for w in (r.text or "").encode().split():
            raw = np.frombuffer(w, dtype=np.uint8)
            eta += float(model.weights[quality_model.features(raw, np.array([0]), np.array([len(raw)]))[0]].sum())
            n += 1
        p = 1 / (1 + np.exp(model.thresholds - eta / max(1, n)))
        assert abs(p[-1] - r.tail_probability) < 1e-6 and abs(p.sum() - r.expected_grade) < 1e-6 and r.kept == (r.tail_probability >= 0.5)
    again = quality_model.fit(docs.orderBy("text").repartition(5), labels.union(labels))
    assert np.array_equal(model.weights, again.weights)


def test_rows_that_repeat_an_id_stay(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, ""), (None, None), (None, "x"), (2, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()) == [(1, 1), (1, 1), (2, 1)]
    assert simhash.near_duplicates(docs).count() == 6 == packing.pack_documents(docs, group=2).count()
    for keep in (3, 4):
        assert {r.component_id for r in simhash.near_duplicates(docs, keep=keep).where("doc_id = 2").collect()} == {1}
