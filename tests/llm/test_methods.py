"""The methods themselves: exact sums over whole documents, factors, tables, and results that do not hang on row order."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from emberlane.llm import bpe, quality_rules, substrings, toxicity
from tests.llm.test_llm import labelled


def plain_marginals(emission, trans):
    """P(state 1) and summed pair marginals of one chain, by the textbook recursion."""
    n, t = len(emission), np.exp(trans)
    e = np.stack([np.ones(n), np.exp(emission)], axis=1)
    ahead, after = [e[0]], [np.ones(2)]
    for k in range(1, n):
        ahead.append(ahead[-1] @ t * e[k])
    for k in range(n - 1, 0, -1):
        after.append(t @ (e[k] * after[-1]))
    after.reverse()
    z = ahead[-1].sum()
    pairs = sum((ahead[k - 1][:, None] * t * (e[k] * after[k])[None, :] for k in range(1, n)), np.zeros((2, 2)))
    return np.array([a[1] * b[1] for a, b in zip(ahead, after)]) / z, pairs / z


def test_marginals_run_over_whole_documents(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [0, 7, 1, 3, 12, 0, 40, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    trans = rng.normal(size=(2, 2))
    values = rng.normal(size=first[-1]) * 2
    for width in (3, 32):
        monkeypatch.setattr(toxicity, "CHAIN", width)
        chain, place, valid, begin = toxicity.chains(first)
        emission = np.zeros(valid.shape)
        emission[chain, place] = values
        got, pairs = toxicity.Field.marginals(emission, valid, begin, trans, pairs=True)
        want = [plain_marginals(values[i:j], trans) for i, j in zip(first[:-1], first[1:]) if j > i]
        assert np.allclose(got[chain, place], np.concatenate([w[0] for w in want]))
        assert np.allclose(pairs, sum(w[1] for w in want))
    # by enumeration of all labellings of one document of seven tokens
    v, total, ones = values[:7], 0.0, np.zeros(7)
    for y in itertools.product((0, 1), repeat=7):
        p = math.exp(sum(a * b for a, b in zip(v, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total, ones = total + p, ones + p * np.array(y)
    assert np.allclose(plain_marginals(v, trans)[0], ones / total)


def test_toxicity_scores_do_not_hang_on_row_order(spark):
    docs, labels = labelled(spark)
    here = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    there = {r.doc_id: r.score for r in toxicity.classify(docs.orderBy("doc_id", ascending=False).repartition(7), labels.repartition(5)).collect()}
    assert here == there
    twice = {r.doc_id: r.score for r in toxicity.classify(docs, labels.union(labels)).collect()}
    assert here == twice


def test_null_ids_are_not_held_out_and_int_ids_pass(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, "some words"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in toxicity.score(odd, toxicity.fit(docs, labels)).collect()}
    assert got[None].held_out is False and got[4].predicted == 0
    assert {r.doc_id: r.n_words for r in substrings.remove_repeats(odd).collect()} == {None: 2, 4: 0}
    assert {r.doc_id: r.n_tokens for r in bpe.tokenize_roundtrip(odd).collect()} == {None: 2, 4: 0}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_fool_polynomials_stay(spark):
    word, other = thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba"))
    same = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(same[:10] + [word] + same[10:])), (2, " ".join(same[:10] + [other] + same[10:]))]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_factors_point_at_equal_words(spark):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) for _ in range(12)]
    for k in range(30):  # pieces of several texts, one after another
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(texts).split()
            at = rng.randrange(max(1, len(w) - 30))
            parts += w[at : at + rng.randint(15, 60)]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    long = 0
    for r in substrings.remove_repeats(docs).collect():
        w, gone = texts[r.doc_id].split(), set()
        for f in r.factors or []:
            source = texts[f.doc_id].split()[f.word : f.word + f.to - f["from"]]
            assert w[f["from"] : f.to] == source and len(source) >= 20 and (f.doc_id, f.word) < (r.doc_id, f["from"])
            gone |= set(range(f["from"], f.to))
            long += len(source) > 34
        assert len(gone) == r.n_removed
        assert hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest() == r.kept_sha256
    assert long > 5


@pytest.mark.parametrize("place", [24, 62, 4])
def test_repeated_windows_where_codes_clash_or_are_too_short(spark, monkeypatch, place):
    monkeypatch.setattr(quality_rules, "PLACE", place)
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 30, 120)] + [" ".join(f"u{i}" for i in range(80)), None, "x y z x y z", "a a a a"]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.line_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)})


def test_gadgets_close_what_the_merges_forbid(tmp_path):
    """Every word over a small alphabet is read as the merges would join it, merge by merge."""
    import json

    rng = random.Random(2)
    for trial in range(20):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 7:
                tokens.append(u + v)
                merges.append((u, v))
        alphabet = [c for c in bpe.byte_letters() if c not in tokens]
        vocab = {t: i for i, t in enumerate(tokens + alphabet)}
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": [f"{u} {v}" for u, v in merges]}}))
        machine = bpe.Automaton(str(path))
        for n in range(1, 9):
            for _ in range(60):
                word = [rng.choice("abc") for _ in range(n)]
                want = list(word)
                for u, v in merges:
                    out, i = [], 0
                    while i < len(want):
                        if i + 1 < len(want) and (want[i], want[i + 1]) == (u, v):
                            out.append(u + v)
                            i += 2
                        else:
                            out.append(want[i])
                            i += 1
                    want = out
                assert machine.read("".join(word).encode()) == [vocab[t] for t in want], (merges, word)
