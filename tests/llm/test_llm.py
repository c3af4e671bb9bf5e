import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from emberlane.llm import bpe, embeddings, lengths, licenses, packing, quality_model, quality_rules, simhash, substrings, toxicity
from emberlane.llm.text import buffers

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi omicron pi rho sigma tau upsilon".split()
ODD = [None, "", " \t\n", "a", "x " * 400, "É été 日本語 😀 don't '' 's", "<|endoftext|> a<|endoftext|>", "word\x0bword\x0cword\rword", "long" * 30000]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(5, 160)) for _ in range(40)]
    passage = prose(rng, 70)
    out = list(ODD) + base + base[:6]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    out += [b.replace("alpha", "Alpha", 1) + " tail" for b in base[6:12]]
    out.append(passage + " " + passage)
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id < 0")


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def split(t):
    return (t or "").encode().split()


def test_substrings_equal_brute_force(docs, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w, gone = split(t), [False] * len(split(t))
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = rows_of(substrings.remove_repeats(docs))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 400
    for k, r in got.items():
        assert sum(s["to"] - s["from"] for s in r.removed or []) == r.n_removed


def test_substrings_of_repeated_rows_and_nothing(spark, docs, nothing):
    assert substrings.remove_repeats(nothing).count() == 0
    t = prose(random.Random(1), 60)
    d = spark.createDataFrame([(1, t), (2, t), (2, t), (None, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(d).collect()) == [(0, 0), (1, 0), (2, 60), (2, 60)]
    left = substrings.drop_repeats(d)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1]
    more = spark.createDataFrame([(1, t, 7, "a"), (2, t + " more words", 7, "b"), (2, t + " more words", 7, "b")], "doc_id long, text string, n_words int, kept_text string")
    got = sorted(tuple(r) for r in substrings.drop_repeats(more).collect())
    assert got == [(1, t, 7, "a"), (2, "more words", 7, "b"), (2, "more words", 7, "b")]


def union(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if z in (x, y) else z for z in label]
    return label


def test_simhash_equals_brute_force(docs, texts):
    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fingerprint(t) for t in texts]
    label = union(len(f), [(a, b) for a in range(len(f)) for b in range(a) if bin(f[a] ^ f[b]).count("1") <= 4])
    got = rows_of(simhash.near_duplicates(docs))
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {i: ("%016x" % f[i], label[i]) for i in range(len(f))}


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_planes_count_distances(radius):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 2**63, 150, dtype=np.uint64)
    v[75:] = v[:75] ^ (np.uint64(1) << rng.integers(0, 63, 75).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 75).astype(np.uint64))
    q, x = simhash.within(simhash.planes(v), v, radius)
    got = {(int(a), int(b)) for a, b in zip(q, x) if b < len(v)}
    assert got == {(i, j) for i in range(150) for j in range(150) if bin(int(v[i] ^ v[j])).count("1") <= radius}


def test_masks_cover_the_radius():
    rng = random.Random(4)
    masks = simhash.bit_groups(4, 3)
    for _ in range(300):
        x = 0
        for b in rng.sample(range(64), 4):
            x |= 1 << b
        assert any(not x & m for m in masks)


def test_large_tiles_are_split(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    d = d.withColumn("text", F.concat_ws(" ", "text", *[F.lit(f"w{i}") for i in range(300)], F.col("doc_id").cast("string")))
    got = simhash.near_duplicates(d, tile=16)
    assert got.select("component_id").distinct().count() == 1


def cases(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(x) for x in base[i % 30] + rng.normal(size=16) * (0.12 if i >= 30 else 0)]) for i in range(110)]
    rows += [(200 + i, rows[3][1]) for i in range(4)] + [(300, [0.0] * 16), (301, None), (302, [float("nan")] * 16), (303, []), (304, [1.0, None]), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] * 16)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_embeddings_equal_brute_force(spark):
    rows, df = cases(spark)
    good = {i: np.array(v, dtype=float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, _ in rows}
    for i, a in good.items():
        for j, b in good.items():
            if i != j and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i].add(j)
    label = {i: i for i in links}
    for _ in links:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    for tile in (1024, 8):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=tile).collect()}
        assert got == {i: (len(links[i]), label[i], label[i] == i) for i in links}
    assert embeddings.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_quality_rules(spark, docs, texts, nothing):
    got = rows_of(quality_rules.line_rules(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, x in enumerate(g) if g.count(x) > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (len(w), len(lines) - len(set(lines)), len(hit))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.line_rules(nothing).count() == 0


def test_line_rules_drop_bad_lines(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    d = spark.createDataFrame([(1, good + "\nHome | About | Contact | Login\nWe use cookies."), (2, "\n".join(f"{x} *** ### $$$ %%%" for x in good.split()))], "doc_id long, text string")
    got = rows_of(quality_rules.line_rules(d))
    assert got[1].kept and got[1].clean_text == good and not got[2].kept


def labelled(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        bad, low = i % 4 == 0, i % 5 == 0
        w = prose(rng, 60).split()
        if bad:
            for k in rng.sample(range(60), 4):
                w[k] = rng.choice(["Vilewordish", "vileworden", "nastything!"])
        if low:
            w = [x + "%%%" for x in w]
        rows.append((i, " ".join(w), int(not low), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")


def test_toxicity_on_the_held_out_fold(spark, nothing):
    docs, labels = labelled(spark)
    got = toxicity.classify(docs, labels).join(labels, "doc_id").join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and len(held) > 60
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97
    for r in held:
        for s in r.spans:
            assert r.text[s["from"] : s["to"]].lower().startswith(("vileword", "nastything"))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, toxicity.fit(docs, labels)).collect())
    assert toxicity.classify(nothing, labels).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    emission, trans, n = rng.normal(size=(2, toxicity.CHAIN)), rng.normal(size=(2, 2)), 5
    valid = np.zeros((2, toxicity.CHAIN), dtype=bool)
    valid[0, :n] = valid[1, :1] = True
    got = toxicity.Field.marginals(emission, valid, np.array([0, 1, 2]), trans)
    total, ones = 0.0, np.zeros(n)
    for m in range(2**n):
        y = [m >> k & 1 for k in range(n)]
        p = math.exp(sum(emission[0, k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
        total += p
        ones += p * np.array(y)
    assert np.allclose(got[0, :n], ones / total) and np.allclose(got[1, 0], 1 / (1 + math.exp(-emission[1, 0])))


def test_quality_model(spark, nothing):
    docs, labels = labelled(spark)
    got = quality_model.classify(docs, labels).join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.97
    model = quality_model.fit(docs, labels)
    assert quality_model.keep(docs, model).count() == sum(r.kept for r in got)
    assert quality_model.classify(nothing, labels).count() == 0


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 600)
    rows, index = np.repeat(np.arange(600), 2), np.stack([grade, 10 + rng.integers(0, 5, 600)], 1).ravel()
    model = quality_model.CumulativeLink.fit(rows, index, np.ones(1200), grade, 4)
    assert (np.diff(model.thresholds) > 0).all()
    eta = np.bincount(rows, weights=model.weights[index], minlength=600)
    tails = model.tails(eta)
    assert np.corrcoef(tails.sum(axis=1), grade)[0, 1] > 0.95 and (np.diff(tails, axis=1) <= 0).all()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


def test_automaton_equals_the_library(docs, texts, library):
    got = rows_of(bpe.tokenize_roundtrip(docs))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())


def test_random_strings_encode_alike(library):
    rng = random.Random(8)
    encoder = bpe.automaton_encoder(bpe.vocabulary_path())
    for _ in range(3000):
        t = "".join(rng.choice("aeinorst  -=!.'\n\té日0123") for _ in range(rng.randint(1, 40)))
        raw, offsets = buffers(pa.array([t]))
        assert encoder.block(raw, offsets)[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_length_histogram(docs, texts, library, nothing):
    n = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in texts)
    hist = lengths.length_histogram(docs)
    for r in hist.collect():
        k = r.n_tokens
        assert r.n_docs == n.count(k) and r.docs_le == sum(x <= k for x in n) and r.docs_ge == sum(x >= k for x in n)
        assert r.tokens_le == sum(x for x in n if x <= k) and r.truncated_total == sum(min(x, k) for x in n)
        assert r.truncated_docs == sum(x > k for x in n) and abs(r["quantile"] - r.docs_le / len(n)) < 1e-12
    assert hist.agg(F.sum("n_docs")).first()[0] == len(texts)
    got = {r.context: (r.kept_tokens, r.cut_docs) for r in lengths.at_limits(hist, [1, 50, 10**6]).collect()}
    assert got == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in (1, 50, 10**6)}
    assert lengths.quantiles(hist, [0.5]).first().n_tokens == n[(len(n) + 1) // 2 - 1]
    assert lengths.length_histogram(nothing).count() == 0


def test_packing(docs, texts, library, nothing):
    got = packing.pack_documents(docs, group=20).collect()
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        at = 0
        for start, length, crc, total in parts:
            assert start == at and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(nothing).count() == 0


def test_best_fit_equals_a_plain_search():
    rng = random.Random(6)
    n = np.array(sorted((rng.randint(1, 64) for _ in range(300)), reverse=True))
    window, offset = packing.best_fit_decreasing(n, 64)
    rest = []
    for x in n:
        fits = [r for r in rest if r >= x]
        if fits:
            rest[rest.index(min(fits))] -= x
        else:
            rest.append(64 - x)
    used = np.bincount(window, weights=n)
    assert sorted(64 - used) == sorted(rest)


def test_licenses(spark, nothing):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = dict((name, t) for name, t in licenses.TEMPLATES if len(t) > 100)["MIT"]
    d = spark.createDataFrame(
        [(1, "Some words before. " + apache + "\nAnd after it."), (2, "x y z " * 50 + mit.upper().replace("TO DEAL", "AND DEAL") + " more"), (3, "nothing to see in this text, licensed or not"), (4, None), (5, "")],
        "doc_id long, text string",
    )
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert set(got) == {1, 2} and got[1].license == "Apache-2.0" and got[2].license == "MIT"
    text = "Some words before. " + apache
    assert text[got[1].from_char : got[1].to_char] == apache.rstrip(".") and got[1].containment == 1.0 and 0.8 <= got[2].containment < 1
    assert licenses.scan(nothing).count() == 0


def test_every_template_is_found_alone(spark):
    d = spark.createDataFrame([(i, "before it " + t + " after it") for i, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(d).collect()}
    assert {(i, n) for i, (n, _) in enumerate(licenses.TEMPLATES)} <= got


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.where("doc_id % 7 = 1").withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < 4:
            assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(at.select("doc_id").distinct().count())
    assert kept[0] < docs.count() and kept[1] < kept[0] and kept[2] < kept[1] and kept[3] == kept[4]
    assert json.loads(at.schema.json())["fields"][0]["name"] == "doc_id"
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()
