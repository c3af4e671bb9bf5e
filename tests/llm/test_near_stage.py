import random

import corpus_pipeline
from emberlane.llm import shingles


def shingles_of(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def texts():
    rng = random.Random(2)
    out = [None, "", " \n", "a b", "A  b", "a b c"]
    for _ in range(25):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 300))]
        out.append(" ".join(w))
        for changes in (1, 2, 3, 5):
            v = list(w)
            for at in rng.sample(range(len(v)), changes):
                v[at] = f"x{rng.randint(0, 3000)}"
            out.append(" ".join(v))
    rng.shuffle(out)
    return out


def test_stage_drops_what_five_word_jaccard_joins(spark, tmp_path):
    given = texts()
    sets = [shingles_of(t) for t in given]
    root = list(range(len(given)))
    for b in range(len(given)):
        for a in range(b):
            if (not sets[a] and not sets[b]) or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    for tile in (512, 3):
        assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, tile=tile).collect()} == dict(enumerate(root))
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == set(root) and len(set(root)) < len(given) - 30


def test_stage_with_nulls_repeats_and_odd_columns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(1, long, 1, "a"), (2, long.upper(), 2, "b"), (2, "another text of its own", 3, "c"), (None, long, 4, "d"), (5, None, 5, "e"), (6, "", None, None), (7, "one two", 7, "f"), (7, "one two", 7, "f")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _rep int, `a.b` string")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    # doc_id 2 goes as a copy, with every row of that id; rows without doc_id stay
    assert sorted((r.doc_id or 0, r._rep) for r in kept.collect()) == [(0, 4), (1, 1), (5, 5), (7, 7), (7, 7)]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_all_stages_take_odd_rows_and_no_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a plain text " * 40, "x", 0), (2, None, None, 1), (3, "", "x", 2), (None, "one two", "x", 3), (4, "w " * 30000, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, grade int")
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                at = out
            else:
                got = {(r.doc_id, r.doc_tokens) for r in out.collect()}
                ids = {d for d, _ in got}
        assert ids == ({1, 2, 4, None} if table is docs else set()) and ((2, 1) in got) == (table is docs)
