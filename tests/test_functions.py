import math

import pytest
from pyspark.sql import functions as F

from emberlane.functions import identity, scoring, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_terms(spark):
    got = one(spark, text.terms(F.lit("HTTPServerError_v2 fooBar the renewal_discount for_renewal")))
    assert got == ["httpservererror_v2", "httpservererror", "http", "server", "error", "foobar", "foo", "bar", "renewal_discount", "renewal", "discount", "for_renewal"]


def test_hash_slots(spark):
    want = {"apply": (151, -1), "loyalty": (233, 1), "discount": (34, -1), "invoice": (82, -1)}
    rows = spark.createDataFrame([(w,) for w in want], "w string").select("w", vectors.hash_slot("w"), vectors.hash_sign("w")).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want


def test_empty_vector_is_first_axis(spark):
    rows = spark.createDataFrame([(1, [])], "k int, t array<string>")
    assert [tuple(r) for r in vectors.hash_embed_sparse(rows, "k", "t").collect()] == [(1, 0, 1.0)]


@pytest.mark.parametrize("s,p", [(0, 0.1419), (0.28, 0.47), (0.30, 0.5), (0.55, 0.8176), (0.70, 0.9168)])
def test_probability(spark, s, p):
    assert round(one(spark, scoring.p_used_soon(F.lit(s))), 4) == p


def test_value_and_keep(spark):
    assert round(one(spark, scoring.expected_value(F.lit(0.5), F.lit(100))["ev"]), 1) == 411.7
    keep = scoring.keep_value(F.lit(False), F.lit(1.0), F.lit(2), F.lit(4), F.lit(0.6), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(100))
    assert math.isclose(one(spark, keep), 0.2602016530, rel_tol=1e-8)
    assert one(spark, scoring.keep_value(F.lit(True), F.lit(1.0), F.lit(2), F.lit(4), F.lit(0.6), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(100))) == 1e9


def test_redaction(spark):
    assert one(spark, text.redact_lines(F.lit("a\napi_key=sekrit-value\nb\n"))) == "a\n[redacted]\nb"
    assert one(spark, text.redact_lines(F.lit('token = "x"'))) == 'token = "x"'
    assert one(spark, text.is_secret_path(F.lit("a/b/.env.local")))
    assert not one(spark, text.is_secret_path(F.lit("a/b/readme.md")))


def test_tokens_and_change(spark):
    assert [one(spark, identity.token_estimate(F.lit(x))) for x in ("", "a", "abcd" * 3)] == [0, 1, 3]
    assert one(spark, identity.pct_change(F.lit(10), F.lit(4))) == -60.0
    assert one(spark, identity.pct_change(F.lit(0), F.lit(4))) is None


def test_card_and_render(spark):
    body = 'def f(x):\n    """Adds one."""\n    return x + 1'
    got = one(spark, text.card(F.lit("def f(x):"), F.lit("f"), F.lit(body), F.array(F.lit("m.g"), F.lit("h"))))
    assert got == "def f(x):\nAdds one.\ncalls g h"
    assert one(spark, text.render(F.lit("signature"), F.lit("def f(x):"), F.lit(body), F.array())) == 'def f(x):\n    """Adds one."""\n    ...'
    assert one(spark, text.render(F.lit("summary"), F.lit("def f(x):"), F.lit(body), F.array(F.lit("g")))).endswith("# calls: g")


def test_jaccard_of_empty_sets(spark):
    none = F.array().cast("array<string>")
    assert one(spark, text.jaccard(none, none)) == 1.0
    assert one(spark, text.jaccard(none, F.array(F.lit("a")))) == 0.0
