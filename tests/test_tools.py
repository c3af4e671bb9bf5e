import json

from pyspark.sql import functions as F

from emberlane.functions import commands
from emberlane.functions.stems import porter, stem_words
from emberlane.operators import jobs, payloads
from emberlane.sources import parser, reports


def test_stems_of_published_examples():
    given = (
        "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing "
        "happy sky relational conditional rational valenci digitizer conformabli radicalli vietnamization predication operator feudalism decisiveness hopefulness "
        "callousness formaliti sensitiviti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic "
        "adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate "
        "cease controll roll at é x1y"
    ).split()
    want = (
        "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file "
        "happi sky relat condit ration valenc digit conform radic vietnam predic oper feudal decis hope "
        "callous formal sensit triplic form formal electr electr hope good reviv allow infer airlin gyroscop "
        "adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler probat rate "
        "ceas control roll at é x1y"
    ).split()
    assert [porter(w) for w in given] == want


def test_stems_in_columns(spark):
    rows = spark.createDataFrame([(["running", "runs"],), (None,), ([],)], "w array<string>").select(stem_words(F.col("w")).alias("s"))
    assert [r.s for r in rows.collect()] == [["run", "run"], None, []]


def test_commands_and_payloads(spark):
    payloads = [
        None, '"x"', "plain", json.dumps({"stdout": "a", "stderr": "b"}), json.dumps({"stdout": "a"}), json.dumps({"file": {"content": "whole"}, "text": "no"}),
        json.dumps({"content": [{"type": "text", "text": "one"}, "two"]}), json.dumps({"other": 1}), json.dumps(["p", "q"]),
    ]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string").select("i", commands.response_text("p").alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["", '"x"', "plain", "a\nb", "a", "whole", "one\ntwo", '{"other": 1}', "p\nq"]
    calls = [("pytest -x a.py|tee", ["-q", "a.py"]), ("make", None), ("cd t && pytest -vv tests/b.py::t ; ls", ["-q", "tests/b.py::t"]), ("pytest", ["-q"])]
    got = spark.createDataFrame(calls, "c string, w array<string>").select("w", commands.pytest_arguments("c").alias("a")).collect()
    assert all(r.a == r.w for r in got)
    kept = spark.createDataFrame([(["a.py", " b.py::t ", "/c.py", "../d.py", "-k", "-x", "gone.py"], ["a.py", "b.py"])], "a array<string>, f array<string>")
    assert kept.select(commands.allowed_arguments("a", files="f")).first()[0] == ["-q", "a.py", "b.py::t", "-x"]
    shown = spark.createDataFrame([(2.0,), (2.346,), (None,), (-1.5,)], "x double").select(commands.number_text("x").alias("t"))
    assert [r.t for r in shown.collect()] == ["2", "2.35", None, "-1.5"]


def test_the_test_file_that_shares_most_parts(spark):
    goals = spark.createDataFrame([(1, "refund of an invoice payment"), (2, "nothing here"), (3, "payments and invoices")], "id int, goal string")
    files = spark.createDataFrame([("tests/test_payment_invoice.py",), ("tests/test_invoice_payment.py",), ("tests/test_refund_invoice_payment.py",), ("tests/helper_invoice_payment.py",)], "path string")
    got = {r.id: (r.path, r.parts) for r in commands.matching_test_files(goals, "id", "goal", files, "path").collect()}
    assert got == {1: ("tests/test_refund_invoice_payment.py", 3), 3: ("tests/test_invoice_payment.py", 2)}


def test_reports_and_lake(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"files": {"a.py": {"executed_lines": [1, 3]}, "b.py": {}}, "meta": 1}, indent=1))
    (tmp_path / "o.jsonl").write_text('{"nodeid": "t::a", "outcome": "failed"}\n\n{"nodeid": "t::b", "outcome": "passed"}\nbroken\n')
    assert sorted(tuple(r) for r in reports.load_coverage(spark, f"{tmp_path}/c.json").collect()) == [("a.py", 1), ("a.py", 3)]
    out = reports.load_outcomes(spark, f"{tmp_path}/o.jsonl")
    assert out.count() == 2 and [r.nodeid for r in reports.failing_tests(out).collect()] == ["t::a"]
    root = f"{tmp_path}/lake"
    assert jobs.read_manifest(spark, root).count() == 0
    for n in (3, 5):  # a second build replaces the first
        jobs.build_lake(spark, root, {"bronze": {"events": spark.range(n)}, "gold": {"one": spark.range(1), "none": spark.range(0)}}, 17)
        assert {(r.layer, r.name, r.rows, r.built_ms) for r in jobs.read_manifest(spark, root).collect()} == {("bronze", "events", n, 17), ("gold", "one", 1, 17), ("gold", "none", 0, 17)}
    assert spark.read.parquet(f"{root}/bronze/events").count() == 5


def test_clones_that_rename_an_attribute_are_equal():
    one, two = "def f(a):\n    a.x = 1\n    b = a.x + 2\n    return b\n", "def g(c):\n    c.y = 1\n    d = c.y + 2\n    return d\n"
    assert parser.fingerprint(one)[0] == parser.fingerprint(two)[0] != parser.fingerprint(one.replace("+ 2", "+ 3"))[0]


def test_reindex_replaces_what_was_indexed(spark, tmp_path):
    files = [("a.py", "import b\n\n\ndef f():\n    return g()\n\n\ndef g():\n    return 1\n"), ("bad.py", "def (")]
    root = f"{tmp_path}/index"
    for given, wanted in ((files, {"regions": 4, "calls": 1, "imports": 1}), (files[1:], {"regions": 1, "calls": 0, "imports": 0}), ([], {"regions": 0, "calls": 0, "imports": 0})):
        done = jobs.reindex(spark, root, spark.createDataFrame(given, "path string, text string"), 9)
        assert {r.name: r.rows for r in done.collect()} == wanted
        assert spark.read.parquet(f"{root}/index/regions").count() == wanted["regions"]
        if given == files:
            assert spark.read.parquet(f"{root}/index/calls").first().callee_id is not None


def test_execution_path_takes_missing_scores_as_none(spark):
    ws = spark.createDataFrame([(1, 0.5, 0.3), (2, 0.5, None), (3, 0.2, 0.9), (4, None, 0.9), (5, 0.21, 0.2)], "r int, x double, a double")
    assert {(r.r, r.joined) for r in payloads.execution_path(ws, "x", "a").collect()} == {(1, True), (2, False), (5, False)}
