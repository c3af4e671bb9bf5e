from pyspark.sql import functions as F

from emberlane.plans.catalogue import SOURCES
from emberlane.sources import files, parser


def parts(spark):
    p = parser.parse_files(spark.createDataFrame(SOURCES, "path string, text string"))
    return [parser.part(p, n) for n in ("regions", "calls", "imports", "attrs")]


def test_regions(spark):
    got = {(r.path, r.symbol, r.kind): (r.start_line, r.end_line) for r in parts(spark)[0].collect()}
    assert got[("shop/cart.py", "Cart", "class")] == (4, 12) and got[("shop/cart.py", "Cart.total", "method")] == (8, 9)
    assert got[("shop/store.py", "Store.load", "method")] == (2, 4)  # with its decorator
    assert [k for k in got if k[0] == "shop/broken.py"] == [("shop/broken.py", "broken", "module")]


def test_resolution(spark):
    regions, calls, imports, attrs = parts(spark)
    names = {r.region_id: r.symbol for r in regions.collect()}
    got = {(names[r.caller_id], r.callee_name): names.get(r.callee_id) for r in parser.resolve(regions, calls, imports, attrs).collect()}
    assert got[("Cart.total", "self.subtotal")] == "Cart.subtotal"
    assert got[("Cart.total", "rate")] == "rate" and got[("rate", "lookup")] == "lookup"
    assert got[("Cart.subtotal", "self.store.load")] == "Store.load"
    assert got[("lookup", "len")] is None and got[("Store.load", "Cart")] is None  # neither imported nor in the file
    assert got[("Store.load", "Cart.total")] == "Cart.total"  # called on what the class makes


def test_fingerprints():
    a, b = (parser.fingerprint(t)[0] for p, t in SOURCES if p in ("shop/a.py", "shop/b.py"))
    assert a == b and a is not None
    assert parser.fingerprint("def f(x):\n    y = x + 2\n    z = y * 2\n    return z\n")[0] != a
    assert parser.fingerprint("def f(x):\n    'doc'\n    y = x + 1\n    z = y * 2\n    return z\n")[0] == a
    assert parser.fingerprint("x = 1") == (None, [], 0)


def test_tree_and_json_lines(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in (("a.py", "x = 1\n"), ("pkg/b.py", "y = 2\n"), ("pkg/__pycache__/c.py", "no"), ("pkg/d.txt", "no")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert sorted(r.path for r in files.source_tree(spark, str(root)).collect()) == ["a.py", "pkg/b.py"]
    rows = spark.range(3).select(F.col("id"), F.lit("x").alias("a"))
    files.write_jsonl(rows, f"{tmp_path}/out")
    assert files.count_jsonl(spark, f"{tmp_path}/out").first().n == 3
    assert spark.read.text(f"{tmp_path}/out").first().value.startswith('{"a"')
    assert files.report(spark, f"{tmp_path}/none", "x int").count() == 0
