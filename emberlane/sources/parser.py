"""Python sources as tables of regions, calls and imports, and the resolution of call names to regions."""

from __future__ import annotations

import ast
import hashlib
import textwrap

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REGION = "region_id string, path string, symbol string, kind string, start_line int, end_line int, content_hash string, token_count int, signature string, body string"
SCHEMA = f"path string, regions array<struct<{','.join(x.strip().replace(' ', ':') for x in REGION.split(','))}>>, calls array<struct<caller_id:string,callee_name:string>>, imports array<struct<region_id:string,module:string,name:string>>, attrs array<struct<class_name:string,attr:string,type_name:string>>"

#: Methods of built-in types and common libraries, which are bound only to a known receiver.
COMMON_METHODS = (
    "append extend pop insert remove clear copy get keys values items update setdefault add discard join split strip lstrip rstrip format lower upper "
    "startswith endswith replace write writelines read writerow writerows writeheader getvalue dumps loads today now isoformat fromisoformat strftime "
    "strptime encode decode hexdigest"
).split()
#: Names of the language that calls are not bound to.
BUILTINS = (
    "abs", "all", "any", "ascii", "bin", "bool", "bytearray", "bytes", "callable", "chr", "classmethod", "compile", "complex", "delattr", "dict", "dir",
    "divmod", "enumerate", "eval", "exec", "filter", "float", "format", "frozenset", "getattr", "globals", "hasattr", "hash", "help", "hex", "id",
    "input", "int", "isinstance", "issubclass", "iter", "len", "list", "locals", "map", "max", "memoryview", "min", "next", "object", "oct", "open",
    "ord", "pow", "print", "property", "range", "repr", "reversed", "round", "set", "setattr", "slice", "sorted", "staticmethod", "str", "sum",
    "super", "tuple", "type", "vars", "zip", "None", "True", "False", "Exception", "ValueError", "TypeError", "KeyError", "AttributeError",
    "RuntimeError", "NotImplementedError", "StopIteration", "AssertionError",
)


def _hash(text: str, digits: int) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()[:digits]


def call_name(node: ast.Call) -> str | None:
    """Dotted name of what is called; a call in front counts by its own name."""
    parts, at = [], node.func
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    if parts and isinstance(at, ast.Call):
        at = at.func
    if not isinstance(at, ast.Name):
        return None
    return ".".join([at.id, *reversed(parts)])


def type_name(node: ast.AST | None, known: dict[str, str]) -> str | None:
    """Class that an annotation or an assigned value names, by its capital letter."""
    if isinstance(node, ast.Call):
        node = node.func
        known = {}
    if isinstance(node, ast.Name):
        return node.id if node.id[:1].isupper() else known.get(node.id)
    if isinstance(node, ast.Attribute):
        return node.attr if node.attr[:1].isupper() else None
    if isinstance(node, ast.BinOp):
        return type_name(node.left, known) or type_name(node.right, known)
    if isinstance(node, ast.BoolOp):
        return next((t for t in (type_name(v, known) for v in node.values) if t), None)
    if isinstance(node, ast.Subscript):
        return type_name(node.slice, known)
    return None


def attribute_types(init: ast.AST) -> dict[str, str]:
    """self.attr -> class, from the assignments of a constructor."""
    args = [*init.args.args, *init.args.kwonlyargs]
    known = {a.arg: t for a in args if (t := type_name(a.annotation, {}))}
    out = {}
    for node in ast.walk(init):
        if not isinstance(node, (ast.Assign, ast.AnnAssign)) or node.value is None:
            continue
        for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
            if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                found = type_name(node.value, known) or (type_name(node.annotation, {}) if isinstance(node, ast.AnnAssign) else None)
                if found:
                    out[target.attr] = found
    return out


def parse(path: str, text: str, repo: str = "repo", commit: str = "head") -> dict:
    """Regions, calls, imports and attribute types of one file; text that does not parse gives the module alone."""
    lines = text.splitlines()
    regions, calls, imports, attrs = [], [], [], []

    def add(start: int, end: int, symbol: str, kind: str, body: str) -> str:
        digest = _hash(body, 16)
        rid = _hash("|".join(map(str, (repo, commit, path, start, end, digest))), 24)
        first = next(iter(body.splitlines()), "").strip()[:240]
        regions.append((rid, path, symbol, kind, start, end, digest, max(1, len(body) // 4) if body else 0, first, body[:4000] if kind == "module" else body))
        return rid

    stem = path.rsplit("/", 1)[-1].removesuffix(".py")
    module = add(1, max(1, len(lines)), stem, "module", text)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        tree = ast.Module(body=[], type_ignores=[])
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(n, ()) for n in reversed(tree.body)]
    while todo:
        node, classes = todo.pop()
        inner = classes
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            is_class = isinstance(node, ast.ClassDef)
            kind = "class" if is_class else "method" if classes else "function"
            rid = add(start, node.end_lineno, ".".join([*classes, node.name]), kind, "\n".join(lines[start - 1 : node.end_lineno]))
            if is_class:
                inner = (*classes, node.name)
            else:
                calls += [(rid, name) for c in ast.walk(node) if isinstance(c, ast.Call) and (name := call_name(c))]
                if classes and node.name == "__init__":
                    attrs += [(".".join(classes), a, t) for a, t in attribute_types(node).items()]
        elif isinstance(node, ast.Import):
            imports += [(module, a.name, a.asname) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [(module, node.module or "", a.name) for a in node.names]
        todo += [(n, inner) for n in reversed(list(ast.iter_child_nodes(node)))]
    return {"path": path, "regions": regions, "calls": sorted(set(calls)), "imports": sorted(set(imports), key=str), "attrs": sorted(set(attrs))}


def parse_files(files: DataFrame) -> DataFrame:
    """One row a file (path, text) with its regions, calls, imports and attribute types as arrays."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([parse(p, t or "") for p, t in zip(pdf["path"], pdf["text"])], columns=["path", "regions", "calls", "imports", "attrs"])

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def part(parsed: DataFrame, name: str) -> DataFrame:
    """One of the arrays as a table."""
    return parsed.select("path", F.explode(name).alias("x")).select(*(["path"] if name == "attrs" else []), "x.*")


def resolve(regions: DataFrame, calls: DataFrame, imports: DataFrame, attrs: DataFrame) -> DataFrame:
    """Calls with callee_id: joins to names that mean one region, the first rule that applies wins.

    Built-in names and common methods stay null. self.m: the caller's class; self.a.m: the class of the attribute; C.m:
    the class; a bare name: what the file imports, then the same file, then a class that the caller makes, then the only
    function of that name, then the only method. An ambiguous name stays null.
    """
    r = regions.where("kind <> 'module'").select("region_id", "path", "symbol", "kind")
    short_of = F.element_at(F.split("symbol", r"\."), -1)
    one = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("region_id").alias("hit")).where("n = 1").drop("n")
    methods = one(r.where("kind = 'method'"), ["symbol"])
    functions = one(r.where("kind = 'function'"), ["symbol"])
    any_method = one(r.where("kind = 'method'").withColumn("short", short_of), ["short"])
    # a file's own names: the last definition of a name that is no method
    w = Window.partitionBy("path", "symbol").orderBy(F.col("region_id").desc())
    local = r.where("kind <> 'method'").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("path").alias("lp"), F.col("symbol").alias("ls"), F.col("region_id").alias("local"))
    modules = regions.where("kind = 'module'").select("region_id", F.col("path").alias("importer"))
    imported = imports.join(modules, "region_id").where("name IS NOT NULL").select("importer", "name", F.concat(F.regexp_replace("module", r"\.", "/"), F.lit(".py")).alias("lp"))
    imported = imported.join(local, (imported.lp == local.lp) & (F.col("name") == F.col("ls"))).groupBy("importer", "name").agg(F.min("local").alias("imported"))

    c = calls.join(r.select(F.col("region_id").alias("caller_id"), "path", F.col("symbol").alias("caller"), F.col("kind").alias("caller_kind")), "caller_id")
    c = c.withColumn("parts", F.split("callee_name", r"\.")).withColumns(
        {
            "short": F.element_at("parts", -1),
            "head": F.element_at("parts", 1),
            "cls": F.when(F.col("caller_kind") == "method", F.regexp_replace("caller", r"\.[^.]*$", "")),
        }
    )
    m = lambda name, key: methods.select(F.col("symbol").alias(key), F.col("hit").alias(name))
    c = c.withColumn("k_self", F.concat_ws(".", "cls", "short")).join(m("by_self", "k_self"), "k_self", "left")
    a = attrs.select("path", F.col("class_name").alias("cls"), F.col("attr").alias("a_attr"), "type_name")
    c = c.withColumn("a_attr", F.get("parts", F.lit(1))).join(a, ["path", "cls", "a_attr"], "left")
    c = c.withColumn("k_attr", F.concat(F.col("type_name"), F.lit("."), F.col("short"))).join(m("by_attr", "k_attr"), "k_attr", "left")
    c = c.withColumn("k_class", F.concat(F.col("head"), F.lit("."), F.col("short"))).join(m("by_class", "k_class"), "k_class", "left")
    c = c.join(imported.withColumnsRenamed({"importer": "path", "name": "short"}), ["path", "short"], "left")
    c = c.join(local.withColumnsRenamed({"lp": "path", "ls": "short"}), ["path", "short"], "left")
    made = calls.where(~F.contains("callee_name", F.lit(".")) & F.substring("callee_name", 1, 1).rlike("[A-Z]")).select("caller_id", F.col("callee_name").alias("made")).distinct()
    built = c.select("caller_id", "short").distinct().join(made, "caller_id").withColumn("symbol", F.concat_ws(".", "made", "short")).join(methods, "symbol")
    built = built.groupBy("caller_id", "short").agg(F.count_distinct("hit").alias("n"), F.min("hit").alias("built")).where("n = 1").drop("n")
    c = c.join(built, ["caller_id", "short"], "left").join(functions.select(F.col("symbol").alias("short"), F.col("hit").alias("by_function")), "short", "left")
    c = c.join(any_method.select("short", F.col("hit").alias("by_method")), "short", "left")
    n, own = F.size("parts"), F.col("head").isin("self", "cls")
    common = F.col("short").isin(COMMON_METHODS)
    rule = (
        F.when(F.col("short").isin(list(BUILTINS)), None)
        .when(own & (n == 1), None)
        .when(own & (n == 2), F.when(F.col("cls").isNotNull(), F.col("by_self")))
        .when(own, F.col("by_attr"))
        .when(common, None)
        .when(n >= 2, F.when(F.substring("head", 1, 1).rlike("[A-Z]"), F.col("by_class")))
        .otherwise(F.coalesce("imported", "local", "built", "by_function", "by_method"))
    )
    return c.select("caller_id", "callee_name", rule.alias("callee_id"))


class _Canonical(ast.NodeVisitor):
    """Node names in order, with identifiers, attributes too, numbered by first use and constants spelled out; docstrings left out."""

    def __init__(self):
        self.kinds: list[str] = []
        self.out: list[str] = []
        self.names: dict[str, int] = {}

    def name(self, text: str) -> str:
        return f"v{self.names.setdefault(text, len(self.names))}"

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, (ast.Load, ast.Store, ast.Del)):
            return
        children = [n for n in ast.iter_child_nodes(node)]
        body = getattr(node, "body", None)
        if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            children = [n for n in children if n is not body[0]]
        kind = type(node).__name__
        words = []
        for field, value in ast.iter_fields(node):
            if isinstance(value, str) and field in ("id", "arg", "name", "attr"):
                words.append(self.name(value))
        if isinstance(node, ast.Constant):
            words.append(repr(node.value))
        self.kinds.append(kind)
        self.out.append(f"{kind}#{len(children)}:{','.join(words)}")
        for n in children:
            self.visit(n)


def fingerprint(source: str) -> tuple[str | None, list[str], int]:
    """(digest of the canonical form, distinct trigrams of node kinds, statements) of the one function in a source.

    Equal up to the names of variables gives equal digests. Sources without exactly one function give (null, [], 0).
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None, [], 0
    functions = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if len(functions) != 1:
        return None, [], 0
    c = _Canonical()
    c.visit(functions[0])
    grams = sorted({" ".join(c.kinds[i : i + 3]) for i in range(len(c.kinds) - 2)})
    body = functions[0].body
    doc = bool(body) and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str)
    statements = sum(isinstance(n, ast.stmt) for n in ast.walk(functions[0])) - 1 - doc
    return _hash("|".join(c.out), 32), grams, statements


def fingerprints(sources: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """(key, digest, grams, statements) of functions with at least so many statements."""
    kind = dict(sources.dtypes)[key]

    def run(batches):
        for pdf in batches:
            got = [fingerprint(textwrap.dedent(t or "")) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "digest": [g[0] for g in got], "grams": [g[1] for g in got], "statements": [g[2] for g in got]})

    out = sources.select(key, text).mapInPandas(run, f"{key} {kind}, digest string, grams array<string>, statements int")
    return out.where(F.col("digest").isNotNull() & (F.col("statements") >= least))
