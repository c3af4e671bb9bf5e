"""Commands, tool payloads and file names of test runs, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions.identity import col
from emberlane.functions.text import terms

#: Options of a test command that are dropped from it.
DROPPED = ("-q", "-x", "-s", "-v", "-vv", "--tb=short", "--tb=long", "--tb=no")
#: Options of a test command that may stay.
SAFE = ("-q", "-x", "--tb=short", "--tb=line", "--lf", "--ff", "-rA")
#: Tools whose operation has another name than the tool.
OPERATIONS = {"grep": "grep", "glob": "glob", "read": "read", "edit": "edit", "multiedit": "edit", "write": "edit", "notebookedit": "edit", "bash": "execute"}
#: Fields of a tool's input that hold its query, first come first.
QUERY_KEYS = ("pattern", "query", "objective", "file_path", "path", "command")


def pytest_arguments(command: str | Column) -> Column:
    """Arguments of the first pytest call in a shell command, -q first; null where there is none."""
    c = col(command)
    after = F.element_at(F.split(F.substring(c, F.instr(c, "pytest") + 6, F.length(c)), r"&&|\||;"), 1)
    given = F.filter(F.split(after, r"\s+"), lambda a: (a != "") & ~a.isin(list(DROPPED)))
    return F.when(F.instr(c, "pytest") > 0, F.concat(F.array(F.lit("-q")), given))


def allowed_arguments(args: str | Column, flags=SAFE, files: str | Column | None = None) -> Column:
    """Arguments that are known flags or relative paths of Python files, with a node behind :: or without; -q first if it
    is not there. files: an array of the files that exist; paths of others go."""
    a = F.filter(F.transform(F.coalesce(col(args), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    path = lambda x: x.rlike(r"^[A-Za-z0-9_./-]+\.py(::[A-Za-z0-9_\[\],.-]+)*$") & ~F.contains(x, F.lit("..")) & ~x.startswith("/") & ~x.startswith("-")
    there = (lambda x: F.lit(True)) if files is None else (lambda x: F.array_contains(col(files), F.element_at(F.split(x, "::"), 1)))
    kept = F.filter(a, lambda x: x.isin(list(flags)) | (path(x) & there(x)))
    return F.when(F.array_contains(kept, "-q"), kept).otherwise(F.concat(F.array(F.lit("-q")), kept))


def name_parts(path: str | Column) -> Column:
    """Parts of a test file's name of more than two letters, without "test"."""
    stem = F.regexp_replace(F.lower(F.element_at(F.split(col(path), "/"), -1)), r"\.py$", "")
    return F.filter(F.split(stem, "_"), lambda p: (p != "test") & (F.length(p) > 2))


def matching_test_files(objectives: DataFrame, key: str, text: str, files: DataFrame, path: str, least: int = 2) -> DataFrame:
    """(key, path, parts): for each objective the test file whose name shares most parts with its terms, the first by name
    of equals; none under so many. A part and a term match if one holds the other. files: the test files of a repository,
    a small table that is joined with every objective."""
    t = objectives.select(key, terms(text).alias("t"))
    f = files.where(F.col(path).rlike(r"(^|/)test_[^/]*\.py$")).select(F.col(path).alias("path"), name_parts(path).alias("p"))
    shared = F.size(F.filter("p", lambda p: F.exists("t", lambda x: F.contains(x, p) | F.contains(p, x))))
    best = t.join(f).select(key, "path", shared.alias("parts")).where(F.col("parts") >= least)
    return best.groupBy(key).agg(F.min(F.struct((-F.col("parts")).alias("n"), "path")).alias("b")).select(key, F.col("b.path").alias("path"), (-F.col("b.n")).alias("parts"))


def frames(text: str | Column) -> Column:
    """Stack frames "file.py:line: message" at the starts of lines: array of (path, line, message)."""
    each = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?m)^([^\s:]+\.py:\d+(?::[^\n]*)?)$"), F.lit(1))
    part = lambda x, k: F.regexp_extract(x, r"^([^\s:]+\.py):(\d+)(?::\s*(.*))?$", k)
    return F.transform(each, lambda x: F.struct(part(x, 1).alias("path"), part(x, 2).cast("int").alias("line"), F.substring(part(x, 3), 1, 200).alias("message")))


def operation_of(tool: str | Column) -> Column:
    """The operation that a tool's name stands for; other names stay, none is execute."""
    t = F.lower(F.coalesce(col(tool), F.lit("")))
    named = reduce(lambda w, kv: w.when(t == kv[0], kv[1]), list(OPERATIONS.items())[1:], F.when(t == "grep", "grep"))
    return named.otherwise(F.when(t == "", "execute").otherwise(t))


def query_of(tool: str | Column, payload: str | Column) -> Column:
    """What a tool was asked: the first field of its JSON input that holds something, at most 500 letters; else its name."""
    found = F.coalesce(*[F.nullif(F.get_json_object(col(payload), f"$.{k}"), F.lit("")) for k in QUERY_KEYS])
    return F.coalesce(F.substring(found, 1, 500), F.nullif(col(tool), F.lit("")))


def response_text(payload: str | Column) -> Column:
    """Text of a tool's JSON response: a file's content, the text under its usual fields (stdout with stderr after it),
    the texts of a list's items one a line, or the payload itself."""
    p = col(payload)
    field = lambda path: F.get_json_object(p, path)
    listed = lambda v: F.array_join(F.transform(F.from_json(v, "array<string>"), lambda x: F.coalesce(F.get_json_object(x, "$.content"), F.get_json_object(x, "$.text"), F.get_json_object(x, "$.stdout"), x)), "\n")
    text = lambda v: F.when(F.ltrim(v).startswith("["), listed(v)).otherwise(v)
    error = F.nullif(field("$.stderr"), F.lit(""))
    out = F.when(error.isNotNull(), F.concat(field("$.stdout"), F.lit("\n"), error)).otherwise(field("$.stdout"))
    given = F.coalesce(field("$.file.content"), text(field("$.content")), out, text(field("$.output")), text(field("$.text")), text(field("$.result")))
    return F.when(p.isNull(), "").when(F.ltrim(p).startswith("["), listed(p)).otherwise(F.coalesce(given, p))


def skipped_path(path: str | Column, prefixes) -> Column:
    """The path begins with one of the prefixes."""
    return reduce(lambda a, b: a | b, [col(path).startswith(p) for p in prefixes], F.lit(False))


def redact_values(variables: str | Column, put: str = "[redacted]") -> Column:
    """A map with all its values replaced."""
    return F.transform_values(col(variables), lambda k, v: F.lit(put))


def number_text(c: str | Column) -> Column:
    """Two decimals at most, none where they are zero."""
    r = F.round(col(c).cast("double"), 2)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))
