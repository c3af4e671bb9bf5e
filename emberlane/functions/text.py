"""Text columns: terms, redaction, secret paths, cards and other renderings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions.identity import col

#: Words that are no terms.
STOP_WORDS = ("the", "and", "when", "with", "from", "that", "this", "into", "for", "find", "locate", "which", "where", "used", "after", "its", "are", "was", "has")
#: A line that holds one of these is redacted.
MARKERS = ("api_key", "apikey", "secret=", "password=", "token=")
#: Globs of files that hold secrets.
SECRET_GLOBS = (".env", ".env.*", "*.pem", "*.key", "credentials.json", "id_rsa", "*.p12", "secrets.yaml", "secrets.yml")


def terms(text: str | Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Distinct lower-case terms in order of appearance: raw words, their snake and camel parts."""
    words = F.array_distinct(F.filter(F.split(col(text), "[^A-Za-z0-9_]+"), lambda w: w != ""))
    camel = "([A-Z][a-z0-9]+|[a-z0-9]+|[A-Z]+(?![a-z]))"
    parts = lambda s: F.concat(F.array(s), F.regexp_extract_all(s, F.lit(camel), F.lit(1)))
    inner = lambda w: F.flatten(F.transform(F.filter(F.split(w, "_"), lambda s: s != ""), parts))
    # a lower-case word without _ is its own only part
    plain = lambda w: (F.lower(w) == w) & (F.instr(w, "_") == 0)
    pieces = F.transform(words, lambda w: F.when(plain(w), F.array(w)).otherwise(F.concat(F.array(w), inner(w))))
    lower = F.transform(F.flatten(pieces), lambda x: F.lower(x))
    banned = F.array(*[F.lit(s) for s in (STOP_WORDS if stop is None else stop)])
    return F.array_except(F.filter(lower, lambda x: F.length(x) >= least), banned)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's terms that b has; 0 where a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of sets: both empty 1, one empty 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def keywords(text: str | Column, most: int = 5, stop: list[str] | None = None) -> Column:
    """First distinct words of four letters or more that are not stop words."""
    found = F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z]{4,})"), F.lit(1))
    banned = F.array(*[F.lit(s) for s in (STOP_WORDS if stop is None else stop)])
    return F.slice(F.array_except(found, banned), 1, most)


def redact_lines(text: str | Column, markers=MARKERS, pattern: str | None = None, put: str = "[redacted]") -> Column:
    """Lines that hold a marker (in any case), or match the pattern, are replaced; a trailing newline is lost."""
    hit = pattern or "|".join(re.escape(m) for m in markers)
    lines = F.split(F.regexp_replace(col(text), "\n$", ""), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(F.lower(x).rlike(hit), F.lit(put)).otherwise(x)), "\n")


def glob_pattern(globs) -> str:
    return "|".join("^" + re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") + "$" for g in globs)


def is_secret_path(path: str | Column, globs=SECRET_GLOBS) -> Column:
    """The path or its last part matches a glob, or it holds secret, credential or .env."""
    p = F.lower(col(path))
    hit = glob_pattern(globs)
    return p.rlike(hit) | F.element_at(F.split(p, "/"), -1).rlike(hit) | p.rlike(r"secret|credential|\.env")


def docstring_line(body: str | Column, first: int, last: int, most: int) -> Column:
    """First docstring line among the body's lines first..last (from 1), without quotes; empty if there is none."""
    lines = F.transform(F.slice(F.split(col(body), "\n"), first, last - first + 1), lambda x: F.trim(x))
    hit = F.get(F.filter(lines, lambda x: x.rlike("^(\"\"\"|''')")), F.lit(0))
    return F.coalesce(F.substring(F.trim(F.regexp_replace(hit, "^[\"']+|[\"']+$", "")), 1, most), F.lit(""))


def card(signature: str | Column, symbol: str | Column, body: str | Column, callees: Column) -> Column:
    """Signature (or symbol), docstring line, names of up to six callees."""
    s, d = F.trim(F.coalesce(F.nullif(col(signature), F.lit("")), col(symbol), F.lit(""))), docstring_line(body, 2, 6, 120)
    names = F.slice(F.transform(F.filter(callees, lambda c: c != ""), lambda c: F.element_at(F.split(c, r"\."), -1)), 1, 6)
    calls = F.when(F.size(names) > 0, F.concat(F.lit("calls "), F.array_join(names, " ")))
    return F.array_join(F.array_compact(F.array(F.nullif(s, F.lit("")), F.nullif(d, F.lit("")), calls)), "\n")


def render(level: Column, signature: Column, body: Column, callees: Column) -> Column:
    """A region as exact text, as signature with docstring, or as a one-line summary with up to four callees."""
    doc = docstring_line(body, 2, 4, 100)
    short = F.concat(signature, F.when(doc != "", F.concat(F.lit('\n    """'), doc, F.lit('"""'))).otherwise(""), F.lit("\n    ..."))
    calls = F.when(F.size(callees) > 0, F.concat(F.lit("  # calls: "), F.array_join(F.slice(callees, 1, 4), ", "))).otherwise("")
    return F.when(level == "exact", body).when(level == "signature", short).otherwise(F.concat(signature, F.lit("  # summarized neighbor"), calls))


def branch_count(body: str | Column) -> Column:
    return F.regexp_count(col(body), F.lit(r"(?m)^\s*(?:elif|else|if|for|while|except|case)\b"))
