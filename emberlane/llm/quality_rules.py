"""Line-first cleaning with DataFrame functions only: rules per line, then documents that lose too much text go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = " \\t\\n\\x0B\\f\\r"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Boilerplate phrases of web pages, in any case.
BOILERPLATE = (
    "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "javascript",
    "lorem ipsum", "sign up", "log in", "read more", "subscribe", "share this", "back to top",
)
#: Signs that end a line of prose.
ENDS = ".!?:;…\"')]»”"
#: Bits of a window's place in its packed code; the others are bits of its hash.
PLACE = 24


def word_array(text):
    return F.array_remove(F.split(text, f"[{WHITE}]+"), "")


def count_of(text, signs: str):
    return F.length(text) - F.length(F.translate(text, signs, ""))


def boilerplate(text):
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE])


def line_fails(line, symbols=None, phrases=None, min_words: int = 1):
    """True for a line that breaks a rule: too many symbols for its length, a row of links between bars, shouting,
    boilerplate, or prose of several words without an end. symbols, phrases: false where the line's document is known to
    hold no such sign or phrase. Words are counted only where the verdict hangs on them."""
    yes = F.lit(True)
    signs = (count_of(line, SYMBOLS) * 10 > F.length(line)) | (count_of(line, "|") >= 3)
    words = lambda n: F.size(word_array(line)) >= n
    shouting = (F.upper(line) == line) & (F.lower(line) != line) & words(3)
    ended = F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1)).isin(list(ENDS))
    few = F.lit(False) if min_words <= 1 else ~words(min_words)
    return ((yes if symbols is None else symbols) & signs) | ((yes if phrases is None else phrases) & boilerplate(line)) | (~ended & words(8)) | shouting | few


def repeat_words(w, m):
    """Words in three-word windows that stand in w twice or more; m: how many windows there are. Windows compare as
    strings, in an order of their hashes."""
    window = F.transform(F.slice(w, F.lit(1), m), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
    s = F.array_sort(F.transform(window, lambda t, i: F.struct(F.xxhash64(t).alias("h"), t.alias("t"), i.alias("i"))))
    dup = F.transform(F.arrays_zip(F.slice(s, F.lit(1), F.greatest(m - 1, F.lit(0))).alias("a"), F.slice(s, F.lit(2), F.greatest(m - 1, F.lit(0))).alias("b")), lambda z: F.when(z["a"]["t"] == z["b"]["t"], F.array(z["a"]["i"], z["b"]["i"])))
    return covered(F.flatten(F.array_compact(dup)))


def covered(starts):
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def line_rules(docs: DataFrame, most_lost: int = 50, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    clean_text, kept_chars, line_chars.

    base_failed: fewer than min_words words, or more than most_repeated percent of them in three-word windows that the
    text holds twice or more. kept: not base_failed, and the lines that pass (first occurrences, no rule broken) hold at
    least 100 - most_lost percent of the characters of all lines with a word. Null and empty texts have no words and
    fail. Rows stay as they come, repeated ones too; other columns are ignored. All work is within a row, by a sort of
    numbers that pack a window's hash and place, so hot keys and very long texts cost no shuffle and n log n at most. A
    text in which different windows meet in these numbers, or too long for them, is done again by whole strings.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.select("doc_id", "text", word_array(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")).alias("all_lines"))
    mask = (1 << PLACE) - 1
    t = t.select(
        "*",
        F.array_distinct("all_lines").alias("lines"),
        F.size("w").cast("long").alias("n_words"),
        F.greatest(F.size("w") - 2, F.lit(0)).alias("m"),
        F.col("text").rlike(f"[{SYMBOLS}]").alias("symbols"),
        boilerplate(F.col("text")).alias("phrases"),
    )
    code = F.transform(F.slice("w", F.lit(1), F.col("m")), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    t = t.select("*", F.sort_array(code).alias("s"))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    meet = lambda x, y: F.shiftright(x.bitwiseXOR(y), PLACE) == 0
    alike = lambda x, y: reduce(lambda a, b: a & b, [F.get("w", place(x) + k) == F.get("w", place(y) + k) for k in range(3)])
    next_to = lambda i, by: F.get("s", i + by)
    beside = F.filter("s", lambda x, i: F.coalesce(meet(x, next_to(i, 1)), F.lit(False)) | F.coalesce(meet(x, next_to(i, -1)), F.lit(False)))
    t = t.select("*", beside.alias("d"))
    clash = F.exists(F.transform("d", lambda x, i: meet(x, F.get("d", i + 1)) & ~alike(x, F.get("d", i + 1))), lambda x: F.coalesce(x, F.lit(False)))
    repeated = F.when(F.size("d") == 0, 0).when(clash | (F.col("m") > mask), repeat_words(F.col("w"), F.col("m"))).otherwise(covered(F.transform("d", place)))
    chars = lambda lines: F.length(F.array_join(lines, "")).cast("long")
    t = t.select(
        "doc_id",
        "n_words",
        chars("w").alias("word_chars"),
        F.when(F.col("symbols"), count_of(F.col("text"), SYMBOLS)).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("all_lines") - F.size("lines")).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.filter("lines", lambda x: ~line_fails(x, F.col("symbols"), F.col("phrases"))).alias("good"),
        chars("all_lines").alias("line_chars"),
    )
    t = t.select("*", F.array_join("good", "\n").alias("clean_text"), chars("good").alias("kept_chars")).drop("good")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    kept = ~failed & (100 * F.col("kept_chars") >= (100 - most_lost) * F.col("line_chars"))
    return t.select("*", failed.alias("base_failed"), kept.alias("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
g2 AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM g),
g3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g2),
g4 AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM g3, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
x AS (SELECT r, unnest(list_distinct(l)) AS line FROM w),
x2 AS (SELECT r, line, len(list_filter(string_split_regex(line, '[ \t\n\x0B\f\r]+'), lambda y: y <> '')) AS n FROM x),
x3 AS (SELECT r, sum(length(line)) AS kept_chars FROM x2 WHERE NOT (
  (length(line) - length(translate(line, '#*$%&|<>', ''))) * 10 > length(line)
  OR length(line) - length(translate(line, '|', '')) >= 3
  OR (n >= 3 AND upper(line) = line AND lower(line) <> line)
  OR regexp_matches(line, '(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|click here|javascript|lorem ipsum|sign up|log in|read more|subscribe|share this|back to top)')
  OR (n >= 8 AND NOT regexp_matches(line, '[.!?:;…"'')\]»”][ \t\x0B\f\r]*$'))) GROUP BY r),
y AS (SELECT r, sum(length(line)) AS line_chars FROM (SELECT r, unnest(l) AS line FROM w) GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kc, coalesce(line_chars, 0) AS lc
  FROM w LEFT JOIN g4 USING (r) LEFT JOIN x3 USING (r) LEFT JOIN y USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * kc >= 50 * lc AS kept FROM f
"""
