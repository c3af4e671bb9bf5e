"""Identity and size columns: content hashes, region ids, token estimates, safe names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(text: str | Column) -> Column:
    """First 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(col(text), 256), 1, 16)


def region_id(*parts: str | Column) -> Column:
    """First 24 hex digits of the SHA-256 of repo|commit|path|start|end|content_hash."""
    return F.substring(F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256), 1, 24)


def token_estimate(text: str | Column) -> Column:
    """0 for empty or null, else a quarter of the characters, at least 1."""
    n = F.length(col(text))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).cast("int")


def safe_id(text: str | Column, most: int = 80) -> Column:
    """Letters, digits, - and _ stay, anything else becomes _."""
    return F.substring(F.regexp_replace(col(text), r"[^\p{L}\p{N}_-]", "_"), 1, most)


def package_of(path: str | Column) -> Column:
    """Directory of a path, "." at the top."""
    p = col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def label(path: str | Column, symbol: str | Column, rid: str | Column) -> Column:
    """path::symbol, or what of them there is, or the id."""
    p, s = F.coalesce(col(path), F.lit("")), F.coalesce(col(symbol), F.lit(""))
    return F.when((p != "") & (s != ""), F.concat(p, F.lit("::"), s)).when(s != "", s).when(p != "", p).otherwise(col(rid).cast("string"))


def short_name(labels: str | Column, shown: int = 3) -> Column:
    """The first labels without their paths, and how many more there are."""
    names = F.transform(col(labels), lambda x: F.element_at(F.split(x, "::"), -1))
    more = F.size(names) - shown
    head = F.array_join(F.slice(names, 1, shown), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" +"), more.cast("string"))).otherwise(head)


def clip01(c: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def pct_change(before: str | Column, after: str | Column) -> Column:
    """(after - before) / before in percent; null where before is null or 0. Round at the edge."""
    b, a = col(before).cast("double"), col(after).cast("double")
    return F.when(b.isNull() | (b == 0), None).otherwise((a - b) / b * 100)


def relative_path(path: str | Column, root: str) -> Column:
    """Forward slashes, without the root and a leading ./"""
    p = F.regexp_replace(col(path), r"\\", "/")
    root = root.rstrip("/") + "/"
    p = F.when(p.startswith(root), F.substring(p, len(root) + 1, 1 << 20)).otherwise(p)
    return F.regexp_replace(p, r"^(\./)+", "")
