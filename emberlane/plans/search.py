"""Queries over documents read as regions: identity, terms, search, redaction, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlane.functions import identity, text, vectors
from emberlane.operators import lexical
from emberlane.plans.registry import query
from emberlane.sources.tables import table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", identity.token_estimate("text").alias("tokens"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, substr(sha256(concat_ws('|', 'repo', 'head', source, '1', doc_id, substr(sha256(text), 1, 16))), 1, 24) AS region_id FROM documents")
def content_hash(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("h", identity.content_hash("text"))
    return d.select("doc_id", F.col("h").alias("content_hash"), identity.region_id(F.lit("repo"), F.lit("head"), "source", F.lit(1), "doc_id", "h").alias("region_id"))


@query(
    "package_rollup",
    """
    SELECT CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS package, count(*) AS n, min(substr(regexp_replace(p, '[^\\p{L}\\p{N}_-]', '_', 'g'), 1, 80)) AS safe
    FROM (SELECT regexp_replace(url, '^https?://', '') AS p FROM pages) GROUP BY 1
    """,
)
def package_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("p"))
    return p.groupBy(identity.package_of("p").alias("package")).agg(F.count(F.lit(1)).alias("n"), F.min(identity.safe_id("p")).alias("safe"))


@query(
    "label_names",
    "SELECT doc_id, source || '::' || lang AS label, CASE WHEN doc_id % 2 = 0 THEN lang || ', x, y +1' ELSE lang END AS short FROM documents",
)
def label_names(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("label", identity.label("source", "lang", "doc_id"))
    many = F.when(F.col("doc_id") % 2 == 0, F.array("label", F.lit("a::x"), F.lit("y"), F.lit("b::z"))).otherwise(F.array("label"))
    return d.select("doc_id", "label", identity.short_name(many).alias("short"))


#: DuckDB has no look-ahead, so the oracle reads a lower-case corpus, on which the terms are words and their parts.
TERMS_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, flatten(list_transform(w, lambda x: [x] || flatten(list_transform(list_filter(string_split(x, '_'), lambda y: y <> ''), lambda y: [y] || regexp_extract_all(y, '[a-z0-9]+'))))) AS t FROM w),
terms AS (SELECT doc_id, list_distinct(list_filter(t, lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'when', 'with', 'from', 'that', 'this', 'into', 'for', 'find', 'locate', 'which', 'where', 'used', 'after', 'its', 'are', 'was', 'has'))) AS t FROM p)
"""


@query("token_terms", TERMS_SQL + "SELECT doc_id, len(t)::INTEGER AS n, sha256(array_to_string(list_sort(t), ' ')) AS digest FROM terms")
def token_terms(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", text.terms(F.lower("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("digest"))


@query(
    "hash_embed",
    TERMS_SQL
    + """, x AS (SELECT doc_id, unnest(t) AS t FROM terms),
    s AS (SELECT doc_id, ('0x' || substr(sha256(t), 1, 2))::INTEGER AS slot, CASE WHEN ('0x' || substr(sha256(t), 9, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS sign FROM x
      UNION ALL SELECT doc_id, 0, 1 FROM terms WHERE len(t) = 0),
    r AS (SELECT doc_id, slot, sum(sign)::DOUBLE AS raw FROM s GROUP BY 1, 2),
    n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY 1)
    SELECT doc_id, slot, round(raw / norm, 6) AS value FROM r JOIN n USING (doc_id) WHERE raw <> 0""",
)
def hash_embed(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", text.terms(F.lower("text")).alias("t"))
    out = vectors.hash_embed_sparse(t, "doc_id", "t")
    return out.select("doc_id", "slot", F.round("value", 6).alias("value"))


@query(
    "cosine_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS q, e AS f FROM v WHERE vec_id % 50 = 0),
    c AS (SELECT q, vec_id, list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))) AS c FROM v, q)
    SELECT q AS query_id, vec_id, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, vec_id) AS n FROM c) WHERE n <= 10
    """,
)
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("f"))
    out = lexical.vector_topk(e, q, "vec_id", "embedding", "query_id", "f", 10)
    return out.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


@query(
    "redact_lines",
    r"""
    SELECT doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: CASE WHEN regexp_matches(lower(x), 'token\s*=|@|licen[sc]e') THEN '[redacted]' ELSE x END), chr(10))) AS digest FROM documents
    """,
)
def redact_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.redact_lines("text", pattern=r"token\s*=|@|licen[sc]e"), 256).alias("digest"))


@query(
    "secret_paths",
    r"""
    SELECT p FROM (SELECT regexp_replace(url, '^https?://', '') || CASE page_id % 6 WHEN 0 THEN '/.env' WHEN 1 THEN '/a.pem' WHEN 2 THEN '/id_rsa' WHEN 3 THEN '/x.key.txt' WHEN 4 THEN '/credentials.json' ELSE '/readme' END AS p FROM pages)
    WHERE NOT (regexp_matches(lower(p), '(^|/)(\.env|\.env\.[^/]*|[^/]*\.pem|[^/]*\.key|credentials\.json|id_rsa|[^/]*\.p12|secrets\.yaml|secrets\.yml)$') OR regexp_matches(lower(p), 'secret|credential|\.env'))
    """,
)
def secret_paths(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("/.env", "/a.pem", "/id_rsa", "/x.key.txt", "/credentials.json", "/readme")])
    p = table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^https?://", ""), F.element_at(ends, (F.col("page_id") % 6 + 1).cast("int"))).alias("p"))
    return p.where(~text.is_secret_path("p"))


@query("like_fallback", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'tion the') OR contains(lower(source), 'src7') ORDER BY n_chars, doc_id LIMIT 25")
def like_fallback(spark, sf_dir):
    return lexical.like_scan(docs(spark, sf_dir), ["tion the", "src7"], ["text", "source"], ["n_chars", "doc_id"], 25).select("doc_id", "n_chars")


@query("regex_grep", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licen[sc]ed? under') ORDER BY doc_id LIMIT 40")
def regex_grep(spark, sf_dir):
    return lexical.pattern_scan(docs(spark, sf_dir), r"licen[sc]ed? under", "text", ["doc_id"], 40).select("doc_id")


@query(
    "line_grep",
    "SELECT doc_id, line, substr(trim(x), 1, 160) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line FROM documents) WHERE contains(lower(x), 'license')",
)
def line_grep(spark, sf_dir):
    return lexical.line_grep(docs(spark, sf_dir), "LICENSE", "doc_id", "text")


SYMBOLS = "SELECT p_partkey AS id, p_name AS symbol, p_type AS path, CASE WHEN p_size > 40 THEN 'module' ELSE 'function' END AS kind, p_size AS start_line FROM part"


def symbols(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"), F.col("p_type").alias("path"), F.when(F.col("p_size") > 40, "module").otherwise("function").alias("kind"), F.col("p_size").alias("start_line")
    )


@query(
    "symbol_search",
    f"WITH s AS ({SYMBOLS}) SELECT symbol, kind, start_line FROM s WHERE contains(lower(symbol), 'ring') ORDER BY symbol <> 'ring', kind = 'module', start_line, symbol LIMIT 40",
)
def symbol_search(spark, sf_dir):
    return lexical.symbol_search(symbols(spark, sf_dir), "ring").select("symbol", "kind", "start_line")


@query(
    "symbol_resolve",
    f"WITH s AS ({SYMBOLS}), m AS (SELECT min(symbol) AS n FROM s WHERE kind <> 'module') SELECT symbol, path FROM s, m WHERE symbol = n AND kind <> 'module' ORDER BY contains(path, 'A') DESC, path, symbol LIMIT 1",
)
def symbol_resolve(spark, sf_dir):
    s = symbols(spark, sf_dir)
    name = s.where("kind <> 'module'").agg(F.min("symbol")).first()[0]
    return lexical.symbol_resolve(s, name, "A").select("symbol", "path")


@query(
    "bm25_topk",
    """
    WITH q AS (SELECT item_id, list_slice(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda x: length(x) >= 3)), 1, 10) AS dummy, text FROM benchmark),
    qw AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS term, generate_subscripts(string_split_regex(lower(text), '[^a-z0-9_]+'), 1) AS i FROM q),
    qd AS (SELECT item_id, term, min(i) AS i FROM qw WHERE length(term) >= 3 GROUP BY 1, 2),
    qt AS (SELECT item_id, term FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM qd) WHERE n <= 10),
    x AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda y: y <> '')) AS term, 1.0 AS w FROM documents
      UNION ALL SELECT doc_id, unnest(list_filter(string_split_regex(lower(source), '[^a-z0-9_]+'), lambda y: y <> '')), 2.0 FROM documents),
    p AS MATERIALIZED (SELECT doc_id, term, sum(w)::DOUBLE AS tf, count(*) AS n FROM x GROUP BY 1, 2),
    len AS (SELECT doc_id, sum(n)::DOUBLE AS l FROM p GROUP BY 1),
    st AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS docs, sum(l) AS total FROM len),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    sc AS (SELECT item_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / (total / docs)))) AS score
      FROM qt JOIN p USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2)
    SELECT item_id, doc_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 8) DESC, doc_id) AS n FROM sc) WHERE n <= 5
    """,
)
def bm25_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "query")
    out = lexical.bm25(docs(spark, sf_dir), q, "doc_id", "item_id", "query", {"text": 1.0, "source": 2.0}, 5)
    return out.select("item_id", "doc_id", F.round("score", 5).alias("score"))


@query(
    "lexical_traps",
    "SELECT doc_id, n AS trap_tokens FROM (SELECT doc_id, (contains(x, 'tion')::INTEGER + contains(x, 'license')::INTEGER + contains(x, 'src3')::INTEGER) AS n FROM (SELECT doc_id, lower(concat_ws(' ', source, text)) AS x FROM documents)) WHERE n >= 2",
)
def lexical_traps(spark, sf_dir):
    return lexical.lexical_traps(docs(spark, sf_dir), ["tion", "license", "src3"], ["source", "text"]).select("doc_id", "trap_tokens")


@query(
    "keywords",
    """
    WITH k AS (SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM conversations)
    SELECT conv_id, turn, role, sha256(text) AS t, least(5, len(list_distinct(list_filter(w, lambda x: x NOT IN ('when', 'with', 'from', 'that', 'this', 'into', 'find', 'locate', 'which', 'where', 'used', 'after')))))::INTEGER AS n FROM k
    """,
)
def keywords(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.sha2("text", 256).alias("t"), F.size(text.keywords("text")).alias("n"))


@query(
    "intent_router",
    """
    SELECT conv_id, turn, role, CASE WHEN regexp_matches(lower(text), 'test|fail') THEN 'trace' WHEN regexp_matches(lower(text), 'why|explain') THEN 'explain' WHEN contains(lower(text), 'metric') THEN 'metrics' WHEN role = 'user' THEN 'context' ELSE 'chat' END AS intent,
      regexp_extract(text, '`([^`]+)`', 1) AS seed FROM conversations
    """,
)
def intent_router(spark, sf_dir):
    t = F.lower("text")
    intent = F.when(t.rlike("test|fail"), "trace").when(t.rlike("why|explain"), "explain").when(t.contains("metric"), "metrics").when(F.col("role") == "user", "context").otherwise("chat")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", intent.alias("intent"), F.regexp_extract("text", "`([^`]+)`", 1).alias("seed"))


@query(
    "card_measure",
    "SELECT count(*) AS n, sum(strlen(text))::BIGINT AS full_bytes, sum(strlen(trim(substr(string_split(text, chr(10))[1], 1, 240))))::BIGINT AS card_bytes FROM documents",
)
def card_measure(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("signature", F.trim(F.substring(F.element_at(F.split("text", "\n"), 1), 1, 240)))
    made = text.card("signature", F.lit(""), F.lit(""), F.array().cast("array<string>"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("full_bytes"), F.sum(F.octet_length(made)).alias("card_bytes"))


@query(
    "branch_lines",
    r"SELECT page_id, len(list_filter(string_split(replace(replace(html, '<div', chr(10) || ' if '), '<p', chr(10) || 'for '), chr(10)), lambda x: regexp_matches(x, '^\s*(elif|else|if|for|while|except|case)\b')))::INTEGER AS n, len(string_split(html, chr(10)))::INTEGER AS lines FROM pages",
)
def branch_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.branch_count(F.replace(F.replace("html", F.lit("<div"), F.lit("\n if ")), F.lit("<p"), F.lit("\nfor "))).alias("n"), F.size(F.split("html", "\n")).alias("lines"))
