"""Queries of text retrieval, extraction and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import diff, references, rules, search
from ..sources import script
from .registry import query, table


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small') AND starts_with(p_brand, 'Brand#1')")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prefix(search.prefix(table(spark, sf_dir, "part"), "p_name", "small"), "p_brand", "Brand#1").select("p_partkey", "p_name")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE instr(text, 'License') > 0")
def contains_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.contains(table(spark, sf_dir, "documents"), "text", "License").select("doc_id", F.length("text").cast("long").alias("n"))


@query(r"SELECT doc_id FROM documents WHERE text ILIKE '%all rights%' OR text LIKE '%100\%%' ESCAPE '\'")
def like_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").ilike(scalars.like_pattern("*all rights*")) | F.col("text").like(scalars.like_pattern("*100") + r"\%%")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])(the|der|las)([^A-Za-z0-9_]|$)', 'i')")
def word_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?i)(^|[^A-Za-z0-9_])(the|der|las)([^A-Za-z0-9_]|$)")).select("doc_id")


@query("""
WITH c AS (SELECT p_name AS name, p_brand AS path, p_size % 4 = 0 AS own, p_name = (SELECT min(p_name) FROM part) AS ex FROM (SELECT p_name, p_brand, p_size, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_size, p_partkey) AS n FROM part) WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY ex, own ORDER BY name, path) AS k FROM c)
SELECT name, path, CAST(place AS INTEGER) AS place FROM (SELECT name, path, row_number() OVER (ORDER BY CASE WHEN ex THEN 0 WHEN own AND k <= 4 THEN 1 ELSE 2 END, name, path) AS place FROM r) WHERE place <= 20
""")
def exact_first_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    first = p.agg(F.min("p_name")).first()[0]
    rows = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("path"), "p_size", "p_partkey")
    once = rows.groupBy("name", "path").agg(F.min(F.struct("p_size", "p_partkey")).alias("b")).select("name", "path", F.col("b.p_size").alias("p_size"))
    return search.rank_results(once, first, F.col("p_size") % 4 == 0, 20, [F.col("name").asc(), F.col("path").asc()], ["name", "path"]).select("name", "path", "place")


def _ranked_sql(terms: list[str]) -> str:
    """BM25 of the documents that hold all terms; a term of several words stands for them in a row."""
    words = [t.split() for t in terms]
    tf = ", ".join(f"len(list_filter(range(1, len(t) - {len(w) - 2}), lambda i: t[i:i + {len(w) - 1}] = {w})) AS f{k}" for k, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(words)))
    idf = [f"CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{k} + 0.5) / (d{k} + 0.5)) END" for k in range(len(words))]
    score = " - ".join(["0.0", *[f"({x}) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * l / avg))" for k, x in enumerate(idf)]])
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS l, {tf} FROM d), w AS (SELECT count(*) AS n, avg(l) AS avg, {df} FROM c)
SELECT doc_id, round({score}, 9) AS score FROM c, w WHERE {" AND ".join(f"f{k} > 0" for k in range(len(words)))} ORDER BY score, doc_id LIMIT 50
"""


@query(_ranked_sql(["rights reserved", "all"]))
def phrase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", '"Rights reserved" ALL', 50)


@query(_ranked_sql(["uber", "die"]))
def accents_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", "ÜBER, die!", 50)


@query(_ranked_sql(["license", "version"]))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", "license version", 50)


@query(r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term FROM documents), i AS (SELECT term, doc_id, count(*) AS tf FROM d GROUP BY 1, 2)
SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM i GROUP BY 1
""")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_counts(table(spark, sf_dir, "documents"), "text")


@query(r"""
WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(url), '/+', '/', 'g'), '^\./', '') AS path FROM pages),
w AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(lower(url), '/+', '/', 'g') WHEN 1 THEN regexp_extract(lower(url), '([^/]+)$', 1) ELSE 'no/such' END AS name FROM pages),
n AS (SELECT DISTINCT name FROM w WHERE name <> '')
SELECT n.name, CASE WHEN e.path IS NOT NULL THEN 'exact' WHEN b.path IS NOT NULL THEN 'basename' ELSE 'none' END AS step, coalesce(e.path, b.path) AS path
FROM n LEFT JOIN p e ON e.path = n.name LEFT JOIN (SELECT regexp_extract(path, '([^/]+)$', 1) AS base, min(path) AS path FROM p GROUP BY 1) b ON b.base = n.name AND e.path IS NULL
""")
def resource_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", scalars.clean_path(F.col("url")).alias("path"))
    name = F.when(F.col("page_id") % 3 == 0, F.col("path")).when(F.col("page_id") % 3 == 1, F.regexp_extract("path", "([^/]+)$", 1)).otherwise("no/such")
    return references.find_resources(pages.select(name.alias("name")).where("name <> ''").distinct(), pages.select("path").distinct())


@query(r"""
WITH l AS (SELECT page_id, unnest(string_split(url || chr(10) || html, chr(10))) AS t, generate_subscripts(string_split(url || chr(10) || html, chr(10)), 1) AS line FROM pages)
SELECT page_id, line::INTEGER AS line, regexp_extract(t, '^\s*([A-Za-z0-9_.\-]+):', 1) AS key FROM l WHERE regexp_matches(t, '^\s*[A-Za-z0-9_.\-]+:')
""")
def loc_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.concat_ws("\n", "url", "html"), "\n")).alias("line", "t"))
    return lines.where(F.col("t").rlike(r"^\s*[A-Za-z0-9_.\-]+:")).select("page_id", (F.col("line") + 1).alias("line"), F.regexp_extract("t", r"^\s*([A-Za-z0-9_.\-]+):", 1).alias("key"))


@query(r"""
WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN CAST(user_id AS VARCHAR) WHEN 3 THEN '{ 1 2 }' WHEN 4 THEN 'culture:' || event_type ELSE 'gfx/' || event_type END AS t FROM events)
SELECT event_id, CASE WHEN t IS NULL OR trim(t) = '' THEN 'empty' WHEN t LIKE '{%' THEN CASE WHEN regexp_matches(t, '^\{\s*\}$') THEN 'empty_block' WHEN regexp_matches(t, '[=<>]') THEN 'block' ELSE 'list' END
  WHEN t IN ('yes', 'no', 'true', 'false') THEN 'boolean' WHEN regexp_matches(t, '^-?\d+$') THEN 'integer' WHEN regexp_matches(t, '^[a-z_]+:') THEN 'scoped' WHEN contains(t, '/') THEN 'path' ELSE 'atom' END AS shape FROM v
""")
def value_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_id") % 6, F.col("event_type")
    t = F.when(k == 0, F.col("props")).when(k == 1, e).when(k == 2, F.col("user_id").cast("string")).when(k == 3, "{ 1 2 }").when(k == 4, F.concat(F.lit("culture:"), e)).otherwise(F.concat(F.lit("gfx/"), e))
    return table(spark, sf_dir, "events").select("event_id", scalars.value_shape(t).alias("shape"))


@query("""
WITH n AS (SELECT lower(trim(r_name)) AS k, 'r' || r_regionkey AS id FROM region UNION SELECT lower(trim(n_name)), 'n' || n_nationkey FROM nation UNION SELECT lower(trim(n_name)), 'x' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0),
a AS (SELECT DISTINCT ' ' || upper(n_name) || ' ' AS asked FROM nation UNION SELECT 'nowhere')
SELECT asked, CASE count(id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM a LEFT JOIN n ON k = lower(trim(asked)) GROUP BY asked
""")
def subject_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    names = r.select(F.col("r_name").alias("name"), F.concat(F.lit("r"), "r_regionkey").alias("id")).union(n.select("n_name", F.concat(F.lit("n"), "n_nationkey"))).union(n.where("n_nationkey % 4 = 0").select("n_name", F.concat(F.lit("x"), "n_nationkey")))
    asked = n.select(F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("asked")).union(spark.createDataFrame([("nowhere",)], "asked string"))
    return search.subjects(names, asked)


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) > 40 THEN substr(trim(text), 1, 40) || '...' ELSE trim(text) END AS clipped, length(text)::BIGINT AS n, len(regexp_extract_all(text, '[^ \\t\\n]+'))::BIGINT AS words FROM conversations")
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.clip_text(F.col("text"), 40).alias("clipped"), F.length("text").cast("long").alias("n"), F.regexp_count("text", F.lit(r"[^ \t\n]+")).cast("long").alias("words"))


@query("""
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'project' || chr(10) || text || chr(10) || 'target'
  ELSE array_to_string(['<<<<<<< project', 'project', '=======', 'target', '>>>>>>> target', text], chr(10)) END) AS digest, doc_id % 2 = 0 AS clean FROM documents WHERE text IS NOT NULL
""")
def text_merge3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with a line added in front on one side, and one at the end on the other."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    rows = d.select("doc_id", F.col("text").alias("base"), F.concat(F.lit("project\n"), "text").alias("project"), F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\ntarget"))).otherwise(F.concat(F.lit("target\n"), "text")).alias("target"))
    return diff.merge_texts(rows, "doc_id").select("doc_id", F.md5("merged").alias("digest"), "clean")


@query("""
SELECT e.event_id AS file_id, n.key, n.value FROM events e, LATERAL (VALUES ('type', event_type), ('user', CAST(user_id AS VARCHAR)), ('k', CAST(json_extract_string(props, '$.k') AS VARCHAR))) n(key, value)
""")
def parse_script_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as block scripts and parsed back into node rows."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("event = { # a comment\n type = "), "event_type", F.lit("\n user=\""), "user_id", F.lit("\"\n props = { k >= "), F.from_json("props", "k long")["k"], F.lit(" }\n}"))
    nodes = script.read_nodes(e.select(F.col("event_id").alias("file_id"), text.alias("text")))
    return nodes.where("value is not null").select("file_id", "key", "value")


@query(r"""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS plain FROM pages
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("plain"))


@query("""
WITH c AS (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'if' WHEN 'assistant' THEN 'else_if' ELSE 'else' END AS key FROM conversations),
b AS (SELECT conv_id, turn, key, lag(key) OVER (PARTITION BY conv_id ORDER BY turn, key, text) AS before FROM c)
SELECT conv_id, turn, key, 'else_without_if' AS code FROM b WHERE key <> 'if' AND coalesce(before NOT IN ('if', 'else_if'), true)
""")
def sibling_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as blocks of a script, of which the lint finds chains out of order."""
    key = F.when(F.col("role") == "user", "if").when(F.col("role") == "assistant", "else_if").otherwise("else")
    order = Window.partitionBy("conv_id").orderBy("turn", "key", "text")
    c = table(spark, sf_dir, "conversations").withColumn("key", key)
    nodes = c.select(F.col("conv_id").alias("file_id"), F.lit(0).alias("parent_local_id"), F.row_number().over(order).alias("local_id"), F.col("turn").alias("start_line"), "key", F.col("key").alias("path"), F.lit(1).alias("depth"), F.lit("block").alias("value_kind"))
    return rules.lint(nodes).select(F.col("file_id").alias("conv_id"), F.col("start_line").alias("turn"), "key", "code")
