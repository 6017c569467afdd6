"""Queries of layers, references, joins, aggregations, sets and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import diagnostics, diff, layers, references, search, temporal
from ..shared import small
from .registry import query, table


@query("""
WITH s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS rk FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT lang, s.rk, count(*) OVER (PARTITION BY lang) AS definitions, min(s.rk) OVER (PARTITION BY lang) AS top
  FROM documents JOIN s ON documents.source IS NOT DISTINCT FROM s.source),
g AS (SELECT lang, definitions, sum(CASE WHEN rk = top THEN 1 ELSE 0 END) AS tops FROM d GROUP BY lang, definitions)
SELECT lang, CAST(definitions AS BIGINT) AS definitions, CAST(CASE WHEN tops = 1 THEN 1 ELSE 0 END AS BIGINT) AS active_count,
  CASE WHEN definitions = 1 THEN 'unique' WHEN tops = 1 THEN 'source_priority' ELSE 'ambiguous' END AS group_status, CAST(tops AS BIGINT) AS top_rows
FROM g
""")
def layer_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    ranks = docs.select(F.col("source").alias("_source")).distinct().withColumn("source_rank", F.row_number().over(Window.orderBy(F.asc_nulls_first("_source"))))
    per = docs.join(small(ranks), F.col("source").eqNullSafe(F.col("_source"))).groupBy("lang", "source_rank").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("lang").agg(F.sum("n").alias("definitions"), F.min_by("n", "source_rank").alias("top_rows"))
    status = F.when(F.col("definitions") == 1, "unique").when(F.col("top_rows") == 1, "source_priority").otherwise("ambiguous")
    return best.select("lang", "definitions", (F.col("top_rows") == 1).cast("long").alias("active_count"), status.alias("group_status"), "top_rows")


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN 'unique' WHEN tops = 1 THEN 'source_priority' ELSE 'ambiguous' END AS group_status,
  CASE WHEN p_size = top AND tops = 1 THEN 'active' WHEN p_size = top THEN 'ambiguous_top_priority' ELSE 'shadowed_by_source_priority' END AS row_status
FROM (SELECT *, sum(CASE WHEN p_size = top THEN 1 ELSE 0 END) OVER (PARTITION BY p_type, p_brand) AS tops
  FROM (SELECT p_partkey, p_type, p_brand, p_size, count(*) OVER (PARTITION BY p_type, p_brand) AS n, min(p_size) OVER (PARTITION BY p_type, p_brand) AS top FROM part))
""")
def definition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    return layers.resolve_definitions(part, ["p_type", "p_brand"], "p_size").select("p_partkey", "group_status", "row_status")


@query("""
SELECT p_partkey, p_size > top AS overridden, CASE WHEN p_size > top THEN 'same_relative_path' END AS override_reason, CASE WHEN p_size > top THEN top END AS override_by_rank
FROM (SELECT p_partkey, p_size, min(p_size) OVER (PARTITION BY p_brand) AS top FROM part)
""")
def override_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("rel_path"), F.col("p_size").alias("source_rank"), F.col("p_name").alias("source_name"))
    return layers.resolve_files(files).select("p_partkey", "overridden", "override_reason", "override_by_rank")


@query("""
WITH f AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS rel_path, CAST(page_id % 3 AS INTEGER) AS source_rank FROM pages),
b AS (SELECT *, min(source_rank) OVER (PARTITION BY rel_path) AS top FROM f)
SELECT page_id, (source_rank > top) OR (source_rank > 0 AND rel_path LIKE 'tionsh.example.net/%') AS overridden,
  CASE WHEN source_rank > top THEN 'rel_path' WHEN source_rank > 0 AND rel_path LIKE 'tionsh.example.net/%' THEN 'tionsh.example.net' END AS override_rule
FROM b
""")
def override_replace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("rel_path"), (F.col("page_id") % 3).cast("int").alias("source_rank"), F.concat(F.lit("layer"), F.col("page_id") % 3).alias("source_name"))
    replaced = spark.createDataFrame([("layer0", 0, "tionsh.example.net/")], "source_name string, source_rank int, prefix string")
    return layers.resolve_files(files, replaced).select("page_id", "overridden", "override_rule")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def object_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type")


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS orders, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large,
  CAST(sum(CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS early FROM orders GROUP BY 1, 2
""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_if(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early"))


@query("""
SELECT count(*) AS lines, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS returned, CAST(count(*) FILTER (l_linestatus = 'O') AS BIGINT) AS open,
  count(DISTINCT l_suppkey) AS suppliers, CAST(count(*) FILTER (l_discount IS NULL) AS BIGINT) AS undiscounted FROM lineitem
""")
def scalar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_discount").isNull()).alias("undiscounted"))


_SEVERITY = ["purchase", "signup", "click"]


@query("""
SELECT e.event_type AS code, coalesce(lower(c.c_mktsegment), '') AS layer, count(*) AS n,
  CAST(CASE e.event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS INTEGER) AS severity_order
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey GROUP BY ALL
""")
def hotspots_case_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = table(spark, sf_dir, "events").select("user_id", "event_type"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    by = e.join(c, e["user_id"] == c["c_custkey"], "left").groupBy(F.col("event_type").alias("code"), F.coalesce(F.lower("c_mktsegment"), F.lit("")).alias("layer")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("severity_order", diagnostics.severity_order(F.col("code"), _SEVERITY)).orderBy("severity_order", F.desc("n"), "code", "layer")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.duplicates(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])


@query("""
SELECT s_nationkey, s_suppkey, parts FROM (SELECT s_nationkey, s_suppkey, parts, row_number() OVER (PARTITION BY s_nationkey ORDER BY parts DESC, s_suppkey) AS n
  FROM (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) JOIN supplier ON s_suppkey = l_suppkey) WHERE n = 1
""")
def distinct_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))
    rows = per.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    best = rows.groupBy("s_nationkey").agg(F.min(F.struct((-F.col("parts")).alias("k"), "s_suppkey", "parts")).alias("b"))
    return best.select("s_nationkey", "b.s_suppkey", "b.parts")


@query("""
SELECT event_type, shape, n, event_id FROM (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS shape, event_id,
  count(*) OVER (PARTITION BY event_type, floor(value / 10)) AS n, row_number() OVER (PARTITION BY event_type, floor(value / 10) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1
""")
def pattern_first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("shape", F.floor(F.col("value") / 10))
    return e.groupBy("event_type", "shape").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
SELECT l_orderkey, l_linenumber, k.p_partkey IS NOT NULL AS resolved, CASE WHEN k.p_partkey IS NOT NULL THEN 'typed_object' ELSE 'missing_object' END AS reason
FROM lineitem l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) k ON l.l_partkey = k.p_partkey
""")
def ref_semi_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    rows = references.flag_in(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_partkey"], known, "resolved")
    return rows.select("l_orderkey", "l_linenumber", "resolved", F.when(F.col("resolved"), "typed_object").otherwise("missing_object").alias("reason"))


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'localization' WHEN 1 THEN 'resource' WHEN 2 THEN 'flag' WHEN 3 THEN 'scope' WHEN 4 THEN 'title' ELSE 'source' END AS k,
    CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN 'docs/' || source || '.txt' WHEN 4 THEN '0' ELSE source END AS n FROM documents),
r AS (SELECT doc_id, k, CASE
  WHEN k = 'localization' AND n IN ('en', 'de') THEN 'indexed_localization' WHEN k = 'localization' THEN 'missing_localization'
  WHEN k = 'resource' AND n IN (SELECT 'docs/' || source || '.txt' FROM (SELECT DISTINCT source FROM documents WHERE source <> 'src0' AND source IS NOT NULL)) THEN 'indexed_resource'
  WHEN k = 'resource' THEN 'missing_resource' WHEN k = 'flag' THEN 'runtime_symbol' WHEN k = 'title' THEN 'null_reference'
  WHEN k = 'source' AND n <> 'src1' THEN 'typed_object' WHEN n <> 'src1' THEN 'untyped_object' WHEN k = 'scope' THEN 'runtime_scope' ELSE 'missing_object' END AS reason FROM d)
SELECT doc_id, reason, CASE WHEN reason = 'runtime_scope' THEN 'dynamic' WHEN reason LIKE 'missing%' THEN 'unresolved' ELSE 'resolved' END AS state FROM r
""")
def ref_resolution_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    kinds = ["localization", "resource", "flag", "scope", "title", "source"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.when(kind == "localization", F.col("lang")).when(kind == "resource", F.concat(F.lit("docs/"), "source", F.lit(".txt"))).when(kind == "title", "0").otherwise(F.col("source"))
    refs = docs.select("doc_id", kind.alias("ref_kind"), name.alias("ref_name"))
    sources = docs.select("source").distinct().where("source is not null")
    objects = sources.where("source <> 'src1'").select(F.lit("source").alias("object_type"), F.col("source").alias("name"))
    resources = sources.where("source <> 'src0'").select(F.concat(F.lit("docs/"), "source", F.lit(".txt")).alias("path"))
    keys = spark.createDataFrame([("en",), ("de",)], "key string")
    facts = spark.createDataFrame([], "kind string, name string")
    return references.resolve(refs, objects, keys, resources, facts).select("doc_id", "reason", "state")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def ref_anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return references.missing(table(spark, sf_dir, "lineitem").select("l_partkey"), ["l_partkey"], known).distinct()


@query("SELECT DISTINCT user_id || '/' || CAST(floor(value) AS BIGINT) AS name FROM events WHERE event_type = 'signup' AND user_id || '/' || CAST(floor(value) AS BIGINT) NOT IN (SELECT user_id || '/' || CAST(floor(value) AS BIGINT) FROM events WHERE event_type IN ('purchase', 'view') AND user_id IS NOT NULL AND value IS NOT NULL)")
def write_only_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.write_only(table(spark, sf_dir, "events").withColumn("name", F.concat("user_id", F.lit("/"), F.floor("value"))), "name", "event_type", ["signup"], ["purchase", "view"])


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS has_open,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS has_big FROM customer
""")
def exists_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    rows = references.flag_in(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], o.where("o_orderstatus = 'O'"), "has_open")
    return references.flag_in(rows, ["c_custkey"], o.where("o_totalprice > 200000"), "has_big")


@query("""
SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase, round(sum(value) FILTER (event_type = 'signup'), 4) AS signup
FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY user_id
""")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["click", "purchase", "signup"]
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*names))
    return e.groupBy("user_id").pivot("event_type", names).agg(F.round(F.sum("value"), 4))


@query("""
SELECT event_id, o_orderkey AS owner_o_orderkey FROM (
  SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS n
  FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts) WHERE n = 1
""")
def interval_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return layers.owner_of(e, o, ["user_id"], "ts", "o_orderdate", "o_orderkey", ["o_orderkey"]).select("event_id", "owner_o_orderkey")


@query("""
SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n
  FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE n = 1
""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz"))
    best = e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "event_id"), F.struct("ts", "event_id")).alias("b"))
    return best.select("user_id", "event_type", "b.value", "b.event_id")


@query("""
WITH l AS (SELECT user_id, arg_max(value, (ts, value)) AS v FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id),
m AS (SELECT c_mktsegment, min(c_custkey) AS main FROM customer GROUP BY 1),
c AS (SELECT c.c_custkey, l.v AS own, lm.v AS lent FROM customer c JOIN m USING (c_mktsegment) LEFT JOIN l ON l.user_id = c.c_custkey LEFT JOIN l lm ON lm.user_id = m.main)
SELECT c_custkey, coalesce(own, lent) AS value, own IS NULL AND lent IS NOT NULL AS borrowed FROM c
""")
def asof_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("_group"))
    main = c.groupBy("_group").agg(F.min("c_custkey").alias("m"))
    group = c.join(small(main), "_group").select("c_custkey", "_group", (F.col("c_custkey") == F.col("m")).alias("_main"))
    history = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "ts", "value")
    return temporal.as_of_with_fallback(history, "c_custkey", group, "ts", F.lit("2024-01-15").cast("timestamp_ntz"), "value")


@query("""
WITH m AS (SELECT user_id, value, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM events),
g AS (SELECT user_id, ep, sum(value) AS total, count(*) AS steps FROM m GROUP BY 1, 2)
SELECT user_id, round(arg_max(total, ep), 4) AS total, CAST(arg_max(steps, ep) AS BIGINT) AS steps FROM g GROUP BY user_id
""")
def timeline_reset_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = temporal.timeline_total(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("value"))
    return out.select("user_id", F.round("total", 4).alias("total"), "steps")


@query("""
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM (
  SELECT user_id, event_type, arg_max(value, (ts, value)) AS value FROM events WHERE ts <= TIMESTAMP '2024-01-15' AND event_type IN ('click', 'purchase') GROUP BY 1, 2) GROUP BY 1
""")
def snapshot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.snapshot(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", F.lit("2024-01-15").cast("timestamp_ntz"), "value", ["click", "purchase"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.upsert(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def insert_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.upsert(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], last_wins=False).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_custkey FROM orders WHERE o_totalprice > 150000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def union_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where((F.col("o_totalprice") > 150000) | (F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "1-URGENT")).select("o_custkey").distinct()


@query("SELECT 'region' AS kind, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part")
def symbol_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, col in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"), ("part", "p_name")):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(col).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'), a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01')
SELECT o_custkey, 'introduced' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT o_custkey, 'resolved' FROM (FROM b EXCEPT FROM a)
""")
def fingerprint_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, day = table(spark, sf_dir, "orders"), F.lit("1995-06-01").cast("timestamp_ntz")
    return diff.delta(o.where(F.col("o_orderdate") < day), o.where(F.col("o_orderdate") >= day), "o_custkey")


@query("""
WITH s AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(s.p_partkey, b.p_partkey) AS p_partkey, CAST(b.p_size AS VARCHAR) AS base_value, CAST(s.p_size AS VARCHAR) AS source_value,
  CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN s.p_partkey IS NULL THEN 'removed' WHEN s.p_size = b.p_size THEN 'same' ELSE 'changed' END AS status
FROM s FULL JOIN b ON s.p_partkey = b.p_partkey
""")
def field_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    base = p.where("p_partkey % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return diff.field_diff(p.where("p_partkey % 7 <> 0"), base, ["p_partkey"], "p_size")


@query("""
WITH b AS (SELECT p_partkey, p_size AS v FROM part WHERE p_partkey % 13 <> 0),
p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 7 <> 0),
t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + p_partkey % 2 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0),
e AS (SELECT coalesce(b.p_partkey, p.p_partkey, t.p_partkey) AS p_partkey, b.v AS b, p.v AS p, t.v AS t FROM b FULL JOIN p ON b.p_partkey = p.p_partkey FULL JOIN t ON coalesce(b.p_partkey, p.p_partkey) = t.p_partkey),
o AS (SELECT *, CASE WHEN p IS NOT DISTINCT FROM b THEN 'target' WHEN t IS NOT DISTINCT FROM b OR p IS NOT DISTINCT FROM t THEN 'project' WHEN b IS NULL THEN 'add_conflict' WHEN p IS NULL OR t IS NULL THEN 'delete_modify_conflict' ELSE 'conflict' END AS outcome FROM e)
SELECT p_partkey, outcome, CAST(CASE outcome WHEN 'target' THEN t WHEN 'project' THEN p END AS BIGINT) AS merged FROM o
""")
def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("v"))
    k, v = F.col("p_partkey"), F.col("v")
    project = p.where("p_partkey % 7 <> 0").select("p_partkey", F.when(k % 3 == 0, v + 1).otherwise(v).alias("v"))
    target = p.where("p_partkey % 11 <> 0").select("p_partkey", F.when(k % 5 == 0, v + k % 2).otherwise(v).alias("v"))
    return diff.three_way(p.where("p_partkey % 13 <> 0"), project, target, ["p_partkey"], "v")


@query("""
WITH b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 4 <> 0), p AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || 'p' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0),
t AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 't' ELSE text END) AS h FROM documents WHERE doc_id % 9 <> 0),
e AS (SELECT d.doc_id, b.h AS b, p.h AS p, t.h AS t FROM (SELECT doc_id FROM b UNION SELECT doc_id FROM p UNION SELECT doc_id FROM t) d LEFT JOIN b USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT doc_id AS path, CASE WHEN p IS NULL THEN CASE WHEN b IS NULL THEN 'upstream_added' WHEN t IS NULL THEN 'upstream_deleted' WHEN b = t THEN 'unchanged_inherited' ELSE 'upstream_only' END
  WHEN b IS NULL THEN CASE WHEN t IS NULL THEN 'project_added' WHEN p = t THEN 'both_added_same' ELSE 'both_changed' END
  WHEN p = b THEN 'shadow_copy' WHEN t IS NULL THEN 'delete_modify_conflict' WHEN t = b THEN 'project_only' WHEN p = t THEN 'both_changed_same' ELSE 'both_changed' END AS kind FROM e
""")
def file_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    edit = lambda n, s: F.md5(F.when(F.col("path") % n == 0, F.concat("text", F.lit(s))).otherwise(F.col("text"))).alias("hash")
    base = d.where("path % 4 <> 0").select("path", F.md5("text").alias("hash"))
    return diff.classify_files(base, d.where("path % 5 <> 0").select("path", edit(3, "p")), d.where("path % 9 <> 0").select("path", edit(7, "t")))


@query("""
WITH r AS (SELECT md5(text) AS k, doc_id, source FROM documents)
SELECT 'missing_resource:' || k AS fingerprint, CAST(min(doc_id) AS VARCHAR) AS line, count(*) AS occurrences, CAST(2 AS INTEGER) AS rank FROM r GROUP BY k
""")
def diag_fingerprint_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("seq"), F.lit("warning").alias("severity"), F.lit("missing_resource").alias("code"), F.col("source").alias("path"), F.col("doc_id").alias("line"), F.concat(F.lit("resource '"), F.md5("text"), F.lit("' is missing")).alias("message"), F.lit("high").alias("confidence"), F.lit(1).cast("long").alias("occurrences"))
    return diagnostics.aggregate(rows).select("fingerprint", F.col("line").cast("string").alias("line"), "occurrences", "rank")


@query("""
WITH t AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'b_' WHEN 1 THEN 'c_' ELSE 'd_' END || n_nationkey AS title, CASE (n_nationkey + n_regionkey) % 3 WHEN 0 THEN 'c_' WHEN 1 THEN 'd_' ELSE 'k_' END || n_regionkey AS parent, n_nationkey // 6 AS place FROM nation)
SELECT 'bad_parent' AS code, title, parent AS detail FROM t WHERE NOT ((title LIKE 'b%' AND parent LIKE 'c%') OR (title LIKE 'c%' AND parent LIKE 'd%') OR (title LIKE 'd%' AND parent LIKE 'k%'))
UNION ALL SELECT 'missing_place', title, '' FROM t WHERE title LIKE 'b%' AND place <= 0
UNION ALL SELECT 'shared_place', title, string_agg(title, ',') OVER w FROM (SELECT title, place, count(*) OVER (PARTITION BY place) AS n FROM t WHERE title LIKE 'b%' AND place > 0) WHERE n > 1
WINDOW w AS (PARTITION BY place ORDER BY title ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def title_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    level = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % 3 + 1).cast("int"))
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    titles = n.select(F.concat(level(["b_", "c_", "d_"], k), k).alias("title"), F.lit("layer").alias("source"), F.lit(0).alias("rank"), F.concat(level(["c_", "d_", "k_"], k + r), r).alias("parent"), F.floor(k / 6).alias("place"))
    return diagnostics.title_integrity(titles, {"b": ["c"], "c": ["d"], "d": ["k"], "k": ["e", "h"]})


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS locations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def listagg_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return diagnostics.locations(rows, ["r_name"], F.col("n_name"))


@query("""
SELECT o_orderkey, o_totalprice, total, place, has_more FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, count(*) OVER () > 40 AS has_more FROM orders) WHERE place BETWEEN 21 AND 40
""")
def paginate_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey").asc()], 2, 20)


@query("SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER) AS date_key, year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate) AS formatted FROM orders")
def packed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat_ws(".", F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate"))
    return o.select("o_orderkey", scalars.date_key(text).alias("date_key"), scalars.format_date_key(scalars.date_key(text)).alias("formatted"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery') OR c_mktsegment IS NULL")
def public_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = spark.createDataFrame([("Building", True), ("MACHINERY", True), ("FURNITURE", False)], "name string, private boolean")
    return layers.public_only(table(spark, sf_dir, "customer"), hidden, "c_mktsegment").select("c_custkey", "c_name")


@query("""
WITH o AS (SELECT p_name AS rel_path, p_size % 3 AS rk, count(DISTINCT p_type || p_brand) AS n FROM part GROUP BY 1, 2),
w AS (SELECT rel_path, arg_min(n, rk) AS wn, min(rk) AS wr FROM o GROUP BY 1)
SELECT rel_path, CAST(wn AS BIGINT) AS winner_count, 'layer' || arg_min(rk, -n * 10 + rk) AS loser, CAST(max(n) AS BIGINT) AS loser_count FROM w JOIN o USING (rel_path) WHERE rk > wr GROUP BY rel_path, wn HAVING max(n) > wn
""")
def partial_override_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("rel_path"), (F.col("p_size") % 3).alias("source_rank"), F.concat(F.lit("layer"), F.col("p_size") % 3).alias("source_name"), F.concat("p_type", "p_brand").alias("name"))
    top = p.groupBy("rel_path").agg(F.min("source_rank").alias("_top"))
    rows = p.join(small(top), "rel_path").withColumn("overridden", F.col("source_rank") > F.col("_top"))
    return layers.partial_overrides(rows).select("rel_path", "winner_count", "loser", "loser_count")


@query("""
WITH e AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'error' ELSE 'warning' END AS severity FROM labels),
r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'localization' WHEN 1 THEN 'object' ELSE 'flag' END AS k FROM documents),
x AS (SELECT doc_id, count(*) FILTER (k = 'object') AS b, count(*) FILTER (k = 'localization') AS w FROM r WHERE k <> 'flag' GROUP BY 1),
y AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS b, count(*) FILTER (severity <> 'error') AS w FROM e GROUP BY 1),
z AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.b, 0) + coalesce(y.b, 0) AS blocking, coalesce(x.w, 0) + coalesce(y.w, 0) AS warnings FROM x FULL JOIN y ON x.doc_id = y.doc_id)
SELECT doc_id, CAST(blocking AS BIGINT) AS blocking, CAST(warnings AS BIGINT) AS warnings, CASE WHEN blocking > 0 THEN 'blocked' WHEN warnings > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM z
""")
def preflight_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "error").otherwise("warning").alias("severity"))
    kind = F.element_at(F.array(F.lit("localization"), F.lit("object"), F.lit("flag")), (F.col("doc_id") % 3 + 1).cast("int"))
    refs = table(spark, sf_dir, "documents").select("doc_id", kind.alias("ref_kind"), F.lit("unresolved").alias("state"))
    return diagnostics.preflight(refs, errors, "doc_id")


@query("SELECT p_brand AS key, 'engine_only' AS side FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 3 EXCEPT SELECT p_brand FROM part WHERE p_size > 48) UNION ALL SELECT p_brand, 'snapshot_only' FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 48 EXCEPT SELECT p_brand FROM part WHERE p_size < 3)")
def rule_audit_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), "p_size")
    return diagnostics.rule_audit(p.where("p_size < 3"), p.where("p_size > 48"), "key")
