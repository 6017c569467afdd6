"""Queries of routes, terrain, rules and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, routes, rules, terrain
from .graphs import _TRADE, _trade
from .registry import query, table


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations in order, as the points of a path."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("step"), k.alias("node"), (F.col("n_regionkey") % 2 == 0).alias("sea"), (k * 8).cast("double").alias("x"), (k * 37 % 60).cast("double").alias("y"))


_PATH = "p AS (SELECT CAST(n_nationkey AS BIGINT) AS step, n_regionkey % 2 = 0 AS sea, CAST(n_nationkey * 8 AS DOUBLE) AS x, CAST(n_nationkey * 37 % 60 AS DOUBLE) AS y FROM nation)"


@query(f"""
WITH {_PATH}, s AS (SELECT x AS ax, y AS ay, lead(x) OVER (ORDER BY step) AS bx, lead(y) OVER (ORDER BY step) AS b2 FROM p), n AS (SELECT c_custkey AS id, CAST(c_custkey % 200 AS DOUBLE) AS x, CAST(c_custkey // 200 % 60 AS DOUBLE) AS y FROM customer),
d AS (SELECT id, x, y, ax, ay, bx, b2, greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (b2 - ay)) / ((bx - ax) * (bx - ax) + (b2 - ay) * (b2 - ay)))) AS t FROM n, s WHERE bx IS NOT NULL)
SELECT id, round(min(sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (b2 - ay), 2))), 6) AS distance FROM d GROUP BY id HAVING min(sqrt(power(x - ax - t * (bx - ax), 2) + power(y - ay - t * (b2 - ay), 2))) <= 3
""")
def corridor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 200).cast("double").alias("x"), (F.floor(F.col("c_custkey") / 200) % 60).cast("double").alias("y"))
    return routes.corridor(nodes, _path(spark, sf_dir), 3.0).withColumn("distance", F.round("distance", 6))


@query(f"""
WITH {_PATH}, d AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS d, CASE WHEN sea <> lag(sea) OVER w THEN 1 ELSE 0 END AS t FROM p WINDOW w AS (ORDER BY step)),
l AS (SELECT *, CAST(sum(t) OVER (ORDER BY step) AS BIGINT) AS leg, sum(d) OVER (ORDER BY step) AS cum FROM d)
SELECT leg, sea, min(step) AS first, max(step) AS last, count(*) AS points, round(sum(d), 2) AS length, round(max(cum), 2) AS travelled FROM l GROUP BY leg, sea
""")
def route_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.legs(_path(spark, sf_dir))


@query("SELECT title, province FROM (SELECT c_nationkey AS title, c_custkey AS province, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 9000 DESC, c_custkey % 17 DESC, c_custkey) AS n FROM customer) WHERE n = 1")
def title_core_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    titles = c.select(F.col("c_nationkey").alias("title"), F.col("c_custkey").alias("id"))
    return routes.core_of(titles, c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 9000).alias("capital"), (F.col("c_custkey") % 17).alias("area")))


@query(f"""
WITH {_TRADE}, g AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS grp FROM nation)
SELECT b.grp, sum(w) AS border FROM t JOIN g a ON a.id = u JOIN g b ON b.id = v WHERE a.grp = 0 AND b.grp <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def neighbour_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("grp"))
    return routes.borders(g.where("grp = 0").select("id"), _trade(spark, sf_dir).withColumnRenamed("w", "border"), g, 10)


@query("""
SELECT s_nationkey AS body, count(*) AS members, CAST(sum(1 + s_suppkey % 7) AS BIGINT) AS area, round(sum(s_acctbal * (1 + s_suppkey % 7)) / sum(1 + s_suppkey % 7), 4) AS mean_depth, max(s_acctbal) AS max_depth,
  round(sum(s_suppkey % 100 * (1 + s_suppkey % 7)) / sum(1 + s_suppkey % 7), 4) AS x FROM supplier GROUP BY 1
""")
def water_body_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("body"), k.alias("id"), (1 + k % 7).alias("area"), F.col("s_acctbal").alias("depth"), (k % 100).alias("x"), (k % 37).alias("y"))
    return terrain.body_statistics(rows).select("body", "members", "area", F.round("mean_depth", 4).alias("mean_depth"), "max_depth", F.round("x", 4).alias("x"))


@query("""
WITH s AS (SELECT s_suppkey AS id, s_nationkey AS body, abs(s_acctbal) AS depth, s_suppkey % 10 AS slope, (s_suppkey % 5) / 100.0 AS rough FROM supplier),
r AS (SELECT *, greatest(0, least(1, coalesce(depth / nullif(max(depth) OVER w, 0), 0))) AS d, greatest(0, least(1, coalesce(slope / nullif(avg(slope) OVER w, 0) / 3, 0))) AS st FROM s WINDOW w AS (PARTITION BY body))
SELECT id, round(greatest(0, least(1, (1 - d) * 0.78 + (1 - st) * 0.22)), 6) AS shelf, round(greatest(0, least(1, d * 0.82 + least(1, greatest(0, rough * 40)) * 0.18)), 6) AS trench FROM r
""")
def ocean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("body"), F.abs("s_acctbal").alias("depth"), (k % 10).cast("double").alias("slope"), (k % 5 / 100).alias("ruggedness"))
    return terrain.ocean_scores(rows).select("id", F.round("shelf", 6).alias("shelf"), F.round("trench", 6).alias("trench"))


@query(f"""
WITH {_TRADE}, s AS (SELECT CAST(c_nationkey AS BIGINT) AS id, avg(c_acctbal) AS mean, c_nationkey % 2 = 0 AS river, c_nationkey % 7 = 3 AS water FROM customer GROUP BY c_nationkey)
SELECT u, v, CASE WHEN b.water THEN 'mouth' WHEN a.mean - b.mean > 50 THEN 'downstream' WHEN a.mean - b.mean < -50 THEN 'upstream' ELSE 'connected' END AS flow FROM t JOIN s a ON a.id = u JOIN s b ON b.id = v WHERE a.river AND (b.river OR b.water)
""")
def river_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey").cast("long")
    stats = table(spark, sf_dir, "customer").groupBy(k.alias("id")).agg(F.avg("c_acctbal").alias("mean"))
    stats = stats.withColumn("river", F.col("id") % 2 == 0).withColumn("water", F.col("id") % 7 == 3)
    return terrain.river_edges(_trade(spark, sf_dir).select("u", "v"), stats, 50.0)


@query("""
WITH o AS (SELECT p_brand AS rel_path, p_type AS name FROM part WHERE p_size < 25), r AS (SELECT p_name AS rel_path, p_type AS ref_name FROM part), po AS (SELECT p_brand AS rel_path, p_type AS name FROM part WHERE p_size >= 49),
k AS (SELECT name FROM o WHERE rel_path NOT IN (SELECT rel_path FROM po) UNION SELECT name FROM po), lost AS (SELECT name FROM o WHERE rel_path IN (SELECT rel_path FROM po) EXCEPT SELECT name FROM k),
pr AS (SELECT p_brand AS rel_path, p_name AS ref_name FROM part WHERE p_size >= 49)
SELECT rel_path, ref_name, 'patch' AS origin, count(*) AS n FROM pr WHERE ref_name NOT IN (SELECT name FROM k) GROUP BY ALL UNION ALL
SELECT rel_path, ref_name, 'others', count(*) FROM r WHERE ref_name IN (SELECT name FROM lost) AND rel_path NOT IN (SELECT rel_path FROM pr UNION SELECT rel_path FROM po) GROUP BY ALL
""")
def patch_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.lit("part")
    def objects(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("p_brand").alias("rel_path"), kind.alias("object_type"), F.col("p_type").alias("name"))

    refs = p.select(F.col("p_name").alias("rel_path"), kind.alias("ref_kind"), F.col("p_type").alias("ref_name"))
    patch_refs = p.where("p_size >= 49").select(F.col("p_brand").alias("rel_path"), kind.alias("ref_kind"), F.col("p_name").alias("ref_name"))
    out = rules.patch_preflight(objects(p.where("p_size < 25")), refs, objects(p.where("p_size >= 49")), patch_refs)
    return out.groupBy("rel_path", "ref_name", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE t AS (SELECT c_custkey AS type, CASE WHEN c_custkey % 11 = 5 THEN -1 WHEN c_custkey > 3 THEN c_custkey // 4 END AS base FROM customer),
r AS (SELECT type, base AS up, type AS root FROM t UNION ALL SELECT r.type, t.base, r.up FROM r JOIN t ON t.type = r.up)
SELECT type, root, 'resolved' AS status FROM r WHERE up IS NULL UNION ALL SELECT type, up, 'missing_base' FROM r WHERE up IS NOT NULL AND up NOT IN (SELECT type FROM t)
""")
def type_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    types = table(spark, sf_dir, "customer").select(k.alias("type"), F.when(k % 11 == 5, -1).when(k > 3, F.floor(k / 4)).cast("long").alias("base"))
    return rules.inherit(types).select("type", "root", "status")


@query("""
SELECT p_partkey AS name, p_brand AS role FROM part WHERE p_type = 'PROMO' AND contains(lower(p_name), 'r') ORDER BY CASE p_brand WHEN 'Brand#2' THEN 0 WHEN 'Brand#7' THEN 1 ELSE 2 END, length(p_name), p_partkey LIMIT 15
""")
def ranked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("object_type"), F.col("p_partkey").alias("name"), F.col("p_brand").alias("role"), F.lit("").alias("path"), F.col("p_name").alias("text"))
    return rules.examples(rows, "PROMO", "R", ["Brand#2", "Brand#7"], 15).select("name", "role")


@query("SELECT c_custkey, CAST(round(3 + 2 * (c_custkey % 100) - 0.5 * (c_custkey // 100)) AS BIGINT) AS x, CAST(round(-1 + 0.25 * (c_custkey % 100) + c_custkey // 100) AS BIGINT) AS y FROM customer")
def affine_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 100).alias("x"), F.floor(F.col("c_custkey") / 100).alias("y"))
    return terrain.affine(p, [3, 2, -0.5, -1, 0.25, 1])


@query("""
SELECT n_name, round(exp(-sum(s * ln(s))), 6) AS effective FROM (SELECT n_name, n / sum(n) OVER (PARTITION BY n_name) AS s FROM (SELECT n_name, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC) AS r
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE r <= 4) GROUP BY 1
""")
def effective_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = c.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return metrics.effective_categories(counts, ["n_name"], "n", 4).withColumn("effective", F.round("effective", 6))
