"""Queries of metrics, quantiles, grids and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import metrics, provinces, raster
from ..shared import small
from .registry import query, table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))


@query("""
SELECT n_name, c_mktsegment, n FROM (SELECT n_name, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, c_mktsegment) AS r
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> '' GROUP BY 1, 2) WHERE r = 1
""")
def mode_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mode(_customers(spark, sf_dir), ["n_name"], "c_mktsegment")


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment <> '' GROUP BY 1, 2), t AS (SELECT c_nationkey, sum(n) AS t, count(*) AS k FROM c GROUP BY 1)
SELECT c.c_nationkey, t.k AS categories, round(CASE WHEN t.k > 1 THEN -sum(n / t.t * ln(n / t.t)) / ln(t.k) ELSE 0 END, 6) AS diversity FROM c JOIN t USING (c_nationkey) GROUP BY c.c_nationkey, t.k
""")
def entropy_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.diversity(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment").withColumn("diversity", F.round("diversity", 6))


@query("SELECT c_nationkey, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END), 6) AS ratio, count(*) AS observed FROM customer WHERE c_mktsegment <> '' GROUP BY 1")
def ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.match_ratio(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "BUILDING").withColumn("ratio", F.round("ratio", 6))


@query("""
SELECT p_brand, round(sum(CASE p_type WHEN 'PROMO' THEN 3.0 WHEN 'STANDARD' THEN 1.0 ELSE 0.5 END * 2 + CAST(p_size AS DOUBLE) * -0.5 + CASE WHEN p_name NOT IN ('', '0', 'none') THEN 1.0 ELSE 0.0 END), 4) AS score, count(*) AS observed FROM part GROUP BY 1
""")
def weighted_component_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [{"field": "p_type", "weights": {"PROMO": 3, "STANDARD": 1}, "default": 0.5, "multiplier": 2}, {"field": "p_size", "multiplier": -0.5}, {"field": "p_name", "presence": True}]
    return metrics.component_score(table(spark, sf_dir, "part"), "p_brand", parts).withColumn("score", F.round("score", 4))


@query("""
SELECT l_returnflag, count(l_extendedprice) AS observed, count(*) - count(l_extendedprice) AS missing, round(min(l_extendedprice), 4) AS low, round(max(l_extendedprice), 4) AS high, round(avg(l_extendedprice), 4) AS mean,
  round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1
""")
def interp_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.stats(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").drop("coverage")
    return out.select("l_returnflag", "observed", "missing", *[F.round(c, 4).alias(c) for c in ("low", "high", "mean", "p10", "p50", "p90")])


@query("""
WITH s AS (SELECT l_returnflag, l_discount AS v, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem WHERE l_discount IS NOT NULL AND l_quantity > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
SELECT l_returnflag, min(v) FILTER (c > round(0.33 * (t - 1))) AS q33, min(v) FILTER (c > round(0.5 * (t - 1))) AS q50, min(v) FILTER (c > round(0.9 * (t - 1))) AS q90 FROM c GROUP BY 1
""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount", F.col("l_quantity").cast("long").alias("w"))
    return metrics.weighted_quantiles(rows, ["l_returnflag"], "l_discount", "w", [0.33, 0.5, 0.9])


@query("""
WITH b AS (SELECT l_linestatus, CAST(greatest(0, least(255, floor(l_discount * 255 + 0.5))) AS BIGINT) AS bin, count(*) AS w FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_linestatus ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY l_linestatus) AS t FROM b)
SELECT l_linestatus, round(min(bin) FILTER (c > round(0.5 * (t - 1))) / 255.0, 6) AS q50, round(min(bin) FILTER (c > round(0.9 * (t - 1))) / 255.0, 6) AS q90 FROM c GROUP BY 1
""")
def hist_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.histogram_quantiles(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_discount", [0.5, 0.9])
    return out.select("l_linestatus", F.round("q50", 6).alias("q50"), F.round("q90", 6).alias("q90"))


@query("SELECT l_suppkey, round(sum(v * l_quantity) / nullif(sum(CASE WHEN v IS NOT NULL THEN l_quantity END), 0), 6) AS mean FROM (SELECT l_suppkey, l_quantity, nullif(l_discount, 0.0) AS v FROM lineitem) GROUP BY 1")
def weighted_mean_nullaware(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.nullif(F.col("l_discount"), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(metrics.weighted_mean(v, F.col("l_quantity")), 6).alias("mean"))


@query("""
SELECT c_custkey, round((c - 1) / CAST(t - 1 AS DOUBLE), 9) AS percentile_rank FROM (SELECT c_custkey, count(*) OVER (ORDER BY round(c_acctbal, 0)) AS c, count(*) OVER () AS t FROM customer)
""")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal", 0).alias("v"), F.lit(0).alias("all"))
    return metrics.percentile_rank(rows, ["all"], "v").select("c_custkey", F.round("percentile_rank", 9).alias("percentile_rank"))


_LEVELS = ["r_name", "n_name"]


def _level_sql(part: str) -> str:
    return " UNION ALL ".join(part.replace("$L", level) for level in _LEVELS)


_FROM = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(
    _level_sql(f"SELECT 'mode' AS metric, '$L' AS level, entity, value, CAST(observed AS BIGINT) AS observed FROM (SELECT $L AS entity, c_mktsegment AS value, count(*) AS observed, row_number() OVER (PARTITION BY $L ORDER BY count(*) DESC, c_mktsegment) AS r {_FROM} GROUP BY 1, 2) WHERE r = 1")
    + " UNION ALL "
    + _level_sql(f"SELECT 'count', '$L', $L, CAST(count(DISTINCT c_mktsegment) AS VARCHAR), count(*) {_FROM} GROUP BY $L")
)
def metric_rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    top = metrics.build(c, _LEVELS, metrics.Metric("mode", "c_mktsegment")).select(F.lit("mode").alias("metric"), "level", "entity", "value", "observed")
    for level in _LEVELS:
        top = top.unionByName(c.groupBy(F.col(level).alias("entity")).agg(F.count_distinct("c_mktsegment").cast("string").alias("value"), F.count(F.lit(1)).alias("observed")).select(F.lit("count").alias("metric"), F.lit(level).alias("level"), "entity", "value", "observed"))
    return top


@query("""
WITH s AS (SELECT s_acctbal AS v, CAST(sum(w) AS BIGINT) AS w FROM (SELECT s_acctbal, 1 + s_suppkey % 5 AS w FROM supplier) GROUP BY 1), c AS (SELECT v, w, sum(w) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM s),
q AS (SELECT min(v) FILTER (c > round(0.33 * (t - 1))) AS lo, min(v) FILTER (c > round(0.67 * (t - 1))) AS hi FROM c),
g AS (SELECT s_nationkey, sum(1 + s_suppkey % 5) AS n, sum(CASE WHEN s_acctbal <= lo THEN 1 + s_suppkey % 5 ELSE 0 END) AS l, sum(CASE WHEN s_acctbal >= hi THEN 1 + s_suppkey % 5 ELSE 0 END) AS h FROM supplier, q GROUP BY 1)
SELECT s_nationkey, 1.0::DOUBLE AS coverage, CASE WHEN l / n >= 0.6 THEN 'shallow' WHEN h / n >= 0.6 THEN 'deep' ELSE 'mixed' END AS depth_class FROM g
""")
def depth_tertile_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("w", 1 + F.col("s_suppkey") % 5)
    return metrics.tertile_classes(rows, "s_acctbal", "w", ["s_nationkey"])


@query("""
SELECT l_suppkey, l_shipmode_, share, rank FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode_, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_suppkey), 9) AS share,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_returnflag || l_linestatus) AS INTEGER) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 2
""")
def material_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("l_shipmode_"), "l_quantity")
    return metrics.shares(rows, ["l_suppkey"], "l_shipmode_", "l_quantity", 2).withColumn("share", F.round("share", 9))


@query("""
SELECT n_name, c_mktsegment, weight FROM (SELECT n_name, c_mktsegment, CAST(sum(CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END) AS BIGINT) AS weight, row_number() OVER (PARTITION BY n_name ORDER BY sum(CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END) DESC, c_mktsegment) AS r
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) WHERE r = 1
""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vote(_customers(spark, sf_dir), ["n_name"], "c_mktsegment", F.when(F.col("c_acctbal") > 0, 2).otherwise(1))


@query("SELECT r_name, round(max(b), 4) AS c_acctbal, count(*) AS parts FROM (SELECT r_name, n_name, max(c_acctbal) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) GROUP BY 1")
def development_once_per_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.once_per(_customers(spark, sf_dir), "r_name", "n_name", "c_acctbal").withColumn("c_acctbal", F.round("c_acctbal", 4))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of all orders: x is the order's place in its block of 512, y the block, the label made of customer and status."""
    o = table(spark, sf_dir, "orders")
    label = F.col("o_custkey") % 4 + F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return o.select((F.floor(F.col("o_orderkey") / 512)).alias("y"), (F.col("o_orderkey") % 512).alias("x"), label.alias("label"), F.col("o_totalprice").alias("h"))


_CELLS = "WITH g AS (SELECT o_orderkey // 512 AS y, o_orderkey % 512 AS x, o_custkey % 4 + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS label, o_totalprice AS h FROM orders)"


@query(_CELLS + " SELECT label, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY y, label ORDER BY x) AS i FROM g) GROUP BY label, y, i")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.runs(_cells(spark, sf_dir))


@query(
    _CELLS
    + """, n AS (SELECT a.label AS l, b.label AS o FROM g a JOIN g b ON a.y = b.y AND b.x = a.x + 1 UNION ALL SELECT a.label, b.label FROM g a JOIN g b ON a.x = b.x AND b.y = a.y + 1)
SELECT least(l, o) AS a, greatest(l, o) AS b, count(*) AS border FROM n WHERE l > 0 AND o > 0 AND l <> o GROUP BY 1, 2"""
)
def raster_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.adjacency(_cells(spark, sf_dir))


@query(
    _CELLS
    + """, s AS (SELECT a.y, a.x, a.label, count(b.label) AS inner_sides FROM g a LEFT JOIN g b ON b.label = a.label AND ((a.y = b.y AND (b.x = a.x + 1 OR b.x = a.x - 1)) OR (a.x = b.x AND (b.y = a.y + 1 OR b.y = a.y - 1))) WHERE a.label > 0 GROUP BY 1, 2, 3)
SELECT label, count(*) AS area, CAST(sum(4 - inner_sides) AS BIGINT) AS perimeter, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(avg(x), 6) AS centre_x, round(avg(y), 6) AS centre_y FROM s GROUP BY 1"""
)
def perimeter_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raster.shapes(_cells(spark, sf_dir))
    return s.withColumn("centre_x", F.round("centre_x", 6)).withColumn("centre_y", F.round("centre_y", 6))


@query(
    _CELLS
    + """, a AS (SELECT g.*, coalesce(l.h, g.h) AS hl, coalesce(r.h, g.h) AS hr, coalesce(u.h, g.h) AS hu, coalesce(d.h, g.h) AS hd FROM g LEFT JOIN g l ON l.y = g.y AND l.x = g.x - 1 LEFT JOIN g r ON r.y = g.y AND r.x = g.x + 1
  LEFT JOIN g u ON u.x = g.x AND u.y = g.y - 1 LEFT JOIN g d ON d.x = g.x AND d.y = g.y + 1),
s AS (SELECT label, h, sqrt(power((hr - hl) / 2, 2) + power((hd - hu) / 2, 2)) AS slope, atan2(-(hr - hl) / 2, (hd - hu) / 2) AS aspect FROM a)
SELECT label, count(*) AS pixels, round(min(h), 4) AS low, round(avg(h), 4) AS mean, round(max(h), 4) AS high, round(quantile_cont(h, 0.5), 4) AS p50, round(avg(slope), 4) AS slope, round(atan2(sum(sin(aspect) * slope), sum(cos(aspect) * slope)), 5) AS aspect FROM s GROUP BY 1"""
)
def zonal_stats_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = raster.zonal(_cells(spark, sf_dir))
    return z.select("label", "pixels", *[F.round(c, 4).alias(c) for c in ("low", "mean", "high", "p50", "slope")], F.round("aspect", 5).alias("aspect"))


@query(
    _CELLS
    + """, t AS (SELECT y, x, CAST(1 + floor(h / 100000) AS BIGINT) AS label FROM g), o AS (SELECT g.label AS source, t.label AS target, count(*) AS pixels FROM g JOIN t USING (y, x) WHERE g.label > 0 GROUP BY 1, 2),
sa AS (SELECT label, count(*) AS n FROM g WHERE label > 0 GROUP BY 1), ta AS (SELECT label, count(*) AS n FROM t GROUP BY 1)
SELECT source, target, pixels, round(pixels / sa.n, 6) AS source_share, round(least(1, pixels / ta.n), 6) AS target_share FROM o JOIN sa ON source = sa.label JOIN ta ON target = ta.label WHERE pixels / sa.n >= 0.2 OR pixels / ta.n >= 0.2"""
)
def raster_overlap_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.diff import significant

    g = _cells(spark, sf_dir)
    out = significant(raster.overlaps(g, g.select("y", "x", (1 + F.floor(F.col("h") / 100000)).alias("label"))), 0.2)
    return out.select("source", "target", "pixels", F.round("source_share", 6).alias("source_share"), F.round("target_share", 6).alias("target_share"))


@query("""
WITH p AS (SELECT o_orderkey, CAST(o_custkey % 41 - 20 AS DOUBLE) AS dx, CAST(o_orderkey % 37 - 18 AS DOUBLE) AS dy FROM orders)
SELECT o_orderkey, round(sqrt(dx * dx + dy * dy), 6) AS distance, round(CASE WHEN degrees(atan2(dx, -dy)) < 0 THEN degrees(atan2(dx, -dy)) + 360 ELSE degrees(atan2(dx, -dy)) END, 6) AS bearing,
  CASE WHEN dx = 0 AND dy = 0 THEN 'same' WHEN abs(dx) < 0.45 * abs(dy) THEN CASE WHEN dy < 0 THEN 'north' ELSE 'south' END WHEN abs(dy) < 0.45 * abs(dx) THEN CASE WHEN dx < 0 THEN 'west' ELSE 'east' END
    ELSE CASE WHEN dy < 0 THEN 'north' ELSE 'south' END || CASE WHEN dx < 0 THEN 'west' ELSE 'east' END END AS direction FROM p WHERE NOT (dx = 0 AND dy = 0)
""")
def bearing_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 41 - 20).cast("double").alias("dx"), (F.col("o_orderkey") % 37 - 18).cast("double").alias("dy")).where("dx <> 0 or dy <> 0")
    dx, dy = F.col("dx"), F.col("dy")
    return o.select("o_orderkey", F.round(scalars.distance(dx, dy), 6).alias("distance"), F.round(scalars.bearing(dx, dy), 6).alias("bearing"), scalars.direction(dx, dy).alias("direction"))


@query("""
SELECT c_custkey, CAST(greatest(0, 50 + CASE WHEN c_acctbal < 0 THEN -60 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 30 WHEN c_mktsegment = 'MACHINERY' THEN 10 WHEN c_mktsegment = 'FURNITURE' THEN -20 ELSE 0 END
  + CASE WHEN c_nationkey % 5 = 0 THEN 8 ELSE 0 END + CASE c_nationkey % 4 WHEN 0 THEN 4 WHEN 3 THEN 0 ELSE 2 END - 8 * (c_nationkey % 2) + CASE WHEN c_acctbal > 5000 THEN 12 ELSE 0 END) AS INTEGER) AS score FROM customer
""")
def additive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as building sites."""
    seg, bal, no = F.col("c_mktsegment"), F.col("c_acctbal"), F.lit(False)
    holding = F.when(seg == "MACHINERY", "great_city_holding").when(seg == "FURNITURE", "None").otherwise("other")
    site = table(spark, sf_dir, "customer").select(
        "c_custkey", (seg == "BUILDING").alias("empty_slot"), (bal < 0).alias("has_special"), (bal > 5000).alias("capital"), (F.col("c_nationkey") % 5 == 0).alias("coastal"),
        no.alias("inland_water"), no.alias("pass_or_choke"), no.alias("border"), holding.alias("holding"), (F.col("c_nationkey") % 4).alias("water_hops"), F.lit(None).cast("int").alias("same_culture_near"), (F.col("c_nationkey") % 2).alias("special_near"),
    )
    return provinces.building_score(site).select("c_custkey", F.col("score").cast("int").alias("score"))


@query("""
WITH n AS (SELECT c_nationkey AS id, count(*) FILTER (c_acctbal > 9000) AS water, count(*) FILTER (c_acctbal BETWEEN 0 AND 300) AS land, count(*) FILTER (c_acctbal < -900) AS mountains FROM customer GROUP BY 1)
SELECT id, array_to_string(list_filter([CASE WHEN water > 0 THEN 'coastal' END, CASE WHEN water > 0 AND land = 0 THEN 'island_like' END, CASE WHEN water > 0 AND land <= 2 THEN 'peninsula_like' END, CASE WHEN mountains > 0 THEN 'near_mountains' END,
  CASE WHEN mountains > 0 AND land >= 2 THEN 'mountain_pass_candidate' END, CASE WHEN land <= 2 AND (water > 0 OR mountains > 0) THEN 'chokepoint_candidate' END, CASE WHEN water = 0 AND mountains >= 2 THEN 'inland_basin_candidate' END], lambda x: x IS NOT NULL), ',') AS tags FROM n
""")
def geography_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("c_acctbal")
    near = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count_if(b > 9000).alias("water"), F.count_if(b.between(0, 300)).alias("land"), F.count_if(b < -900).alias("mountains"))
    return raster.geography_tags(near.withColumn("mountainous", F.lit(False))).select("id", F.array_join("tags", ",").alias("tags"))


def region_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's nation as a strip of pixels, split among three seeds; rows only."""
    s = table(spark, sf_dir, "supplier").withColumn("i", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    pixels = s.select(F.col("s_nationkey").cast("long").alias("label"), F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), (F.col("s_acctbal") / 10000).alias("resistance"))
    seeds = pixels.groupBy("label").agg(F.min(F.struct("y", "x")).alias("a"), F.max(F.struct("y", "x")).alias("b")).select("label", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("seed"), "a.y", "a.x"), F.struct(F.lit(2).cast("long").alias("seed"), "b.y", "b.x"))).alias("s")).select("label", "s.*")
    return raster.grow_regions(pixels, small(seeds))


query()(region_grow)
