"""Queries of graphs: neighbourhoods, chains, components, paths, diffusion and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges (u, v, w) between nations whose customers order from whose suppliers; w is the number of lines."""
    l, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    both = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return both.groupBy(F.col("c_nationkey").cast("long").alias("u"), F.col("s_nationkey").cast("long").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))


_TRADE = "t AS (SELECT CAST(c_nationkey AS BIGINT) AS u, CAST(s_nationkey AS BIGINT) AS v, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
#: A sparse directed graph over all customers: each points to its third and to its successor's half.
_HEAP = "h AS (SELECT c_custkey AS u, c_custkey // 3 AS v FROM customer WHERE c_custkey // 3 > 0 UNION SELECT c_custkey, (c_custkey + 7) // 2 FROM customer WHERE (c_custkey + 7) // 2 IN (SELECT c_custkey FROM customer))"


def _heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"))
    a = c.select("u", F.floor(F.col("u") / 3).alias("v")).where("v > 0")
    b = c.select("u", F.floor((F.col("u") + 7) / 2).alias("v")).join(c.select(F.col("u").alias("v")), "v", "left_semi")
    return a.union(b.select("u", "v")).distinct()


@query(f"""
WITH {_HEAP}, e AS (SELECT u, v FROM h WHERE u <> v UNION SELECT v, u FROM h WHERE u <> v), s AS (SELECT c_custkey AS n FROM customer WHERE c_mktsegment = 'BUILDING'),
a AS (SELECT DISTINCT n AS seed, v AS node FROM s JOIN e ON u = n), b AS (SELECT DISTINCT a.seed, e.v AS node FROM a JOIN e ON e.u = a.node)
SELECT seed, node, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT n AS seed, n AS node, 0 AS hops FROM s UNION ALL SELECT seed, node, 1 FROM a UNION ALL SELECT seed, node, 2 FROM b) GROUP BY 1, 2
""")
def khop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return graph.hops(graph.undirected(_heap(spark, sf_dir)), seeds, 2)


@query(f"""
WITH RECURSIVE {_HEAP}, e AS (SELECT u, v FROM h WHERE u <> v UNION SELECT v, u FROM h WHERE u <> v),
r AS (SELECT c_custkey AS node, 0 AS hops FROM customer WHERE c_acctbal > 9800 UNION SELECT e.v, r.hops + 1 FROM r JOIN e ON e.u = r.node WHERE r.hops < 3)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1
""")
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "customer").where("c_acctbal > 9800").select(F.col("c_custkey").alias("node"))
    return graph.distance_to(graph.undirected(_heap(spark, sf_dir)), targets, 3)


@query(f"""
WITH RECURSIVE {_HEAP}, r AS (SELECT c_custkey AS node, 0 AS hops FROM customer WHERE c_mktsegment = 'MACHINERY' UNION SELECT h.v, r.hops + 1 FROM r JOIN h ON h.u = r.node WHERE r.hops < 4)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1
""")
def event_chain_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node"))
    return graph.call_chain(_heap(spark, sf_dir), start, 4).select("node", "hops")


@query(f"""
WITH {_HEAP}, n AS (SELECT u AS node, 1 AS o, 0 AS i FROM h UNION ALL SELECT v, 0, 1 FROM h)
SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CASE WHEN sum(i) = 0 THEN 'root' WHEN sum(o) = 0 THEN 'leaf' ELSE 'inner' END AS role FROM n GROUP BY 1
""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_heap(spark, sf_dir))


@query("SELECT doc_id AS vertex, min(doc_id) OVER (PARTITION BY md5(text)) AS component FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a text, as chains of each to the next; components undo the chains."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    chain = d.select(F.col("doc_id").alias("u"), F.lead("doc_id").over(Window.partitionBy("h").orderBy("doc_id")).alias("v")).where("v is not null")
    return graph.components(chain)


@query("""
WITH e AS (SELECT DISTINCT p_partkey AS l, CASE WHEN p_partkey % 3 = 0 THEN p_partkey WHEN p_partkey % 3 = 1 THEN p_partkey + 1000000 ELSE p_partkey - p_partkey % 2 + 2000000 END AS r FROM part
  UNION SELECT p_partkey, p_partkey + 3000000 FROM part WHERE p_partkey % 9 = 1),
nl AS (SELECT l, count(*) AS nr, min(r) AS r FROM e GROUP BY 1), nr AS (SELECT r, count(*) AS nl, min(l) AS l FROM e GROUP BY 1),
g AS (SELECT coalesce(min(e.l) OVER (PARTITION BY e.r), e.l) AS root, e.l, e.r FROM e)
SELECT kind, count(*) AS groups FROM (SELECT c.root, CASE WHEN c.ls = 1 AND c.rs = 1 AND c.l = c.r THEN 'one_to_one' WHEN c.ls = 1 AND c.rs = 1 THEN 'renumbered' WHEN c.ls = 1 THEN 'split' WHEN c.rs = 1 THEN 'merge' ELSE 'complex' END AS kind
  FROM (SELECT root, count(DISTINCT l) AS ls, count(DISTINCT r) AS rs, min(l) AS l, min(r) AS r FROM g GROUP BY root) c) GROUP BY kind
""")
def bipartite_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey")
    to = F.when(k % 3 == 0, k).when(k % 3 == 1, k + 1000000).otherwise(k - k % 2 + 2000000)
    edges = p.select(k.alias("l"), to.alias("r")).union(p.where("p_partkey % 9 = 1").select("p_partkey", k + 3000000)).distinct()
    return graph.bipartite_groups(edges, "l", "r").groupBy("kind").agg(F.count(F.lit(1)).alias("groups"))


@query(f"""
WITH RECURSIVE {_TRADE}, m AS (SELECT avg(w) AS a FROM t), e AS (SELECT u, v FROM t, m WHERE w > 1.1 * a AND u <> v UNION SELECT u, v FROM t WHERE u = v AND u % 5 = 0), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT a.u AS vertex, least(a.u, min(a.v)) AS component FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.u = a.v AND b.v = a.u) GROUP BY a.u
""")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph.cut(_trade(spark, sf_dir))
    mean = t.agg(F.avg("w")).first()[0] or 0.0
    return graph.strong_components(t.where((F.col("w") > 1.1 * mean) & (F.col("u") != F.col("v"))).select("u", "v").union(t.where("u = v and u % 5 = 0").select("u", "v")))


@query(f"""
WITH RECURSIVE {_HEAP}, e AS (SELECT u, v, 1.0 + (u * 7 + v * 13) % 10 AS w FROM h WHERE u <> v UNION SELECT v, u, 1.0 + (u * 7 + v * 13) % 10 FROM h WHERE u <> v),
r AS (SELECT c_custkey AS node, 0.0::DOUBLE AS cost FROM customer WHERE c_custkey = 1 UNION ALL SELECT node, min(cost) FROM (SELECT e.v AS node, r.cost + e.w AS cost FROM r JOIN e ON e.u = r.node WHERE r.cost + e.w <= 14) GROUP BY node)
SELECT node, CAST(min(cost) AS DOUBLE) AS cost FROM r GROUP BY node
""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within cost 14 of customer 1; edges that leave that ball aren't needed inside it."""
    h = _heap(spark, sf_dir).where("u <> v").withColumn("w", (1 + (F.col("u") * 7 + F.col("v") * 13) % 10).cast("double"))
    edges = graph.cut(h.union(h.select("v", "u", "w")).groupBy("u", "v").agg(F.min("w").alias("w")))
    start = table(spark, sf_dir, "customer").where("c_custkey = 1").select(F.col("c_custkey").alias("node"))
    return graph.shortest_paths(edges, start, 1000, 14.0).select("node", "cost")


def _rounds_sql(n: int, rate: list[float], extra: str = "") -> str:
    out, last = "", "v0"
    for i in range(n):
        out += f", v{i + 1} AS (SELECT a.node, a.value + {rate[i]} * coalesce(p.s, 0) AS value FROM {last} a LEFT JOIN (SELECT t.u AS node, sum(t.w * (b.value - c.value)) / sum(t.w) AS s FROM t JOIN {last} b ON b.node = t.v JOIN {last} c ON c.node = t.u {extra} GROUP BY 1) p ON p.node = a.node)"
        last = f"v{i + 1}"
    return out


@query(f"WITH {_TRADE}, v0 AS (SELECT CAST(c_nationkey AS BIGINT) AS node, avg(c_acctbal) AS value FROM customer GROUP BY 1) {_rounds_sql(2, [0.25, 0.1])} SELECT node, round(value, 4) AS value FROM v2")
def diffusion_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.avg("c_acctbal").alias("value")).withColumn("absorption", F.lit(1.0))
    return graph.diffuse(start, graph.cut(_trade(spark, sf_dir)), 2, [0.25, 0.1]).select("node", F.round("value", 4).alias("value"))


@query(f"WITH {_TRADE}, v0 AS (SELECT CAST(c_nationkey AS BIGINT) AS node, avg(c_acctbal) AS value FROM customer GROUP BY 1) {_rounds_sql(2, [0.2, 0.2], 'WHERE b.value > c.value')} SELECT node, round(value, 4) AS value FROM v2")
def diffusion_high_to_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("node")).agg(F.avg("c_acctbal").alias("value")).withColumn("absorption", F.lit(1.0))
    return graph.diffuse(start, graph.cut(_trade(spark, sf_dir)), 2, [], "high_to_low").select("node", F.round("value", 4).alias("value"))


@query(f"""
WITH RECURSIVE {_HEAP}, e AS (SELECT u, v FROM h WHERE u <> v UNION SELECT v, u FROM h WHERE u <> v),
r AS (SELECT c_custkey AS node, 0 AS hops FROM customer WHERE c_acctbal > 9800 UNION SELECT e.v, r.hops + 1 FROM r JOIN e ON e.u = r.node WHERE r.hops < 3), d AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1)
SELECT c_custkey AS node, round(c_acctbal * power(0.5, coalesce(d.hops, 0)), 7) AS value FROM customer LEFT JOIN d ON d.node = c_custkey
""")
def distance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    values, seeds = c.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("value")), c.where("c_acctbal > 9800").select(F.col("c_custkey").alias("node"))
    return graph.decay(values, graph.undirected(_heap(spark, sf_dir)), seeds, 0.5, 3).select("node", F.round("value", 7).alias("value"))


@query("""
WITH RECURSIVE p AS (SELECT c_custkey AS node, CASE WHEN c_custkey >= 5 THEN c_custkey // 5 END AS parent, c_acctbal AS b FROM customer),
r AS (SELECT node, node AS a, 0 AS hops FROM p UNION ALL SELECT r.node, p.parent, r.hops + 1 FROM r JOIN p ON p.node = r.a WHERE p.parent IS NOT NULL AND r.hops < 6)
SELECT node, holder, CAST(hops AS INTEGER) AS hops FROM (SELECT r.node, r.a AS holder, r.hops, row_number() OVER (PARTITION BY r.node ORDER BY r.hops) AS n FROM r JOIN p ON p.node = r.a WHERE p.b > 5000) WHERE n = 1
""")
def ancestor_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    chain = graph.ancestors(c.select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") >= 5, F.floor(F.col("c_custkey") / 5)).alias("parent")), 6)
    holders = c.select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") > 5000, F.col("c_custkey")).alias("holder"))
    return graph.nearest_valid(chain, holders, lambda h: h.isNotNull())


@query("""
WITH RECURSIVE m AS (SELECT c_custkey // 5 AS node, c_custkey AS member FROM customer WHERE c_custkey >= 5), r AS (SELECT node, member, 0 AS d FROM m UNION SELECT r.node, m.member, d + 1 FROM r JOIN m ON m.node = r.member WHERE d < 3)
SELECT DISTINCT node, member FROM r
""")
def region_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "customer").where("c_custkey >= 5").select(F.floor(F.col("c_custkey") / 5).alias("node"), F.col("c_custkey").alias("member"))
    return graph.closure(m, 3)


@query(f"""
WITH {_TRADE}, g AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS grp FROM nation)
SELECT least(a.grp, b.grp) AS a, greatest(a.grp, b.grp) AS b, sum(w) AS w FROM t JOIN g a ON a.node = u JOIN g b ON b.node = v WHERE a.grp <> b.grp GROUP BY 1, 2
""")
def title_adjacency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("grp"))
    return graph.membership_edges(_trade(spark, sf_dir), members)


@query()
def graph_colouring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: a proper colouring of the nations that trade more than average."""
    t = graph.cut(_trade(spark, sf_dir))
    mean = t.agg(F.avg("w")).first()[0] or 0.0
    return graph.colours(t.where(F.col("w") > mean).select("u", "v"), 64)
