"""Routes over provinces: the graph they run on, and what a found path consists of and passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import segment_distance
from ..shared import small


def boundary_kind(from_water: Column, to_water: Column, blocked: Column, mountain: Column) -> Column:
    """How two touching provinces meet: water counts before what is blocked, as navigable water is blocked land."""
    return F.when(from_water | to_water, "water_boundary").when(blocked & mountain, "impassable_mountain_boundary").when(blocked, "blocked_boundary").otherwise("land_boundary")


def route_graph(adjacent: DataFrame, passages: DataFrame, provinces: DataFrame) -> DataFrame:
    """Directed edges (u, v, kind, blocked, w) of adjacencies (u, v, blocked) and passages (u, v, kind), w being the distance of centres.

    Of an adjacency stated twice the unblocked statement holds; passages that are gateways lead nowhere.
    provinces: id, x, y, water; and, if there is one, block_kind, in which impassable mountains are named.
    """
    a = adjacent.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "blocked").where("u <> v").groupBy("u", "v").agg(F.bool_and("blocked").alias("blocked"))
    block = F.coalesce("block_kind", F.lit("")) if "block_kind" in provinces.columns else F.lit("")
    p = provinces.select("id", "x", "y", "water", block.contains("mountain").alias("mountain"))
    ends = [p.select(*[F.col(c).alias(f"{c}_{e}") for c in p.columns]) for e in ("u", "v")]
    near = a.withColumn("kind", F.lit(None).cast("string")).unionByName(passages.where("not contains(kind, 'gateway')").select("u", "v", "kind", F.lit(False).alias("blocked")))
    both = near.join(ends[0], F.col("u") == F.col("id_u")).join(ends[1], F.col("v") == F.col("id_v"))
    kind = F.coalesce("kind", boundary_kind(F.col("water_u"), F.col("water_v"), F.col("blocked"), F.col("mountain_u") | F.col("mountain_v")))
    one = both.select("u", "v", kind.alias("kind"), "blocked", F.hypot(F.col("x_u") - F.col("x_v"), F.col("y_u") - F.col("y_v")).alias("w"), F.col("water_u").alias("from_sea"), F.col("water_v").alias("to_sea"))
    return one.union(one.select("v", "u", "kind", "blocked", "w", "to_sea", "from_sea"))


def priced(edges: DataFrame, mode: str, switch: float = 250.0, scenic: dict[str, float] | None = None) -> DataFrame:
    """The edges that a mode may take, with their price: going aboard or ashore costs extra in `mixed`; scenic factors by kind make the column `scenic`."""
    from .graph import edge_allowed

    ok = edges.where(edge_allowed(mode, F.col("kind"), F.col("blocked"), F.col("from_sea"), F.col("to_sea")))
    w = F.col("w") + F.when(F.lit(mode == "mixed") & (F.col("from_sea") != F.col("to_sea")), switch).otherwise(0.0)
    factor = F.lit(1.0)
    for kind, f in (scenic or {}).items():
        factor = F.when(F.col("kind") == kind, f).otherwise(factor)
    return ok.select("u", "v", "kind", w.alias("w"), (w * factor).alias("scenic"))


def legs(path: DataFrame) -> DataFrame:
    """(leg, sea, first, last, points, length) of a path (step, node, sea, x, y): its maximal parts by land or sea, with cumulative distances rounded to hundredths."""
    w = Window.orderBy("step")  # a path is bounded by the nodes a route may visit
    d = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    turn = F.coalesce((F.col("sea") != F.lag("sea").over(w)).cast("int"), F.lit(0))
    marked = path.withColumn("_d", d).withColumn("_t", turn).withColumn("leg", F.sum("_t").over(w)).withColumn("cum", F.sum("_d").over(w))
    return marked.groupBy("leg", "sea").agg(F.min_by("node", "step").alias("first"), F.max_by("node", "step").alias("last"), F.count(F.lit(1)).alias("points"), F.round(F.sum("_d"), 2).alias("length"), F.round(F.max("cum"), 2).alias("travelled"))


def corridor(nodes: DataFrame, path: DataFrame, radius: float) -> DataFrame:
    """(id, distance) of nodes (id, x, y) within a radius of a path (step, x, y).

    Each segment is put in the square cells of side `radius` that its surroundings touch, and each node in its own: an
    equi-join on cells in place of a comparison of all nodes with all segments.
    """
    w = Window.orderBy("step")
    seg = path.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    cell = lambda c: F.floor(c / F.lit(float(radius)))
    lo = lambda a, b: cell(F.least(a, b) - radius)
    hi = lambda a, b: cell(F.greatest(a, b) + radius)
    laid = seg.withColumn("cx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("cy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    here = nodes.select("id", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    d = segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
    return here.join(small(laid), ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).groupBy("id").agg(F.min("d").alias("distance"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes of the starts' components (edges in both directions)."""
    from .graph import components

    of = components(edges.select("u", "v"))
    mine = starts.join(of, starts["node"] == of["vertex"]).select("component").distinct()
    return of.join(mine, "component", "left_semi").select(F.col("vertex").alias("node")).union(starts.select("node")).distinct()


def core_of(titles: DataFrame, provinces: DataFrame) -> DataFrame:
    """(title, province): of each title's provinces (title, id, capital, area) the capital, else the largest, then the least id."""
    rows = titles.join(provinces, "id")
    best = F.min(F.struct((~F.col("capital")).alias("c"), (-F.col("area")).alias("a"), "id"))
    return rows.groupBy("title").agg(best.alias("b")).select("title", F.col("b.id").alias("province"))


def borders(inside: DataFrame, edges: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """The outside groups that a set of provinces (id) borders most: (grp, border), longest first."""
    out = edges.join(inside.select(F.col("id").alias("u")), "u", "left_semi").join(inside.select(F.col("id").alias("v")), "v", "left_anti")
    return out.join(names.select(F.col("id").alias("v"), "grp"), "v").groupBy("grp").agg(F.sum("border").alias("border")).orderBy(F.desc("border"), "grp").limit(limit)


def representatives(rows: DataFrame, key: str, orders: list[Column], limit: int) -> list:
    """Up to limit keys: the first of each order that is new, in turn, until there are enough. Only the heads of the orders reach the driver."""
    heads = [[r[0] for r in rows.orderBy(o, key).limit(limit).select(key).collect()] for o in orders]
    out: list = []
    for i in range(limit):
        for h in heads:
            if i < len(h) and h[i] not in out and len(out) < limit:
                out.append(h[i])
    return out
