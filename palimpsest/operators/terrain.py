"""Water and relief of provinces, from pixel tables and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import histogram_quantiles


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def surface_reference(boundary: DataFrame) -> DataFrame:
    """(label, surface): the median height of each water label's boundary pixels (label, h in 0..1), from 256 bins."""
    return histogram_quantiles(boundary, ["label"], "h", [0.5]).select("label", F.col("q50").alias("surface"))


def body_statistics(provinces: DataFrame) -> DataFrame:
    """Per body: members, area, mean depth weighted by area, greatest depth, and the area-weighted centre (provinces: body, id, area, depth, x, y)."""
    a = F.col("area")
    return provinces.groupBy("body").agg(F.count(F.lit(1)).alias("members"), F.sum(a).alias("area"), (F.sum(F.col("depth") * a) / F.sum(a)).alias("mean_depth"), F.max("depth").alias("max_depth"), (F.sum(F.col("x") * a) / F.sum(a)).alias("x"), (F.sum(F.col("y") * a) / F.sum(a)).alias("y"))


def ocean_scores(provinces: DataFrame) -> DataFrame:
    """provinces (body, id, area, depth, slope, ruggedness) with shelf and trench scores against their bodies."""
    w = Window.partitionBy("body")
    d = _clamp(F.coalesce(F.col("depth") / F.nullif(F.max("depth").over(w), F.lit(0.0)), F.lit(0.0)))
    steep = _clamp(F.coalesce(F.col("slope") / F.nullif(F.avg("slope").over(w), F.lit(0.0)) / 3, F.lit(0.0)))
    return provinces.withColumn("shelf", _clamp((1 - d) * 0.78 + (1 - steep) * 0.22)).withColumn("trench", _clamp(d * 0.82 + _clamp(F.col("ruggedness") * 40) * 0.18))


def coastal_drops(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """(id, drop): the greatest depth below each land province's coast among its water neighbours; stats: id, water, mean, depth."""
    land, sea = stats.where("not water").select(F.col("id").alias("u")), stats.where("water").select(F.col("id").alias("v"), "depth")
    return edges.join(land, "u", "left_semi").join(sea, "v").groupBy(F.col("u").alias("id")).agg(F.max("depth").alias("drop"))


def river_edges(edges: DataFrame, stats: DataFrame, least: float = 0.0) -> DataFrame:
    """(u, v, flow) between river provinces (id, mean, river, water): downstream if the height falls by more than `least`, upstream if it rises, else connected; a river into water is a mouth."""
    a, b = (stats.select(F.col("id").alias(k), F.col("mean").alias(f"h_{k}"), F.col("river").alias(f"r_{k}"), F.col("water").alias(f"w_{k}")) for k in ("u", "v"))
    both = edges.join(a, "u").join(b, "v").where("r_u and (r_v or w_v)")
    fall = F.col("h_u") - F.col("h_v")
    flow = F.when(F.col("w_v"), "mouth").when(fall > least, "downstream").when(fall < -least, "upstream").otherwise("connected")
    return both.select("u", "v", flow.alias("flow"))


def flow_accumulation(height: np.ndarray) -> np.ndarray:
    """How many cells drain through each cell (itself included) by the steepest of eight ways down; pits are first filled to the lowest rim, and flats drain in the order of filling."""
    import heapq

    h, w = height.shape
    seen = np.zeros((h, w), bool)
    to = np.full((h, w, 2), -1, np.int64)
    heap, order = [], []
    for y in range(h):
        for x in range(w):
            if y in (0, h - 1) or x in (0, w - 1):
                seen[y, x] = True
                heapq.heappush(heap, (float(height[y, x]), y, x))
    while heap:
        level, y, x = heapq.heappop(heap)
        order.append((y, x))
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                a, b = y + dy, x + dx
                if (dy or dx) and 0 <= a < h and 0 <= b < w and not seen[a, b]:
                    seen[a, b] = True
                    to[a, b] = y, x
                    heapq.heappush(heap, (max(level, float(height[a, b])), a, b))
    flow = np.ones((h, w), np.int64)
    for y, x in reversed(order):
        if to[y, x, 0] >= 0:
            flow[to[y, x, 0], to[y, x, 1]] += flow[y, x]
    return flow


def accumulate_by_basin(heights: DataFrame, basin: str = "basin") -> DataFrame:
    """(basin, y, x, flow) of pixels (basin, y, x, h); each basin's frame is one group. Cells outside the basin count as its rim."""
    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(p["y"].min()) - 1, int(p["x"].min()) - 1
        grid = np.full((int(p["y"].max()) - y0 + 2, int(p["x"].max()) - x0 + 2), float(p["h"].min()) - 1)
        yy, xx = p["y"].to_numpy() - y0, p["x"].to_numpy() - x0
        grid[yy, xx] = p["h"].to_numpy()
        return pd.DataFrame({basin: key[0], "y": p["y"], "x": p["x"], "flow": flow_accumulation(grid)[yy, xx]})

    kind = heights.schema[basin].dataType.simpleString()
    return heights.groupBy(basin).applyInPandas(one, f"{basin} {kind}, y long, x long, flow long")


def river_order(flow: DataFrame) -> DataFrame:
    """(label, flow, river_class): each label's greatest flow, in five classes by percentile rank (label, flow)."""
    from .metrics import percentile_rank

    most = flow.groupBy("label").agg(F.max("flow").alias("flow")).withColumn("_all", F.lit(0))
    p = percentile_rank(most, ["_all"], "flow")
    r = F.col("percentile_rank")
    return p.select("label", "flow", F.when(r >= 0.98, 5).when(r >= 0.9, 4).when(r >= 0.75, 3).when(r >= 0.5, 2).otherwise(1).alias("river_class"))


def affine(points: DataFrame, a: list[float]) -> DataFrame:
    """points (x, y) moved by x' = a0 + a1 x + a2 y, y' = a3 + a4 x + a5 y, rounded to pixels."""
    x, y = F.col("x"), F.col("y")
    return points.withColumn("_x", F.round(a[0] + a[1] * x + a[2] * y).cast("long")).withColumn("_y", F.round(a[3] + a[4] * x + a[5] * y).cast("long")).drop("x", "y").withColumnRenamed("_x", "x").withColumnRenamed("_y", "y")


def triangle_warp(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """points (x, y) carried from the triangles that hold them (ax, ay, bx, by, cx, cy) to their images (ax2 .. cy2) by barycentric coordinates; the first triangle by id counts.

    Both sides meet in grid cells as wide as the widest triangle, so that a triangle lies in at most four.
    """
    wide = triangles.agg(F.max(F.greatest(*[F.greatest(*three) - F.least(*three) for three in (("ax", "bx", "cx"), ("ay", "by", "cy"))]))).first()[0]
    cell = lambda v: F.floor(v / float(wide or 1))
    over = lambda *three: F.explode(F.sequence(cell(F.least(*three)), cell(F.greatest(*three))))
    t = triangles.withColumn("_cx", over("ax", "bx", "cx")).withColumn("_cy", over("ay", "by", "cy"))
    both = points.join(t, (cell(F.col("x")) == F.col("_cx")) & (cell(F.col("y")) == F.col("_cy")) & (F.col("x") >= F.least("ax", "bx", "cx")) & (F.col("x") <= F.greatest("ax", "bx", "cx")) & (F.col("y") >= F.least("ay", "by", "cy")) & (F.col("y") <= F.greatest("ay", "by", "cy")))
    c = {k: F.col(k) for k in ("x", "y", "ax", "ay", "bx", "by", "cx", "cy")}
    det = (c["by"] - c["cy"]) * (c["ax"] - c["cx"]) + (c["cx"] - c["bx"]) * (c["ay"] - c["cy"])
    u = ((c["by"] - c["cy"]) * (c["x"] - c["cx"]) + (c["cx"] - c["bx"]) * (c["y"] - c["cy"])) / det
    v = ((c["cy"] - c["ay"]) * (c["x"] - c["cx"]) + (c["ax"] - c["cx"]) * (c["y"] - c["cy"])) / det
    inside = both.withColumn("_u", u).withColumn("_v", v).where("_u >= -1e-9 and _v >= -1e-9 and _u + _v <= 1 + 1e-9")
    to = lambda k: F.round(F.col("_u") * F.col(f"a{k}2") + F.col("_v") * F.col(f"b{k}2") + (1 - F.col("_u") - F.col("_v")) * F.col(f"c{k}2")).cast("long")
    return inside.withColumn("_to", F.struct(to("x").alias("x"), to("y").alias("y"))).groupBy(*points.columns).agg(F.min_by("_to", "id").alias("_to")).select(*[F.col(p).alias(f"from_{p}") if p in ("x", "y") else F.col(p) for p in points.columns], "_to.x", "_to.y")


def asset_problems(definitions: DataFrame, pixels: DataFrame) -> DataFrame:
    """(code, subject) of a colour table (id, colour) against a raster (value): colours without definition, definitions without pixels, and repeated ids and colours."""
    used = pixels.select(F.col("value").alias("colour")).distinct()
    d = definitions.select("id", "colour")
    parts = [
        used.where("colour <> 0").join(d, "colour", "left_anti").select(F.lit("undefined_colour").alias("code"), F.col("colour").cast("string").alias("subject")),
        d.join(used, "colour", "left_anti").select(F.lit("missing_pixels"), F.col("id").cast("string")),
        d.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id"), F.col("id").cast("string")),
        d.groupBy("colour").count().where("count > 1").select(F.lit("duplicate_colour"), F.col("colour").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
