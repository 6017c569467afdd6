"""Label grids and height grids as pixel tables: runs, borders, zonal statistics, overlaps, region growing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(pixels: DataFrame) -> DataFrame:
    """(label, y, x0, x1): maximal runs of a label in a row of pixels (y, x, label)."""
    w = Window.partitionBy("y", "label").orderBy("x")
    return pixels.withColumn("_i", F.col("x") - F.row_number().over(w)).groupBy("label", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def pack_runs(rows: list[tuple[int, int, int]]) -> bytes:
    """Runs as little-endian 32-bit triples (y, x0, x1)."""
    return b"".join(struct.pack("<3i", *r) for r in rows)


def unpack_runs(data: bytes) -> Iterator[tuple[int, int, int]]:
    return struct.iter_unpack("<3i", data)


def pixels_of(run_rows: DataFrame) -> DataFrame:
    """The pixels (label, y, x) of runs."""
    return run_rows.select("label", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def neighbours(pixels: DataFrame, value: str) -> DataFrame:
    """pixels (y, x, value) with the values right of and below each, by windows over rows and columns; gaps in the grid have none."""
    row, col = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    right = F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead(value).over(row))
    down = F.when(F.lead("y").over(col) == F.col("y") + 1, F.lead(value).over(col))
    return pixels.withColumn("right", right).withColumn("down", down)


def adjacency(pixels: DataFrame) -> DataFrame:
    """(a, b, border): touching pixel pairs of different positive labels, a < b."""
    sides = neighbours(pixels, "label").select("label", F.explode(F.array("right", "down")).alias("other"))
    pairs = sides.where("label > 0 and other > 0 and label <> other")
    return pairs.groupBy(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).agg(F.count(F.lit(1)).alias("border"))


def shapes(pixels: DataFrame) -> DataFrame:
    """(label, area, perimeter, min_x, max_x, min_y, max_y, centre_x, centre_y) of positive labels; each pixel side that meets another label, none, or the edge counts to the perimeter."""
    row, col = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")

    def same(f, w, c, d):
        return ((f(c).over(w) == F.col(c) + d) & (f("label").over(w) == F.col("label"))).cast("int")

    inner = sum((F.coalesce(same(f, w, c, d), F.lit(0)) for f, w, c, d in ((F.lead, row, "x", 1), (F.lag, row, "x", -1), (F.lead, col, "y", 1), (F.lag, col, "y", -1))), F.lit(0))
    p = pixels.withColumn("_in", inner).where("label > 0")
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.sum(4 - F.col("_in")).alias("perimeter"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.avg("x").alias("centre_x"), F.avg("y").alias("centre_y"))


def gradients(heights: DataFrame) -> DataFrame:
    """heights (y, x, h) with dx, dy, slope, aspect, ruggedness and curvature from the 3 x 3 about each pixel; missing neighbours count as the pixel itself.

    A pixel's eight neighbours are read by windows, never by a self-join: the row's window gives the left and right
    ones, and the column's window carries those of the rows above and below.
    """
    row = Window.partitionBy("y").orderBy("x")
    h = F.col("h")
    beside = heights.withColumn("l", F.when(F.lag("x").over(row) == F.col("x") - 1, F.lag("h").over(row))).withColumn("r", F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead("h").over(row)))
    col = Window.partitionBy("x").orderBy("y")
    up, down = F.lag("y").over(col) == F.col("y") - 1, F.lead("y").over(col) == F.col("y") + 1
    three = F.struct("l", "h", "r")
    near = beside.withColumn("u", F.when(up, F.lag(three).over(col))).withColumn("d", F.when(down, F.lead(three).over(col)))
    around = [F.coalesce(F.col(c), h) for c in ("l", "r", "u.l", "u.h", "u.r", "d.l", "d.h", "d.r")]
    dx, dy = (around[1] - around[0]) / 2, (around[6] - around[3]) / 2
    out = near.select(*heights.columns, dx.alias("dx"), dy.alias("dy"), (F.greatest(h, *around) - F.least(h, *around)).alias("ruggedness"), (h - sum(around[1:], around[0]) / 8).alias("curvature"))
    return out.withColumn("slope", F.hypot("dx", "dy")).withColumn("aspect", F.atan2(-F.col("dx"), F.col("dy")))


def zonal(heights: DataFrame, label: str = "label") -> DataFrame:
    """Per label: count, least, mean, largest height, interpolated deciles, mean slope, ruggedness, ridge and valley, and the circular mean of aspect weighted by slope."""
    g = gradients(heights)
    s = F.col("slope")
    return g.groupBy(label).agg(
        F.count(F.lit(1)).alias("pixels"), F.min("h").alias("low"), F.avg("h").alias("mean"), F.max("h").alias("high"),
        *[F.percentile("h", q).alias(f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9)],
        F.avg("slope").alias("slope"), F.avg("ruggedness").alias("ruggedness"),
        F.avg(F.greatest(F.lit(0.0), F.col("curvature"))).alias("ridge"), F.avg(F.greatest(F.lit(0.0), -F.col("curvature"))).alias("valley"),
        F.atan2(F.sum(F.sin("aspect") * s), F.sum(F.cos("aspect") * s)).alias("aspect"),
    )


def overlaps(source: DataFrame, target: DataFrame) -> DataFrame:
    """(source, target, pixels, source_area, target_area) of two label grids (y, x, label); counted before areas are joined."""
    s, t = source.where("label > 0"), target.where("label > 0")
    both = s.select("y", "x", F.col("label").alias("source")).join(t.select("y", "x", F.col("label").alias("target")), ["y", "x"])
    n = both.groupBy("source", "target").agg(F.count(F.lit(1)).alias("pixels"))
    sa = s.groupBy(F.col("label").alias("source")).agg(F.count(F.lit(1)).alias("source_area"))
    ta = t.groupBy(F.col("label").alias("target")).agg(F.count(F.lit(1)).alias("target_area"))
    return n.join(sa, "source").join(ta, "target")


def merge_grids(base: DataFrame, project: DataFrame, target: DataFrame) -> DataFrame:
    """(y, x, outcome, merged) of three grids (y, x, value); grids merge if no outcome is a conflict."""
    from .diff import three_way

    return three_way(base, project, target, ["y", "x"], "value")


def grow(pixels: list[tuple[int, int]], seeds: list[tuple[int, int]], resistance: dict[tuple[int, int], float], weight: float) -> dict[tuple[int, int], int]:
    """Each pixel's seed by cost 1 + weight * resistance a step between side neighbours; of equal costs the seed reached first. Pieces that no seed reaches go whole to the seed nearest to their centre."""
    import heapq

    free, best, owner, heap = set(pixels), {}, {}, []
    for i, s in enumerate(seeds):
        if s in free and s not in best:
            best[s], owner[s] = 0.0, i
            heapq.heappush(heap, (0.0, i, s))
    while heap:
        cost, i, (y, x) = heapq.heappop(heap)
        if cost > best[y, x] or owner[y, x] != i:
            continue
        for p in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if p in free:
                c = cost + 1 + weight * min(1.0, max(0.0, resistance.get(p, 0.0)))
                if c < best.get(p, float("inf")):
                    best[p], owner[p] = c, i
                    heapq.heappush(heap, (c, i, p))
    left = free - owner.keys()
    while left and seeds:
        piece, todo = [], [min(left)]
        left.discard(todo[0])
        while todo:
            y, x = todo.pop()
            piece.append((y, x))
            for p in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
                if p in left:
                    left.discard(p)
                    todo.append(p)
        cy, cx = (sum(v) / len(piece) for v in zip(*piece, strict=True))
        near = min(range(len(seeds)), key=lambda i: ((seeds[i][0] - cy) ** 2 + (seeds[i][1] - cx) ** 2, i))
        owner.update(dict.fromkeys(piece, near))
    return owner


def grow_regions(pixels: DataFrame, seeds: DataFrame, weight: float = 1.0) -> DataFrame:
    """(label, y, x, region) of pixels (label, y, x, resistance), each label's region split among its seeds (label, seed, y, x); a label is one group of pixels."""
    import pandas as pd

    def one(key, p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s.sort_values("seed")
        at = list(zip(p["y"], p["x"], strict=True))
        owner = grow(at, list(zip(s["y"], s["x"], strict=True)), dict(zip(at, p["resistance"], strict=True)), weight)
        names = s["seed"].tolist()
        return pd.DataFrame({"label": p["label"], "y": p["y"], "x": p["x"], "region": [names[owner[a]] if a in owner else -1 for a in at]})

    return pixels.groupBy("label").cogroup(seeds.groupBy("label")).applyInPandas(one, "label long, y long, x long, region long")


def water_bodies(provinces: DataFrame, edges: DataFrame) -> DataFrame:
    """(province, body) of water provinces (id, kind) joined by edges (u, v) of one kind; named by the least member."""
    from .graph import components

    kinds = provinces.select("id", "kind")
    same = edges.join(kinds.select(F.col("id").alias("u"), F.col("kind").alias("ku")), "u").join(kinds.select(F.col("id").alias("v"), F.col("kind").alias("kv")), "v").where("ku = kv")
    found = components(same.select("u", "v"))
    return kinds.join(found, kinds["id"] == found["vertex"], "left").select(F.col("id").alias("province"), F.coalesce("component", "id").alias("body"))


def geography_tags(near: DataFrame) -> DataFrame:
    """(id, tags) from counts of each province's neighbours (land, water, mountains) and whether it is mountainous."""
    land, water, hills = F.col("land"), F.col("water"), F.col("mountains")
    tags = F.array(
        F.when(water > 0, "coastal"), F.when((water > 0) & (land == 0), "island_like"), F.when((water > 0) & (land <= 2), "peninsula_like"),
        F.when(hills > 0, "near_mountains"), F.when((F.col("mountainous") | (hills > 0)) & (land >= 2), "mountain_pass_candidate"),
        F.when((land <= 2) & ((water > 0) | (hills > 0)), "chokepoint_candidate"), F.when((water == 0) & (hills >= 2), "inland_basin_candidate"),
    )
    return near.select("id", F.array_compact(tags).alias("tags"))


#: A short passage's class by its kind; of sea passages, those up to 80 are straits.
PASSAGES = {"river": "river_crossing", "river_large": "river_crossing", "mountain": "mountain_pass", "sea": "sea_route", "land": "land_passage"}


def passage_kind(kind, length, diagonal: float, from_under, to_under, through_under=None):
    """A strategic passage's class by its kind, its length, and which of its ends, or the province it passes, are underground."""
    under = from_under | to_under | (F.lit(False) if through_under is None else through_under)
    far = length >= max(250.0, 0.05 * diagonal)
    usual = F.lit("explicit_passage")
    for name, found in PASSAGES.items():
        usual = F.when(kind == name, found).otherwise(usual)
    usual = F.when((kind == "sea") & (length <= 80), "strait").otherwise(usual)
    return F.when(under, F.when(~far & from_under & to_under, "underground_internal").otherwise("underground_gateway")).when(far, "offmap_gateway").otherwise(usual)
