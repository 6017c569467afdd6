"""Questions about provinces and titles: metric recipes, neighbourhoods, building sites, and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bearing, direction, distance
from . import graph
from .metrics import Metric, build, diversity, mode, vote

# The weights that results are stated in.
HOLDING_WEIGHTS = {"great_city_holding": 8, "great_city_holding_e": 8, "great_city_holding_m": 8, "metro_holding": 6, "city_holding": 5, "church_holding": 4, "castle_holding": 3, "tribal_holding": 2, "none": 0.5}
TERRAIN_WEIGHTS = {
    "farmlands": 2.5, "floodplains": 2, "oasis": 2, "plains": 1, "drylands": 0.25, "forest": 0, "steppe": 0, "taiga": -0.25,
    "hills": -0.25, "jungle": -0.5, "wetlands": -0.75, "desert": -1, "desert_mountains": -1.25, "mountains": -1.5,
}

HOLDING = {"field": "holding", "weights": HOLDING_WEIGHTS}
TERRAIN = {"field": "terrain", "weights": TERRAIN_WEIGHTS}

# How much of a neighbour's gain a terrain takes up; 0.7 elsewhere.
ABSORPTION = {
    "farmlands": 1, "floodplains": 1, "oasis": 1, "plains": 0.85, "forest": 0.85, "steppe": 0.85, "hills": 0.65, "taiga": 0.65,
    "jungle": 0.65, "wetlands": 0.45, "desert": 0.45, "mountains": 0.25, "desert_mountains": 0.25,
}
USUAL_ABSORPTION = 0.7

#: Metrics by name, with the level that they are usually taken at. Their ids and settings are fixed values.
RECIPES: dict[str, tuple[str, Metric]] = {
    "development_network": ("county", Metric("sum", components=[HOLDING, TERRAIN], transform={"kind": "high_to_low", "rounds": 3, "rates": [0.25, 0.1, 0.04], "cap": 50.0, "floor": 0.0, "absorption": True})),
    "cultural_frontier": ("county", Metric("mode", "culture")),
    "faith_and_holy_sites": ("county", Metric("mode", "religion")),
    "special_building_constellation": ("county", Metric("sum", components=[{"field": "special_building", "presence": True}])),
    "capital_gravity": ("county", Metric("sum", components=[HOLDING, {"field": "is_county_capital", "presence": True, "multiplier": 3}], transform={"kind": "neighbor_mean", "rounds": 1, "rates": [0.15], "cap": 50.0})),
    "settlement_terrain_gap": ("county", Metric("sum", components=[TERRAIN, HOLDING | {"multiplier": -0.45}])),
    "elevation_relief": ("province", Metric("mean", "elevation")),
    "ridge_network": ("province", Metric("mean", "ridge_score")),
    "watershed_flow": ("province", Metric("max", "catchment_area")),
    "composite_rivers": ("province", Metric("sum", components=[{"field": "river_pixel_count"}, {"field": "major_river", "multiplier": 25}])),
    "relative_bathymetry": ("province", Metric("mean", "relative_depth")),
    "continental_shelf": ("province", Metric("mean", "shelf_score")),
    "ocean_basins": ("province", Metric("mode", "ocean_basin_id")),
}


def recipe(members: DataFrame, name: str, level: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(level, entity, value, observed) of a recipe; edges (u, v, w) between entities carry its transform, if it has one."""
    usual, metric = RECIPES[name]
    out = build(members, [level or usual], metric)
    if metric.transform and edges is not None:
        t = metric.transform
        now = out.select(F.col("entity").alias("node"), F.col("value").try_cast("double").alias("value"))
        if t.get("absorption"):
            takes = F.lit(USUAL_ABSORPTION)
            for terrain, share in ABSORPTION.items():
                takes = F.when(F.col("terrain") == terrain, float(share)).otherwise(takes)
            now = now.join(members.groupBy(F.col(level or usual).alias("node")).agg(F.avg(takes).alias("absorption")), "node", "left")
        else:
            now = now.withColumn("absorption", F.lit(1.0))
        moved = graph.diffuse(now, edges, t["rounds"], t["rates"], t["kind"], cap=t.get("cap"), floor=t.get("floor"))
        out = out.drop("value").join(moved.select(F.col("node").alias("entity"), F.round("value", 6).cast("string").alias("value")), "entity").select("level", "entity", "value", "observed")
    return out


def neighbours(edges: DataFrame, provinces: DataFrame, start: int, radius: int) -> DataFrame:
    """(id, hops, distance, bearing, direction) of provinces (id, x, y) within a radius of one, seen from it."""
    near = graph.hops(edges, edges.sparkSession.createDataFrame([(start,)], "node long"), radius).where("hops > 0")
    here = F.broadcast(provinces.where(F.col("id") == start).select(F.col("x").alias("x0"), F.col("y").alias("y0")).limit(1))
    rows = near.join(provinces, near["node"] == provinces["id"]).crossJoin(here)  # one row
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    return rows.select("id", "hops", F.round(distance(dx, dy), 2).alias("distance"), F.round(bearing(dx, dy), 2).alias("bearing"), direction(dx, dy).alias("direction"))


def adjacency_kind(from_block: Column, to_block: Column, blocked: Column) -> Column:
    """The boundary of two provinces by what blocks them (impassable_mountain, water, other or null) and the adjacency's own flag; the first that applies."""
    either = lambda kind: (F.coalesce(from_block, F.lit("")) == kind) | (F.coalesce(to_block, F.lit("")) == kind)
    return F.when(either("impassable_mountain"), "impassable_mountain_boundary").when(either("water"), "water_boundary").when(blocked, "other_blocked_boundary").otherwise("land_border")


def adjacency_water(from_block: Column, to_block: Column, from_water: Column, to_water: Column) -> Column:
    """Of a water boundary, the kind of water: the far side's, else the near side's; null for other boundaries."""
    known = lambda x: F.when(x != "", x)
    return F.when(adjacency_kind(from_block, to_block, F.lit(False)) == "water_boundary", F.coalesce(known(to_water), known(from_water)))


def building_score(rows: DataFrame) -> DataFrame:
    """rows with score, the worth of a site for a special building: 50 points and what speaks for and against, at least 0.

    Columns: empty_slot, has_special, capital, coastal, inland_water, pass_or_choke, border (booleans), holding
    (string), water_hops (null if far), same_culture_near, special_near (numbers).
    """
    def points(when: Column, n: int) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)

    h = F.lower(F.coalesce(F.col("holding"), F.lit("")))
    kind = F.when(h.contains("city"), 10).when(h.contains("castle"), 6).when(h.contains("temple") | h.contains("church"), 6).when(h.contains("ruin"), -12).when(h.contains("wasteland") | h.contains("empty") | (h == "none"), -20).otherwise(0)
    water = F.when(F.col("water_hops") == 0, 4).when(F.col("water_hops").between(1, 2), 2).otherwise(0)
    total = (
        F.lit(50) + points(F.col("empty_slot"), 30) + points(F.col("has_special"), -60) + points(F.col("capital"), 12) + kind
        + points(F.col("coastal"), 8) + points(F.col("inland_water"), 5) + points(F.col("pass_or_choke"), 8) + water
        + 2 * F.coalesce("same_culture_near", F.lit(0)) - 8 * F.coalesce("special_near", F.lit(0)) + points(F.col("border"), 4)
    )
    return rows.withColumn("score", F.greatest(F.lit(0), total))


def faith_plan(provinces: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, religion, weight): a faith for each province (id, culture, religion) without one: what its neighbours with one have, by border length, doubled for the same culture."""
    p = provinces.select("id", "culture", "religion")
    bare = p.where("religion is null or religion = ''").select(F.col("id").alias("u"), F.col("culture").alias("mine"))
    full = p.where("religion <> ''").select(F.col("id").alias("v"), "culture", "religion")
    both = edges.join(bare, "u").join(full, "v")
    weight = F.col("border") * F.when(F.col("mine") == F.col("culture"), 2).otherwise(1)
    return vote(both.withColumnRenamed("u", "id"), ["id"], "religion", weight)


def title_context(members: DataFrame, title: str) -> DataFrame:
    """Per title (a column of members): provinces, area, the main culture and religion, and how mixed cultures are."""
    rows = members.where(F.col(title).isNotNull())
    base = rows.groupBy(title).agg(F.count(F.lit(1)).alias("provinces"), F.sum("area").alias("area"))
    for f in ("culture", "religion"):
        base = base.join(mode(rows, [title], f).select(title, F.col(f).alias(f"main_{f}")), title, "left")
    return base.join(diversity(rows, [title], "culture").select(title, "diversity"), title, "left")
