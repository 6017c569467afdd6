"""Which layer's file or definition holds. A lower rank is a higher priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_files(files: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """files (rel_path, source_name, source_rank) with overridden, override_reason, override_by_source, override_by_rank and override_rule.

    The file of least rank holds its path. A holder is still overridden if a layer of higher priority replaces a
    folder that covers it (`replaced`: source_name, source_rank, prefix); the highest such layer, then the shortest
    prefix, is named. Paths are matched by their folder prefixes, an equi-join.
    """
    w = Window.partitionBy("rel_path")
    out = files.withColumn("_best", F.min(F.struct("source_rank", "source_name")).over(w))
    lost = F.col("source_rank") > F.col("_best.source_rank")
    if replaced is not None:
        parts = F.split("_path", "/")
        folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
        keyed = files.select(F.col("rel_path").alias("_path"), F.col("source_rank").alias("_rank")).distinct().select("_path", "_rank", F.explode(folders).alias("prefix"))
        rule = replaced.select(F.rtrim(F.regexp_replace("prefix", "/+$", "")).alias("prefix"), F.col("source_name").alias("_by"), F.col("source_rank").alias("_by_rank"))
        hit = keyed.join(rule, "prefix").where("_by_rank < _rank").groupBy("_path", "_rank").agg(F.min(F.struct("_by_rank", F.length("prefix").alias("n"), "prefix", "_by")).alias("_rule"))
        out = out.join(hit, (F.col("rel_path") == F.col("_path")) & (F.col("source_rank") == F.col("_rank")), "left").drop("_path", "_rank")
    else:
        out = out.withColumn("_rule", F.lit(None).cast("struct<_by_rank:int,n:int,prefix:string,_by:string>"))
    swept = ~lost & F.col("_rule").isNotNull()
    return out.select(
        *files.columns,
        (lost | swept).alias("overridden"),
        F.when(lost, "same_relative_path").when(swept, "descriptor_replace_path").alias("override_reason"),
        F.when(lost, F.col("_best.source_name")).when(swept, F.col("_rule._by")).alias("override_by_source"),
        F.when(lost, F.col("_best.source_rank")).when(swept, F.col("_rule._by_rank")).alias("override_by_rank"),
        F.when(lost, "rel_path").when(swept, F.col("_rule.prefix")).alias("override_rule"),
    )


def definition_domain(object_type: Column, path: Column) -> Column:
    """Titles are defined apart in their hierarchy, in their history, and elsewhere by path."""
    title = F.when(path.contains("/landed_titles/"), "landed_titles").when(path.contains("/history/titles/"), "title_history").otherwise(path)
    return F.when(object_type == "title", title).otherwise("")


def resolve_definitions(rows: DataFrame, keys: list[str], rank: str = "source_rank", merged: Column | None = None) -> DataFrame:
    """rows with definitions, active_count, group_status and row_status.

    Of rows with equal keys those of least rank hold: one is `active` and the rest are shadowed; several are
    `ambiguous_top_priority`. Rows for which `merged` holds all count.
    """
    w = Window.partitionBy(*keys)
    top = F.col(rank) == F.min(rank).over(w)
    out = rows.withColumn("definitions", F.count(F.lit(1)).over(w)).withColumn("_tops", F.sum(top.cast("int")).over(w)).withColumn("_top", top)
    merge = F.lit(False) if merged is None else merged
    one = F.col("_tops") == 1
    return out.select(
        *rows.columns,
        "definitions",
        F.when(merge, F.col("definitions")).when(one, 1).otherwise(0).cast("long").alias("active_count"),
        F.when(merge, "merged").when(F.col("definitions") == 1, "unique").when(one, "source_priority").otherwise("ambiguous").alias("group_status"),
        F.when(merge, "merged").when(F.col("_top") & one, "active").when(F.col("_top"), "ambiguous_top_priority").otherwise("shadowed_by_source_priority").alias("row_status"),
    )


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(rows: DataFrame, keys: list[str], sequence: list[str], last_wins: bool = True) -> DataFrame:
    """The row of each key that an upsert keeps: the last by sequence, or the first."""
    return first_by(rows, keys, [F.desc_nulls_last(c) if last_wins else F.asc_nulls_first(c) for c in sequence])


def owner_of(points: DataFrame, owners: DataFrame, keys: list[str], at: str, start: str, order: str, payload: list[str]) -> DataFrame:
    """points with the payload of the last owner that starts at or before them; of equal starts the later by order.

    Owners and points are sorted together and the last owner is carried on, so nothing is joined by a range.
    """
    mark = F.struct(*[F.col(c) for c in payload])
    o = owners.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.col(order).alias("_order"), mark.alias("_owner"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_row"))
    p = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_order"), F.lit(None).cast(o.schema["_owner"].dataType).alias("_owner"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind", F.asc_nulls_first("_order")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = o.unionByName(p).withColumn("_last", F.last("_owner", ignorenulls=True).over(w)).where("_kind = 1")
    return every.select("_row.*", *[F.col(f"_last.{c}").alias(f"owner_{c}") for c in payload])


def public_only(rows: DataFrame, layers: DataFrame, source: str = "source_name") -> DataFrame:
    """rows of layers that aren't private, before anything is counted or limited."""
    hidden = layers.where("private").select(F.lower("name").alias("_hidden"))
    return rows.join(hidden, F.lower(F.coalesce(F.col(source), F.lit(""))) == F.col("_hidden"), "left_anti")


def partial_overrides(objects: DataFrame) -> DataFrame:
    """Paths whose holder defines fewer objects than the file it overrides.

    objects: rel_path, source_name, source_rank, overridden, name. Returns rel_path, winner, winner_count, loser,
    loser_count; of several losers the one with the most objects, then the first by name.
    """
    per = objects.groupBy("rel_path", "source_name", "overridden").agg(F.count_distinct("name").alias("n"))
    won = per.where("not overridden").select("rel_path", F.col("source_name").alias("winner"), F.col("n").alias("winner_count"))
    lost = per.where("overridden").groupBy("rel_path").agg(F.min_by(F.struct("source_name", "n"), F.struct(-F.col("n"), "source_name")).alias("l"))
    return won.join(lost, "rel_path").select("rel_path", "winner", "winner_count", F.col("l.source_name").alias("loser"), F.col("l.n").alias("loser_count")).where("loser_count > winner_count and winner_count > 0")
