"""Dated history: rows hold from their date on, until the entity's next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(history: DataFrame, entity: list[str], date: str, at: Column, value: str, tie: str | None = None) -> DataFrame:
    """The value of each entity at a date, by one aggregation; of equal dates the one last by tie (or by value)."""
    order = F.struct(F.col(date), F.col(tie or value))
    return history.where(F.col(date) <= at).groupBy(*entity).agg(F.max_by(value, order).alias(value), F.max(date).alias(date))


def as_of_with_fallback(history: DataFrame, entity: str, group: DataFrame, date: str, at: Column, value: str) -> DataFrame:
    """The value of each entity of group (entity, _group, _main), or, where it has none, that of its group's main entity; one step only."""
    now = as_of(history, [entity], date, at, value).select(entity, F.col(value).alias("_own"))
    rows = group.join(now, entity, "left")
    main = rows.where("_main").select("_group", F.col("_own").alias("_lent"))
    return rows.join(main, "_group", "left").select(entity, F.coalesce("_own", "_lent").alias(value), (F.col("_own").isNull() & F.col("_lent").isNotNull()).alias("borrowed"))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, payload: list[str], tie: str) -> DataFrame:
    """left with the payload of the last right row at or before it: both are sorted together and the last is carried on."""
    from .layers import owner_of

    return owner_of(left, right, keys, left_at, right_at, tie, payload)


def timeline_total(events: DataFrame, entity: list[str], order: list[str], is_set: Column, amount: Column) -> DataFrame:
    """Of each entity, its last `set` amount plus all later changes; entities that were never set start at 0."""
    w = Window.partitionBy(*entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = events.select(*entity, F.sum(is_set.cast("int")).over(w).alias("_epoch"), amount.alias("_amount"))
    last = marked.groupBy(*entity, "_epoch").agg(F.sum("_amount").alias("total"), F.count(F.lit(1)).alias("steps"))
    return last.groupBy(*entity).agg(F.max_by("total", "_epoch").alias("total"), F.max_by("steps", "_epoch").alias("steps"))


def snapshot(history: DataFrame, entity: str, field: str, date: str, at: Column, value: str, fields: list[str]) -> DataFrame:
    """A row per entity with the fields' values at a date."""
    now = as_of(history.where(F.col(field).isin(*fields)), [entity, field], date, at, value)
    return now.groupBy(entity).pivot(field, fields).agg(F.first(value))


def profile(history: DataFrame, entity: str, date: str, field: str, value: str) -> DataFrame:
    """Of each entity and date, its fields in order; date 0 holds what is static."""
    return history.groupBy(entity, date).agg(F.sort_array(F.collect_list(F.struct(field, value))).alias("fields"))


def validity(history: DataFrame, entity: list[str], date: str) -> DataFrame:
    """history with until, the entity's next date."""
    return history.withColumn("until", F.lead(date).over(Window.partitionBy(*entity).orderBy(date)))
