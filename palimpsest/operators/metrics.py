"""Metrics of entities and of what rolls up into them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-empty value of each key, of equals the first in code-point order; with its count."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), (-F.col("m.k")).alias("n"))


def diversity(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy of the shares of non-empty values over the logarithm of their number; 0 for one value."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"), F.count(F.lit(1)).alias("categories"))
    entropy = F.ln("t") - F.col("s") / F.col("t")
    return total.select(*keys, "categories", F.when(F.col("categories") > 1, entropy / F.ln("categories")).otherwise(0.0).alias("diversity"))


def effective_categories(shares: DataFrame, keys: list[str], share: str, top: int) -> DataFrame:
    """exp of the entropy of each key's largest shares, made to sum to 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(share))
    kept = shares.where(F.col(share) > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    total = kept.groupBy(*keys).agg(F.sum(share).alias("t"), F.sum(F.col(share) * F.ln(share)).alias("s"))
    return total.select(*keys, F.exp(F.ln("t") - F.col("s") / F.col("t")).alias("effective"))


def match_ratio(rows: DataFrame, keys: list[str], value: str, wanted: str) -> DataFrame:
    """The part of non-empty values that are the wanted one."""
    good = rows.where(F.col(value).isNotNull() & (F.col(value) != ""))
    return good.groupBy(*keys).agg(F.avg((F.col(value) == wanted).cast("double")).alias("ratio"), F.count(F.lit(1)).alias("observed"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean over rows that have the value."""
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0))


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """The discrete quantiles of integer weights: the first value whose running weight exceeds round(q * (W - 1)).

    Equal values are summed before the window, so it orders distinct values only.
    """
    sums = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = sums.withColumn("c", F.sum("w").over(run)).withColumn("t", F.sum("w").over(Window.partitionBy(*keys)))
    return cum.groupBy(*keys).agg(*[F.min(F.when(F.col("c") > F.round(F.lit(q) * (F.col("t") - 1)), F.col(value))).alias(f"q{round(100 * q)}") for q in qs])


def histogram_quantiles(rows: DataFrame, keys: list[str], value: str, qs: list[float], bins: int = 256) -> DataFrame:
    """Quantiles from counts in equal bins of [0, 1]: bin i stands for i / (bins - 1)."""
    binned = rows.where(F.col(value).isNotNull()).select(*keys, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(value) * (bins - 1) + 0.5))).alias("bin"))
    out = weighted_quantiles(binned.withColumn("one", F.lit(1)), keys, "bin", "one", qs)
    return out.select(*keys, *[(F.col(f"q{round(100 * q)}") / (bins - 1)).alias(f"q{round(100 * q)}") for q in qs])


def stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, missing, coverage, extremes, mean and interpolated deciles of a value."""
    v, qs = F.col(value), (0.1, 0.5, 0.9)
    found = F.count(v)
    all_ = rows.groupBy(*keys).agg(
        found.alias("observed"),
        (F.count(F.lit(1)) - found).alias("missing"),
        (found / F.count(F.lit(1))).alias("coverage"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.avg(v).alias("mean"),
        F.percentile(v, list(qs)).alias("_p"),
    )
    return all_.select("*", *[F.col("_p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(qs)]).drop("_p")


def percentile_rank(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with (number of values at most this one - 1) / (n - 1); 1 for a single value. Equal values are ranked once."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_c", F.sum("_n").over(run)).withColumn("_t", F.sum("_n").over(Window.partitionBy(*keys)))
    rank = F.when(F.col("_t") <= 1, 1.0).otherwise((F.col("_c") - 1) / (F.col("_t") - 1))
    return rows.join(ranked.select(*keys, value, rank.alias("percentile_rank")), [*keys, value])


def component_score(rows: DataFrame, entity: str, components: list[dict], aggregate: str = "sum", physical: bool = False) -> DataFrame:
    """The score of each entity over its members.

    A component is {field, default, presence | weights, multiplier}: presence counts 1 for a value that says
    something; weights maps values to numbers; else the value is read as a number. A multiplier of 0 means 1.
    Members count as observed if some component has a value, or none is physical.
    """
    score, seen = F.lit(0.0), F.lit(not physical)
    for c in components:
        v = F.col(c["field"]).cast("string")
        part = F.lit(float(c.get("default", 0)))
        if c.get("presence"):
            part = F.when(~F.coalesce(v, F.lit("")).isin("", "0", "none"), 1.0).otherwise(part)
        elif c.get("weights"):
            table = F.create_map(*[F.lit(x) for kv in c["weights"].items() for x in (kv[0], float(kv[1]))])
            part = F.coalesce(F.try_element_at(table, v), part)
        else:
            part = F.coalesce(v.try_cast("double"), part)
        score = score + part * float(c.get("multiplier") or 1)
        seen = seen | (F.coalesce(v, F.lit("")) != "")
    rows = rows.select(entity, F.when(seen, score).alias("_s"))
    how = {"sum": F.sum("_s"), "mean": F.avg("_s"), "max": F.max("_s")}[aggregate]
    return rows.groupBy(entity).agg(F.coalesce(how, F.lit(0.0)).alias("score"), F.count("_s").alias("observed"))


def once_per(rows: DataFrame, entity: str, part: str, value: str, aggregate: str = "max") -> DataFrame:
    """An aggregate in which each part counts once per entity, at its largest value."""
    one = rows.groupBy(entity, part).agg(F.max(value).alias("v"))
    return one.groupBy(entity).agg({"max": F.max("v"), "sum": F.sum("v"), "mean": F.avg("v")}[aggregate].alias(value), F.count(F.lit(1)).alias("parts"))


def shares(rows: DataFrame, keys: list[str], item: str, weight: str, top: int) -> DataFrame:
    """Each key's top items by weight with their share of all its items, ranked (weight, then item)."""
    sums = rows.groupBy(*keys, item).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    ranked = sums.withColumn("share", F.col("_w") / F.sum("_w").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("_w"), item)))
    return ranked.where(F.col("rank") <= top).select(*keys, item, "share", "rank")


def vote(rows: DataFrame, keys: list[str], choice: str, weight: Column) -> DataFrame:
    """The choice with the largest summed weight, of equals the first in code-point order."""
    sums = rows.where(F.col(choice).isNotNull()).groupBy(*keys, choice).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("k"), F.col(choice).alias("c"))).alias("m")).select(*keys, F.col("m.c").alias(choice), (-F.col("m.k")).alias("weight"))


def tertile_classes(rows: DataFrame, value: str, weight: str, group: list[str], least_coverage: float = 0.8, least_share: float = 0.6) -> DataFrame:
    """Groups as shallow, deep or mixed by weighted thirds of all values; insufficient below the coverage."""
    thirds = weighted_quantiles(rows, [], value, weight, [0.33, 0.67])
    known = rows.crossJoin(F.broadcast(thirds))  # one row
    v, w = F.col(value), F.col(weight)
    by = known.groupBy(*group).agg(F.sum(w).alias("_all"), F.sum(F.when(v.isNotNull(), w)).alias("_seen"), F.sum(F.when(v <= F.col("q33"), w)).alias("_low"), F.sum(F.when(v >= F.col("q67"), w)).alias("_high"))
    cover = F.coalesce(F.col("_seen"), F.lit(0)) / F.col("_all")
    low, high = (F.coalesce(F.col(c), F.lit(0)) / F.col("_seen") for c in ("_low", "_high"))
    kind = F.when(cover < least_coverage, "insufficient").when(low >= least_share, "shallow").when(high >= least_share, "deep").otherwise("mixed")
    return by.select(*group, cover.alias("coverage"), kind.alias("depth_class"))


@dataclasses.dataclass
class Metric:
    """What a metric computes: a field or components, an aggregate, and a transform over the neighbour graph."""

    aggregate: str
    field: str | None = None
    match: str | None = None
    components: list[dict] = dataclasses.field(default_factory=list)
    transform: dict | None = None


def build(members: DataFrame, levels: list[str], metric: Metric) -> DataFrame:
    """(level, entity, value, observed) of a metric for each level of a hierarchy held as columns of members."""
    out = None
    for level in levels:
        rows = members.where(F.col(level).isNotNull() & (F.col(level).cast("string") != "")).withColumn("entity", F.col(level).cast("string"))
        if metric.components:
            part = component_score(rows, "entity", metric.components, metric.aggregate).select("entity", F.col("score").cast("string").alias("value"), "observed")
        elif metric.aggregate == "mode":
            part = mode(rows, ["entity"], metric.field).select("entity", F.col(metric.field).cast("string").alias("value"), F.col("n").alias("observed"))
        elif metric.aggregate == "diversity":
            part = diversity(rows, ["entity"], metric.field).select("entity", F.round("diversity", 9).cast("string").alias("value"), F.col("categories").alias("observed"))
        elif metric.aggregate == "ratio":
            part = match_ratio(rows, ["entity"], metric.field, metric.match).select("entity", F.round("ratio", 9).cast("string").alias("value"), "observed")
        else:
            v = F.col(metric.field).try_cast("double")
            how = {"sum": F.sum(v), "mean": F.avg(v), "max": F.max(v), "min": F.min(v)}[metric.aggregate]
            part = rows.groupBy("entity").agg(F.round(how, 6).cast("string").alias("value"), F.count(v).alias("observed"))
        part = part.select(F.lit(level).alias("level"), "entity", "value", "observed")
        out = part if out is None else out.unionByName(part)
    return out


def outliers(rows: DataFrame, value: str, key: str, limit: int = 10) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(value), key).limit(limit)
