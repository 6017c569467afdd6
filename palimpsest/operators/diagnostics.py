"""Diagnostics: counting, merging, ordering, and rules over hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes that are one problem wherever they occur.
BY_TARGET = ("missing_localization", "missing_resource", "resource_resolution_uncertain")


def target_of(message: Column) -> Column:
    """The first quoted part of a message, else all of it."""
    quoted = F.regexp_extract(message, "'([^']*)'", 1)
    return F.when(message.rlike("'[^']*'"), quoted).otherwise(message)


def fingerprint(code: Column, path: Column, line: Column, message: Column) -> Column:
    target = F.lower(target_of(message))
    return F.when(code.isin(*BY_TARGET), F.concat_ws(":", code, target)).otherwise(F.concat_ws(":", code, F.coalesce(path, F.lit("")), F.coalesce(line.cast("string"), F.lit("0")), target))


def rank(severity: Column, code: Column, confidence: Column) -> Column:
    """Which diagnostics come first."""
    return (
        F.when(severity == "error", 0)
        .when(confidence.isin("low", "uncertain"), 5)
        .when((confidence == "high") & (code.startswith("scope_") | code.endswith("reference")), 1)
        .when(code.contains("resource"), 2)
        .when(code.contains("localization"), 3)
        .otherwise(4)
    )


def aggregate(rows: DataFrame) -> DataFrame:
    """Rows (seq, severity, code, path, line, message, confidence, occurrences) merged by fingerprint into the first of each, occurrences summed (each at least 1), with their rank."""
    rows = rows.withColumn("fingerprint", fingerprint(F.col("code"), F.col("path"), F.col("line"), F.col("message")))
    first = F.min_by(F.struct("severity", "code", "path", "line", "message", "confidence"), "seq")
    by = rows.groupBy("fingerprint").agg(first.alias("f"), F.sum(F.greatest(F.lit(1), F.coalesce("occurrences", F.lit(1)))).alias("occurrences"))
    out = by.select("fingerprint", "f.*", "occurrences")
    return out.withColumn("rank", rank(F.col("severity"), F.col("code"), F.col("confidence")))


def severity_order(severity: Column, order: list[str]) -> Column:
    """The place of a severity in a list; unknown ones last."""
    out = F.lit(len(order))
    for i, s in reversed(list(enumerate(order))):
        out = F.when(severity == s, i).otherwise(out)
    return out


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def locations(rows: DataFrame, keys: list[str], location: Column) -> DataFrame:
    """Each key's distinct locations, sorted and joined."""
    return rows.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(location)), ", ").alias("locations"), F.count(F.lit(1)).alias("n"))


def title_integrity(titles: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(code, title, detail) of titles (title, source, rank, parent, place).

    duplicate_in_source: a source has the title twice. shared_place: of each title's best-ranked rows, two name one
    place. missing_place: a lowest-level title has none. bad_parent: the parent's level (its first letter) is not
    among those allowed for the title's; titles without parents are free.
    """
    twice = titles.groupBy("source", "title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_in_source").alias("code"), "title", F.concat_ws(":", "source", "n").alias("detail"))
    best = titles.withColumn("_r", F.rank().over(Window.partitionBy("title").orderBy("rank"))).where("_r = 1")
    lowest = next(iter(allowed))
    low = best.where(F.substring("title", 1, 1) == lowest)
    shared = low.where("place > 0").groupBy("place").agg(F.sort_array(F.collect_set("title")).alias("ts")).where("size(ts) > 1").select(F.lit("shared_place").alias("code"), F.explode("ts").alias("title"), F.array_join("ts", ",").alias("detail"))
    none = low.where("place is null or place <= 0").select(F.lit("missing_place").alias("code"), "title", F.lit("").alias("detail"))
    level, parent = F.substring("title", 1, 1), F.substring("parent", 1, 1)
    fine = F.lit(False)
    for k, ps in allowed.items():
        fine = fine | ((level == k) & parent.isin(*ps)) if ps else fine
    bad = best.where(F.col("parent").isNotNull() & (F.col("parent") != "") & ~fine & level.isin(*allowed)).select(F.lit("bad_parent").alias("code"), "title", F.col("parent").alias("detail"))
    return twice.unionByName(shared).unionByName(none).unionByName(bad).distinct()


def preflight(refs: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Per key, what blocks an edit and what merely warns: error diagnostics and unresolved references block, except that localization, define and scope ones warn, and flags count for nothing."""
    bad = refs.where("state <> 'resolved'").withColumn("_w", F.col("ref_kind").isin("localization", "define", "scope")).where(~F.col("ref_kind").isin("flag", "global_var"))
    r = bad.groupBy(key).agg(F.count_if(~F.col("_w")).alias("b"), F.count_if(F.col("_w")).alias("w"))
    e = errors.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("eb"), F.count_if(F.col("severity") != "error").alias("ew"))
    both = r.join(e, key, "full").fillna(0, ["b", "w", "eb", "ew"])
    return both.select(key, (F.col("b") + F.col("eb")).alias("blocking"), (F.col("w") + F.col("ew")).alias("warnings")).withColumn("verdict", F.when(F.col("blocking") > 0, "blocked").when(F.col("warnings") > 0, "warn").otherwise("ok"))


def rule_audit(engine: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """(key, side) of rules that only one of two sources has."""
    e, s = engine.select(key).distinct(), snapshot.select(key).distinct()
    return e.join(s, key, "left_anti").withColumn("side", F.lit("engine_only")).union(s.join(e, key, "left_anti").withColumn("side", F.lit("snapshot_only")))


def write_only_context(nodes: DataFrame, parents: list[str], keys: list[str]) -> DataFrame:
    """Nodes with such a key below a parent with such a key: a self-join of the node table."""
    up = nodes.where(F.col("key").isin(*parents)).select("file_id", F.col("local_id").alias("parent_local_id"), F.col("key").alias("parent_key"))
    return nodes.where(F.col("key").isin(*keys)).join(up, ["file_id", "parent_local_id"])
