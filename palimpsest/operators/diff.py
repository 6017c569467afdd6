"""Two- and three-way comparison and merging of keyed rows, files and texts."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_diff(source: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, base_value, source_value and status of every key: added, removed, changed, same, or ambiguous (repeated, with unequal values)."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.coalesce(F.col(value).cast("string"), F.lit("")))).alias(name))

    both = side(source, "_s").join(side(base, "_b"), keys, "full")
    status = (
        F.when(F.col("_b").isNull(), "added")
        .when(F.col("_s").isNull(), "removed")
        .when(F.col("_s") == F.col("_b"), "same")
        .when((F.size("_s") > 1) | (F.size("_b") > 1), "ambiguous")
        .otherwise("changed")
    )
    return both.select(*keys, F.array_join("_b", "|").alias("base_value"), F.array_join("_s", "|").alias("source_value"), status.alias("status"))


def decide(base: Column, project: Column, target: Column) -> tuple[Column, Column]:
    """(outcome, value) of a three-way merge in which null means absent."""
    same = lambda a, b: a.eqNullSafe(b)
    outcome = (
        F.when(same(project, base), "target")
        .when(same(target, base) | same(project, target), "project")
        .when(base.isNull(), "add_conflict")
        .when(project.isNull() | target.isNull(), "delete_modify_conflict")
        .otherwise("conflict")
    )
    return outcome, F.when(outcome == "target", target).when(outcome == "project", project)


def three_way(base: DataFrame, project: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, outcome and merged value over the union of all keys (rows are unique by key)."""
    parts = [x.select(*keys, F.col(value).alias(n)) for x, n in ((base, "_b"), (project, "_p"), (target, "_t"))]
    every = parts[0].join(parts[1], keys, "full").join(parts[2], keys, "full")
    outcome, merged = decide(F.col("_b"), F.col("_p"), F.col("_t"))
    return every.select(*keys, outcome.alias("outcome"), merged.alias("merged"))


def all_or_none(merged: DataFrame, group: list[str]) -> DataFrame:
    """Groups of a three-way merge with `applied`: whether none of their keys is in conflict."""
    return merged.groupBy(*group).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("outcome").endswith("conflict")).alias("conflicts")).withColumn("applied", F.col("conflicts") == 0)


def classify_files(base: DataFrame, project: DataFrame, target: DataFrame) -> DataFrame:
    """(path, kind) from three inventories (path, hash)."""
    parts = [x.select("path", F.col("hash").alias(n)) for x, n in ((base, "b"), (project, "p"), (target, "t"))]
    every = parts[0].join(parts[1], "path", "full").join(parts[2], "path", "full")
    b, p, t = F.col("b"), F.col("p"), F.col("t")
    kind = (
        F.when(p.isNull(), F.when(b.isNull(), "upstream_added").when(t.isNull(), "upstream_deleted").when(b == t, "unchanged_inherited").otherwise("upstream_only"))
        .when(b.isNull(), F.when(t.isNull(), "project_added").when(p == t, "both_added_same").otherwise("both_changed"))
        .when(p == b, "shadow_copy")
        .when(t.isNull(), "delete_modify_conflict")
        .when(t == b, "project_only")
        .when(p == t, "both_changed_same")
        .otherwise("both_changed")
    )
    return every.select("path", kind.alias("kind"))


def drift(byte_equal: Column, parsed: Column, differing: Column, entries: Column) -> Column:
    """The kind of an override's drift from the file it replaces."""
    return F.when(byte_equal, "identical").when(~parsed | (entries == 0), "unsupported").when(differing == 0, "format_only").otherwise("semantic_drift")


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that came or went: (key, change) with introduced or resolved."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("introduced")).union(b.join(a, key, "left_anti").withColumn("change", F.lit("resolved")))


def significant(overlaps: DataFrame, least: float, scale: float = 1.0) -> DataFrame:
    """Overlaps (source, target, pixels, source_area, target_area) with shares, where either share is at least `least`."""
    s, t = F.col("pixels") / F.col("source_area"), F.least(F.lit(1.0), F.col("pixels") / (F.col("target_area") * scale))
    return overlaps.select("source", "target", "pixels", s.alias("source_share"), t.alias("target_share")).where((F.col("source_share") >= least - 1e-12) | (F.col("target_share") >= least - 1e-12))


def rewrite_policy(groups: DataFrame) -> DataFrame:
    """Mapping groups (kind, same_water, confident, share_ok) with what references may be rewritten without asking."""
    one = F.col("kind").isin("one_to_one", "renumbered") & F.col("same_water") & F.col("confident")
    many = one | (F.col("kind").isin("split", "merge") & F.col("same_water") & F.col("share_ok"))
    return groups.withColumn("scalar_safe", one).withColumn("collection_safe", many)


def _aligned(base: list[str], other: list[str]) -> list[int]:
    """For each line of base, the place of the line of other that it is kept as, or -1; places ascend."""
    n, most = 0, min(len(base), len(other))
    while n < most and base[n] == other[n]:
        n += 1
    m = 0
    while m < most - n and base[-1 - m] == other[-1 - m]:
        m += 1
    to = [*range(n), *[-1] * (len(base) - n - m), *range(len(other) - m, len(other))]
    for x in difflib.SequenceMatcher(None, base[n : len(base) - m], other[n : len(other) - m], autojunk=False).get_matching_blocks():
        to[n + x.a : n + x.a + x.size] = range(n + x.b, n + x.b + x.size)
    return to


def merge_lines(base: list[str], project: list[str], target: list[str], prefer: str | None = None) -> tuple[list[str], bool]:
    """A three-way merge of lines, and whether it is free of conflicts.

    Both sides are aligned with the base; lines that both keep separate the parts. A part that one side changed, or both
    alike, is taken; one that both changed differently is a conflict, kept between markers, or settled for the side that
    `prefer` names (project or target; it still counts as one). Where lines repeat, what is one conflict and what two
    depends on the alignment.
    """
    out, clean, at = [], True, (0, 0, 0)
    kept = [(i, j, k) for i, (j, k) in enumerate(zip(_aligned(base, project), _aligned(base, target), strict=True)) if j >= 0 and k >= 0]
    for ends in [*kept, (len(base), len(project), len(target))]:
        b, p, t = (x[s:e] for x, s, e in zip((base, project, target), at, ends, strict=True))
        if b == p or p == t:
            out += t
        elif b == t:
            out += p
        else:
            clean = False
            out += {"project": p, "target": t}.get(prefer or "", ["<<<<<<< project", *p, "=======", *t, ">>>>>>> target"])
        out += base[ends[0] : ends[0] + 1]
        at = tuple(e + 1 for e in ends)
    return out, clean


def merge_texts(rows: DataFrame, key: str, prefer: str | None = None) -> DataFrame:
    """(key, merged, clean) of rows (base, project, target) of texts, null for absent; whole texts in Arrow batches."""
    import pandas as pd

    def run(frames):
        for f in frames:
            out = [merge_lines(*[("" if x is None else x).split("\n") for x in r], prefer) for r in zip(f["base"], f["project"], f["target"], strict=True)]
            yield pd.DataFrame({key: f[key], "merged": ["\n".join(x) for x, _ in out], "clean": [ok for _, ok in out]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "base", "project", "target").mapInPandas(run, f"`{key}` {kind}, merged string, clean boolean")
