"""Whether names that content refers to exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, clean_path, null_like, placeholder_key, stem

#: Kinds set at run time, which no definition has to back.
RUNTIME = ("flag", "global_var", "variable", "character_flag")


def flag_in(rows: DataFrame, on: list[str], known: DataFrame, flag: str) -> DataFrame:
    """rows with a flag: whether their columns `on` occur in known (same column names). An outer join with the distinct keys."""
    keys = known.select(*on).distinct().withColumn(flag, F.lit(True))
    return rows.join(keys, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def resolve(refs: DataFrame, objects: DataFrame, localization: DataFrame, resources: DataFrame, facts: DataFrame) -> DataFrame:
    """refs (ref_kind, ref_name) with resolved, reason and state (resolved, dynamic or unresolved).

    objects: object_type, name; localization: key; resources: path; facts: kind, name, the engine's own sounds,
    iterators, scope transitions and defines. Each test is one hash join with distinct keys.
    """
    rows = refs.withColumn("_typed", F.concat_ws(":", "ref_kind", "ref_name")).withColumn("_path", clean_path(F.col("ref_name")))
    rows = flag_in(rows, ["_typed"], objects.select(F.concat_ws(":", "object_type", "name").alias("_typed")), "_by_type")
    rows = flag_in(rows, ["ref_name"], objects.select(F.col("name").alias("ref_name")), "_by_name")
    rows = flag_in(rows, ["ref_name"], localization.select(F.col("key").alias("ref_name")), "_by_key")
    rows = flag_in(rows, ["_path"], resource_keys(resources).select(F.col("key").alias("_path")), "_by_path")
    rows = flag_in(rows, ["ref_kind", "ref_name"], facts.select(F.col("kind").alias("ref_kind"), F.col("name").alias("ref_name")), "_by_fact")
    k, n = F.col("ref_kind"), F.col("ref_name")
    fixed = k.isin("sound", "iterator", "scope_transition", "define")
    reason = (
        F.when((k == "localization") & F.col("_by_key"), "indexed_localization")
        .when((k == "localization") & placeholder_key(n), "placeholder_localization")
        .when(k == "localization", "missing_localization")
        .when(k == "resource", F.when(F.col("_by_path"), "indexed_resource").otherwise("missing_resource"))
        .when(fixed, F.when(F.col("_by_fact"), "engine_fact").otherwise("missing_engine_fact"))
        .when(k.isin(*RUNTIME), "runtime_symbol")
        .when(null_like(k, n), "null_reference")
        .when(F.col("_by_type"), "typed_object")
        .when(F.col("_by_name"), "untyped_object")
        .when(k == "scope", "runtime_scope")
        .otherwise("missing_object")
    )
    rows = rows.withColumn("reason", reason)
    good = F.col("reason").isin("indexed_localization", "placeholder_localization", "indexed_resource", "engine_fact", "runtime_symbol", "null_reference", "typed_object", "untyped_object")
    state = F.when(good, "resolved").when(F.col("reason") == "runtime_scope", "dynamic").otherwise("unresolved")
    return rows.select(*refs.columns, good.alias("resolved"), "reason", state.alias("state"))


def missing(refs: DataFrame, on: list[str], known: DataFrame) -> DataFrame:
    """refs whose columns `on` occur nowhere in known; nulls count as missing."""
    return refs.join(known.select(*on).distinct(), on, "left_anti")


def write_only(uses: DataFrame, name: str, relation: str, writes: list[str], reads: list[str]) -> DataFrame:
    """Names that some row writes and none reads."""
    return uses.where(F.col(relation).isin(*writes)).select(name).distinct().join(uses.where(F.col(relation).isin(*reads)).select(name).distinct(), name, "left_anti")


def resource_keys(resources: DataFrame) -> DataFrame:
    """(key, how) under which a path can be asked for: exact, each suffix of folders (basename the last), the same without extension, and leading folders."""
    path = clean_path(F.col("path"))
    parts = F.split(path, "/")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    bare = F.transform(suffixes, lambda s: F.regexp_replace(s, r"\.[^./]*$", ""))
    tag = lambda xs, how: F.transform(xs, lambda s: F.struct(s.alias("key"), F.lit(how).alias("how")))
    every = F.concat(F.array(F.struct(path.alias("key"), F.lit("exact").alias("how"))), tag(suffixes, "suffix"), tag(bare, "stem"), tag(prefixes, "prefix"))
    return resources.select("path", F.explode(every).alias("k")).select("path", "k.key", "k.how").distinct()


def find_resources(wanted: DataFrame, resources: DataFrame) -> DataFrame:
    """wanted (name) with the first step of the ladder that finds it - exact, basename, suffix, stem, prefix - and the first path there."""
    keys = resource_keys(resources)
    asked = wanted.select("name", clean_path(F.col("name")).alias("key"))
    hits = asked.join(keys, "key")
    step = F.when(F.col("how") == "exact", 1).when((F.col("how") == "suffix") & (basename(F.col("path")) == F.col("key")), 2).when(F.col("how") == "suffix", 3).when(F.col("how") == "stem", 4).otherwise(5)
    best = hits.groupBy("name").agg(F.min(F.struct(step.alias("step"), "path")).alias("b"))
    names = F.when(F.col("b.step") == 1, "exact").when(F.col("b.step") == 2, "basename").when(F.col("b.step") == 3, "suffix").when(F.col("b.step") == 4, "stem").when(F.col("b.step") == 5, "prefix")
    return wanted.select("name").distinct().join(best, "name", "left").select("name", F.coalesce(names, F.lit("none")).alias("step"), F.col("b.path").alias("path"))


def diagnose_missing(resolved: DataFrame, project_rank: int) -> DataFrame:
    """Diagnostics (severity, code, target) for unresolved references of the project's layer."""
    code = F.when(F.col("ref_kind") == "localization", "missing_localization").when(F.col("ref_kind") == "resource", "missing_resource").otherwise("missing_object_reference")
    return resolved.where((F.col("state") == "unresolved") & (F.col("source_rank") == project_rank)).select(F.when(code == "missing_object_reference", "error").otherwise("warning").alias("severity"), code.alias("code"), F.col("ref_name").alias("target"))


__all__ = ["RUNTIME", "diagnose_missing", "find_resources", "flag_in", "missing", "resolve", "resource_keys", "stem", "write_only"]
