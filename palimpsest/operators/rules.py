"""Rules over node tables: context, scopes, contracts of fields, lint, and patches seen over an index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def phases(nodes: DataFrame, names: list[str], depth: int) -> DataFrame:
    """(file_id, local_id, phase): of each node the nearest of itself and its ancestors whose key is among names. The node's path, kept from parsing, already holds its ancestors."""
    steps = F.filter(F.slice(F.reverse(F.split("path", "/")), 1, depth), lambda k: k.isin(*names))
    return nodes.select("file_id", "local_id", F.try_element_at(steps, F.lit(1)).alias("phase")).where("phase is not null")


def wrong_context(nodes: DataFrame, effects: DataFrame, triggers: DataFrame) -> DataFrame:
    """(file_id, start_line, key, code): effects inside triggers and triggers inside effects, judged by the nearest enclosing phase."""
    inside = phases(nodes, ["trigger", "limit", "allow", "potential", "immediate", "effect", "option", "after"], 64)
    rows = nodes.where("key is not null").join(inside, ["file_id", "local_id"])
    test = F.col("phase").isin("trigger", "limit", "allow", "potential")
    bad = rows.where(test).join(effects.select("key"), "key", "left_semi").withColumn("code", F.lit("effect_in_trigger"))
    return bad.unionByName(rows.where(~test & (F.col("phase") != "option")).join(triggers.select("key"), "key", "left_semi").withColumn("code", F.lit("trigger_in_effect"))).select("file_id", "start_line", "key", "code")


def field_contracts(fields: DataFrame, contracts: DataFrame) -> DataFrame:
    """(file_id, object, field, code): fields that an object's type requires and that are absent, or whose shape is not allowed.

    fields: object_type, file_id, object, field, value_shape; contracts: object_type, field, required, shapes (array).
    """
    objects = fields.select("object_type", "file_id", "object").distinct()
    wanted = objects.join(contracts.where("required").select("object_type", "field"), "object_type")
    absent = wanted.join(fields, ["object_type", "file_id", "object", "field"], "left_anti").withColumn("code", F.lit("missing_field"))
    shaped = fields.join(contracts.select("object_type", "field", "shapes"), ["object_type", "field"]).where(~F.array_contains("shapes", F.col("value_shape"))).withColumn("code", F.lit("wrong_shape"))
    return absent.select("file_id", "object", "field", "code").union(shaped.select("file_id", "object", "field", "code"))


def lint(nodes: DataFrame) -> DataFrame:
    """(file_id, start_line, key, code): trigger_else chains out of order, nested iterators, self-calls of scripted effects, and events without options."""
    w = Window.partitionBy("file_id", "parent_local_id").orderBy("local_id")
    chain = nodes.withColumn("_before", F.lag("key").over(w)).where(F.col("key").isin("trigger_else_if", "trigger_else", "else_if", "else"))
    opener = F.when(F.col("key").startswith("trigger_"), F.col("_before").isin("trigger_if", "trigger_else_if")).otherwise(F.col("_before").isin("if", "else_if"))
    parts = [chain.where(~F.coalesce(opener, F.lit(False))).select("file_id", "start_line", "key", F.lit("else_without_if").alias("code"))]
    iterators = F.size(F.filter(F.split("path", "/"), lambda k: k.rlike("^(any|every|random|ordered)_")))
    parts.append(nodes.where(F.col("key").rlike("^(any|every|random|ordered)_") & (iterators > 2)).select("file_id", "start_line", "key", F.lit("deep_iterators").alias("code")))
    own = F.split_part("path", F.lit("/"), F.lit(2))
    parts.append(nodes.where((F.col("depth") > 0) & (F.col("key") == own)).select("file_id", "start_line", "key", F.lit("calls_itself").alias("code")))
    events = nodes.where("depth = 0 and key rlike '^[a-z_0-9]+[.][0-9]+$' and value_kind = 'block'").select("file_id", F.col("local_id").alias("_l"), "start_line", "key")
    options = nodes.where("key in ('option', 'hidden', 'is_hidden')").select("file_id", F.col("parent_local_id").alias("_l"))
    parts.append(events.join(options, ["file_id", "_l"], "left_anti").select("file_id", "start_line", "key", F.lit("event_no_option").alias("code")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scope_problems(nodes: DataFrame, rules: dict[str, tuple[int, int]], root: int) -> DataFrame:
    """(file_id, start_line, key, scope): keys used in scopes they don't support.

    rules: key -> (mask of scopes it can stand in, mask of the scope it opens; 0 keeps the outer one). A file's
    nodes are one group, walked from parents to children; files are bounded by what a parser could hold.
    """
    def walk(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        scope, out = {}, []
        for r in f.sort_values("local_id").itertuples(index=False):
            outer = root if pd.isna(r.parent_local_id) else scope.get(int(r.parent_local_id), root)
            supported, opens = rules.get(r.key, (0, 0))
            if supported and not supported & outer:
                out.append((key[0], r.start_line, r.key, outer))
            scope[r.local_id] = opens or outer
        return pd.DataFrame(out, columns=["file_id", "start_line", "key", "scope"])

    return nodes.select("file_id", "local_id", "parent_local_id", "key", "start_line").groupBy("file_id").applyInPandas(walk, "file_id long, start_line int, key string, scope long")


def overlay(index: DataFrame, patch: DataFrame, path: str = "rel_path") -> DataFrame:
    """index as it would be with a patch's rows in place of all rows of the patched paths."""
    return index.join(patch.select(path).distinct(), path, "left_anti").unionByName(patch, allowMissingColumns=True)


def patch_preflight(index_objects: DataFrame, index_refs: DataFrame, patch_objects: DataFrame, patch_refs: DataFrame) -> DataFrame:
    """(rel_path, ref_kind, ref_name, origin) of references that dangle once a patch is in: its own, and those of others to what it takes away.

    objects: rel_path, object_type, name; refs: rel_path, ref_kind, ref_name.
    """
    objects = overlay(index_objects, patch_objects)
    known = objects.select(F.col("object_type").alias("ref_kind"), F.col("name").alias("ref_name")).distinct()
    own = patch_refs.join(known, ["ref_kind", "ref_name"], "left_anti").withColumn("origin", F.lit("patch"))
    lost = index_objects.join(patch_objects.select("rel_path").distinct(), "rel_path", "left_semi").select(F.col("object_type").alias("ref_kind"), F.col("name").alias("ref_name")).distinct().join(known, ["ref_kind", "ref_name"], "left_anti")
    others = index_refs.join(patch_refs.select("rel_path").union(patch_objects.select("rel_path")).distinct(), "rel_path", "left_anti").join(lost, ["ref_kind", "ref_name"], "left_semi").withColumn("origin", F.lit("others"))
    return own.unionByName(others)


def examples(rows: DataFrame, kind: str, holds: str | None, roles: list[str], limit: int) -> DataFrame:
    """Examples (object_type, name, role, path, text) of a type, those of earlier roles and shorter texts first."""
    found = rows.where(F.col("object_type") == kind)
    if holds:
        found = found.where(F.instr(F.lower("text"), holds.lower()) > 0)
    place: Column = F.lit(len(roles))
    for i, r in reversed(list(enumerate(roles))):
        place = F.when(F.col("role") == r, i).otherwise(place)
    return found.orderBy(place, F.length("text"), "name", "path").limit(limit)


def inherit(types: DataFrame, depth: int = 16) -> DataFrame:
    """(type, root, chain, status) of types (type, base): status missing_base, cycle, or resolved."""
    known = types.select(F.col("type").alias("_t"), F.col("base").alias("_b"))
    now = types.select("type", F.col("base").alias("at"), F.array("type").alias("chain"))
    done = now.where("at is null").select("type", F.element_at("chain", -1).alias("root"), "chain", F.lit("resolved").alias("status"))
    now = now.where("at is not null")
    for _ in range(depth):
        loop = now.where(F.array_contains("chain", F.col("at")))
        done = done.union(loop.select("type", "at", "chain", F.lit("cycle")))
        step = now.where(~F.array_contains("chain", F.col("at"))).join(known, F.col("at") == F.col("_t"), "left")
        done = done.union(step.where("_t is null").select("type", "at", "chain", F.lit("missing_base")))
        step = cut(step.where("_t is not null").select("type", F.col("_b").alias("_next"), F.concat("chain", F.array("at")).alias("chain")))
        done = done.union(step.where("_next is null").select("type", F.element_at("chain", -1), "chain", F.lit("resolved")))
        now = step.where("_next is not null").select("type", F.col("_next").alias("at"), "chain")
        if now.isEmpty():
            break
    return done


def script_matches(texts: DataFrame, key: str, query: str) -> DataFrame:
    """(key, line, snippet) of runs of script tokens equal to the query's, in any case; comments never match."""
    from ..sources.script import tokens

    want = [t[1].strip('"').lower() for t in tokens(query) if t[0] in ("atom", "string")]
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f["k"], f["t"], strict=True):
                if t is None or not want or want[0] not in t.lower():
                    continue
                have = [(x[1].strip('"').lower(), x[2]) for x in tokens(t) if x[0] in ("atom", "string")]
                lines = t.split("\n")
                for i in range(len(have) - len(want) + 1):
                    if all(have[i + j][0] == w for j, w in enumerate(want)):
                        out.append((k, have[i][1], lines[have[i][1] - 1].strip()[:220]))
            yield pd.DataFrame(out, columns=["k", "line", "snippet"])

    return texts.select(F.col(key).alias("k"), F.col("text").alias("t")).mapInPandas(run, f"k {kind}, line int, snippet string").withColumnRenamed("k", key)
