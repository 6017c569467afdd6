"""Reader of block scripts: `key operator value` statements, nested by braces, as node rows.

Texts are read by table: comments run from `#` to the line's end, strings stand between double quotes (a backslash
keeps the next character), operators are those of OPERATORS, and any other run of characters is an atom. A value can
be an atom, a string, or a block, itself optionally led by an atom (as in `rgb { 1 2 3 }`). An item without operator is
a bare node. Braces that don't match are reported, and the rest is still read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATORS = ("==", "!=", ">=", "<=", "?=", "=", ">", "<")
_TOKEN = re.compile(r'(?P<space>\s+|#[^\n]*)|(?P<string>"(?:\\.|[^"\\])*"?)|(?P<op>==|!=|>=|<=|\?=|[=<>])|(?P<brace>[{}])|(?P<atom>(?:[^\s#"=<>{}!?]|[!?](?!=))+)|(?P<other>.)', re.S)


@dataclass
class Node:
    key: str | None
    op: str | None
    value: str | None
    kind: str
    line: int
    end_line: int = 0
    children: list[Node] = field(default_factory=list)


def tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, line) of each token."""
    line = 1
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "space":
            yield m.lastgroup, m[0], line
        line += m[0].count("\n")


#: Words that stand before a name in interface files, as in `type button_x = button { }`.
PREFIXES = ("type", "types", "template", "local_template", "block", "blockoverride", "layer", "state", "item")


def parse(text: str, gui: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """The statements of a text, and (line, message) of what was wrong. With gui, a prefix word joins the name after it to one key, and a name before a block is its value's type."""
    items, errors = list(tokens(text.removeprefix("\ufeff"))), []
    if gui:
        items = _joined(items)
    top: list[Node] = []
    stack: list[tuple[list[Node], Node | None]] = [(top, None)]
    i = 0
    while i < len(items):
        kind, s, line = items[i]
        here = stack[-1][0]
        if s == "}" and kind == "brace":
            if len(stack) == 1:
                errors.append((line, "unmatched closing brace"))
            else:
                stack.pop()[1].end_line = line
            i += 1
            continue
        if s == "{" and kind == "brace":
            node = Node(None, None, None, "block", line)
            here.append(node)
            stack.append((node.children, node))
            i += 1
            continue
        if kind == "op" or kind == "other":
            errors.append((line, f"unexpected {s}"))
            i += 1
            continue
        if kind == "string" and (len(s) < 2 or not s.endswith('"')):
            errors.append((line, "string without end"))
        if i + 1 < len(items) and items[i + 1][0] == "op":
            op, i = items[i + 1][1], i + 2
            if i >= len(items) or items[i][1] == "}":
                errors.append((line, "no value"))
                here.append(Node(s, op, None, "none", line, line))
                continue
            vkind, v, vline = items[i]
            if vkind == "brace":
                node = Node(s, op, None, "block", line)
            elif vkind == "atom" and i + 1 < len(items) and items[i + 1][1] == "{" and (gui or re.fullmatch(r"rgb|hsv|hsv360|hex|list|scripted_\w+", v)):
                node, i = Node(s, op, v, "block", line), i + 1
            else:
                here.append(Node(s, op, v.strip('"') if vkind == "string" else v, vkind, line, vline))
                i += 1
                continue
            here.append(node)
            stack.append((node.children, node))
            i += 1
            continue
        here.append(Node(None, None, s.strip('"') if kind == "string" else s, kind, line, line))
        i += 1
    for _, node in stack[1:]:
        errors.append((node.line, "block without end"))
        node.end_line = items[-1][2] if items else 1
    return top, errors


def _joined(items: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """Tokens of an interface file as those of plain statements: `type a = b {` becomes `type a` = b {, and `block "x" {` becomes `block x` = {."""
    out, i = [], 0
    while i < len(items):
        kind, s, line = items[i]
        if kind == "atom" and s in PREFIXES and i + 1 < len(items) and items[i + 1][0] in ("atom", "string"):
            out.append(("atom", f"{s} {items[i + 1][1].strip(chr(34))}", line))
            i += 2
            if i < len(items) and items[i][1] == "{":
                out.append(("op", "=", line))
            continue
        if kind == "atom" and i + 1 < len(items) and items[i + 1][1] == "{" and (not out or out[-1][0] != "op"):
            out += [items[i], ("op", "=", line)]
            i += 1
            continue
        out.append(items[i])
        i += 1
    return out


def canonical_hash(node: Node) -> str:
    """A digest of a statement without its place and spacing; a block's follows from its children's."""
    h = hashlib.sha256(f"{node.key}\x1f{node.op}\x1f{node.value}\x1f{node.kind == 'block'}\x1e".encode())
    for c in node.children:
        h.update(canonical_hash(c).encode())
    return h.hexdigest()


NODES = "file_id long, local_id long, parent_local_id long, depth int, key string, operator string, value string, value_kind string, start_line int, end_line int, path string, hash string, error string"


def rows(file_id: int, text: str) -> Iterator[tuple]:
    """Node rows of a text, parents before children; errors as rows without key."""
    top, errors = parse(text)
    todo = [(n, None, 0, "") for n in reversed(top)]
    k = 0
    while todo:
        n, parent, depth, above = todo.pop()
        path = f"{above}/{n.key if n.key is not None else '-'}"
        yield file_id, k, parent, depth, n.key, n.op, n.value, n.kind, n.line, n.end_line, path, canonical_hash(n), None
        todo.extend((c, k, depth + 1, path) for c in reversed(n.children))
        k += 1
    for line, message in errors:
        yield file_id, k, None, 0, None, None, None, "error", line, line, "", None, message
        k += 1


def read_nodes(files: DataFrame, key: str = "file_id", text: str = "text") -> DataFrame:
    """The node rows of files (key, text)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = [c.split()[0] for c in NODES.split(", ")], []
        for f in frames:
            for i, x in zip(f["k"], f["t"], strict=True):
                held.extend(rows(i, x) if x is not None else ())
                if len(held) >= 20_000:
                    yield pd.DataFrame(held, columns=names).astype({"parent_local_id": "Int64"})
                    held = []
        if held:
            yield pd.DataFrame(held, columns=names).astype({"parent_local_id": "Int64"})

    return files.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, NODES)


def objects(nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """Top-level blocks as objects (object_type, name, file_id, line, end_line); typed: file_id, object_type."""
    return nodes.where("depth = 0 and value_kind = 'block' and key is not null").join(typed, "file_id").select("object_type", F.col("key").alias("name"), "file_id", F.col("start_line").alias("line"), "end_line", "hash")


def object_fields(nodes: DataFrame) -> DataFrame:
    """Direct fields of top-level blocks: file_id, object, field, value, shape, date_key (0 if undated; dated blocks are opened once)."""
    from ..functions.scalars import date_key, value_shape

    top = nodes.where("depth = 0 and value_kind = 'block'").select("file_id", F.col("local_id").alias("parent_local_id"), F.col("key").alias("object"))
    first = nodes.where("depth = 1 and key is not null").join(top, ["file_id", "parent_local_id"])
    dated = first.where(date_key(F.col("key")).isNotNull() & (F.col("value_kind") == "block")).select("file_id", F.col("local_id").alias("parent_local_id"), "object", date_key(F.col("key")).alias("date_key"))
    inner = nodes.where("depth = 2 and key is not null").join(dated, ["file_id", "parent_local_id"])
    plain = first.where(date_key(F.col("key")).isNull()).withColumn("date_key", F.lit(0))
    shape = F.when(F.col("value_kind") == "block", "block").when(F.col("value_kind") == "string", "string").otherwise(value_shape(F.col("value")))
    return plain.unionByName(inner, allowMissingColumns=True).select("file_id", "object", F.col("key").alias("field"), "value", shape.alias("value_shape"), "date_key")


def references(nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """Nodes whose key names a kind of reference (key, ref_kind), or whose value has a typed prefix `kind:name`."""
    keyed = nodes.where("value is not null").join(F.broadcast(kinds), "key").select("file_id", "ref_kind", F.col("value").alias("ref_name"), F.col("start_line").alias("line"))
    typed = nodes.where(F.col("value").rlike(r"^[a-z_]+:[\w.\-]+$")).select("file_id", F.split_part("value", F.lit(":"), F.lit(1)).alias("ref_kind"), F.split_part("value", F.lit(":"), F.lit(2)).alias("ref_name"), F.col("start_line").alias("line"))
    return keyed.union(typed).distinct()
