"""Saved games: their envelope, and what of their state other tables can be held against."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .script import parse


def envelope(data: bytes) -> dict:
    """format (zip or plain), text (whether the state can be read as text) and where the packed part begins."""
    at = data.find(b"PK\x03\x04")
    head = data[: at if at > 0 else 4096]
    body = data
    if at >= 0:
        with zipfile.ZipFile(io.BytesIO(data[at:])) as z:
            names = z.namelist()
            body = z.read("gamestate" if "gamestate" in names else names[0])[:4096]
    plain = not any(b < 9 for b in body[:4096])
    return {"format": "zip" if at >= 0 else "plain", "text": plain, "offset": max(at, 0), "header": head[:64].split(b"\n")[0].decode("latin-1")}


def gamestate(data: bytes) -> str:
    """The state's text."""
    e = envelope(data)
    if not e["text"]:
        raise ValueError("binary state: token names are needed")
    if e["format"] == "plain":
        return data.decode("utf-8", "replace")
    with zipfile.ZipFile(io.BytesIO(data[e["offset"] :])) as z:
        return z.read("gamestate" if "gamestate" in z.namelist() else z.namelist()[0]).decode("utf-8", "replace")


def inventory(saves: DataFrame) -> DataFrame:
    """(save, kind, id, field, value) of the direct fields of what stands two blocks deep in saves (save, content), as in `living = { 7 = { trait = brave } }`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s, c in zip(f["save"], f["content"], strict=True):
                out = []
                for section in parse(gamestate(bytes(c)))[0]:
                    for thing in section.children:
                        for field in thing.children:
                            if field.kind == "block":
                                out.extend((s, section.key, thing.key, field.key, v.value) for v in field.children if v.key is None)
                            else:
                                out.append((s, section.key, thing.key, field.key, field.value))
                yield pd.DataFrame(out, columns=["save", "kind", "id", "field", "value"])

    return saves.select("save", "content").mapInPandas(run, "save string, kind string, id string, field string, value string")


def audit(rows: DataFrame, symbols: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(save, object_type, name) of inventory values that no symbol (object_type, name) defines; kinds: field -> object type. Without any symbols it fails, rather than calling all undefined."""
    if symbols.isEmpty():
        raise ValueError("no symbols to hold the save against")
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    used = rows.select("save", F.try_element_at(table, F.col("field")).alias("object_type"), F.col("value").alias("name")).where("object_type is not null and name is not null").distinct()
    typed = used.join(symbols.select("object_type", "name").distinct(), ["object_type", "name"], "left_anti")
    return typed.join(symbols.select("name").distinct(), "name", "left_anti").select("save", "object_type", "name")


def dossier(rows: DataFrame, who: DataFrame) -> DataFrame:
    """Of each asked (save, id): its fields as a map, and the titles (`landed_titles` with that holder)."""
    mine = rows.where("kind in ('living', 'dead_unprunable', 'characters')").join(who, ["save", "id"], "left_semi")
    fields = mine.groupBy("save", "id", "field").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("v")).groupBy("save", "id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v")))).alias("fields"))
    held = rows.where("kind = 'landed_titles' and field = 'holder'").groupBy("save", F.col("value").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("titles"))
    return who.join(fields, ["save", "id"], "left").join(held, ["save", "id"], "left")


def token_map(observed: DataFrame, maps: DataFrame) -> DataFrame:
    """(map, resolved, wanted, complete): the token map (map, seq, token) that names most of the observed tokens (token); of equals the first by seq."""
    seen = observed.select("token").distinct()
    total = F.broadcast(seen.agg(F.count(F.lit(1)).alias("wanted")))  # one row
    per = maps.join(seen, "token", "left_semi").groupBy("map", "seq").agg(F.count_distinct("token").alias("resolved")).crossJoin(total)
    best = per.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("resolved"), "seq"))).where("_n = 1")
    return best.select("map", "resolved", "wanted", (F.col("resolved") == F.col("wanted")).alias("complete"))


def write_zip(files: Iterator[tuple[str, bytes]]) -> bytes:
    """A ZIP of files that depends on their names and contents alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, data)
    return out.getvalue()
