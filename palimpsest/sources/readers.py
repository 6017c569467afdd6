"""Readers of files into tables; all by Spark, none by the driver."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Top folders by kind of file.
SCRIPT_ROOTS = ("common", "events", "history", "gui", "map_data", "gfx")


def scan(spark: SparkSession, root: str, source: str, rank: int) -> DataFrame:
    """The files below a root: rel_path, kind, size, changed, sha256 and content. Hidden parts and summaries are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), "^.*?" + "".join("\\" + c if c in r".+*?()[]{}|^$\\" else c for c in base) + "/", "")
    out = raw.withColumn("rel_path", rel).where(~F.col("rel_path").rlike(r"(^|/)\.") & ~F.lower("rel_path").contains("summary"))
    return out.select(F.lit(source).alias("source_name"), F.lit(rank).alias("source_rank"), "rel_path", classify(F.col("rel_path")).alias("kind"), F.col("length").alias("file_size"), F.col("modificationTime").alias("changed"), F.sha2("content", 256).alias("sha256"), "content")


def classify(path: Column) -> Column:
    """script, schema, localization, resource, or empty, by top folder and extension."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"^localization/.*\.yml$"), "localization")
        .when(p.endswith(".info"), "schema")
        .when(p.rlike("^(" + "|".join(SCRIPT_ROOTS) + r")/.*\.(txt|gui|map|settings)$"), "script")
        .when(p.rlike(r"\.(dds|png|tga|csv|wav|bank|mesh|shader|asset)$"), "resource")
        .otherwise("")
    )


def localization(files: DataFrame, path: str = "rel_path", text: str = "text") -> DataFrame:
    """(path, language, replaced, line, key, value) of `key:n "value"` lines."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\r?\n")).alias("line", "t"))
    pattern = r"""^\s*([A-Za-z0-9_.:\-]+):\d*\s+(".*"|'.*')\s*$"""
    hit = lines.where(F.col("t").rlike(pattern))
    value = F.regexp_extract("t", pattern, 2)
    language = F.regexp_extract("path", r"(?:^|/)localization/(?:replace/)?([^/]+)/", 1)
    return hit.select("path", language.alias("language"), F.col("path").contains("/replace/").alias("replaced"), (F.col("line") + 1).alias("line"), F.regexp_extract("t", pattern, 1).alias("key"), F.substr(value, F.lit(2), F.length(value) - 2).alias("value"))


def runtime_references(entries: DataFrame) -> DataFrame:
    """(key, kind, name) of variables that localized values read."""
    kinds = [("global_var", r"GetGlobalVariable\(\s*'([^']+)'\s*\)"), ("variable", r"\.Var\(\s*'([^']+)'\s*\)")]
    parts = [entries.select("key", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("value", F.lit(p), 1)).alias("name")) for k, p in kinds]
    return parts[0].union(parts[1]).distinct()


def expand_keys(entries: DataFrame, depth: int) -> DataFrame:
    """(key, needs): keys reached through `$key$` in values, to a depth."""
    from ..operators.graph import closure

    return closure(entries.select(F.col("key").alias("node"), F.explode(F.regexp_extract_all("value", F.lit(r"\$([\w.\-]+)\$"), 1)).alias("member")), depth).select(F.col("node").alias("key"), F.col("member").alias("needs"))


def localization_problems(entries: DataFrame) -> DataFrame:
    """(path, line, code) of values with unbalanced brackets or an odd number of `$`."""
    v = F.col("value")
    count = lambda c: F.length(v) - F.length(F.replace(v, F.lit(c), F.lit("")))
    code = F.when(count("[") != count("]"), "unbalanced_brackets").when(count("$") % 2 == 1, "unbalanced_dollar")
    return entries.select("path", "line", code.alias("code")).where("code is not null")


def schema_fields(files: DataFrame, path: str = "rel_path", text: str = "text") -> DataFrame:
    """(path, line, field, raw) of documented fields: lines that begin, behind comment marks, with `name =`."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw"))
    name = F.regexp_extract("raw", r"^\s*#?\s*([A-Za-z_][\w]*)\s*=", 1)
    return lines.select("path", (F.col("line") + 1).alias("line"), name.alias("field"), F.trim("raw").alias("raw")).where("field <> ''")


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(id, colour, name) of a `id;r;g;b;name;x` table; rows whose numbers don't parse are void."""
    raw = spark.read.csv(path, sep=";", schema="id string, r string, g string, b string, name string, x string")
    n = {c: F.col(c).try_cast("int") for c in "rgb"}
    colour = F.shiftleft(n["r"], 16).bitwiseOR(F.shiftleft(n["g"], 8)).bitwiseOR(n["b"])
    return raw.select(F.col("id").try_cast("int").alias("id"), colour.alias("colour"), "name").where("id > 0 and colour is not null")


def passages(spark: SparkSession, path: str, provinces: DataFrame) -> DataFrame:
    """Strategic edges of a `From;To;Type;Through;...` table whose both ends are known provinces (id)."""
    raw = spark.read.csv(path, sep=";", header=True)
    rows = raw.select(F.col("From").try_cast("int").alias("u"), F.col("To").try_cast("int").alias("v"), F.lower(F.coalesce("Type", F.lit(""))).alias("kind"), F.coalesce(F.col("Through").try_cast("int"), F.lit(-1)).alias("through"))
    known = provinces.select("id")
    return rows.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")


def blocked(files: DataFrame, text: str = "text") -> DataFrame:
    """(id, kind) of `kind = LIST { ids }` blocks; of several blocks with an id the last holds."""
    block = r"(?m)^\s*([a-z_]+)\s*=\s*LIST\s*\{([^}]*)\}"
    rows = files.select(F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(block), 1).alias("k"), F.regexp_extract_all(text, F.lit(block), 2).alias("v"))).alias("n", "b"))
    ids = rows.select("n", F.col("b.k").alias("kind"), F.explode(F.split(F.trim("b.v"), r"\s+")).alias("id")).withColumn("id", F.col("id").try_cast("int")).where("id is not null")
    return ids.groupBy("id").agg(F.max_by("kind", "n").alias("kind"))


def engine_log(files: DataFrame, text: str = "text") -> DataFrame:
    """(name, facts) of log entries set apart by lines of dashes: the first line names the entry (up to ` - `), `Key: value` lines describe it."""
    entries = files.select(F.explode(F.split(text, r"(?m)^-{5,}\s*$")).alias("e")).select(F.regexp_replace("e", r"^\s+|\s+$", "").alias("e")).where("e <> ''")
    lines = F.split("e", r"\r?\n")
    facts = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.struct(F.regexp_extract(x, r"^([A-Z][\w ]*):", 1).alias("key"), F.trim(F.regexp_extract(x, r"^[A-Z][\w ]*:(.*)$", 1)).alias("value"))), lambda s: s["key"] != "")
    return entries.select(F.trim(F.split_part(lines[0], F.lit(" - "), F.lit(1))).alias("name"), facts.alias("facts"))


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit grey, RGB or RGBA image (not interlaced) as rows x columns x channels."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("unsupported PNG")
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    before = np.zeros(width * channels, np.int64)
    for y in range(height):
        how, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if how == 0:
            now = line
        elif how == 2:
            now = line + before & 255
        elif how == 1:
            now = (np.cumsum(line.reshape(width, channels), axis=0) & 255).ravel()
        else:
            now = line.copy()
            for i in range(width * channels):
                left = int(now[i - channels]) if i >= channels else 0
                up, corner = int(before[i]), int(before[i - channels]) if i >= channels else 0
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                now[i] = now[i] + guess & 255
        out[y] = before = now
    return out.reshape(height, width, channels)


def decode_tga(data: bytes) -> np.ndarray:
    """An uncompressed or run-length coded true-colour or grey TGA as rows x columns x channels (blue first)."""
    skip, _, kind = data[0], data[1], data[2]
    width, height, bits, flags = struct.unpack_from("<HHBB", data, 12)
    channels, at = bits // 8, 18 + skip
    if kind in (2, 3):
        out = np.frombuffer(data, np.uint8, width * height * channels, at)
    elif kind in (10, 11):
        parts, n = [], 0
        while n < width * height:
            head = data[at]
            count, at = (head & 127) + 1, at + 1
            if head & 128:
                parts.append(np.tile(np.frombuffer(data, np.uint8, channels, at), count))
                at += channels
            else:
                parts.append(np.frombuffer(data, np.uint8, channels * count, at))
                at += channels * count
            n += count
        out = np.concatenate(parts)[: width * height * channels]
    else:
        raise ValueError("unsupported TGA")
    out = out.reshape(height, width, channels)
    return out if flags & 32 else out[::-1]


def decode_dds(data: bytes) -> np.ndarray:
    """A DDS of block format 1 or 3 (DXT1, DXT5), or of uncompressed 32-bit pixels, as rows x columns x RGBA; the first level alone."""
    if data[:4] != b"DDS ":
        raise ValueError("no DDS")
    height, width = struct.unpack_from("<2I", data, 12)
    code, bits = data[84:88], struct.unpack_from("<I", data, 88)[0]
    if code not in (b"DXT1", b"DXT5"):
        if bits != 32:
            raise ValueError("unsupported DDS")
        order = [int(m).bit_length() // 8 - 1 for m in struct.unpack_from("<4I", data, 92)]
        raw = np.frombuffer(data, np.uint8, width * height * 4, 128).reshape(height, width, 4)
        return np.stack([raw[..., k] if k >= 0 else np.full((height, width), 255, np.uint8) for k in order], -1)
    size = 8 if code == b"DXT1" else 16
    rows, cols = -(-height // 4), -(-width // 4)
    block = np.frombuffer(data, np.uint8, rows * cols * size, 128).reshape(rows * cols, size)
    colour = block[:, size - 8 :]
    ends = np.ascontiguousarray(colour[:, :4]).view("<u2").astype(np.int64)
    rgb = np.stack([(ends >> 11 & 31) * 255 // 31, (ends >> 5 & 63) * 255 // 63, (ends & 31) * 255 // 31], -1)
    a, b = rgb[:, 0], rgb[:, 1]
    four = (ends[:, 0] > ends[:, 1])[:, None] | (size == 16)
    table = np.stack([a, b, np.where(four, (2 * a + b) // 3, (a + b) // 2), np.where(four, (a + 2 * b) // 3, 0)], 1)
    pick = np.ascontiguousarray(colour[:, 4:]).view("<u4").astype(np.int64) >> (2 * np.arange(16)) & 3
    out = np.concatenate([np.take_along_axis(table, pick[..., None], 1), np.full((len(block), 16, 1), 255)], 2)
    if size == 8:
        out[..., 3] = np.where(~four & (pick == 3), 0, 255)
    else:
        e = block[:, :2].astype(np.int64)
        code6 = sum(block[:, 2 + i].astype(np.int64) << (8 * i) for i in range(6))[:, None] >> (3 * np.arange(16)) & 7
        k = np.arange(8)[None]
        more = (e[:, :1] * (8 - k) + e[:, 1:] * (k - 1)) // 7
        less = (e[:, :1] * (6 - k) + e[:, 1:] * (k - 1)) // 5
        alpha = np.where(e[:, :1] > e[:, 1:], more, np.where(k == 6, 0, np.where(k == 7, 255, less)))
        alpha[:, 0], alpha[:, 1] = e[:, 0], e[:, 1]
        out[..., 3] = np.take_along_axis(alpha, code6, 1)
    return out.reshape(rows, cols, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(rows * 4, cols * 4, 4)[:height, :width].astype(np.uint8)


def pixels(files: DataFrame, key: str, content: str = "content", form: str = "png") -> DataFrame:
    """(key, y, x, value) of images: colours packed as r * 65536 + g * 256 + b, grey as it is. Rows are sent on as they are decoded."""
    decode = {"png": decode_png, "tga": decode_tga, "dds": decode_dds}[form]

    def run(frames):
        for f in frames:
            for k, c in zip(f["k"], f["c"], strict=True):
                a = decode(bytes(c)).astype(np.int64)
                value = a[..., 0] if a.shape[2] < 3 else (a[..., 0] << 16 | a[..., 1] << 8 | a[..., 2]) if form != "tga" else (a[..., 2] << 16 | a[..., 1] << 8 | a[..., 0])
                for y in range(0, len(value), 256):
                    part = value[y : y + 256]
                    yy, xx = np.indices(part.shape)
                    yield pd.DataFrame({"k": k, "y": (yy + y).ravel(), "x": xx.ravel(), "value": part.ravel()})

    kind = files.schema[key].dataType.simpleString()
    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"k {kind}, y long, x long, value long").withColumnRenamed("k", key)
