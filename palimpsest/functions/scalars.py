"""Column functions: packed dates, value shapes, names and paths, planar geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_LIKE = ("", "0", "none")


def date_key(text: Column) -> Column:
    """y.m.d (month and day 1 where absent) as the integer y * 10000 + m * 100 + d; null if it is none. Days reach 31 in every month."""
    y, m, d = (F.regexp_extract(text, r"^\s*(\d{1,5})(?:\.(\d{1,2})(?:\.(\d{1,2}))?)?\s*$", i) for i in (1, 2, 3))
    month, day = (F.when(x == "", 1).otherwise(x.try_cast("int")) for x in (m, d))
    ok = (y != "") & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, y.try_cast("int") * 10000 + month * 100 + day)


def year_key(year: Column) -> Column:
    """The first day of a year."""
    return year * 10000 + 101


def format_date_key(key: Column) -> Column:
    k = key.cast("int")
    return F.when(k > 0, F.concat_ws(".", F.floor(k / 10000), F.floor(k % 10000 / 100), k % 100))


def value_shape(text: Column) -> Column:
    """The kind of a raw value; the first that fits."""
    t = F.trim(text)
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.rlike(r"^\{"), F.when(t.rlike(r"^\{\s*\}$"), "empty_block").when(t.rlike("[=<>]"), "block").otherwise("list"))
        .when(t.rlike(r'^".*"$'), "string")
        .when(t.isin("yes", "no", "true", "false"), "boolean")
        .when(t.rlike(r"^-?\d+$"), "integer")
        .when(t.rlike(r"^-?\d*\.\d+$"), "decimal")
        .when(t.rlike(r"^\d{1,5}\.\d{1,2}\.\d{1,2}$"), "date")
        .when(t.rlike(r"^@"), "constant")
        .when(t.rlike(r"^[a-z_]+:"), "scoped")
        .when(t.contains("/"), "path")
        .otherwise("atom")
    )


def typed_id(text: Column) -> tuple[Column, Column]:
    """(type, name) of an id; the type is empty unless there is exactly one colon with text on either side."""
    typed = text.rlike(r"^[^:]+:[^:]+$")
    return F.when(typed, F.split_part(text, F.lit(":"), F.lit(1))).otherwise(""), F.when(typed, F.split_part(text, F.lit(":"), F.lit(2))).otherwise(text)


def clean_path(text: Column) -> Column:
    """A resource path without quotes, with single forward slashes and lower case."""
    t = F.lower(F.replace(F.trim(F.translate(text, '"', "")), F.lit("\\"), F.lit("/")))
    return F.regexp_replace(F.regexp_replace(t, "/+", "/"), r"^\./", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def clip_text(text: Column, most: int) -> Column:
    """Trimmed text of at most so many characters, the cut marked by three dots."""
    t = F.trim(text)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def like_pattern(text: str) -> str:
    """A LIKE pattern (escape character backslash) for a literal text whose stars are wildcards."""
    return "".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in text)


def null_like(kind: Column, name: Column) -> Column:
    return (kind == "title") & (F.trim(name) == "0")


def placeholder_key(key: Column) -> Column:
    return F.trim(F.translate(key, '"', "")) == "..."


def distance(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, with y growing southwards."""
    return F.pmod(F.degrees(F.atan2(dx, -dy)), F.lit(360.0))


def direction(dx: Column, dy: Column, ratio: float = 0.45) -> Column:
    ns, ew = F.when(dy < 0, "north").otherwise("south"), F.when(dx < 0, "west").otherwise("east")
    return (
        F.when((dx == 0) & (dy == 0), "same")
        .when(F.abs(dx) < ratio * F.abs(dy), ns)
        .when(F.abs(dy) < ratio * F.abs(dx), ew)
        .otherwise(F.concat(ns, ew))
    )


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the segment a-b."""
    vx, vy = bx - ax, by - ay
    size = vx * vx + vy * vy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * vx + (py - ay) * vy) / size)))
    return F.hypot(px - ax - t * vx, py - ay - t * vy)


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def mask(names: Column, order: list[str]) -> Column:
    """An array of names as a bit mask; a name's bit is its place in order."""
    out = F.lit(0).cast("long")
    for i, n in enumerate(order):
        out = out.bitwiseOR(F.when(F.array_contains(names, n), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def confidence_tier(samples: Column) -> Column:
    return F.when(samples < 4, 0.55).when(samples < 16, 0.75).when(samples < 64, 0.9).otherwise(1.0)


def word_rlike(text: Column, word: str) -> Column:
    """Whether text holds the word between boundaries, in any case."""
    import re

    return text.rlike(r"(?iu)(?<![\w])" + re.escape(word) + r"(?![\w])")
