"""Language identification by rank-order profiles.

A language's profile lists its most frequent character n-grams by rank. A document's own most frequent n-grams are
compared with each profile by the out-of-place distance: the sum over its n-grams of the difference between the two
ranks, an n-gram unknown to the profile costing the most. The nearest profile wins.

Profiles are fitted on at most PER_LANGUAGE rows a language, those with the smallest hash of id and text; predictions
read whole texts. Texts are lower-cased, and words are runs of letters, padded by a space on either side.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text when nothing was learned;
ties go to the language first in code-point order; rows with null lang teach nothing; repeated rows are scored alike;
extra columns are never read.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import chunks

PER_LANGUAGE, PROFILE, MINE, LONGEST = 1_500, 400, 300, 3


def _codes(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text, its code points, lower-cased, where letters are kept and all else is 32."""
    for a, b, buf, off in chunks(col, 300_000):
        for i in range(b - a):
            yield a + i, buf[off[i] : off[i + 1]]


_MAP: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """For each code point of the first plane, the lower-case letter, or 32 for what is no letter."""
    if not _MAP:
        t = np.full(0x10000, 32, np.int64)
        for c in range(0x10000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low[0])
        _MAP["t"] = t
    return _MAP["t"]


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of a text's folded code points, as integers: 21 bits a character."""
    if not len(codes):
        return np.empty(0, np.int64)
    c = np.concatenate(([32], codes, [32]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = c[keep]
    one = c[c != 32]
    two = c[:-1] << 21 | c[1:]
    mid = c[1:-1] != 32
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[mid]
    return np.concatenate((one, two, three))


def folded(raw: bytes) -> np.ndarray:
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    t = _fold()
    high = code >= 0x10000
    out = t[np.where(high, 0, code)]
    if high.any():
        out[high] = [ord(ch.lower()[0]) if (ch := chr(x)).isalpha() else 32 for x in code[high].tolist()]
    return out


def top(g: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, by count, then value."""
    u, n = np.unique(g, return_counts=True)
    if len(u) > 4 * most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        u, n = u[n >= least], n[n >= least]
    return u[np.lexsort((u, -n))][:most]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's profile, from at most per_language rows of each (the number of languages is taken to be small)."""
    rows = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")).where("_lang is not null and _text is not null")
    narrow = rows.select("_lang", "_h").withColumn("_n", F.row_number().over(Window.partitionBy("_lang", F.pmod("_h", F.lit(64))).orderBy("_h"))).where(F.col("_n") <= per_language)
    limit = narrow.groupBy("_lang").agg(F.sort_array(F.collect_list("_h")).alias("hs")).select("_lang", F.element_at("hs", F.least(F.size("hs"), F.lit(per_language))).alias("_most"))
    picked = rows.join(F.broadcast(limit), "_lang").where(F.col("_h") <= F.col("_most")).select("_lang", "_text")
    counted = picked.mapInArrow(_counted, "_lang string, gram long, n long").groupBy("_lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("_lang").orderBy(F.desc("n"), "gram")
    best = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).orderBy("_lang", "r").select("_lang", "gram").collect()
    out: dict[str, list[int]] = {}
    for r in best:
        out.setdefault(r["_lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in sorted(out.items())}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, Counter] = {}
        langs = b.column(0).to_pylist()
        for i, raw in _codes(b.column(1)):
            u, n = np.unique(grams(folded(raw.tobytes())), return_counts=True)
            c = by.setdefault(langs[i], Counter())
            for g, m in zip(u.tolist(), n.tolist(), strict=True):
                c[g] += m
        for lang, c in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["_lang", "gram", "n"])


def score_texts(col: pa.Array, profiles: dict[str, np.ndarray], mine: int = MINE) -> tuple[list[str], list[float]]:
    """Language and score of each text. The score is 1 - distance / largest distance, times the lead over the second profile raised to a fixed power of 1/4."""
    names = list(profiles)
    most = max((len(p) for p in profiles.values()), default=0)
    order = [(p[o := np.argsort(p)], o) for p in profiles.values()]
    langs, scores = ["und"] * len(col), [0.0] * len(col)
    for i, raw in _codes(col):
        g = grams(folded(raw.tobytes())) if len(raw) and names else ()
        if not len(g):
            continue
        t = top(g, mine)
        at = np.arange(len(t))
        dist = []
        for sorted_grams, rank in order:
            j = np.minimum(np.searchsorted(sorted_grams, t), len(sorted_grams) - 1)
            dist.append(int(np.where(sorted_grams[j] == t, np.minimum(np.abs(rank[j] - at), most), most).sum()))
        best = int(np.argmin(dist))
        second = min((d for k, d in enumerate(dist) if k != best), default=most * len(t))
        langs[i] = names[best]
        scores[i] = float((1 - dist[best] / (most * len(t))) * (1 - dist[best] / second) ** 0.25) if second else 0.0
    return langs, scores


def _predict(batches: Iterator[pa.RecordBatch], profiles: dict[str, np.ndarray], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, scores = score_texts(b.column(at), profiles)
        cols = [c for i, c in enumerate(b.columns) if i != at] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(cols, [n for i, n in enumerate(b.schema.names) if i != at] + ["lang_pred", "score"])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep (none of them the text), lang_pred and score of each document."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "_text")
    return rows.mapInArrow(functools.partial(_predict, profiles=profiles, at=len(keep)), schema + ", lang_pred string, score double")


def filter_languages(docs: DataFrame, profiles: dict[str, np.ndarray], least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The documents with a recognised language whose score is at least `least`, with all their columns; all of them if nothing was learned to judge them by."""
    if not profiles:
        return docs
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = score_texts(b.column(b.schema.get_field_index(text_col)), profiles)
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = fit(docs.where(~held))
    return predict(docs.withColumn("held_out", held), profiles, ["doc_id", "held_out"])
