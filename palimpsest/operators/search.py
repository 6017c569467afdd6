"""Ranked retrieval: prefixes, substrings, BM25, and how branches of results are put together."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import small

K1, B = 1.2, 0.75


def prefix(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column starts with the query: a range that reaches the scan."""
    return rows.where(F.col(column).startswith(query))


def contains(rows: DataFrame, column: str, query: str) -> DataFrame:
    return rows.where(F.instr(F.col(column), query) > 0).orderBy(F.length(column), column)


def quota(limit: int) -> int:
    """Places kept for the project's own rows: a quarter, at least 1 and at most 4."""
    return max(1, min(4, (limit + 3) // 4))


def rank_results(rows: DataFrame, query: str, project: Column, limit: int, order: list[Column], key: list[str]) -> DataFrame:
    """At most limit rows with `place`: exact names first, then up to a quota of the project's, then the rest in order; each key once.

    Both windows run over rows that a top-k per class has already bounded.
    """
    exact = F.coalesce(F.col("name") == query, F.lit(False))
    first = Window.partitionBy(*key).orderBy(*order)
    once = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k").withColumn("_exact", exact).withColumn("_own", F.coalesce(project, F.lit(False)))
    need = limit + quota(limit)
    best = [once.where("_exact").orderBy(*order).limit(need), once.where("not _exact and _own").orderBy(*order).limit(need), once.where("not _exact and not _own").orderBy(*order).limit(need)]
    every = best[0].union(best[1]).union(best[2])
    own = Window.partitionBy("_exact", "_own").orderBy(*order)
    kind = F.when(F.col("_exact"), 0).when(F.col("_own") & (F.row_number().over(own) <= quota(limit)), 1).otherwise(2)
    every = every.withColumn("_class", kind)
    return every.withColumn("place", F.row_number().over(Window.orderBy("_class", *order))).where(F.col("place") <= limit).drop("_exact", "_own", "_class")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of rows with the total and whether more follow; sorting stops at the page's end."""
    counted = rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row
    top = counted.orderBy(*order).limit(number * size)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.where(F.col("place") > (number - 1) * size).withColumn("has_more", F.col("total") > number * size)


def _plain() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters without; by Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(a, b) for a, b in pairs if a != b and a == a.lower() and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


_MARKED, _BARE = _plain()


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased, Latin letters without their marks."""
    return F.regexp_extract_all(F.translate(F.lower(text), _MARKED, _BARE), F.lit(r"([\p{L}\p{N}]+)"))


def asked_terms(query: str) -> list[list[str]]:
    """A query's terms, each once: the words in double quotes are one term, to be found in a row; others stand alone."""
    fold = str.maketrans(_MARKED, _BARE)
    out = []
    for i, part in enumerate(query.lower().translate(fold).split('"')):
        words = re.findall(r"[^\W_]+", part)
        out += ([words] if words else []) if i % 2 else [[w] for w in words]
    return [list(t) for t in dict.fromkeys(map(tuple, out))]


def _uses(words: list[str]) -> Column:
    """How often the words stand in a row among the tokens _t."""
    if len(words) == 1:
        return F.size("_t") - F.size(F.array_remove("_t", words[0]))
    row, n = F.array(*map(F.lit, words)), len(words)
    places = F.sequence(F.lit(1), F.size("_t") - (n - 1))
    found = F.size(F.filter(places, lambda i: F.slice("_t", i, n) == row))
    return F.when((F.size("_t") >= n) & F.arrays_overlap("_t", F.array(F.lit(words[0]))), found).otherwise(0)


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): one row per term and document."""
    split = docs.select(key, tokens(F.col(text)).alias("_t"))
    return split.select(key, F.size("_t").alias("length"), F.explode("_t").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, docs, uses): how many rows hold a term, and how often. A row's tokens are sorted within it, so that what is shuffled is sums by term."""
    split = docs.select(F.sort_array(tokens(F.col(text))).alias("_t"))
    marked = F.transform("_t", lambda x, i: F.struct(x.alias("term"), (x.eqNullSafe(F.get("_t", i - 1))).alias("again")))
    each = split.select(F.explode(marked).alias("_m")).select("_m.term", "_m.again")
    return each.groupBy("term").agg(F.count_if(~F.col("again")).alias("docs"), F.count(F.lit(1)).alias("uses"))


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int) -> DataFrame:
    """The documents with all of the query's terms and quoted phrases, best first (score as a negative number, ascending); none if it has no letters or digits.

    Terms are counted within each document by one pass over the texts, so that nothing is shuffled but sums and hits.
    """
    wanted = asked_terms(query)
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    split = docs.select(key, tokens(F.col(text)).alias("_t"))
    tf = [_uses(w).alias(f"_tf{i}") for i, w in enumerate(wanted)]
    counted = split.select(key, F.size("_t").alias("_len"), *tf)
    whole = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(wanted))])
    hits = counted.where(" and ".join(f"_tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"_tf{i}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return hits.select(key, F.round(score, 9).alias("score")).orderBy("score", key).limit(limit)


def snippet(text: Column, line: Column, around: int = 2) -> Column:
    """The lines about a line (from 1)."""
    lines = F.split(text, "\n")
    start = F.greatest(F.lit(1), line - around)
    return F.array_join(F.slice(lines, start, F.least(F.size(lines), line + around) - start + 1), "\n")


def subjects(names: DataFrame, asked: DataFrame) -> DataFrame:
    """Of each asked name, the subjects so called (trimmed, in any case): status not_found, ok or ambiguous, and the only id."""
    known = names.select(F.lower(F.trim("name")).alias("_key"), "id").distinct()
    found = asked.select("asked").distinct().withColumn("_key", F.lower(F.trim("asked"))).join(known, "_key", "left")
    by = found.groupBy("asked").agg(F.count("id").alias("n"), F.min("id").alias("first"))
    return by.select("asked", F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("id"))


def in_list(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose column occurs in a list of any length."""
    return rows.join(small(values.select(column).distinct()), column, "left_semi")


def union_search(branches: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows (name, path) of several searchers, tagged with kind and branch."""
    out = None
    for i, (kind, rows) in enumerate(branches):
        part = rows.select(F.lit(i).alias("branch"), F.lit(kind).alias("kind"), "name", "path")
        out = part if out is None else out.unionByName(part)
    return out
