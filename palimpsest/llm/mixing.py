"""Mixing sources to target weights.

Tokens are summed per source, each source's target and repetition rate follow, and every document is taken
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the rate's fraction.

Defined cases: a null text has no words; null is a source of its own, sorted last; sources without words get target
and rate 0; rows with the same id draw alike; an empty table gives an empty mix; extra columns are kept by `mix` and
never read. The draw depends on the id and seed alone, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import WORD, cut, small

#: Largest part of 2**52 that a draw can take.
DRAWS = 1 << 52


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """A number from [0, 1) that depends on key and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(DRAWS))


def source_rates(sizes: DataFrame, cycle: int = 3, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Of sizes (_source, _size per document): _source, source_size, target, rate.

    Sources by code point, null last, weigh 1..cycle, repeating. Targets stop at `most` times their source's size; the
    excess is shared anew by weight until none is above. Sorted by size/weight, the stopped sources are a prefix,
    which running sums find without iterating. The windows run over one row per source.
    """
    by = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    by = by.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))
    cap = F.col("source_size") * F.lit(most)
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("_source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    by = by.withColumn("level", F.col("left") / F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct(F.col("source_size") / F.col("weight"), "level"))).over(every)["level"])
    by = by.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return by.select("_source", "source_size", "target", rate.alias("rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """A row per document: _id, _size, source_size, target, rate and copies, the times the mix takes it."""
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words(F.col(text_col)).alias("_size"))
    rates = small(cut(source_rates(sized, share=share, most=most)))
    out = sized.join(rates, sized["_source"].eqNullSafe(rates["_source"])).drop(rates["_source"])
    copies = F.floor("rate") + F.when(draw(F.col("_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long"))


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Every document as often as the mix takes it, with its columns and `copy`, counted from 1 (an own column of that name gives way)."""
    keep = [c for c in docs.columns if c != "copy"]
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_doc")
    sized = docs.select(doc).select("_doc", F.col(f"_doc.`{source_col}`").alias("_source"), words(F.col(f"_doc.`{text_col}`")).alias("_size"))
    rates = small(cut(source_rates(sized.select("_source", "_size"), share=share, most=most)))
    out = sized.join(rates, sized["_source"].eqNullSafe(rates["_source"]))
    copies = F.floor("rate") + F.when(draw(F.col(f"_doc.`{id_col}`"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = out.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).select(*[F.col(f"_doc.`{c}`").alias(c) for c in keep], "copy")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY source
), r AS (
  SELECT source, source_size, weight, false AS stopped, CAST(NULL AS DOUBLE) AS level, 0 AS turn FROM s
  UNION ALL
  SELECT source, source_size, weight, stopped OR level * weight > 3.0 * source_size, level, turn + 1 FROM (
    SELECT source, source_size, weight, stopped, turn,
      (sum(source_size) OVER () - coalesce(sum(CASE WHEN stopped THEN 3.0 * source_size END) OVER (), 0))
        / nullif(sum(CASE WHEN NOT stopped THEN weight END) OVER (), 0) AS level
    FROM r WHERE turn < (SELECT count(*) + 1 FROM s)) q
), t AS (
  SELECT source, source_size, weight,
    CASE WHEN stopped OR source_size = 0 THEN 3.0 * source_size ELSE level * weight END AS target
  FROM r WHERE turn = (SELECT count(*) + 1 FROM s)
), m AS (
  SELECT d.doc_id, d.size, t.source_size, CAST(t.target AS DOUBLE) AS target,
    CASE WHEN t.source_size > 0 THEN least(3.0, t.target / t.source_size) ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT doc_id, size, source_size, target, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM m
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
