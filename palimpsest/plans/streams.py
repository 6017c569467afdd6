"""Streams over events, run to their end and read back; SQL over the whole table is their twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..streaming import windows
from .registry import query, table

def _run(spark: SparkSession, sf_dir: str, make, mode: str) -> DataFrame:
    """The rows of a stream over events, each batch written under its number in the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    schema = table(spark, sf_dir, "events").schema
    stream = windows.timed(windows.source(spark, sf_dir, schema, pattern="events.parquet"), late="40 days")

    def each(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/batch_id={n}")

    windows.publish(make(stream), f"{base}/state", each, mode)
    return spark.read.parquet(f"{base}/out").drop("batch_id")

@query("""
SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir, lambda s: windows.tumbling(s, "1 day", ["event_type"], "value"), "update")
    last = out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("b"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "b.n", F.round("b.total", 4).alias("total"))

@query("SELECT user_id, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1")
def stream_last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir, lambda s: windows.last_values(s, "user_id", "ts", "value"), "update")
    return out.groupBy("user_id").agg(F.max_by("value", F.struct("batch", "at")).alias("value"))
