"""Structured Streaming over event tables: windows with watermarks, exact de-duplication, last values, and publication."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, schema: Any, files_per_batch: int = 1_000, pattern: str | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def timed(events: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """events with the column `at` as an instant and a watermark for rows up to `late` behind."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def tumbling(events: DataFrame, width: str, keys: list[str], value: str, at: str = "ts") -> DataFrame:
    return events.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, keys: list[str], value: str, at: str = "ts") -> DataFrame:
    return events.groupBy(F.window(at, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def sessions(events: DataFrame, gap: str, keys: list[str], value: str, at: str = "ts") -> DataFrame:
    return events.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *keys, "n", "total")


def unique(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def last_values(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """After each batch, the value of greatest time of every key it touched; state is one pair a key."""
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, 0.0)
        for f in frames:
            for t, v in zip(f["t"], f["v"], strict=True):
                if (t, v) > best:
                    best = (int(t), float(v))
        state.update(best)
        yield pd.DataFrame({key: [k[0]], "at": [best[0]], "value": [best[1]]})

    rows = events.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, at long, value double", "at long, value double", "update", GroupStateTimeout.NoTimeout)


def publish(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what there is, handing each micro-batch on; a batch that is run again has the same number."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
