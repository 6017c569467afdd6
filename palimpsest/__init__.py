"""Spark-native analytics over layered, cross-referenced content."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch sent to Python, where Spark's own limit of 64 MB is in force: bounds what a worker holds of long texts.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Lets the session's executors import this package: sends it to them once, as a zip from the driver. Also bounds the session's Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not getattr(sc, "_palimpsest_shipped", False):
        here = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="palimpsest-zip-")) / f"{here.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(str(to))
        sc._palimpsest_shipped = True
    return spark
