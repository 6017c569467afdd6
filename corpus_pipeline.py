"""A pipeline of five corpus stages: each reads documents and returns documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest import ship
from palimpsest.llm import decontam, langid, lines, mixing, similar
from palimpsest.llm.core import shared_folder

LEAST_LANGUAGE_SCORE = 0.02


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that its profile recognises; texts without letters, or like no profile, go."""
    ship(spark)
    return langid.filter_languages(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of five words or more that an earlier line is at least 0.8 similar to; documents stay."""
    ship(spark)
    return lines.dedup(docs).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of least id."""
    ship(spark)
    return similar.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which an item of the benchmark has leaked."""
    ship(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins out each source's documents to its target; `copy` counts a document's repetitions."""
    ship(spark)
    return mixing.materialise(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
#: SQL can't express the stages: language profiles, set-similarity joins and edit distances. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(to := f"{folder}/{k}_{name}")
        docs = spark.read.parquet(to)
    return docs
