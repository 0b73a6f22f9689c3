"""A training corpus from ``documents``: judged, cleared of boilerplate, deduplicated, mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberfield.llm.stages import STAGES
from emberfield.session import settle

ORACLE_SQL = None
"""Fingerprints, the fitted labeller and the tokenizer are beyond SQL; tests hold the stages against plain versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each writes its result for the next one to read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
