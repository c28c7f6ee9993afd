"""From raw documents to packed training sequences, one written table a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import stages
from gleaner.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", stages.keep_good),
    ("near_dedup", stages.one_of_each),
    ("substring_dedup", stages.without_repeats),
    ("decontamination", stages.without_leaks),
    ("packing", stages.packed),
]

# Trained weights and Python-side fingerprints have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder; each stage's rows are written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
