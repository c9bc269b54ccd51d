"""The training-data pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logjury.llm import stages
from logjury.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", stages.good_quality),
    ("language ID", stages.known_language),
    ("SimHash near-dedup", stages.one_of_each_group),
    ("mixing sources", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

# Models trained here, XXH64 and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents`` to packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
