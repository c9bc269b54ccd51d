"""All registered queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logjury.plans import judging, parsing

QUERIES = {**parsing.QUERIES, **judging.QUERIES}
ORACLES = {**parsing.ORACLES, **judging.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed lines of every lane to decisions."""
    return QUERIES["h16_end_to_end"](spark, sf_dir)
