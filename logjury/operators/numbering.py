"""Consecutive numbers in key order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logjury.schema import ORDER_KEY
from logjury.session import ensure_checkpoint_dir


def number(rows: DataFrame, keys: list[str] | None = None, column: str = "seq", start: int = 1) -> DataFrame:
    """Consecutive numbers in key order without pulling the rows into one partition.

    Rows are range-partitioned by the key and sorted within partitions, which splits any hot
    value of a key prefix. Position and partition are written down as data and cut off by a
    checkpoint, so a lost executor cannot change them. Only one count per partition is added up.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    keys = keys or ORDER_KEY
    placed = (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    sizes = placed.groupBy("_part").agg((F.max("_pos") + 1).alias("rows"))
    # One row per partition: small enough for a single running total.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_skip"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_skip") + F.col("_pos") + start)
        .drop("_part", "_pos", "_skip")
    )
