"""Reading raw lines: text files (batch or stream) and tables with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logjury.functions.text import is_blank, strip_line_end


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files as ``(ord, file, split, value)``.

    ``ord`` is unique and grows within a file split; it is neither dense nor in file order, as Spark
    packs splits by size. ``number_lines`` gives order and line numbers for a second pass.
    """
    lines = _with_file(spark.read.text(path))
    return lines.select(F.monotonically_increasing_id().alias("ord"), "file", "split", "value")


def stream_lines(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same columns from files as they arrive.

    Streams know no line positions: ``ord`` is the file's modification time in microseconds, so
    it orders files, not the lines of one file. ``run_recent`` puts the lines' places in per micro-batch.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = _with_file(reader.load(path))
    return lines.select(F.unix_micros("modified").alias("ord"), "file", "split", "value")


def _with_file(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add the 1-based ``line_no`` of every line within its file, and make ``ord`` the place of the
    line in the order of (file, line): dense, and the same however the files were split.

    Lines of one file split are consecutive in one task, so a count and a smallest ``ord`` per split
    are enough: one row per split is aggregated, running totals are taken, and the rows are numbered
    by a join on the split. No line is moved. ``normalize`` names bad lines by ``line_no``.
    """
    splits = lines.groupBy("file", "split").agg(
        F.min("ord").alias("first_ord"), F.count("*").alias("lines")
    )
    rows = Window.unboundedPreceding, -1
    in_file = Window.partitionBy("file").orderBy("split").rowsBetween(*rows)
    in_all = Window.orderBy("file", "split").rowsBetween(*rows)
    offsets = splits.select(
        "file",
        "split",
        "first_ord",
        F.coalesce(F.sum("lines").over(in_file), F.lit(0)).alias("skip"),
        F.coalesce(F.sum("lines").over(in_all), F.lit(0)).alias("start"),
    )
    # One row per input split, a list the driver holds anyway to plan the scan.
    joined = lines.join(F.broadcast(offsets), ["file", "split"])
    at = F.col("ord") - F.col("first_ord")
    return joined.select(
        (F.col("start") + at).alias("ord"),
        "file",
        "split",
        "value",
        (F.col("skip") + at + 1).alias("line_no"),
    )


def clean_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Drop lines of white space only and cut trailing line ends."""
    return lines.where(~is_blank(F.col(line))).withColumn(line, strip_line_end(F.col(line)))


def lines_of(table: DataFrame, ord: Column, value: Column, source: Column | str = "auto", *keep: str) -> DataFrame:
    """Any table as a line frame ``(ord, value, requested_source, *keep)``."""
    requested = F.lit(source) if isinstance(source, str) else source
    return table.select(
        ord.alias("ord"), value.alias("value"), requested.alias("requested_source"), *keep
    )
