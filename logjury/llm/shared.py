"""Helpers the operators of this subpackage share: stored tables and global positions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from logjury.session import ensure_checkpoint_dir

# Words as most contracts of this subpackage define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet to the folder all executors share, and read again.

    This cuts the lineage: a lost executor costs a read and not a second computation, and what
    depends on partition numbers cannot change. Reading with the known schema makes an empty
    frame valid.
    """
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def with_position(frame: DataFrame, *keys: str | Column) -> DataFrame:
    """Adds ``_position``, the 0-based place of every row in the order of the keys.

    Rows are dealt by ranges of the whole key, so one hot value of its first part is split over
    many tasks. Places within a partition are written down with the partition's number; only one
    count per partition is added up.
    """
    placed = stored(
        frame.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_skip"))
    )
    # One row per partition of the shuffle: bounded by its setting, not by the data.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("_position", F.col("_skip") + F.col("_at"))
        .drop("_part", "_at", "_skip")
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this library to the executors' Python once per application, installed there or not."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="logjury-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(package.rglob("*.py")):
            packed.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def in_batches(frame: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this library at hand in the tasks."""
    ship(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def of_texts(
    docs: DataFrame, keep: list[str], text: str, results: dict[str, DataType], run: Callable[[list], list]
) -> DataFrame:
    """The columns ``keep`` and, beside each row, what ``run`` makes of its text.

    ``run`` gets the texts of a batch (None for null) and returns one Arrow array per result. A text
    that is kept is sent to Python once.
    """
    sent = keep if text in keep else [*keep, text]
    place = sent.index(text)
    names = [*keep, *results]

    def batch_by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = run(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)

    fields = [StructField(name, docs.schema[name].dataType) for name in keep]
    fields += [StructField(name, kind) for name, kind in results.items()]
    return in_batches(docs.select(*sent), batch_by_batch, StructType(fields))


def unused(docs: DataFrame, name: str) -> str:
    """The name, made longer until no column of ``docs`` has it."""
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_learning_fold(doc_id: Column) -> Column:
    """Rows that models may learn from: crc32 of the id's text leaves a remainder other than 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(2)) != 2
