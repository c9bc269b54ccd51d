"""NDJSON in committed batches: a batch is in the sink once or not at all.

A batch is written to a folder of its own attempt, partitioned by source, and committed by one small
manifest that names the folder, put in place by a rename. Readers read the folders that manifests name, so an
attempt that failed half-way is never seen, and a batch that is already committed is not written again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logjury.sources.ndjson import ndjson


class NdjsonSink:
    """A folder all executors share; ``data`` holds attempts, ``manifest`` one file per committed batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self, batch: int) -> bool:
        files, path = self._hadoop(f"manifest/{batch}")
        return files.exists(path)

    def prepare(self, records: DataFrame) -> str:
        """Write the parsed records to a new attempt, which nobody reads yet; its name."""
        attempt = f"data/attempt=a{uuid.uuid4().hex}"
        parsed = records.where(F.col("parse_error").isNull()) if "parse_error" in records.columns else records
        lines = parsed.select(ndjson().alias("value"), F.col("source").alias("of_source"))
        lines.write.partitionBy("of_source").text(f"{self.path}/{attempt}")
        return attempt

    def commit(self, batch: int, attempt: str) -> bool:
        """Name the attempt as the batch's; false, and nothing changes, if the batch has one already."""
        files, draft = self._hadoop(f"drafts/{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(attempt.encode()))
        out.close()
        _, target = self._hadoop(f"manifest/{batch}")
        files.mkdirs(target.getParent())
        return False if files.exists(target) else bool(files.rename(draft, target))

    def abort(self, attempt: str) -> None:
        files, path = self._hadoop(attempt)
        files.delete(path, True)

    def write(self, records: DataFrame, batch: int) -> bool:
        """Write and commit a batch; false if it is in the sink already, where its rows stay as they are."""
        if self.committed(batch):
            return False
        attempt = self.prepare(records)
        if not self.commit(batch, attempt):
            self.abort(attempt)
            return False
        return True

    def read(self, source: str | None = None) -> DataFrame:
        """``(batch, source, value)`` of all committed batches; one source reads its own folders only."""
        files, path = self._hadoop("manifest")
        empty = self.spark.createDataFrame([], "batch long, source string, value string")
        if not files.exists(path):
            return empty
        named = self.spark.read.text(f"{self.path}/manifest", wholetext=True)
        batch = F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]+)$", 1).cast("long").alias("batch")
        # One name per batch, as a driver lists the folders it scans anyway.
        attempts = {row["value"]: row["batch"] for row in named.select("value", batch).collect()}
        if not attempts:
            return empty
        data = self.spark.read.schema("value string, attempt string, of_source string")
        rows = data.option("basePath", f"{self.path}/data").text([f"{self.path}/{attempt}" for attempt in attempts])
        if source is not None:
            rows = rows.where(F.col("of_source") == source)
        pairs = [(attempt.split("=")[1], batch) for attempt, batch in attempts.items()]
        known = self.spark.createDataFrame(pairs, "attempt string, batch long")
        return rows.join(known, "attempt").select("batch", F.col("of_source").alias("source"), "value")


def run_to_sink(stream: DataFrame, sink: NdjsonSink, checkpoint: str, normalize: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Normalize a line stream into the sink, each micro-batch once: a redone batch finds itself committed."""

    def on_batch(lines: DataFrame, batch: int) -> None:
        sink.write(normalize(lines), batch)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(on_batch).start()
