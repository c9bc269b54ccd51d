"""The batch pipeline on streams.

Normalizing, evaluating and judging are stateless, so a streaming frame goes through the very
same functions. Only the latest-decisions view keeps state: at most ``max_decisions`` rows,
rewritten per micro-batch, or kept in the state store (``state``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logjury.operators.judge import judge, recent, with_ids
from logjury.operators.normalize import counted, normalize
from logjury.operators.rules import RuleSet
from logjury.schema import ORDER_KEY
from logjury.sources.lines import number_lines


def normalize_stream(lines: DataFrame, **options) -> DataFrame:
    """Records of a line stream; takes the options of ``normalize``."""
    return normalize(lines, **options)


def judge_stream(records: DataFrame, rule_set: RuleSet) -> DataFrame:
    """Decisions of a record stream. Rows carry the order key; numbers are a matter of batches."""
    return judge(records, rule_set)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a parquet folder, exactly once."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.outputMode("append").start(path)


class RecentStore:
    """The latest decisions across micro-batches, in a folder all executors share.

    Every batch writes a folder of its own, ``batch=<id>``, from the one before it plus its own
    last rows, and the next free decision number to ``next/batch=<id>``. Redoing a batch after a
    failure rewrites the same folders with the same rows; folders older than the one before are
    dropped. A batch whose predecessor is missing is refused, as its view would be wrong.
    """

    KEY = ["batch_id", *ORDER_KEY]

    def __init__(self, spark: SparkSession, path: str, max_decisions: int) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.max_decisions = max_decisions

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def _counter(self, batch: int) -> str:
        return f"{self.path}/next/batch={batch}"

    def _hadoop(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, folder: str) -> bool:
        files, marker = self._hadoop(f"{folder}/_SUCCESS")
        return files.exists(marker)

    def _drop(self, folder: str) -> None:
        files, path = self._hadoop(folder)
        files.delete(path, True)

    def next_number(self, batch: int) -> int:
        """The number the first decision of this batch gets."""
        if batch == 0:
            return 1
        if not self._exists(self._counter(batch - 1)):
            raise RuntimeError(f"{self.path} holds no batch {batch - 1}; store and checkpoint belong together")
        return self.spark.read.parquet(self._counter(batch - 1)).first()["next"]

    def next_line(self, batch: int) -> int:
        """The position the first line of this batch gets."""
        return 0 if batch == 0 else self.spark.read.parquet(self._counter(batch - 1)).first()["next_line"]

    def update(self, decisions: DataFrame, batch: int, next_line: int = 0) -> None:
        """Merge the numbered decisions of one micro-batch; call from ``foreachBatch``."""
        first = self.next_number(batch)
        new = recent(decisions, self.max_decisions).withColumn("batch_id", F.lit(batch).cast("bigint"))
        if batch > 0:
            new = self.spark.read.parquet(self._folder(batch - 1)).unionByName(new)
        recent(new, self.max_decisions, self.KEY).write.mode("overwrite").parquet(self._folder(batch))
        counted = decisions.agg((F.count("*") + first).alias("next"), F.lit(next_line).cast("long").alias("next_line"))
        counted.write.mode("overwrite").parquet(self._counter(batch))
        if batch > 1:
            self._drop(self._folder(batch - 2))
            self._drop(self._counter(batch - 2))

    def read(self, batch: int) -> DataFrame:
        """The view after a batch, oldest first."""
        return self.spark.read.parquet(self._folder(batch)).orderBy(*self.KEY)


class TooManyMalformed(RuntimeError):
    """A batch with more malformed lines than are tolerated."""


def run_recent(
    lines: DataFrame,
    rule_set: RuleSet | Callable[[], RuleSet],
    store: RecentStore,
    checkpoint: str,
    sink: str | None = None,
    tolerance: float | None = None,
    **options,
) -> StreamingQuery:
    """Judge a line stream in micro-batches and keep the latest decisions in ``store``.

    Lines of files (``stream_lines``) get their place: ``line_no`` in the file, ``ord`` over all files and
    batches, so that order and ids are those of a batch run over the same files in the order they came. Other lines keep
    the ``ord`` they have, or get their place in the batch. Decisions are numbered on and on over the
    batches. With ``sink`` all decisions of a batch are written there too, one folder per batch.
    ``rule_set`` may be a function, which is asked at every batch: rules can change while a stream runs, and decisions
    carry the generation they come from. With ``tolerance`` a batch of which a larger share of lines is malformed
    fails the query before anything of it is kept; a restart tries it again. ``options`` go to ``normalize``.
    """

    def on_batch(batch_lines: DataFrame, batch: int) -> None:
        rules = rule_set() if callable(rule_set) else rule_set
        of_files = {"file", "split"} <= set(batch_lines.columns)
        next_line = 0
        if of_files:
            batch_lines = batch_lines.persist()  # counted, numbered and judged
            start = store.next_line(batch)
            next_line = start + batch_lines.count()
            numbered = number_lines(batch_lines.withColumn("ord", F.monotonically_increasing_id()))
            placed = numbered.withColumn("ord", F.col("ord") + start)
        elif "ord" in batch_lines.columns:
            placed = batch_lines
        else:
            placed = batch_lines.withColumn("ord", F.monotonically_increasing_id())
        seen = Observation()
        records = normalize(placed, **options)
        records = records if tolerance is None else counted(records, seen)
        decisions = with_ids(judge(records, rules), start=store.next_number(batch))
        if tolerance is not None:
            # Numbering has run the batch, twice where it drew a sample: only the share is told.
            bad, good = seen.get["quarantined"], seen.get["lines"]
            if bad > tolerance * (bad + good):
                raise TooManyMalformed(f"batch {batch}: {bad / (bad + good):.0%} of the lines are malformed")
        if sink:
            target = f"{sink.rstrip('/')}/batch={batch}"
            decisions.write.mode("overwrite").parquet(target)
            decisions = batch_lines.sparkSession.read.parquet(target)
        store.update(decisions, batch, next_line)
        if of_files:
            batch_lines.unpersist()

    return (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(on_batch)
        .start()
    )
