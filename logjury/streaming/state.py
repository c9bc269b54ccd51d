"""The latest decisions of a running stream as streaming state.

Every decision goes to one of ``shards`` groups by a hash of its order key, so no group is hot; each group keeps
its last ``max_decisions`` decisions and a count in the state store (RocksDB), which Spark versions with the
checkpoint of the query: a redone batch starts from the state before it, and a restarted query goes on. The view is
read from the checkpoint, merged over the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from heapq import nlargest
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from logjury.schema import ORDER_KEY

SHARDS = 32
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEYS = [f"k{n}" for n in range(len(ORDER_KEY))]
_HELD = ", ".join(f"{k} long" for k in _KEYS) + ", body string"


class LastRows(StatefulProcessor):
    """Keeps the rows with the greatest keys of a group, and how many it has seen."""

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _HELD)
        self.seen = handle.getValueState("seen", "rows long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        count = self.seen.get()[0] if self.seen.exists() else 0

        def counted() -> Iterator[tuple]:
            nonlocal count
            for row in rows:
                count += 1
                yield (*(row[k] for k in _KEYS), row["body"])

        old = (tuple(row) for row in self.held.get()) if self.held.exists() else ()
        # At least one is asked for, so that all rows are read and counted.
        last = nlargest(max(1, self.limit), chain(old, counted()))[: self.limit]
        if last:
            self.held.put(last[::-1])
        self.seen.update((count,))
        yield Row(shard=key[0], rows=count)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store is chosen when a query starts; the session's own choice is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def keep_recent(
    decisions: DataFrame, max_decisions: int, checkpoint: str, counts: str, shards: int = SHARDS
) -> StreamingQuery:
    """Run a stream of decisions to its end into state; ``counts`` gets the count of each group after each batch."""
    keyed = decisions.select(
        F.pmod(F.xxhash64(*ORDER_KEY), F.lit(shards)).cast("int").alias("shard"),
        *[F.col(name).cast("long").alias(k) for name, k in zip(ORDER_KEY, _KEYS, strict=True)],
        F.to_json(F.struct(*decisions.columns)).alias("body"),
    )
    held = keyed.groupBy("shard").transformWithState(
        statefulProcessor=LastRows(max_decisions),
        outputStructType="shard int, rows long",
        outputMode="append",
        timeMode="none",
    )
    with _rocks(decisions.sparkSession):
        return (
            held.writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .outputMode("append")
            .start(counts)
        )


def kept_recent(spark: SparkSession, schema: StructType, max_decisions: int, checkpoint: str) -> DataFrame:
    """The latest decisions of all groups after the last finished batch, oldest first."""
    state = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint)
    rows = state.select("list_element.*").orderBy(*[F.desc(k) for k in _KEYS]).limit(max_decisions)
    return rows.orderBy(*_KEYS).select(F.from_json("body", schema).alias("d")).select("d.*")
