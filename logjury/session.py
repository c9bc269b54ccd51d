"""Session settings the library relies on, and the reliable folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Text times are rendered and read in UTC; duplicate JSON keys keep the last value.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators need. Safe to call many times."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` wins. A machine-local folder is only made for local masters
    (tests); on a cluster a missing setting is an error, because executors could not read it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="logjury-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def settled(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: computed once, of a size Catalyst knows."""
    path = f"{ensure_checkpoint_dir(frame.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
