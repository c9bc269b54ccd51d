"""Records as one compact JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logjury.schema import RECORD_FIELDS


def ndjson(record: DataFrame | None = None) -> Column:
    """JSON text of a record row; absent fields and an empty attribute map are left out."""
    col = F.col if record is None else record.__getitem__
    attributes = col("attributes")
    ordered = F.when(
        F.size(attributes) > 0, F.map_from_entries(F.array_sort(F.map_entries(attributes)))
    )
    fields = [col(name).alias(name) for name in RECORD_FIELDS[:-1]]
    return F.to_json(F.struct(*fields, ordered.alias("attributes")))


def write_ndjson(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write parsed records as text files, one record per line."""
    parsed = records.where(F.col("parse_error").isNull()) if "parse_error" in records.columns else records
    parsed.select(ndjson().alias("value")).write.mode(mode).text(path)
