"""Building record structs."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from logjury.functions.text import empty_map
from logjury.schema import RECORD


def record(
    source: Column,
    message: Column,
    timestamp: Column | None = None,
    level: Column | None = None,
    service: Column | None = None,
    attributes: Column | None = None,
) -> Column:
    """One record struct; everything but source and message may be left out.

    The level is taken as written: ``normalize`` brings the levels of all lanes to one form.
    """
    none = F.lit(None).cast("string")
    values = {
        "source": source,
        "timestamp": none if timestamp is None else timestamp,
        "level": none if level is None else level,
        "service": none if service is None else service,
        "message": message,
        "attributes": empty_map() if attributes is None else attributes,
    }
    return F.struct(*[values[name].alias(name) for name in RECORD.names])


def only(one: Column) -> Column:
    return F.array(one)


def passthrough(members: Column, consumed: list[str]) -> Column:
    """Members a normalizer did not use, without JSON nulls."""
    return F.map_filter(members, lambda key, value: value.isNotNull() & ~key.isin(consumed))


def literal_rows(rows: list[dict], fields: str) -> Column:
    """Rows of configuration as one constant array of structs; the optimizer folds it once."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
