"""Container log-driver records: the ``log`` member is a payload of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logjury.functions.json import JsonObject
from logjury.functions.text import empty_map, overlay_map
from logjury.operators.application import SERVICE_FIELDS
from logjury.operators.records import passthrough
from logjury.sources.registry import TRANSPORT, Descriptor, Line, Provider

SOURCE = "docker_logs"
DESCRIPTORS = (Descriptor(SOURCE, ("docker-logs", "docker_logs"), TRANSPORT),)


def takes(line: Line) -> Column:
    obj = line.object
    return obj.has("log") & ((line.requested == SOURCE) | (obj.has("stream") & obj.has("time")))


def inner_payload(obj: JsonObject) -> Column:
    return F.coalesce(obj.field("log"), F.lit(""))


def source_text(line: Line, payload: Column) -> Column:
    """Where the source of the payload is looked for: the service name and the text itself."""
    return F.when(line.is_auto, F.concat_ws(" ", line.object.field(*SERVICE_FIELDS), payload))


def overlay(obj: JsonObject) -> Column:
    """Attributes the wrapper adds to every record inside it."""
    marked = overlay_map(
        F.create_map(F.lit("input_source"), F.lit(SOURCE)),
        passthrough(obj.members, ["log", "time", "stream"]),
    )
    stream = obj.field("stream")
    return F.when(
        stream.isNotNull(), F.map_concat(marked, F.create_map(F.lit("stream"), stream))
    ).otherwise(F.coalesce(marked, empty_map()))


PROVIDER = Provider(DESCRIPTORS, takes_json=takes, unwraps=True)
