"""Journal exports as JSON objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logjury.functions.text import literal_map, strip_line_end, strip_slashes
from logjury.operators.records import only, passthrough, record
from logjury.sources.registry import JOURNAL, Descriptor, Line, Provider

# Journal field names, syslog priorities.
TIME_FIELDS = ["__REALTIME_TIMESTAMP", "_SOURCE_REALTIME_TIMESTAMP"]
SERVICE_FIELDS = ["CONTAINER_NAME", "CONTAINER_TAG", "SYSLOG_IDENTIFIER", "_SYSTEMD_UNIT", "_COMM"]
CONTAINER_FIELDS = ["CONTAINER_ID", "CONTAINER_NAME", "CONTAINER_TAG"]
PRIORITIES = ["emergency", "alert", "critical", "error", "warning", "notice", "info", "debug"]

DESCRIPTORS = (
    Descriptor("docker_journald", ("docker-journald", "docker_journald"), JOURNAL),
    Descriptor("linux_journal", ("linux-journal", "linux_journal"), JOURNAL),
)


def takes(line: Line) -> Column:
    return line.object.has("MESSAGE", "__REALTIME_TIMESTAMP") | line.requested.isin(
        [d.canonical for d in DESCRIPTORS]
    )


def journal_source(line: Line) -> Column:
    detected = F.when(line.object.has(*CONTAINER_FIELDS), F.lit("docker_journald")).otherwise(
        F.lit("linux_journal")
    )
    return F.when(line.is_auto, detected).otherwise(line.requested)


def priority_level(priority: Column) -> Column:
    known = literal_map({str(i): name for i, name in enumerate(PRIORITIES)})
    return F.coalesce(known[priority], priority)


def records(line: Line) -> Column:
    field = line.object.field
    return only(
        record(
            source=journal_source(line),
            timestamp=field(*TIME_FIELDS),
            level=priority_level(field("PRIORITY")),
            service=strip_slashes(field(*SERVICE_FIELDS)),
            message=strip_line_end(F.coalesce(field("MESSAGE"), F.lit(""))),
            attributes=passthrough(
                line.object.members, ["MESSAGE", "PRIORITY", *TIME_FIELDS, *SERVICE_FIELDS]
            ),
        )
    )


PROVIDER = Provider(DESCRIPTORS, takes_json=takes, json=records)
