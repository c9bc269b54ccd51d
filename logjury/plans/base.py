"""Log lines rendered from the given tables, and the same facts in SQL for the oracle.

The oracle never parses a line: it derives the expected fields from the table columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.operators import api, application, docker, journal
from logjury.operators.normalize import normalize as normalize_lines
from logjury.session import ensure_checkpoint_dir, prepare
from logjury.sources.registry import Registry

c = F.col

# Per user: service name, the source it points to.
SERVICES = [
    ("Edge-Gate", "edge"),
    ("Authelia", "authelia"),
    ("Ory Kratos", "ory"),
    ("history", "ory"),
    ("voidauth", "voidauth"),
    ("bitwarden_rs", "vaultwarden"),
    ("shop", "docker_logs"),
]
# Per event type: level as written, level as normalized, outcome word.
LEVELS = {
    "error": ("ERROR", "error", "denied"),
    "purchase": ("warn", "warning", "OK"),
    "signup": (" Info ", "info", "Success"),
    "view": ("debug", "debug", "Pending"),
    "click": ("notice", "notice", "failed"),
}


# The built-in providers, with one source of our own.
SOURCES = Registry(
    (
        docker.PROVIDER,
        journal.PROVIDER,
        api.PROVIDER,
        application.provider({"edge": ["edge"], **application.SOURCE_WORDS}),
    )
)


def normalize(lines: DataFrame, **options) -> DataFrame:
    return normalize_lines(lines, **{"registry": SOURCES, **options})


def _case(column: Column, values: dict) -> Column:
    found = F.lit(None).cast("string")
    for key, value in values.items():
        found = F.when(column == key, F.lit(value)).otherwise(found)
    return found


def sql_case(column: str, values: dict) -> str:
    arms = " ".join(f"WHEN {key!r} THEN {value!r}" for key, value in values.items())
    return f"CASE {column} {arms} END"


def _spread(table: DataFrame) -> DataFrame:
    """Use all cores for an input of few file splits; a large input already has enough."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the texts the lines are made of."""
    prepare(spark)
    table = _spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return table.select(
        c("event_id").alias("ord"),
        c("event_id"),
        c("user_id"),
        c("event_type"),
        c("value").alias("amount"),
        c("props"),
        c("ts"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("t"),
        _case(c("event_type"), {k: v[0] for k, v in LEVELS.items()}).alias("lvl"),
        _case(c("event_type"), {k: v[2] for k, v in LEVELS.items()}).alias("out"),
        _case(c("user_id") % 7, {i: s for i, (s, _) in enumerate(SERVICES)}).alias("svc"),
        F.concat(
            F.lit("event "),
            c("event_type"),
            F.lit(" by user "),
            c("user_id"),
            F.when(c("event_type") == "error", F.lit(" denied")).otherwise(F.lit("")),
        ).alias("msg"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"),
    )


# The same columns for the oracle.
EVENTS_SQL = f"""
SELECT event_id, user_id, event_type, value AS amount, props, ts,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS t,
  {sql_case("event_type", {k: v[0] for k, v in LEVELS.items()})} AS lvl,
  {sql_case("event_type", {k: v[1] for k, v in LEVELS.items()})} AS level,
  {sql_case("event_type", {k: v[2] for k, v in LEVELS.items()})} AS out,
  {sql_case("user_id % 7", {i: s for i, (s, _) in enumerate(SERVICES)})} AS svc,
  {sql_case("user_id % 7", {i: s for i, (_, s) in enumerate(SERVICES)})} AS src,
  'event ' || event_type || ' by user ' || user_id || CASE WHEN event_type = 'error' THEN ' denied' ELSE '' END AS msg,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
FROM events
"""


def oracle(select: str) -> str:
    """A query over the events as ``e``."""
    return f"WITH e AS ({EVENTS_SQL}) {select}"


def to_line(**members: Column | str) -> Column:
    """A JSON object with these members; ``_`` in a name stays."""
    return F.to_json(
        F.struct(*[(c(v) if isinstance(v, str) else v).alias(name) for name, v in members.items()])
    )


def parse(table: DataFrame, line: Column, source="auto", keep: list[str] | None = None, **options) -> DataFrame:
    lines = table.withColumn("value", line)
    return normalize(lines, source=source, keep=keep or [], **options)


def app_line(**more: Column | str) -> Column:
    return to_line(time="t", level="lvl", service="svc", message="msg", **more)


def attr(name: str, alias: str | None = None) -> Column:
    return c("attributes")[name].alias(alias or name)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def text_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Records whose messages are the whole texts of ``documents``, ``pages`` or ``conversations``."""
    prepare(spark)
    source = _spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if table == "documents":
        rows = source.select(c("doc_id").alias("ord"), c("text"), c("lang").alias("svc"), c("source").alias("src"))
    elif table == "pages":
        rows = source.select(c("page_id").alias("ord"), c("html").alias("text"), F.lit("web").alias("svc"), c("url").alias("src"))
    else:
        rows = source.select(
            (c("conv_id") * 1000 + c("turn")).alias("ord"), c("text"), c("role").alias("svc"), F.lit("chat").alias("src")
        )
    return parse(rows, to_line(message="text", service="svc", origin="src"))
