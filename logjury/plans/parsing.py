"""Queries for reading, dispatch, normalizers and their helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logjury.functions.text import strip_line_end
from logjury.operators.application import looks_like_time
from logjury.operators.numbering import number
from logjury.operators.records import record
from logjury.plans.base import (
    SOURCES,
    app_line,
    attr,
    c,
    events,
    normalize,
    oracle,
    parse,
    scratch,
    sql_case,
    to_line,
)
from logjury.sources.lines import clean_lines, number_lines, read_lines
from logjury.sources.ndjson import ndjson
from logjury.sources.registry import Descriptor, Provider
from logjury.sources.sink import NdjsonSink

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("a1_line_scan", "SELECT count(*) AS lines, count(*) AS numbered, count(*) AS last_numbers FROM events")
def a1(spark, sf_dir):
    folder = scratch(spark)
    events(spark, sf_dir).select(app_line().alias("value")).write.text(folder)
    numbered = number_lines(read_lines(spark, folder))
    per_file = numbered.groupBy("file").agg(
        F.count("*").alias("lines"),
        F.max("line_no").alias("last"),
        F.sum("line_no").alias("total"),
    )
    exact = F.when(c("total") * 2 == c("last") * (c("last") + 1), c("lines")).otherwise(F.lit(0))
    return per_file.agg(
        F.sum("lines").alias("lines"), F.sum(exact).alias("numbered"), F.sum("last").alias("last_numbers")
    )


@query(
    "a2_blank_skip",
    "SELECT event_id, event_type || CASE WHEN event_id % 5 = 1 THEN ' ' ELSE '' END AS line FROM events WHERE event_id % 5 <> 0",
)
def a2(spark, sf_dir):
    blank = F.lit(" \t\u00a0\u2003\r")
    line = (
        F.when(c("event_id") % 5 == 0, blank)
        .when(c("event_id") % 5 == 1, F.concat("event_type", F.lit(" \r\n\r")))
        .otherwise(F.concat("event_type", F.lit("\r\n")))
    )
    lines = events(spark, sf_dir).select("event_id", line.alias("value"))
    return clean_lines(lines).select("event_id", c("value").alias("line"))


# ------------------------------------------------------------------ collections


def _collection_line() -> Column:
    """1 to 3 items per line, with a number between them, under one of several fields."""
    items = F.transform(
        F.sequence(F.lit(1), (c("event_id") % 3 + 1).cast("int")),
        lambda i: F.concat(
            F.lit('{"event":"'), c("event_type"), F.lit('","request_id":"r'), i.cast("string"), F.lit('"}')
        ),
    )
    body = F.concat(F.lit("["), F.array_join(F.concat(F.array(F.lit("7")), items), ","), F.lit("]"))
    field = (
        F.when(c("event_id") % 4 == 0, F.lit("dynamic_policy_audit"))
        .when(c("event_id") % 4 == 1, F.lit("operations"))
        .when(c("event_id") % 4 == 2, F.lit("ipm_audit"))
        .otherwise(F.lit("events"))
    )
    return F.concat(F.lit('{"audit":[],"page":1,"'), field, F.lit('":'), body, F.lit("}"))


_FIELD_SQL = """CASE event_id % 4 WHEN 0 THEN 'dynamic_policy_audit' WHEN 1 THEN 'operations'
 WHEN 2 THEN 'ipm_audit' ELSE 'events' END"""
_SERVICE_SQL = """CASE event_id % 4 WHEN 0 THEN 'dynamic_policy' WHEN 1 THEN 'operations'
 WHEN 2 THEN 'ipm' ELSE 'events' END"""


@query(
    "a3_expand_records",
    "SELECT event_id, CAST(i - 1 AS INTEGER) AS rec_idx, event_type AS message FROM events, generate_series(1, 3) g(i) WHERE i <= event_id % 3 + 1",
)
def a3(spark, sf_dir):
    rows = parse(events(spark, sf_dir), _collection_line(), keep=["event_id"])
    return rows.select("event_id", "rec_idx", "message")


@query("a4_first_record", "SELECT event_id, 'r1' AS request_id FROM events")
def a4(spark, sf_dir):
    rows = parse(events(spark, sf_dir), _collection_line(), keep=["event_id"], first_only=True)
    return rows.select("event_id", attr("request_id"))


@query(
    "a5_ndjson",
    oracle(
        """SELECT event_id, '{"schema":"logjury.log.v1","source":"' || src || '","timestamp":"' || t
 || '","level":"' || level || '","service":"' || svc || '","message":"' || msg || '"'
 || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"attributes":{"a":"' || k || '","z":"' || user_id || '"}' END
 || '}' AS line FROM e"""
    ),
)
def a5(spark, sf_dir):
    no_more = c("event_id") % 3 == 0
    line = app_line(z=F.when(~no_more, c("user_id")), a=F.when(~no_more, c("k")))
    return parse(events(spark, sf_dir), line, keep=["event_id"]).select("event_id", ndjson().alias("line"))


@query(
    "a5_committed_batches",
    oracle("SELECT event_id % 3 AS batch, src AS source, '{\"schema\":\"logjury.log.v1\",\"source\":\"' || src || '\",\"message\":\"' || event_id || '\"}' AS value FROM e"),
)
def a5_committed(spark, sf_dir):
    """Three batches in a committed sink: one is written twice, one has an attempt that was never committed."""
    sink = NdjsonSink(spark, scratch(spark))
    table = events(spark, sf_dir)
    parsed = parse(table, to_line(service="svc", message=c("event_id").cast("string")), keep=["event_id"])
    records = parsed.withColumns({"service": F.lit(None).cast("string")})
    sink.prepare(records.where(c("event_id") % 3 == 1))
    for batch in (0, 1, 2, 1):
        sink.write(records.where(c("event_id") % 3 == batch), batch)
    return sink.read()


@query(
    "a6_count",
    "SELECT count(DISTINCT event_id) AS lines, count(*) AS records FROM events, generate_series(1, 3) g(i) WHERE i <= event_id % 3 + 1",
)
def a6(spark, sf_dir):
    rows = parse(events(spark, sf_dir), _collection_line())
    return rows.agg(F.count_distinct("ord").alias("lines"), F.count("*").alias("records"))


# ------------------------------------------------------------------ source names

_ALIASES = ["docker-logs", "linux-journal", "open-api", "admin-openapi", "ory", "docker_journald", "nowhere"]
_CANONICAL = ["docker_logs", "linux_journal", "openapi", "openapi", "ory", "docker_journald"]


def _alias() -> Column:
    return F.get(F.array(*[F.lit(a) for a in _ALIASES]), (c("event_id") % 7).cast("int"))


@query(
    "a7_alias",
    f"""SELECT event_id, {sql_case("event_id % 7", dict(enumerate(_CANONICAL)))} AS source,
 CASE WHEN event_id % 7 = 6 THEN 'no such source: nowhere' END AS parse_error FROM events""",
)
def a7(spark, sf_dir):
    table = events(spark, sf_dir).withColumn("asked", _alias())
    journal_free = F.when(c("event_id") % 7 != 6, F.lit("just text")).otherwise(c("msg"))
    rows = parse(table, journal_free, source=c("asked"), keep=["event_id"])
    return rows.select("event_id", "source", "parse_error")


_CHOICES = [
    "auto", "docker-logs", "docker_logs", "docker-journald", "docker_journald", "linux-journal",
    "linux_journal", "openapi", "open-api", "admin-openapi", "edge", "authelia", "ory",
    "voidauth", "vaultwarden",
]


@query(
    "a8_choices",
    "SELECT position, choice, asked FROM (VALUES "
    + ", ".join(f"({i}, '{a}')" for i, a in enumerate(_CHOICES))
    + f""") v(position, choice) LEFT JOIN (SELECT {sql_case("event_id % 7", dict(enumerate(_ALIASES)))} AS a,
 count(*) AS asked FROM events GROUP BY 1) n ON n.a = choice""",
)
def a8(spark, sf_dir):
    asked = events(spark, sf_dir).groupBy(_alias().alias("alias")).agg(F.count("*").alias("asked"))
    choices = SOURCES.alias_table(spark)
    return choices.join(asked, "alias", "left").select("position", c("alias").alias("choice"), "asked")


# ------------------------------------------------------------------ malformed JSON


@query(
    "a9_quarantine",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'line ' || event_id || ' is no JSON object' END AS parse_error FROM events",
)
def a9(spark, sf_dir):
    whole = app_line()
    line = F.when(c("event_id") % 7 == 0, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole)
    return parse(events(spark, sf_dir), line, keep=["event_id"]).select("event_id", "parse_error")


@query(
    "a9_files",
    """SELECT bucket, line_no, 'line ' || line_no || ' is no JSON object' AS parse_error, '{"broken":' || event_id AS raw_line,
 row_number() OVER (ORDER BY bucket, line_no) AS bad_line FROM (SELECT event_id, event_id % 7 AS bucket,
 row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) AS line_no FROM events) WHERE event_id % 4 = 1""",
)
def a9_files(spark, sf_dir):
    """Bad lines of many files by the number they have in their file, in the order of the files."""
    folder = scratch(spark)
    line = F.when(c("event_id") % 4 == 1, F.concat(F.lit('{"broken":'), "event_id")).otherwise(c("msg"))
    lines = events(spark, sf_dir).select("event_id", (c("event_id") % 7).alias("bucket"), line.alias("value"))
    ordered = lines.repartition("bucket").sortWithinPartitions("bucket", "event_id")
    ordered.select("bucket", "value").write.partitionBy("bucket").text(folder)
    records = normalize(number_lines(read_lines(spark, folder)), keep=["file", "line_no"])
    bad = number(records.where("parse_error IS NOT NULL"), ["ord"], "bad_line")
    bucket = F.regexp_extract("file", r"bucket=(\d+)", 1).cast("bigint")
    return bad.select(bucket.alias("bucket"), "line_no", "parse_error", "raw_line", "bad_line")


_TAILS = ["", " ", " junk", "]", ',"x":2}', "{}", "}", "\t\t"]


@query(
    "b1_strict_json",
    oracle("SELECT event_id, event_id % 8 IN (0, 1, 7) AS is_object, CASE WHEN event_id % 8 IN (0, 1, 7) THEN msg END AS message FROM e"),
)
def b1(spark, sf_dir):
    tail = F.get(F.array(*[F.lit(t) for t in _TAILS]), (c("event_id") % 8).cast("int"))
    rows = parse(events(spark, sf_dir), F.concat(F.lit(" "), app_line(), tail), keep=["event_id"])
    return rows.select("event_id", c("parse_error").isNull().alias("is_object"), "message")


# ------------------------------------------------------------------ dispatch


def _docker(log: Column) -> Column:
    return to_line(log=log, stream=F.lit("stdout"), time=F.lit("2024-02-02T00:00:00Z"))


def _mixed_line() -> Column:
    kinds = [
        _docker(c("msg")),
        to_line(MESSAGE="msg", PRIORITY=F.lit("3")),
        to_line(request_id="user_id", actor="svc", message="msg"),
        app_line(),
        F.concat(F.lit("["), c("t"), F.lit("][svc][INFO] "), c("msg")),
        F.concat(F.lit("level=info msg=\""), c("msg"), F.lit('"')),
        c("msg"),
        to_line(MESSAGE="msg", CONTAINER_ID="user_id"),
    ]
    line = kinds[0]
    for i, kind in enumerate(kinds[1:], 1):
        line = F.when(c("event_id") % 8 == i, kind).otherwise(line)
    return line


@query(
    "b2_auto_lanes",
    oracle(
        """SELECT event_id, msg AS message, CASE event_id % 8 WHEN 0 THEN 'docker_logs' WHEN 1 THEN 'linux_journal'
 WHEN 2 THEN 'openapi' WHEN 3 THEN src WHEN 4 THEN 'vaultwarden' WHEN 7 THEN 'docker_journald'
 ELSE 'docker_logs' END AS source FROM e"""
    ),
)
def b2(spark, sf_dir):
    rows = parse(events(spark, sf_dir), _mixed_line(), keep=["event_id"])
    return rows.select("event_id", "message", "source")


@query(
    "b3_explicit",
    oracle(
        """SELECT event_id, msg AS message, CASE WHEN event_id % 8 = 0 THEN 'docker_logs'
 WHEN event_id % 8 = 2 AND user_id % 3 = 2 THEN 'openapi'
 WHEN event_id % 8 = 3 AND user_id % 3 = 1 THEN 'openapi'
 ELSE CASE user_id % 3 WHEN 0 THEN 'ory' WHEN 1 THEN 'openapi' ELSE 'docker_logs' END END AS source FROM e"""
    ),
)
def b3(spark, sf_dir):
    asked = F.get(
        F.array(F.lit("ory"), F.lit("open-api"), F.lit("docker-logs")), (c("user_id") % 3).cast("int")
    )
    table = events(spark, sf_dir).withColumn("asked", asked)
    rows = parse(table, _mixed_line(), source=c("asked"), keep=["event_id"])
    return rows.select("event_id", "message", "source")


@query("b4_text_dispatch", oracle("SELECT event_id, msg AS message, 'linux_journal' AS source FROM e"))
def b4(spark, sf_dir):
    rows = parse(events(spark, sf_dir), c("msg"), source="linux-journal", keep=["event_id"])
    return rows.select("event_id", "message", "source")


@query("b5_nested_lenient", oracle("SELECT event_id, '{\"message\":\"' || msg AS message, 'docker_logs' AS source FROM e"))
def b5(spark, sf_dir):
    broken = F.concat(F.lit('{"message":"'), c("msg"), F.lit("\n"))
    rows = parse(events(spark, sf_dir), _docker(broken), keep=["event_id"])
    return rows.select("event_id", "message", "source")


def _split_records(line) -> Column:
    """A plug-in that makes one record of every word of a text."""
    return F.transform(F.split(line.payload, " "), lambda word: record(line.requested, word))


WORDS = Provider(
    (Descriptor("example_idp", ("example-idp", "example_idp"), "application"),), text=_split_records
)


@query(
    "b7_plugin",
    oracle(
        """SELECT event_id, 'example_idp' AS source, CAST(i - 1 AS INTEGER) AS rec_idx, string_split(msg, ' ')[i] AS message
 FROM e, generate_series(1, 6) g(i) WHERE i <= len(string_split(msg, ' '))"""
    ),
)
def b7(spark, sf_dir):
    registry = SOURCES.with_provider(WORDS)
    rows = parse(events(spark, sf_dir), c("msg"), source="example-idp", registry=registry, keep=["event_id"])
    return rows.select("event_id", "source", "rec_idx", "message")


# ------------------------------------------------------------------ containers


def _docker_columns(rows):
    return rows.select(
        "event_id", "source", "timestamp", "level", "service", "message",
        attr("input_source"), attr("stream"), attr("user_id", "inner_user"), attr("node"),
    )


@query(
    "c1_docker_json",
    oracle(
        """SELECT event_id, 'docker_logs' AS source, CASE WHEN event_id % 2 = 0 THEN '2024-02-02T00:00:00Z' ELSE t END AS timestamp,
 level, svc AS service, msg AS message, 'docker_logs' AS input_source,
 CASE WHEN event_id % 3 > 0 THEN 'stderr' END AS stream, CAST(user_id AS VARCHAR) AS inner_user, CAST(k AS VARCHAR) AS node FROM e"""
    ),
)
def c1(spark, sf_dir):
    line = to_line(
        log=F.concat(app_line(user_id="user_id"), F.lit("\n")),
        stream=F.when(c("event_id") % 3 > 0, F.lit("stderr")).otherwise(F.lit("")),
        time=F.when(c("event_id") % 2 == 0, F.lit("2024-02-02T00:00:00Z")).otherwise(F.lit("")),
        node="k",
    )
    return _docker_columns(parse(events(spark, sf_dir), line, keep=["event_id"]))


@query(
    "c2_docker_nested",
    oracle(
        """SELECT event_id, 'docker_logs' AS source, '2024-02-02T00:00:00Z' AS timestamp, level, svc AS service,
 msg AS message, 'docker_logs' AS input_source, 'stdout' AS stream, CAST(user_id AS VARCHAR) AS inner_user,
 CAST(CASE WHEN event_id % 4 > 0 THEN event_id % 4 END AS VARCHAR) AS node FROM e"""
    ),
)
def c2(spark, sf_dir):
    """Wrappers inside wrappers, one to four deep; the outermost value of an attribute counts."""
    line = app_line(user_id="user_id")
    layers = [_docker(line)]
    for depth in range(1, 4):
        layers.append(
            to_line(
                log=layers[-1], stream=F.lit("stdout"), time=F.lit("2024-02-02T00:00:00Z"), node=F.lit(depth)
            )
        )
    value = layers[0]
    for depth in range(1, 4):
        value = F.when(c("event_id") % 4 == depth, layers[depth]).otherwise(value)
    return _docker_columns(parse(events(spark, sf_dir), value, keep=["event_id"]))


@query(
    "c3_docker_overlay",
    oracle(
        """SELECT event_id, svc AS message, CAST(user_id AS VARCHAR) AS node, 'inner' AS shared_or_inner,
 CASE WHEN event_id % 2 = 0 THEN 'mine' ELSE 'docker_logs' END AS input_source FROM e"""
    ),
)
def c3(spark, sf_dir):
    inner = to_line(message="svc", node=F.lit("x"), own=F.lit("inner"))
    line = to_line(
        log=inner, stream=F.lit("s"), time=F.lit("t"), node="user_id",
        input_source=F.when(c("event_id") % 2 == 0, F.lit("mine")),
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "message", attr("node"), attr("own", "shared_or_inner"), attr("input_source"))


# ------------------------------------------------------------------ journals


@query(
    "c4_journal",
    oracle(
        """SELECT event_id, msg AS message, CAST(epoch_us(ts) AS VARCHAR) AS timestamp,
 CASE user_id % 4 WHEN 0 THEN 'sshd' WHEN 1 THEN 'unit.service' WHEN 2 THEN 'comm' END AS service,
 CAST(user_id AS VARCHAR) AS pid FROM e"""
    ),
)
def c4(spark, sf_dir):
    when = c("user_id") % 4
    line = to_line(
        __REALTIME_TIMESTAMP=F.unix_micros(c("ts").cast("timestamp")).cast("string"),
        MESSAGE=F.concat("msg", F.lit("\n")),
        SYSLOG_IDENTIFIER=F.when(when == 0, F.lit("sshd")),
        _SYSTEMD_UNIT=F.when(when.isin(0, 1), F.lit("unit.service")),
        _COMM=F.when(when != 3, F.lit("comm")),
        _PID="user_id",
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "message", "timestamp", "service", attr("_PID", "pid"))


@query(
    "c5_journal_source",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'linux_journal' ELSE 'docker_journald' END AS source,
 CASE event_id % 3 WHEN 1 THEN svc WHEN 0 THEN svc END AS service,
 CASE WHEN event_id % 3 = 2 THEN CAST(user_id AS VARCHAR) END AS container FROM e"""
    ),
)
def c5(spark, sf_dir):
    kind = c("event_id") % 3
    line = to_line(
        MESSAGE="msg",
        CONTAINER_NAME=F.when(kind == 1, F.concat(F.lit("//"), "svc")),
        CONTAINER_ID=F.when(kind == 2, c("user_id")),
        SYSLOG_IDENTIFIER=F.when(kind == 0, c("svc")),
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "source", "service", attr("CONTAINER_ID", "container"))


@query(
    "c7_priority",
    oracle(
        """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'emergency' WHEN 1 THEN 'alert' WHEN 2 THEN 'critical'
 WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'info' WHEN 7 THEN 'debug'
 WHEN 8 THEN '8' ELSE 'critical' END AS level FROM e"""
    ),
)
def c7(spark, sf_dir):
    priority = F.when(c("event_id") % 10 == 9, F.lit(" Crit ")).otherwise((c("event_id") % 10).cast("string"))
    rows = parse(events(spark, sf_dir), to_line(MESSAGE="msg", PRIORITY=priority), keep=["event_id"])
    return rows.select("event_id", "level")


# ------------------------------------------------------------------ API records


@query(
    "c8_api_single",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'docker_logs' ELSE 'openapi' END AS source,
 CASE WHEN event_id % 5 < 4 THEN 'admin_api' END AS service FROM e"""
    ),
)
def c8(spark, sf_dir):
    kind = c("event_id") % 5
    line = to_line(
        request_id=F.when(kind.isin(0, 2, 4), c("user_id")),
        actor=F.when(kind == 0, F.lit("a")),
        event=F.when(kind == 1, c("msg")),
        operation=F.when(kind == 1, F.lit("list")),
        error=F.when(kind == 2, c("msg")),
        ipm_audit=F.when(kind == 3, F.lit("none")),
        x=F.lit(1),
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "source", "service")


@query(
    "c10_api_expand",
    f"""SELECT event_id, CAST(i - 1 AS INTEGER) AS rec_idx, 'openapi' AS source, {_SERVICE_SQL} AS service,
 {_FIELD_SQL} AS api_collection, event_type AS message, 'r' || i AS request_id
 FROM events, generate_series(1, 3) g(i) WHERE i <= event_id % 3 + 1""",
)
def c10(spark, sf_dir):
    rows = parse(events(spark, sf_dir), _collection_line(), keep=["event_id"])
    return rows.select(
        "event_id", "rec_idx", "source", "service", attr("api_collection"), "message", attr("request_id")
    )


@query(
    "c11_api_message",
    oracle(
        """SELECT event_id, CASE event_id % 8 WHEN 0 THEN msg WHEN 1 THEN 'code ' || k WHEN 2 THEN msg
 WHEN 3 THEN 'sync done' WHEN 4 THEN 'operation done' WHEN 5 THEN out WHEN 6 THEN 'list' ELSE '{"a":1}' END AS message FROM e"""
    ),
)
def c11(spark, sf_dir):
    nested = [
        to_line(request_id="user_id", actor=F.lit("a"), summary=F.concat("msg", F.lit("\r\n"))),
        to_line(request_id="user_id", message=F.lit(""), error=F.struct(F.concat(F.lit("code "), "k").alias("code"))),
        to_line(request_id="user_id", error="msg", outcome="out"),
        to_line(request_id="user_id", operation=F.struct(F.lit("sync").alias("kind"), F.lit("done").alias("state"))),
        to_line(request_id="user_id", operation=F.struct(F.lit("done").alias("state"))),
        to_line(request_id="user_id", outcome="out", operation=F.lit("list")),
        to_line(request_id="user_id", operation=F.lit("list")),
        to_line(request_id="user_id", error=F.struct(F.lit(1).alias("a"))),
    ]
    line = nested[0]
    for i, kind in enumerate(nested[1:], 1):
        line = F.when(c("event_id") % 8 == i, kind).otherwise(line)
    return parse(events(spark, sf_dir), line, keep=["event_id"]).select("event_id", "message")


_OUTCOME_LEVELS = {"error": "error", "purchase": "info", "signup": "info", "view": "pending", "click": "error"}


@query(
    "c12_api_level",
    oracle(
        f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN level ELSE {sql_case("event_type", _OUTCOME_LEVELS)} END AS level,
 CASE WHEN event_id % 3 = 0 THEN t WHEN event_id % 3 = 1 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) END AS timestamp FROM e"""
    ),
)
def c12(spark, sf_dir):
    kind = c("event_id") % 3
    line = to_line(
        request_id="user_id",
        outcome="out",
        status=F.when(c("event_id") % 4 == 0, c("lvl")),
        created_at=F.when(kind == 0, c("t")),
        timestamp_unix_ms=F.when(kind != 2, F.unix_millis(c("ts").cast("timestamp"))),
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "level", "timestamp")


@query(
    "c13_api_attributes",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN svc ELSE 'admin_api' END AS service,
 event_type AS operation_kind, CAST(k AS VARCHAR) AS operation_state,
 CASE WHEN event_id % 3 = 0 THEN 'top' ELSE CAST(user_id AS VARCHAR) END AS request_id,
 replace(props, ' ', '') AS extra, CAST(NULL AS VARCHAR) AS dropped FROM e"""
    ),
)
def c13(spark, sf_dir):
    operation = F.struct(
        c("event_type").alias("kind"), c("k").alias("state"), c("user_id").alias("request_id")
    )
    line = to_line(
        event="msg",
        operation=operation,
        service=F.when(c("event_id") % 2 == 0, c("svc")),
        request_id=F.when(c("event_id") % 3 == 0, F.lit("top")),
        extra=F.struct(c("k").alias("k")),
        action=F.lit("unused"),
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select(
        "event_id", "service", attr("operation_kind"), attr("operation_state"), attr("request_id"),
        attr("extra"), attr("action", "dropped"),
    )


# ------------------------------------------------------------------ applications (C14-C20)


@query("c14_infer_source", oracle("SELECT event_id, src AS source, svc AS service FROM e"))
def c14(spark, sf_dir):
    names = ["service", "service_name", "program", "app", "application", "logger", "target", "component"]
    at = c("event_id") % 8
    members = {name: F.when(at == i, c("svc")) for i, name in enumerate(names)}
    rows = parse(events(spark, sf_dir), to_line(**members, msg="msg"), keep=["event_id"])
    return rows.select("event_id", "source", "service")


@query(
    "c15_app_json",
    oracle(
        """SELECT event_id, src AS source, t AS timestamp, level, svc AS service, msg AS message,
 CAST(user_id AS VARCHAR) AS user_id, CAST(amount AS VARCHAR) AS amount, replace(props, ' ', '') AS props,
 CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS even, CAST(NULL AS VARCHAR) AS severity FROM e"""
    ),
)
def c15(spark, sf_dir):
    line = app_line(
        severity=F.lit("unused"),
        user_id="user_id",
        amount="amount",
        props=F.struct(c("k").alias("k")),
        even=c("event_id") % 2 == 0,
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select(
        "event_id", "source", "timestamp", "level", "service", "message",
        attr("user_id"), attr("amount"), attr("props"), attr("even"), attr("severity"),
    )


@query(
    "c16_text_source",
    oracle("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'docker_logs' ELSE 'authelia' END AS source, svc AS message FROM e"),
)
def c16(spark, sf_dir):
    asked = F.when(c("event_id") % 2 == 0, F.lit("auto")).otherwise(F.lit("authelia"))
    table = events(spark, sf_dir).withColumn("asked", asked)
    return parse(table, c("svc"), source=c("asked"), keep=["event_id"]).select("event_id", "source", "message")


@query(
    "c17_text_cascade",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'vaultwarden' ELSE 'docker_logs' END AS source, level,
 CASE WHEN event_id % 3 = 2 THEN msg ELSE svc END AS message FROM e"""
    ),
)
def c17(spark, sf_dir):
    kind = c("event_id") % 3
    level = F.trim("lvl")
    line = (
        F.when(kind == 0, F.concat(F.lit("[x] [y] ["), level, F.lit("]  "), c("svc")))
        .when(kind == 1, F.concat(F.lit("lvl="), level, F.lit(' msg="'), c("svc"), F.lit('" a=')))
        .otherwise(F.concat(level, F.lit(": "), c("msg")))
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "source", "level", "message")


@query(
    "c18_bracket",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'docker_logs' ELSE 'vaultwarden' END AS source,
 CASE WHEN event_id % 4 < 3 THEN t END AS timestamp, CASE WHEN event_id % 4 < 3 THEN svc END AS service,
 CASE WHEN event_id % 4 < 3 THEN level END AS level,
 CASE WHEN event_id % 4 = 3 THEN '[' || t || '][' || svc || '][loud] ' || msg ELSE msg END AS message FROM e"""
    ),
)
def c18(spark, sf_dir):
    level = F.when(c("event_id") % 4 == 3, F.lit("loud")).otherwise(F.trim("lvl"))
    gap = F.when(c("event_id") % 4 == 1, F.lit(" \t ")).otherwise(F.lit(""))
    line = F.concat(
        F.lit("["), c("t"), F.lit("]"), gap, F.lit("["), c("svc"), F.lit("]"), gap,
        F.lit("["), level, F.lit("] "), c("msg"),
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "source", "timestamp", "service", "level", "message")


@query(
    "c19_logfmt",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE t END AS timestamp, CASE WHEN event_id % 5 = 4 THEN NULL ELSE level END AS level,
 CASE event_id % 5 WHEN 2 THEN 'time=' || t || ' level=' || trim(lvl) || ' bare k=' || k
   WHEN 4 THEN 'ts=' || t || ' k=' || k ELSE msg || ' "x"' END AS message,
 CASE event_id % 5 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN 'last' WHEN 3 THEN '' END AS k FROM e"""
    ),
)
def c19(spark, sf_dir):
    kind = c("event_id") % 5
    head = F.concat(F.lit("time="), c("t"), F.lit(" level="), F.trim("lvl"))
    message = F.concat(F.lit(' msg="'), c("msg"), F.lit(' \\"x\\""'))
    line = (
        F.when(kind == 0, F.concat(head, message, F.lit(" k="), c("k")))
        .when(kind == 1, F.concat(head, F.lit(" k=first"), message, F.lit('\tk="last"')))
        .when(kind == 2, F.concat(head, F.lit(" bare k="), c("k")))
        .when(kind == 3, F.concat(head, message, F.lit(" k=")))
        .otherwise(F.concat(F.lit("ts="), c("t"), F.lit(" k="), c("k")))
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "timestamp", "level", "message", attr("k"))


@query(
    "c20_plain",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN t END AS timestamp,
 CASE WHEN event_id % 4 IN (0, 2) THEN level END AS level,
 CASE event_id % 4 WHEN 3 THEN t || ' ' || trim(lvl) ELSE msg END AS message FROM e"""
    ),
)
def c20(spark, sf_dir):
    kind = c("event_id") % 4
    line = (
        F.when(kind == 0, F.concat(c("t"), F.lit("  ["), F.trim("lvl"), F.lit("]:  "), c("msg"), F.lit("  ")))
        .when(kind == 1, F.concat(c("t"), F.lit("\t"), c("msg")))
        .when(kind == 2, F.concat(F.lit("  "), F.trim("lvl"), F.lit(" "), c("msg")))
        .otherwise(F.concat(F.lit(" "), c("t"), F.lit(" "), F.trim("lvl")))
    )
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    return rows.select("event_id", "timestamp", "level", "message")


# ------------------------------------------------------------------ helpers


@query(
    "n22_time_like",
    oracle("SELECT event_id, event_id % 4 < 2 AS is_time FROM e"),
)
def n22(spark, sf_dir):
    kind = c("event_id") % 4
    token = (
        F.when(kind == 0, c("t"))
        .when(kind == 1, F.lit("aaaa-bb-cctdd:ee:ff."))
        .when(kind == 2, F.substring("t", 1, 19))
        .otherwise(F.replace("t", F.lit(":"), F.lit("-")))
    )
    return events(spark, sf_dir).select("event_id", looks_like_time(token).alias("is_time"))


@query(
    "n24_level_normalize",
    oracle(
        """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' WHEN 2 THEN 'critical'
 WHEN 3 THEN level WHEN 4 THEN 'Äpfel' ELSE 'fatal' END AS level FROM e"""
    ),
)
def n24(spark, sf_dir):
    forms = [F.lit("\u2003WARN "), F.lit("Err"), F.lit("crit\t"), c("lvl"), F.lit("ÄPFEL"), F.lit("FATAL")]
    level = F.get(F.array(*forms), (c("event_id") % 6).cast("int"))
    return parse(events(spark, sf_dir), to_line(msg="msg", level=level), keep=["event_id"]).select(
        "event_id", "level"
    )


@query("n25_clean", oracle("SELECT event_id, msg || chr(13) || 'x' AS message FROM e"))
def n25(spark, sf_dir):
    text = F.concat("msg", F.lit("\rx\r\n\n\r"))
    return events(spark, sf_dir).select("event_id", strip_line_end(text).alias("message"))


@query(
    "n26_first_field",
    oracle(
        """SELECT event_id, CASE event_id % 3 WHEN 0 THEN msg WHEN 1 THEN '' ELSE svc END AS message FROM e"""
    ),
)
def n26(spark, sf_dir):
    kind = c("event_id") % 3
    null_first = F.concat(F.lit('{"message":null,"msg":"'), c("msg"), F.lit('"}'))
    empty_first = F.concat(F.lit('{"msg":"'), c("msg"), F.lit('","message":""}'))
    line = F.when(kind == 0, null_first).when(kind == 1, empty_first).otherwise(to_line(log="svc"))
    return parse(events(spark, sf_dir), line, keep=["event_id"]).select("event_id", "message")


_VALUES = [
    "1.0", "1e20", "-0.5", "true", "[1, 2.50,{\"b\":null,\"a\":\"x\"}]", '{"z":1,"a":[]}', '"1.0E7"', "25000000.25", "1.5e-9",
    "[1e20]", '{"z":1.0,"a":2}', '{"q":"1.0 \\\\ 2e3","b":[-1.50,1e-7,{"y":0,"x":100.0}]}',
]
_TEXTS = [
    "1.0", "1e20", "-0.5", "true", '[1,2.5,{"a":"x","b":null}]', '{"a":[],"z":1}', "1.0E7", "25000000.25", "1.5e-9",
    "[1e20]", '{"a":2,"z":1.0}', '{"b":[-1.5,1e-7,{"x":100.0,"y":0}],"q":"1.0 \\\\ 2e3"}',
]


def _texts_sql() -> str:
    arms = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(_TEXTS))
    return f"CASE event_id % {len(_TEXTS)} {arms} END"


@query("n27_json_text", f"""SELECT event_id, {_texts_sql()} AS v FROM events""")
def n27(spark, sf_dir):
    value = F.get(F.array(*[F.lit(v) for v in _VALUES]), (c("event_id") % len(_VALUES)).cast("int"))
    line = F.concat(F.lit('{"v":'), value, F.lit("}"))
    return parse(events(spark, sf_dir), line, keep=["event_id"]).select("event_id", attr("v"))


@query(
    "n28_passthrough",
    oracle(
        """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k,last,u' ELSE 'k,u' END AS keys,
 CASE WHEN event_id % 2 = 0 THEN '2' END AS last FROM e"""
    ),
)
def n28(spark, sf_dir):
    twice = F.when(c("event_id") % 2 == 0, F.lit(',"last":1,"last":2')).otherwise(F.lit(""))
    line = F.concat(F.lit('{"level":"x","k":"'), c("k"), F.lit('","n":null,"u":'), c("user_id"), twice, F.lit("}"))
    rows = parse(events(spark, sf_dir), line, keep=["event_id"])
    keys = F.array_join(F.array_sort(F.map_keys("attributes")), ",")
    return rows.select("event_id", keys.alias("keys"), attr("last"))


@query(
    "n23_level_token",
    oracle(
        "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 0 THEN level ELSE 'fatal' END AS level,"
        " CASE WHEN event_id % 3 = 2 THEN 'emergency ' || msg ELSE msg END AS message FROM e"
    ),
)
def n23(spark, sf_dir):
    word = F.when(c("event_id") % 3 == 0, F.trim("lvl")).when(
        c("event_id") % 3 == 1, F.lit("::FATAL]")
    ).otherwise(F.lit("emergency"))
    line = F.concat(word, F.lit(" "), c("msg"))
    return parse(events(spark, sf_dir), line, keep=["event_id"]).select("event_id", "level", "message")


