"""Raw lines to records of one schema, as a narrow Spark job without any shuffle.

Stages: resolve the source, parse JSON once, route each line to a provider, open container
wrappers, build the records, explode. Every record of a line comes out of one ``explode``;
filters on record fields stay above it, so nothing is parsed twice.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logjury.functions.json import (
    JsonObject,
    looks_like_object,
    object_mark,
    open_object,
    parse_marked,
    text_map,
    without_mark,
)
from logjury.functions.text import (
    is_blank,
    let,
    level_name,
    lower_ascii,
    overlay_map,
    strip_line_end,
)
from logjury.operators import api, application, docker, journal
from logjury.operators.application import infer_source
from logjury.operators.records import record
from logjury.schema import RECORDS, SCHEMA_TAG
from logjury.session import prepare
from logjury.sources.registry import Line, Registry

BUILTIN = Registry((docker.PROVIDER, journal.PROVIDER, api.PROVIDER, application.PROVIDER))


def normalize(
    lines: DataFrame,
    line: str = "value",
    source: str | Column = "auto",
    ord: str = "ord",
    mode: str = "quarantine",
    first_only: bool = False,
    schema_tag: str = SCHEMA_TAG,
    registry: Registry = BUILTIN,
    keep: list[str] | None = None,
) -> DataFrame:
    """Records of every non-blank line.

    ``source`` is one name for all lines or a column with a name per line. A line that begins
    like a JSON object but is none, and a line with an unknown source, become a row with
    ``parse_error``; with ``mode="failfast"`` the first such line stops the job instead.
    ``first_only`` keeps only the first record of a line. Columns named in ``keep`` travel along.

    Output: ``ord, rec_idx``, the kept columns, the seven record fields, ``parse_error``, and for a
    bad line ``raw_line``. Bad lines are named by ``line_no`` if the lines have one, else by ``ord``.
    """
    if mode not in ("quarantine", "failfast"):
        raise ValueError(f"unknown mode: {mode}")
    prepare(lines.sparkSession)
    if isinstance(source, str):
        requested = F.lit(registry.resolve(source))
        unknown = F.lit(None).cast("string")
    else:
        requested = registry.resolve_column(source)
        unknown = F.when(
            requested.isNull(), F.concat(F.lit("no such source: "), source.cast("string"))
        )
    carried = keep or []

    cleaned = lines.where(~is_blank(F.col(line))).select(
        F.col(ord).alias("ord"),
        F.col("line_no" if "line_no" in lines.columns else ord).alias("number"),
        *carried,
        strip_line_end(F.col(line)).alias("payload"),
        requested.alias("requested"),
        unknown.alias("unknown"),
    )
    staged = cleaned
    for step in _steps(lines.sparkSession.sparkContext, registry, first_only):
        staged = staged.withColumns(step)
    failure = F.col("parse_error").isNotNull()
    raw_line = F.when(failure, F.col("payload")).alias("raw_line")
    built = staged.select("ord", *carried, "parse_error", raw_line, "over", "time", "wrapped", "records")
    if mode == "failfast":
        # The check sits in the explode input, so no later projection can skip it.
        records = F.when(failure, F.raise_error(F.col("parse_error")).cast(RECORDS)).otherwise(
            F.col("records")
        )
    else:
        records = F.when(failure, F.array(F.lit(None)).cast(RECORDS)).otherwise(F.col("records"))
    exploded = built.select(
        "ord", *carried, "parse_error", "raw_line", "over", "time", "wrapped",
        F.posexplode(records).alias("rec_idx", "rec"),
    )
    # Every output depends on the exploded struct, so a filter on any of them stays above the
    # explode and no line is parsed twice for it.
    rec = F.col("rec")
    wrapped = rec.isNotNull() & F.col("wrapped")
    return exploded.select(
        "ord",
        "rec_idx",
        *carried,
        F.when(rec.isNotNull(), F.lit(schema_tag)).alias("schema"),
        F.when(wrapped, F.lit(docker.SOURCE)).otherwise(rec["source"]).alias("source"),
        F.when(wrapped, F.coalesce("time", rec["timestamp"]))
        .otherwise(rec["timestamp"])
        .alias("timestamp"),
        level_name(rec["level"]).alias("level"),
        rec["service"].alias("service"),
        rec["message"].alias("message"),
        F.when(wrapped, overlay_map(rec["attributes"], F.col("over")))
        .otherwise(rec["attributes"])
        .alias("attributes"),
        F.when(rec.isNull(), F.col("parse_error")).alias("parse_error"),
        F.when(rec.isNull(), F.col("raw_line")).alias("raw_line"),
    )


def unparsed(records: DataFrame) -> DataFrame:
    """Quarantined rows: ``ord``, the reason and the line as it came."""
    return records.where(F.col("parse_error").isNotNull()).select("ord", "parse_error", "raw_line")


def counted(records: DataFrame, observation: Observation | str = "normalized") -> DataFrame:
    """The same rows; the running job counts records and quarantined lines on the way.

    With an ``Observation`` the figures are there after the first action; with a name they are part of
    every progress report of a stream (``observedMetrics``).
    """
    bad = F.col("parse_error").isNotNull()
    return records.observe(
        observation,
        F.count_if(~bad).alias("records"),
        F.count_if(bad).alias("quarantined"),
        F.count_if(~bad & (F.col("rec_idx") == 0)).alias("lines"),
    )


def _malformed() -> Column:
    return F.when(
        F.col("members").isNull() & looks_like_object(F.col("payload")),
        F.concat(F.lit("line "), F.col("number").cast("string"), F.lit(" is no JSON object")),
    )


@lru_cache(maxsize=8)
def _steps(
    context: SparkContext, registry: Registry, first_only: bool
) -> list[dict[str, Column]]:
    """The projections between a cleaned line and its records.

    They only name columns, so one build serves all frames. Each step is a projection of its own
    because its results are used more than once by the next ones.
    """
    c = F.col
    line = Line(c("requested"), c("payload"), JsonObject(c("payload"), c("members")))
    wraps = _is_wrapper(registry, c("provider"))
    log = docker.inner_payload(line.object)

    def if_wrapped(inner: Column, name: str | None = None) -> Column:
        value = F.when(c("wrapped"), inner)
        return value if name is None else value.otherwise(c(name))

    the_line = [
        {"mark": object_mark(c("payload"))},
        {"parsed": parse_marked(c("payload"), c("mark"))},
        {"parsed": without_mark(c("parsed"), c("mark"))},
        {"members": text_map(c("payload"), c("parsed"))},
        {"parse_error": F.coalesce(c("unknown"), _malformed())},
        {"provider": F.when(c("parse_error").isNull(), _route(registry, line))},
    ]
    one_wrapper = [
        {
            "wrapped": wraps,
            "over": F.when(wraps, docker.overlay(line.object)),
            "time": F.when(wraps, line.object.field("time")),
            "text": F.when(wraps, docker.source_text(line, log)),
            "payload": F.when(wraps, strip_line_end(log)).otherwise(c("payload")),
        },
        {"text": lower_ascii(c("text")), "mark": if_wrapped(object_mark(c("payload")))},
        {
            "requested": if_wrapped(infer_source(c("requested"), c("text"), registry.source_words), "requested"),
            "parsed": if_wrapped(parse_marked(c("payload"), c("mark"))),
        },
        {"parsed": if_wrapped(without_mark(c("parsed"), c("mark")))},
        {"members": if_wrapped(text_map(c("payload"), c("parsed")), "members")},
        {"provider": if_wrapped(_route(registry, line), "provider")},
    ]
    more_wrappers = [
        {"deep": _open_deeper(registry, line)},
        {
            name: F.when(c("deep").isNotNull(), c("deep")[name]).otherwise(c(name))
            for name in _STATE
        },
    ]
    records = [{"records": _records(registry, line, first_only)}, {"records": _at_least_one()}]
    return [*the_line, *one_wrapper, *more_wrappers, *_prepared(registry, line), *records]


def _route(registry: Registry, line: Line) -> Column:
    return F.when(line.is_json, registry.route_json(line)).otherwise(registry.route_text(line))


def _is_wrapper(registry: Registry, provider: Column) -> Column:
    wrappers = [i for i, p in enumerate(registry.providers) if p.unwraps]
    return F.coalesce(provider.isin(wrappers), F.lit(False)) if wrappers else F.lit(False)


# Columns that describe the payload being looked at while wrappers are opened.
_STATE = ["payload", "members", "requested", "provider", "over", "time"]


def _state(**columns: Column) -> Column:
    return F.struct(*[columns[name].alias(name) for name in _STATE])


def _open_deeper(registry: Registry, line: Line) -> Column:
    """What is left when wrappers inside the first wrapper are opened too, to any depth.

    Each level costs the text at least one brace, plain or escaped, so counting braces and
    backslashes bounds the number of levels exactly; NULL if there is nothing more to open.
    """
    log = docker.inner_payload(line.object)
    marks = F.length(log) - F.length(F.translate(log, "{\\", ""))
    levels = F.when(looks_like_object(log), marks + 1).otherwise(F.lit(1))
    start = _state(**{name: F.col(name) for name in _STATE})

    def unwrap(state: Column, _: Column) -> Column:
        here = Line(
            state["requested"],
            state["payload"],
            JsonObject(state["payload"], state["members"]),
        )
        text = docker.inner_payload(here.object)
        requested = let(
            lower_ascii(docker.source_text(here, text)),
            lambda lower: infer_source(here.requested, lower, registry.source_words),
        )
        over = overlay_map(docker.overlay(here.object), state["over"])
        time = F.coalesce(state["time"], here.object.field("time"))

        def route(inner: Column) -> Column:
            payload, members = inner["payload"], inner["members"]
            inside = Line(inner["requested"], payload, JsonObject(payload, members))
            return _state(
                payload=payload,
                members=members,
                requested=inner["requested"],
                provider=_route(registry, inside),
                over=over,
                time=time,
            )

        def parse(inner: Column) -> Column:
            payload = inner["payload"]
            members = let(open_object(payload), lambda m: text_map(payload, m))
            return let(
                F.struct(
                    payload.alias("payload"),
                    inner["requested"].alias("requested"),
                    members.alias("members"),
                ),
                route,
            )

        opened = let(
            F.struct(strip_line_end(text).alias("payload"), requested.alias("requested")), parse
        )
        return F.when(_is_wrapper(registry, state["provider"]), opened).otherwise(state)

    return F.when(
        F.col("wrapped") & _is_wrapper(registry, F.col("provider")),
        F.aggregate(F.sequence(F.lit(1), levels), start, unwrap),
    )


def _prepared(registry: Registry, line: Line) -> list[dict[str, Column]]:
    """Extra projections asked for by providers, for the lines they took."""
    steps = []
    for number in range(max((len(p.prepare) for p in registry.providers), default=0)):
        step = {}
        for index, provider in enumerate(registry.providers):
            if number < len(provider.prepare):
                before = F.col(f"prepared_{index}") if number else None
                column = provider.prepare[number](replace(line, prepared=before))
                step[f"prepared_{index}"] = F.when(F.col("provider") == index, column)
        steps.append(step)
    return steps


def _records(registry: Registry, line: Line, first_only: bool) -> Column:
    """Records from the provider that took the payload."""
    records = F.array().cast(RECORDS)
    for index, provider in enumerate(registry.providers):
        taken = F.col("provider") == index
        if provider.prepare:
            line = replace(line, prepared=F.col(f"prepared_{index}"))
        if provider.text is not None:
            records = F.when(taken & ~line.is_json, provider.text(line)).otherwise(records)
        if provider.json is not None:
            records = F.when(taken & line.is_json, provider.json(line)).otherwise(records)
    return F.slice(records, 1, 1) if first_only else records


def _at_least_one() -> Column:
    """A wrapper yields a record even if nothing came out of its payload."""
    records = F.col("records")
    blank = F.array(record(F.col("requested"), F.lit("")))
    return F.when(F.col("wrapped") & (F.size(records) == 0), blank).otherwise(records)
