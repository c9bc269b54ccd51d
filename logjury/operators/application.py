"""Application logs: JSON objects, bracketed text, key=value text and plain text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logjury.functions.text import (
    is_level_token,
    last_wins_map,
    lower_ascii,
    strip,
    strip_line_end,
    strip_start,
)
from logjury.operators.records import only, passthrough, record
from logjury.sources.registry import APPLICATION, Descriptor, Line, Provider, SourceWords

# Field names in order of preference.
MESSAGE_FIELDS = ["message", "msg", "log", "event", "error", "description"]
TIME_FIELDS = ["timestamp", "time", "ts", "@timestamp", "date"]
LEVEL_FIELDS = ["level", "lvl", "severity", "status"]
SERVICE_FIELDS = [
    "service", "service_name", "program", "app",
    "application", "logger", "target", "component",
]

# Source names and the words that point to them, in order of preference. These are well-known public
# services; a deployment passes its own to ``provider``.
SOURCE_WORDS = {
    "authelia": ["authelia"],
    "ory": ["ory", "kratos", "hydra"],
    "voidauth": ["voidauth"],
    "vaultwarden": ["vaultwarden", "bitwarden"],
}
FALLBACK_SOURCE = "docker_logs"
# Whose bracketed text is, if nothing else is known.
BRACKET_SOURCE = "vaultwarden"

# Keys of key=value text.
PAIR_MESSAGE = ["msg", "message"]
PAIR_TIME = ["time", "timestamp", "ts"]
PAIR_LEVEL = ["level", "lvl"]
PAIR_SERVICE = ["service", "service_name", "app"]
PAIR_REQUIRED = ["msg", "message", "level", "time"]

_BRACKETS = r"(?sU)^\[([^\]]*+)\]\s*+\[([^\]]*+)\]\s*+\[([^\]]*+)\](.*)\z"

# One pair, anchored where the previous one ended; stops at the first word without "=".
# Possessive throughout: no backtracking however long the line is.
_PAIR = (
    r"(?s)\G[ \t\n\f\r]*+([^ \t\n\f\r=]++)="
    r'("[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|(?!")[^ \t\n\f\r]*+)'
)
_STARTS_WITH_PAIR = r"^[ \t\n\f\r]*+[^ \t\n\f\r=]++="


def source_from_words(text: Column, source_words: SourceWords) -> Column:
    """First source one of whose words occurs in a lower-case text."""
    found = F.lit(FALLBACK_SOURCE)
    for name, words in reversed(source_words):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return found


def infer_source(requested: Column, lower_text: Column, source_words: SourceWords) -> Column:
    """The named source; in auto mode the one the service name or payload points to."""
    return F.when(requested != "auto", requested).otherwise(source_from_words(lower_text, source_words))


def json_records(line: Line, source_words: SourceWords) -> Column:
    field = line.object.field
    service = line.prepared["service"]
    return only(
        record(
            source=infer_source(line.requested, line.prepared["lower_service"], source_words),
            timestamp=field(*TIME_FIELDS),
            level=field(*LEVEL_FIELDS),
            service=service,
            message=strip_line_end(F.coalesce(field(*MESSAGE_FIELDS), F.lit(""))),
            attributes=passthrough(
                line.object.members,
                [*MESSAGE_FIELDS, *TIME_FIELDS, *LEVEL_FIELDS, *SERVICE_FIELDS],
            ),
        )
    )


def unstructured_source(requested: Column) -> Column:
    return F.when(requested == "auto", F.lit(FALLBACK_SOURCE)).otherwise(requested)


def bracketed(line: Line, bracket_source: str) -> Column:
    """``[time][service][LEVEL] message``; NULL if the text has another form."""

    def part(n: int) -> Column:
        return F.regexp_extract(line.payload, _BRACKETS, n)

    source = F.when(line.is_auto, F.lit(bracket_source)).otherwise(line.requested)
    return F.when(
        F.startswith(line.payload, F.lit("[")) & is_level_token(part(3)),
        record(
            source=source,
            timestamp=part(1),
            level=part(3),
            service=part(2),
            message=strip(part(4)),
        ),
    )


def unquote(raw: Column) -> Column:
    """Value of a pair: quotes go, and of the escapes only the escaped quote is resolved."""
    # The first quote opens; the last character closes only if it is an unescaped quote.
    closed = raw.rlike(r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"\z')
    open_end = F.substring(raw, F.lit(2), F.length(raw))
    inner = F.when(closed, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(open_end)
    return F.when(
        F.startswith(raw, F.lit('"')), F.replace(inner, F.lit('\\"'), F.lit('"'))
    ).otherwise(raw)


def key_value(line: Line) -> Column:
    """key=value text; NULL unless a message, level or time key is among the pairs."""
    found = line.prepared["pairs"]
    known = F.map_contains_key(found, PAIR_REQUIRED[0])
    for key in PAIR_REQUIRED[1:]:
        known = known | F.map_contains_key(found, key)

    def first(keys: list[str]) -> Column:
        return F.coalesce(*[found[key] for key in keys])

    return F.when(
        known,
        record(
            source=unstructured_source(line.requested),
            timestamp=first(PAIR_TIME),
            level=first(PAIR_LEVEL),
            service=first(PAIR_SERVICE),
            message=F.coalesce(first(PAIR_MESSAGE), line.payload),
            attributes=passthrough(
                found, [*PAIR_MESSAGE, *PAIR_TIME, *PAIR_LEVEL, *PAIR_SERVICE]
            ),
        ),
    )


def looks_like_time(token: Column) -> Column:
    """RFC 3339 shape by byte position; digits are not checked."""
    as_bytes = F.decode(F.encode(token, "UTF-8"), "ISO-8859-1")
    shape = r"(?s)^.{4}-.{2}-.{2}[Tt ].{2}:.{2}:.{3}"
    ascii_only = F.length(token) == F.octet_length(token)
    return F.when(ascii_only, token.rlike(shape)).otherwise(as_bytes.rlike(shape))


def plain(line: Line) -> Column:
    """Optional leading time and level tokens; the rest is the message."""
    found = line.prepared
    leveled = is_level_token(found["word"])
    message = F.when(
        leveled, F.regexp_replace(found["rest"], r"(?U)^\s*+\S++", "")
    ).otherwise(found["rest"])
    return record(
        source=unstructured_source(line.requested),
        timestamp=found["time"],
        level=F.when(leveled, found["word"]),
        message=strip(message),
    )


def text_records(line: Line, bracket_source: str) -> Column:
    return only(F.coalesce(bracketed(line, bracket_source), key_value(line), plain(line)))


def scan(line: Line) -> Column:
    """Step 1: the service of an object; pairs and the first word of a text."""
    has_pairs = ~line.is_json & line.payload.rlike(_STARTS_WITH_PAIR)
    return F.struct(
        F.when(line.is_json, line.object.field(*SERVICE_FIELDS)).alias("service"),
        F.when(has_pairs, F.regexp_extract_all(line.payload, F.lit(_PAIR), F.lit(1))).alias("keys"),
        F.when(has_pairs, F.regexp_extract_all(line.payload, F.lit(_PAIR), F.lit(2))).alias("values"),
        F.when(~line.is_json, F.regexp_extract(line.payload, r"(?U)^(\S*+)\s", 1)).alias("word"),
    )


def split_time(line: Line) -> Column:
    """Step 2: the service in lower case; pairs as a map; time and rest of a text."""
    found = line.prepared
    word = found["word"]
    timed = looks_like_time(word)
    after = F.substring(line.payload, F.length(word) + 1, F.length(line.payload))
    return F.struct(
        found["service"].alias("service"),
        F.when(line.is_auto, lower_ascii(found["service"])).alias("lower_service"),
        F.when(
            found["keys"].isNotNull(),
            last_wins_map(found["keys"], F.transform(found["values"], unquote)),
        ).alias("pairs"),
        F.when(timed, word).alias("time"),
        F.when(timed, strip_start(after)).when(word.isNotNull(), line.payload).alias("rest"),
    )


def split_level(line: Line) -> Column:
    """Step 3: the word of a text that may be its level."""
    found = line.prepared
    word = F.regexp_extract(found["rest"], r"(?U)^\s*+(\S++)\s", 1)
    carried = [found[name].alias(name) for name in ("service", "lower_service", "pairs", "time", "rest")]
    return F.struct(
        *carried, F.regexp_replace(word, r"^[\[\]:]++|[\[\]:]++\z", "").alias("word")
    )


def provider(
    source_words: Mapping[str, Sequence[str]] = SOURCE_WORDS, bracket_source: str = BRACKET_SOURCE
) -> Provider:
    """Application logs of these sources.

    A line in auto mode belongs to the first source one of whose words is in its service name, and
    bracketed text to ``bracket_source``.
    """
    words = tuple((name, tuple(found)) for name, found in source_words.items())
    return Provider(
        tuple(Descriptor(name, (name,), APPLICATION) for name, _ in words),
        takes_json=lambda line: F.lit(True),
        json=lambda line: json_records(line, words),
        text=lambda line: text_records(line, bracket_source),
        prepare=(scan, split_time, split_level),
        source_words=words,
    )


PROVIDER = provider()
