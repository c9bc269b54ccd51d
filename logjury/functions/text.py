"""Text helpers as Column expressions: trimming, ASCII case, levels, map merging."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens recognised as a log level, and the short forms that are spelled out.
LEVEL_TOKENS = [
    "trace", "debug", "info", "notice", "warn", "warning",
    "error", "err", "critical", "crit", "fatal",
]
LEVEL_SHORT_FORMS = {"warn": "warning", "err": "error", "crit": "critical"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, for use inside larger expressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends (Spark's trim only knows the blank)."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")


def strip_start(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++", "")


def strip_line_end(text: Column) -> Column:
    return F.rtrim(text, F.lit("\r\n"))


def strip_slashes(text: Column) -> Column:
    return F.ltrim(text, F.lit("/"))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def _ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.when(_ascii_only(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase)
    )


def upper_ascii(text: Column) -> Column:
    return F.when(_ascii_only(text), F.upper(text)).otherwise(
        F.translate(text, ascii_lowercase, ascii_uppercase)
    )


def level_name(level: Column) -> Column:
    """Trim, lower-case and spell out the short level names."""
    spelled = [name for name in LEVEL_TOKENS if name not in LEVEL_SHORT_FORMS]
    name = lower_ascii(strip(level))
    return F.when(level.isin(spelled), level).otherwise(
        F.coalesce(literal_map(LEVEL_SHORT_FORMS)[name], name)
    )


def is_level_token(token: Column) -> Column:
    return lower_ascii(token).isin(LEVEL_TOKENS)


def none_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def overlay_map(base: Column, top: Column) -> Column:
    """Union of two maps in which entries of ``top`` replace those of ``base``."""

    def merge(maps: Column) -> Column:
        below, above = maps["base"], maps["top"]
        kept = F.map_filter(below, lambda key, _: ~F.map_contains_key(above, key))
        return (
            F.when(F.size(above) == 0, below)
            .when(F.size(below) == 0, above)
            .otherwise(F.map_concat(kept, above))
        )

    return let(F.struct(base.alias("base"), top.alias("top")), merge)


def last_wins_map(keys: Column, values: Column) -> Column:
    """Map from parallel arrays; of equal keys the last one counts.

    Sorting (key, position) keeps this n log n for a line with very many pairs.
    """
    distinct = F.size(F.array_distinct(keys)) == F.size(keys)
    ordered = F.array_sort(
        F.transform(
            F.arrays_zip(keys.alias("k"), values.alias("v")),
            lambda pair, at: F.struct(pair["k"].alias("k"), at.alias("at"), pair["v"].alias("v")),
        )
    )

    def keep_last(pairs: Column) -> Column:
        last = F.filter(
            pairs,
            lambda pair, at: (at == F.size(pairs) - 1)
            | (F.get(pairs, at + 1)["k"] != pair["k"]),
        )
        return F.map_from_entries(
            F.transform(last, lambda pair: F.struct(pair["k"], pair["v"]))
        )

    return F.when(distinct, F.map_from_arrays(keys, values)).otherwise(let(ordered, keep_last))
