"""Strict JSON objects as ``map<string,string>`` columns.

A payload is parsed once. Its closing brace is moved behind one more member that holds a hash of
the payload: only if the text is one whole object does the parser reach that member on the top
level, so trailing text, a second value or a missing brace all show. (The hash is the value, not
the name: the JSON parser keeps every member name it has seen.) Values are kept as text;
JSON null is a present key with a NULL value. The variant type is consulted only for values
whose text alone does not tell the JSON kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logjury.functions.text import last_wins_map, let, none_if_empty, strip_start

# Member name outside the characters meant for interchange.
_MARK = "\ufdd0end"

# Around numbers inside nested values while their keys are put in order.
_NUMBER = "\ufdd1"

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Text that may be a nested value, a float in scientific form or an integer beyond 64 bits.
_AMBIGUOUS = r"^(?:[\[{]|-?\d\.\d+E-?\d+\z|-?\d{19,}\z)"


@dataclass(frozen=True)
class JsonObject:
    """A parsed object: its JSON text and its members as text."""

    text: Column
    members: Column

    def has(self, *keys: str) -> Column:
        found = F.map_contains_key(self.members, keys[0])
        for key in keys[1:]:
            found = found | F.map_contains_key(self.members, key)
        return found

    def field(self, *keys: str) -> Column:
        return first_field(self.members, *keys)

    def raw(self, key: str) -> Column:
        """A nested member as written, before its keys are put in order."""
        return raw_members(self.text)[key]

    def kind_is(self, key: str, kind: str) -> Column:
        """True if the member is a JSON value of that kind (ARRAY or OBJECT)."""
        opening = {"ARRAY": "[", "OBJECT": "{"}[kind]
        value = F.element_at(variant_members(self.text), key)
        return F.when(
            F.startswith(self.members[key], F.lit(opening)),
            F.startswith(F.schema_of_variant(value), F.lit(kind)),
        ).otherwise(F.lit(False))


def raw_members(text: Column) -> Column:
    """Members of an object as written, before nested keys are put in order."""
    return let(F.from_json(text, "map<string,string>", _STRICT), unique_members)


def variant_members(text: Column) -> Column:
    return F.try_parse_json(text).cast("map<string,variant>")


def first_field(members: Column, *keys: str) -> Column:
    """Value of the first key that is not JSON null; an empty text counts as none."""
    return none_if_empty(F.coalesce(*[members[key] for key in keys]))


def object_mark(payload: Column) -> Column:
    """Value of the extra member; a payload cannot be expected to hold its own hash."""
    return F.xxhash64(payload).cast("string")


def parse_marked(payload: Column, mark: Column) -> Column:
    """Members of the payload and the mark; without the mark the payload is no whole object."""
    body = F.rtrim(payload, F.lit(" \t\r\n"))
    closed = F.endswith(body, F.lit("}")) & looks_like_object(payload)
    empty = payload.rlike(r"(?U)^\s*+\{[ \t\r\n]*+\}[ \t\r\n]*+\z")
    inside = F.substring(body, F.lit(1), F.length(body) - 1)
    start = F.when(F.startswith(payload, F.lit("{")), inside).otherwise(strip_start(inside))
    joint = F.when(empty, F.lit(f'"{_MARK}":"')).otherwise(F.lit(f',"{_MARK}":"'))
    text = F.concat(start, joint, mark, F.lit('"}'))
    return F.from_json(F.when(closed, text), "map<string,string>", _STRICT)


def without_mark(parsed: Column, mark: Column) -> Column:
    """Members of a whole object, NULL for anything else."""
    last = F.lit(-1)
    whole = (F.try_element_at(F.map_keys(parsed), last) == _MARK) & (
        F.try_element_at(F.map_values(parsed), last) == mark
    )
    return F.when(whole, F.map_filter(parsed, lambda key, _: key != _MARK))


def open_object(payload: Column) -> Column:
    """Members of a payload that is exactly one JSON object, else NULL."""
    return let(
        object_mark(payload),
        lambda mark: let(
            parse_marked(payload, mark), lambda parsed: without_mark(parsed, mark)
        ),
    )


def looks_like_object(payload: Column) -> Column:
    return F.startswith(payload, F.lit("{")) | payload.rlike(r"(?U)^\s+\{")


def text_map(payload: Column, members: Column) -> Column:
    """Members with unique keys and every value in its canonical text form."""
    unique = unique_members(members)
    ambiguous = F.exists(F.map_values(members), lambda value: value.rlike(_AMBIGUOUS))
    exact = let(
        variant_members(payload),
        lambda kinds: F.transform_values(
            unique,
            lambda key, value: F.when(
                value.rlike(_AMBIGUOUS), _exact_text(value, kinds[key])
            ).otherwise(value),
        ),
    )
    return F.when(ambiguous, exact).otherwise(unique)


def unique_members(members: Column) -> Column:
    """Parsed members with the last value of every repeated key."""
    distinct = F.size(F.array_distinct(F.map_keys(members))) == F.size(members)
    return F.when(distinct, members).otherwise(
        last_wins_map(F.map_keys(members), F.map_values(members))
    )


def _exact_text(raw: Column, value: Column) -> Column:
    return let(
        F.struct(F.schema_of_variant(value).alias("kind"), raw.alias("raw")),
        lambda it: F.when(it["kind"] == "STRING", it["raw"])
        .when(it["raw"].rlike(r"^[\[{]"), _nested_text(it["raw"]))
        .otherwise(number_text(it["raw"])),
    )


def _nested_text(raw: Column) -> Column:
    """Compact text with sorted keys in which every number has its own shortest form.

    The variant type sorts keys but shortens 1.0 to 1, so numbers travel through it as marked texts:
    every number outside a text is put between marks, the marks behind texts go, and marked numbers
    become texts; sorted, they are cut out again and spelled.
    """
    text = r'"(?:[^"\\]|\\.)*+"'
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    marked = F.regexp_replace(raw, f"({text})|({number})", f"$1{_NUMBER}$2{_NUMBER}")
    marked = F.regexp_replace(marked, f"{_NUMBER}{_NUMBER}", "")
    marked = F.regexp_replace(marked, f"{_NUMBER}([^{_NUMBER}]*){_NUMBER}", f'"{_NUMBER}$1"')
    ordered = F.try_parse_json(marked).cast("string")
    found = f'"{_NUMBER}([^"]*)"'

    def respell(sorted_text: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(sorted_text, F.lit(found), F.lit(1)), number_text)
        between = F.split(sorted_text, f'"{_NUMBER}[^"]*"', -1)
        pairs = F.zip_with(between, numbers, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.array_join(pairs, "")

    return let(ordered, respell)


def number_text(java: Column) -> Column:
    """Shortest decimal form of a number printed by the JVM.

    Plain digits up to 16 places before and 5 after the point, else ``1.5e-7``; integers
    beyond 64 bits become floats.
    """
    integer = java.rlike(r"^-?\d+\z")
    fits = F.try_to_number(java, F.lit("S" + "9" * 38)).between(
        F.lit("-9223372036854775808").cast("decimal(38,0)"),
        F.lit("18446744073709551615").cast("decimal(38,0)"),
    )
    floating = F.when(integer, java.try_cast("double").cast("string")).otherwise(java)

    def spell(text: Column) -> Column:
        sign = F.regexp_extract(text, r"^(-?)", 1)
        whole = F.regexp_extract(text, r"^-?(\d)\.", 1)
        fraction = F.regexp_extract(text, r"\.(\d*?)0*E", 1)
        power = F.regexp_extract(text, r"E(-?\d+)\z", 1).try_cast("int")
        return let(
            F.struct(
                sign.alias("sign"),
                F.concat(whole, fraction).alias("digits"),
                (power + 1).alias("point"),
            ),
            lambda n: F.when(power.isNull(), text).otherwise(
                F.concat(n["sign"], _place_point(n["digits"], n["point"]))
            ),
        )

    return F.when(integer & F.coalesce(fits, F.lit(False)), java).otherwise(let(floating, spell))


def _place_point(digits: Column, point: Column) -> Column:
    count = F.length(digits)
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(
            F.lit("")
        ),
        F.lit("e"),
        (point - 1).cast("string"),
    )
    return (
        F.when(
            point.between(1, 16) & (count <= point),
            F.concat(F.rpad(digits, point, F.lit("0")), F.lit(".0")),
        )
        .when(
            point.between(1, 16),
            F.concat(
                F.substring(digits, F.lit(1), point),
                F.lit("."),
                F.substring(digits, point + 1, count),
            ),
        )
        .when(
            point.between(-4, 0),
            F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits),
        )
        .otherwise(scientific)
    )
