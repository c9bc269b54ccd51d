"""Functions for rule predicates.

They are SQL functions: Catalyst inlines their bodies, so a rule costs no more than the built-in
expressions it is made of. Python callers use the ``Column`` twins at the end, which name the
same functions. None of them raises on data: what cannot be decided is NULL, and a rule that is
NULL counts as undecided, never as a match.

Text functions that Spark already has (``contains``, ``startswith``, ``endswith``) are used as
they are. Patterns follow Java syntax with Unicode classes switched on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_TEXTS = "MAP<STRING, STRING>"
_LIST = "ARRAY<STRING>"
_V4 = (
    r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    r"(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"
)
_GROUPS = r"(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*+)"


def _octet(text: str, n: int, base: int, width: int) -> str:
    return f"lpad(conv(split_part({text}, '.', {n}), 10, {base}), {width}, '0')"


def _hex_pair(text: str, n: int) -> str:
    return f"{_octet(text, n, 16, 2)}, {_octet(text, n + 1, 16, 2)}"


def _regex(pattern: str) -> str:
    return f"concat('(?U)', {pattern})"


def _let(value: str, name: str, body: str) -> str:
    """Evaluate a value once and use it by name, so that inlining does not multiply it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _v6_words(s: str) -> str:
    """An IPv6 address in lower case, a dotted tail as two groups."""
    tail = rf"regexp_extract({s}, r'([^:]*)\z', 1)"
    return (
        f"CASE WHEN NOT contains({s}, '.') THEN lower({s}) "
        rf"WHEN {s} RLIKE r'^[0-9a-fA-F:]*:{_V4}\z' THEN lower(concat("
        rf"regexp_extract({s}, r'^(.*:)', 1), {_hex_pair(tail, 1)}, ':', {_hex_pair(tail, 3)})) END"
    )


def _v6_digits(s: str) -> str:
    """Groups as four digits each, without separators."""
    return (
        f"regexp_replace(regexp_replace({s}, '([0-9a-f]+)', '000$1'), "
        r"r'[0-9a-f]*([0-9a-f]{4})(?::|\z)', '$1')"
    )


def _v6_hex(w: str) -> str:
    """The 32 digits of an address; ``::`` stands for one zero group at least."""
    groups = f"size(regexp_extract_all({w}, '[0-9a-f]+', 0))"
    head, tail = (_v6_digits(f"split_part({w}, '::', {n})") for n in (1, 2))
    return (
        rf"CASE WHEN {w} RLIKE r'^(?:[0-9a-f]{{1,4}}:){{7}}[0-9a-f]{{1,4}}\z' THEN {_v6_digits(w)} "
        rf"WHEN {w} RLIKE r'^{_GROUPS}?::{_GROUPS}?\z' AND {groups} <= 7 "
        f"THEN concat({head}, repeat('0000', 8 - {groups}), {tail}) END"
    )


def _v6_bits(h: str) -> str:
    halves = [f"lpad(conv(substr({h}, {at}, 16), 16, 2), 64, '0')" for at in (1, 17)]
    return f"concat('6', {', '.join(halves)})"


# name -> (parameters, result type, body); order matters, later ones may use earlier ones.
DEFINITIONS: dict[str, tuple[str, str, str]] = {
    "lower_ascii": (
        "s STRING",
        "STRING",
        f"CASE WHEN octet_length(s) = char_length(s) THEN lower(s) "
        f"ELSE translate(s, '{ascii_uppercase}', '{ascii_lowercase}') END",
    ),
    "upper_ascii": (
        "s STRING",
        "STRING",
        f"CASE WHEN octet_length(s) = char_length(s) THEN upper(s) "
        f"ELSE translate(s, '{ascii_lowercase}', '{ascii_uppercase}') END",
    ),
    "byte_size": ("s STRING", "BIGINT", "CAST(octet_length(s) AS BIGINT)"),
    "byte_count": ("s STRING", "BIGINT", "CAST(octet_length(s) AS BIGINT)"),
    "list_size": (f"a {_LIST}", "BIGINT", "CAST(size(a) AS BIGINT)"),
    "map_size": (f"m {_TEXTS}", "BIGINT", "CAST(size(m) AS BIGINT)"),
    "matches": ("s STRING, p STRING", "BOOLEAN", f"s RLIKE {_regex('p')}"),
    "has_text": ("s STRING, x STRING", "BOOLEAN", "contains(s, x)"),
    "has_item": (f"a {_LIST}, x STRING", "BOOLEAN", "array_contains(a, x)"),
    "has_key": (f"m {_TEXTS}, k STRING", "BOOLEAN", "map_contains_key(m, k)"),
    "get_value": (f"m {_TEXTS}, k STRING", "STRING", "m[k]"),
    "get_all": (
        f"m {_TEXTS}, k STRING",
        _LIST,
        "CASE WHEN map_contains_key(m, k) THEN array(m[k]) ELSE CAST(array() AS ARRAY<STRING>) END",
    ),
    "any_value_contains": (
        f"m {_TEXTS}, x STRING",
        "BOOLEAN",
        "exists(map_values(m), v -> coalesce(contains(v, x), false))",
    ),
    "any_key_matches": (
        f"m {_TEXTS}, p STRING",
        "BOOLEAN",
        f"exists(map_keys(m), k -> k RLIKE {_regex('p')})",
    ),
    "any_name_matches": (
        f"m {_TEXTS}, p STRING",
        "BOOLEAN",
        f"exists(map_keys(m), k -> k RLIKE {_regex('p')})",
    ),
    "any_value_matches": (
        f"m {_TEXTS}, p STRING",
        "BOOLEAN",
        f"exists(map_values(m), v -> coalesce(v RLIKE {_regex('p')}, false))",
    ),
    "any_item_matches": (
        f"a {_LIST}, p STRING",
        "BOOLEAN",
        f"exists(a, v -> coalesce(v RLIKE {_regex('p')}, false))",
    ),
    "any_matches": (
        f"m {_TEXTS}, p STRING",
        "BOOLEAN",
        f"exists(map_entries(m), e -> e.key RLIKE {_regex('p')} "
        f"OR coalesce(e.value RLIKE {_regex('p')}, false))",
    ),
    # The same questions to one text or a list; conditions are led here by their receiver.
    "any_value_contains_text": ("s STRING, x STRING", "BOOLEAN", "contains(s, x)"),
    "any_value_contains_list": (
        f"a {_LIST}, x STRING",
        "BOOLEAN",
        "exists(a, v -> coalesce(contains(v, x), false))",
    ),
    "any_value_matches_text": ("s STRING, p STRING", "BOOLEAN", f"s RLIKE {_regex('p')}"),
    "any_value_matches_list": (
        f"a {_LIST}, p STRING",
        "BOOLEAN",
        f"exists(a, v -> coalesce(v RLIKE {_regex('p')}, false))",
    ),
    "any_matches_text": ("s STRING, p STRING", "BOOLEAN", f"s RLIKE {_regex('p')}"),
    "any_matches_list": (
        f"a {_LIST}, p STRING",
        "BOOLEAN",
        f"exists(a, v -> coalesce(v RLIKE {_regex('p')}, false))",
    ),
    "any_entry_matches": (
        f"m {_TEXTS}, kp STRING, vp STRING",
        "BOOLEAN",
        f"exists(map_entries(m), e -> e.key RLIKE {_regex('kp')} "
        f"AND coalesce(e.value RLIKE {_regex('vp')}, false))",
    ),
    "all_entries_match": (
        f"m {_TEXTS}, kp STRING, vp STRING",
        "BOOLEAN",
        f"forall(map_entries(m), e -> e.key RLIKE {_regex('kp')} "
        f"AND coalesce(e.value RLIKE {_regex('vp')}, false))",
    ),
    # '4' or '6' followed by the bits of the address; NULL for anything else.
    "ip_bits": (
        "s STRING",
        "STRING",
        rf"CASE WHEN s RLIKE r'^{_V4}\z' THEN concat('4', "
        + ", ".join(_octet("s", n, 2, 8) for n in (1, 2, 3, 4))
        + ") WHEN contains(s, ':') THEN "
        + _let(_v6_words("s"), "w", _let(_v6_hex("w"), "h", _v6_bits("h")))
        + " END",
    ),
    "cidr_prefix": (
        "c STRING",
        "BIGINT",
        r"CASE WHEN c RLIKE r'^[^/]*/\+?[0-9]+\z' "
        r"AND try_cast(regexp_extract(c, r'/(.*)\z', 1) AS BIGINT) <= 4294967295 "
        r"THEN try_cast(regexp_extract(c, r'/(.*)\z', 1) AS BIGINT) END",
    ),
    "in_cidr": (
        "ip STRING, cidr STRING",
        "BOOLEAN",
        _let(
            "named_struct('ip', ip_bits(ip), 'net', ip_bits(split_part(cidr, '/', 1)), "
            "'prefix', cidr_prefix(cidr))",
            "v",
            "CASE WHEN v.ip IS NULL OR v.net IS NULL OR v.prefix IS NULL THEN NULL "
            "WHEN v.prefix < char_length(v.net) "
            "THEN startswith(v.ip, left(v.net, CAST(v.prefix + 1 AS INT))) "
            "WHEN left(v.ip, 1) <> left(v.net, 1) THEN false END",
        ),
    ),
}


# Places of the pattern arguments of the functions above.
PATTERN_ARGUMENTS = {
    "matches": (1,),
    "any_key_matches": (1,),
    "any_name_matches": (1,),
    "any_value_matches": (1,),
    "any_item_matches": (1,),
    "any_matches": (1,),
    "any_value_matches_text": (1,),
    "any_value_matches_list": (1,),
    "any_matches_text": (1,),
    "any_matches_list": (1,),
    "any_entry_matches": (1, 2),
    "all_entries_match": (1, 2),
}


# Functions that also take a text or a list; and all that take a root or another struct as a map.
WIDE_RECEIVERS = ("any_value_contains", "any_value_matches", "any_matches")
MAP_RECEIVERS = (
    *WIDE_RECEIVERS, "has_key", "get_value", "get_all", "map_size", "any_key_matches", "any_name_matches",
    "any_entry_matches", "all_entries_match",
)


def register_functions(spark: SparkSession) -> None:
    """Make the rule functions known to a session; does nothing if they already are."""
    if spark.catalog.functionExists("any_matches_list"):
        return
    for name, (parameters, result, body) in DEFINITIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}"
        )


def quote(text: str) -> str:
    """SQL string literal that keeps every character."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Nesting of a pattern for many literals; suffixes below are listed side by side.
_DEEPEST = 40


def _escaped(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", text)


def any_of_pattern(literals: Iterable[str]) -> str:
    """One Java pattern that finds any of the literals.

    It is the trie of the literals written as a pattern: common beginnings are looked at once, so the time for
    a text hardly grows with their number. A literal that begins with another one adds nothing.
    """
    kept: list[str] = []
    for literal in sorted(set(literals)):
        if not kept or not literal.startswith(kept[-1]):
            kept.append(literal)

    def node(words: list[str], at: int, depth: int) -> str:
        """The pattern of what follows place ``at`` of words that agree up to there."""
        if len(words) == 1 or depth == _DEEPEST:
            return "|".join(_escaped(word[at:]) for word in words)
        singles, longer = [], []
        for _, group in groupby(words, key=lambda word: word[at]):
            own = list(group)
            if len(own) == 1 and len(own[0]) == at + 1:
                singles.append(_escaped(own[0][at]))
                continue
            stop = at + 1  # as far as all of the group agree
            while len(own) > 1 and own[0][stop] == own[-1][stop]:
                stop += 1
            tail = node(own, stop, depth + 1) if len(own) > 1 else _escaped(own[0][stop:])
            head = _escaped(own[0][at:stop])
            longer.append(f"{head}(?:{tail})" if len(own) > 1 else head + tail)
        if singles:
            longer.insert(0, f"[{''.join(singles)}]")
        return "|".join(longer)

    return node(kept, 0, 0) if kept and kept[0] else ""


def pattern_set_functions(contains: dict[str, list[str]], regex: dict[str, list[str]]) -> list[str]:
    """Statements that define ``contains_any`` and ``matches_any`` for named pattern sets.

    With a literal set name the CASE folds away and only that set's tests remain.
    """

    def choose(sets: dict[str, list[str]], test) -> str:
        if not sets:
            return "CAST(NULL AS BOOLEAN)"
        arms = [
            f"WHEN n = {quote(name)} THEN ({' OR '.join(map(test, patterns)) or 'false'})"
            for name, patterns in sets.items()
        ]
        return f"CASE {' '.join(arms)} END"

    # Literals of a set are one pattern; a set without any is never found.
    tries = {name: [any_of_pattern(literals)] if literals else [] for name, literals in contains.items()}
    bodies = {
        "contains_any": choose(tries, lambda p: f"s RLIKE {quote(p)}"),
        "matches_any": choose(regex, lambda p: f"s RLIKE {quote('(?U)' + p)}"),
    }
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING, n STRING) RETURNS BOOLEAN RETURN {body}"
        for name, body in bodies.items()
    ]


def call(name: str, *args: Column | str) -> Column:
    """Column twin of a rule function: text arguments are literals.

    >>> df.where(call("in_cidr", F.col("Request.Client.Ip"), "10.0.0.0/8"))
    """
    register_functions(SparkSession.active())
    return F.call_function(name, *[F.lit(a) if isinstance(a, str) else a for a in args])


def java_pattern_problem(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern cannot be compiled, or None."""
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?U)" + pattern)
    except Exception as error:  # py4j wraps PatternSyntaxException
        return re.sub(r"\s+", " ", str(getattr(error, "java_exception", error)))
    return None
