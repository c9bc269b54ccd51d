"""Operator 11: personal data, by fixed formats and by boosted trees over candidate spans.

Base: four kinds (email, ip, card, phone) by the formats of the contract; these spans always stay. Beyond them
generators of high recall propose spans of the same kinds in looser forms: addresses written with `at` and `dot`
or in brackets, network addresses with bracketed points and of the newer kind, cards and telephone numbers with
other separators, without a plus sign, or as part of a longer row of digits. Proposals overlap. Boosted trees, one
set per kind, score each by its format (digits, groups, separators, check digit) and its context (signs around,
words before); a proposal above the threshold of its kind is a span, the best first, and none that overlaps another
span. Trees learn from a bounded sample of documents, without anyone's labels: base spans are right, other proposals are
wrong; base spans are also rewritten in their place to looser forms (right), and to the same forms with a broken
check digit or range (wrong). The threshold of a kind is the lowest score at which the share of right proposals,
smoothed to rise with the score, reaches ``SURE`` on sampled documents that no tree has seen.

Scale: learning reads ``SAMPLE_DOCS`` documents, taken by a hash of the id, of which each gives at most
``SAMPLE_EACH`` proposals, and fits in the driver's Python. Scoring is narrow. Every pattern takes time in proportion to
the text: rows of digits and signs are walked once, and a proposal is at most some hundred signs long.

Defined cases: null text counts as empty and has no span; a text may be of any length; ties go to the earlier, then
to the longer proposal; a kind with too few examples adds no span; documents without an id are searched like all others
but not learned from; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import nsmallest
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logjury.llm.shared import in_batches, of_texts, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 4096
SAMPLE_EACH = 32
SURE = 0.97
ENOUGH = 20  # right proposals a kind needs, both to learn and to set the threshold
AT_ONCE = 8192  # proposals scored at once
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.25, 32

Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


# Base.


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _run_start(text: str, floor: int, stop: int) -> int:
    """Where the signs of a local part that end at ``stop`` begin."""
    while stop > floor and text[stop - 1] in _LOCAL:
        stop -= 1
    return stop


def emails(text: str) -> list[Span]:
    """Around every @: a local part never holds one, so each is looked at once."""
    found, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = _run_start(text, floor, at)
        after = at + 1
        if start < at:
            domain = _DOMAIN.match(text, at + 1)
            if domain:
                found.append((start, domain.end()))
                after = domain.end()
        floor = after
        at = text.find("@", after)
    return found


def _octets(text: str) -> bool:
    parts = (part.lstrip("0") for part in text.split("."))
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the fixed formats, by kind."""
    found: dict[str, list[Span]] = {"email": emails(text) if "@" in text else []}
    plus = "+" in text
    for kind, pattern, holds in (("ip", _IP, _octets), ("card", _CARD, _card), ("phone", _PHONE, _phone)):
        given = kind != "phone" or plus
        found[kind] = [m.span() for m in pattern.finditer(text) if holds(m[0])] if given else []
    return found


def listed(spans: list[tuple[int, int, str]]) -> str:
    """``kind:start:end``, by start, then by kind as listed."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


# Proposals.

_AT = re.compile(r" ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) | ?@ ?")
_DOT = r"(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)"
_LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}")
_POINT = r"(?: ?[\[({] ?(?:dot|\.) ?[\])}] ?| \. | ?dot ?|\.)"
_LOOSE_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")
# A row of groups of digits, with up to three signs between groups.
_DIGITS = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[ ().\-/\xa0]{1,3}")
_LONGEST = 19
_GROUPS = 8  # groups a number is written in


def _rows_of_digits(text: str) -> Iterator[list[Span]]:
    """Rows of neighbouring groups of digits, each group once."""
    row: list[Span] = []
    for match in _DIGITS.finditer(text):
        if row and not (match.start() - row[-1][1] <= 3 and _BETWEEN.fullmatch(text, row[-1][1], match.start())):
            yield row
            row = []
        row.append(match.span())
    if row:
        yield row


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans that may be personal data; they overlap."""
    for match in _AT.finditer(text):
        start = _run_start(text, max(0, match.start() - 64), match.start())
        domain = _LOOSE_DOMAIN.match(text, match.end())
        if domain and start < match.start():
            yield start, domain.end(), "email"
    for match in _LOOSE_IP.finditer(text):
        yield *match.span(), "ip"
    if ":" in text:
        for match in _COLONS.finditer(text):
            yield *match.span(), "ip"
    for row in _rows_of_digits(text):
        if row[-1][1] - row[0][0] < 7:
            continue
        for first, (start, _) in enumerate(row):
            total = 0
            before = text[start - 1] if start else ""
            for begin, end in row[first : first + _GROUPS]:
                total += end - begin
                if total > _LONGEST:
                    break
                if total >= 12:
                    yield start, end, "card"
                if 7 <= total <= 15:
                    yield start - (before in ("+", "(")), end, "phone"


# Features. Words that tell the kind of what follows them, and words before other numbers (fixed values).
_CUES = (
    ("mail", "contact", "write to", "address"),
    ("tel", "phone", "call", "fax", "mobil", "sms"),
    ("card", "visa", "master", "credit", "karte", "carte", "tarjeta"),
    ("ip", "host", "server", "from", "client", "addr"),
    ("id", "order", "no.", "ref", "version", "invoice", "serial", "token", "isbn"),
)
_SIGNS = " .-/([@:+\xa0"
FEATURES = 18 + len(_SIGNS) + len(_CUES)


def _class(sign: str) -> int:
    return 0 if not sign or sign.isspace() else 1 if sign.isalpha() else 2 if sign.isdigit() else 3


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    """Format and context of a proposal as numbers."""
    start, end, _ = span
    part = text[start:end]
    groups = [len(g) for g in _DIGITS.findall(part)]
    digits = _NOT_DIGIT.sub("", part)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 4]
    words = part.lower().split()
    tail = re.split(r"[^A-Za-z]+", part)[-1]
    return [
        len(part),
        len(digits),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(all(len(g) <= 3 and int(g) <= 255 for g in _DIGITS.findall(part))),
        len(set(digits)),
        float(digits[:1] or -1),
        len(tail),
        float("at" in words) + float("dot" in words),
        _class(text[start - 1 : start]),
        _class(after[:1]),
        sum(c.isdigit() for c in before[-4:]),
        sum(c.isdigit() for c in after),
        float("::" in part),
        *(float(part.count(sign)) for sign in _SIGNS),
        *(float(any(cue in before for cue in cues)) for cues in _CUES),
    ]


# Examples.


def _draw(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def _looser(kind: str, part: str, draw: int, right: bool) -> str:
    """A base span in a looser form; ``right`` false breaks what makes it one."""
    if kind == "email":
        local, _, domain = part.partition("@")
        at, dot = ((" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)"), (" @ ", "."))[draw % 4]
        labels = domain.split(".")
        if not right:  # prose has no such end
            return f"{local} at {labels[0]}.{labels[0]}9 "
        return local + at + dot.join(labels)
    if kind == "ip":
        parts = part.split(".")
        if not right:
            parts[draw // 7 % 4] = str(256 + draw // 31 % 700)
        return ("[.]", "(.)", " . ", "[dot]")[draw % 4].join(parts)
    digits = _NOT_DIGIT.sub("", part)
    if kind == "card":
        if not right:
            digits = digits[:-1] + str((int(digits[-1]) + 1 + draw // 7 % 9) % 10)
        sign = (".", "/", "  ", "\xa0")[draw % 4]
        return sign.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    number = digits[-10:]
    if not right:
        return (f"{number[:4]}-{number[4:6]}-{number[6:8]}", f"{number[:2]}/{number[2:4]}/{number[4:8]}", number)[draw % 3]
    area, mid, line = number[:-7], number[-7:-4], number[-4:]
    forms = (f"({area}) {mid}-{line}", f"{area}-{mid}-{line}", f"{area}.{mid}.{line}", f"00{digits[:-10]} {area} {mid} {line}")
    return forms[draw % 4]


def rewritten(text: str, base: dict[str, list[Span]], right: bool, seed) -> tuple[str, set[tuple[int, int, str]]]:
    """The text with base spans in looser forms, and where those are."""
    spans = sorted((start, end, kind) for kind in KINDS for start, end in base[kind])
    parts, made, at, length = [], set(), 0, 0
    for start, end, kind in spans:
        if start < at:
            continue
        new = _looser(kind, text[start:end], _draw(seed, start), right)
        parts += [text[at:start], new]
        length += start - at
        made.add((length, length + len(new.rstrip()), kind))
        length += len(new)
        at = end
    return "".join([*parts, text[at:]]), made


def examples(text: str, seed) -> Iterator[tuple[str, bool, list[float]]]:
    """``(kind, right, features)`` of proposals in a text and in its two rewritten forms."""
    base = base_spans(text)
    right = {(*span, kind) for kind in KINDS for span in base[kind]}
    yield from _examples(text, right, seed)
    if right:
        for form in (True, False):
            other, made = rewritten(text, base, form, seed)
            yield from _examples(other, made if form else set(), seed, made)


def _examples(text: str, right: set, seed, near: set | None = None) -> Iterator[tuple[str, bool, list[float]]]:
    """All right proposals and others by a hash, up to the bound; of rewritten forms only those that touch one."""
    found = proposals(text)
    if near is not None:
        found = _touching(found, [(start, end) for start, end, _ in near])
    for p in nsmallest(SAMPLE_EACH, found, key=lambda p: (p not in right, _draw(seed, *p))):
        yield p[2], p in right, features(text, p)


def _touching(found: Iterable[tuple[int, int, str]], spans: list[Span]) -> Iterator[tuple[int, int, str]]:
    """The proposals that overlap a span."""
    spans = sorted(spans)
    starts = [start for start, _ in spans]
    ends = list(accumulate((end for _, end in spans), max))
    for p in found:
        before = bisect_left(starts, p[1]) - 1
        if before >= 0 and ends[before] > p[0]:
            yield p


# Boosted trees.


class Trees:
    """Trees of equal depth; a tree tests one feature per inner node."""

    def __init__(self, tests: np.ndarray, bounds: np.ndarray, leaves: np.ndarray, start: float):
        self.tests, self.bounds, self.leaves, self.start = tests, bounds, leaves, start

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for tests, bounds, leaves in zip(self.tests, self.bounds, self.leaves, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[np.arange(len(rows)), tests[node]] > bounds[node])
            total += leaves[node - (2**DEPTH - 1)]
        return total


def boost(rows: np.ndarray, right: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss on features in at most ``BINS`` steps."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1], method="lower")) for column in rows.T]
    bins = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, rows.T, strict=True)])
    share = right.mean()
    start = float(np.log(share / (1 - share)))
    score = np.full(len(rows), start)
    inner = 2**DEPTH - 1
    tests = np.zeros((ROUNDS, inner), dtype=np.int64)
    bounds = np.full((ROUNDS, inner), np.inf)
    leaves = np.zeros((ROUNDS, inner + 1))
    for k in range(ROUNDS):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = right - chance, chance * (1 - chance)
        node = np.zeros(len(rows), dtype=np.int64)
        for parent in range(inner):
            own = np.flatnonzero(node == parent)
            best, at = 1e-6, None
            whole, weight = slope[own].sum(), bend[own].sum() + 1
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                left = np.bincount(bins[f, own], slope[own], len(c) + 1).cumsum()[:-1]
                mass = np.bincount(bins[f, own], bend[own], len(c) + 1).cumsum()[:-1]
                gain = left**2 / (mass + 1) + (whole - left) ** 2 / (weight - mass) - whole**2 / weight
                if gain.max() > best:
                    best, at = gain.max(), (f, int(gain.argmax()))
            if at is not None:
                tests[k, parent], bounds[k, parent] = at[0], cuts[at[0]][at[1]]
            node[own] = 2 * parent + 1 + (rows[own, tests[k, parent]] > bounds[k, parent])
        leaf = node - inner
        leaves[k] = RATE * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + 1)
        score += leaves[k][leaf]
    return Trees(tests, bounds, leaves, start)


def threshold(scores: np.ndarray, right: np.ndarray) -> float:
    """The lowest score whose share of right ones, made to rise with the score, is ``SURE``; else none."""
    if right.sum() < ENOUGH:
        return np.inf
    values, place = np.unique(scores, return_inverse=True)
    hits, sizes = np.bincount(place, right), np.bincount(place)
    pools: list[list[float]] = []  # value, hits, size
    for value, hit, size in zip(values, hits, sizes, strict=True):
        pools.append([value, hit, size])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, hit, size = pools.pop()
            pools[-1][1] += hit
            pools[-1][2] += size
    sure = [value for value, hit, size in pools if hit >= SURE * size]
    return float(sure[0]) if sure else np.inf


Model = dict[str, tuple[Trees, float]]


def learn(kinds: np.ndarray, right: np.ndarray, tested: np.ndarray, rows: np.ndarray) -> Model:
    """Trees and threshold of every kind with enough examples; ``tested`` rows set the thresholds."""
    model = {}
    for kind in KINDS:
        own = kinds == kind
        train, test = own & ~tested, own & tested
        if right[train].sum() < ENOUGH or not (~right[train]).any():
            continue
        trees = boost(rows[train], right[train].astype(np.float64))
        at = threshold(trees.score(rows[test]), right[test].astype(np.float64))
        if np.isfinite(at):
            model[kind] = trees, at
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_DOCS) -> Model:
    """Learn from about ``limit`` documents by a hash of the id, the same on every run."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    place = F.xxhash64(F.lit(11), F.col("id")).bitwiseAND(F.lit((1 << 53) - 1))
    share = min(1.0, limit / max(1, docs.where(F.col(doc_id).isNotNull()).count()))
    # Ids with very many rows are one document here.
    taken = rows.where(place < F.lit(int(share * (1 << 53)))).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (kind, right, _draw("fold", key) % 3 == 0, values)
                for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for kind, right, values in examples(content, key)
            ]
            columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.float32()))
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "right", "tested", "values"])

    made = in_batches(taken, run, "kind string, right boolean, tested boolean, values array<float>").toArrow()
    values = made["values"].combine_chunks().flatten().to_numpy() if made.num_rows else np.zeros(0)
    rows = values.astype(np.float64).reshape(-1, FEATURES)
    columns = [np.array(made[name].to_pylist(), dtype=kind) for name, kind in (("kind", str), ("right", bool), ("tested", bool))]
    order = np.lexsort([*rows.T, columns[2], columns[1], columns[0]])  # the same sums whatever the order of rows
    return learn(*(column[order] for column in columns), rows[order])


def added(text: str, base: dict[str, list[Span]], model: Model) -> list[tuple[int, int, str]]:
    """Proposals above the threshold, the best first, that overlap neither each other nor a base span."""
    taken = [span for spans in base.values() for span in spans]
    found = (p for p in proposals(text) if p[2] in model)
    scored = []
    while part := list(islice(found, AT_ONCE)):
        touching = set(_touching(part, taken)) if taken else ()
        for kind, (trees, at) in model.items():
            own = [p for p in part if p[2] == kind and p not in touching]
            if own:
                scores = trees.score(np.array([features(text, p) for p in own], dtype=np.float32).astype(np.float64))
                hits = [(at - s, p[0], p[0] - p[1], p) for s, p in zip(scores.tolist(), own, strict=True) if s >= at]
                scored += hits
    chosen: list[tuple[int, int, str]] = []
    # Proposals are short, so a span overlaps one only if it is in the same or a neighbouring cell of the text.
    cells: dict[int, list[Span]] = {}
    for *_, p in sorted(scored):
        reach = range(p[0] // 64 - 1, p[1] // 64 + 2)
        if all(b <= p[0] or p[1] <= a for cell in reach for a, b in cells.get(cell, ())):
            chosen.append(p)
            for cell in range(p[0] // 64, p[1] // 64 + 1):
                cells.setdefault(cell, []).append(p[:2])
    return chosen


COLUMNS = {
    **{f"n_{kind}": LongType() for kind in KINDS},
    "base_sha256": StringType(),
    "spans": StringType(),
}


def find(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the number of base spans of each kind, their digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list[pa.Array]:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, spans = [], []
        for content in texts:
            content = content or ""
            base = base_spans(content)
            for k, kind in enumerate(KINDS):
                counts[k].append(len(base[kind]))
            own = [(*span, kind) for kind in KINDS for span in base[kind]]
            digests.append(hashlib.sha256(listed(own).encode()).hexdigest())
            spans.append(listed(own + added(content, base, shared.value)))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]

    return of_texts(docs, keep, text, COLUMNS, run)


def redact(docs: DataFrame, spans: str = "spans", text: str = "text", name: str = "redacted") -> DataFrame:
    """Adds the text with every span replaced by its kind in brackets, of overlapping ones the first."""

    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                None if content is None else redacted(content, listing or "")
                for content, listing in zip(batch[text].to_pylist(), batch[spans].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=names)

    return in_batches(docs, run, StructType([*docs.schema.fields, StructField(name, StringType())]))


def redacted(text: str, listing: str) -> str:
    parts, at = [], 0
    for entry in filter(None, listing.split(",")):
        kind, start, end = entry.split(":")
        if int(start) >= at:
            parts += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*parts, text[at:]])


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs), ["doc_id"])
