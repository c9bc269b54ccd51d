"""Operator 8: language identification by cross-parsing against suffix automata.

Of every language a bounded sample of labelled text is put into a suffix automaton, which knows all
its substrings. A text is parsed from left to right into the longest phrases found in the sample;
where the automaton cannot go on, a new phrase begins at its root. A phrase costs about the
logarithm of the sample's length, so phrases times that logarithm, divided by the length of the
text, estimates the cross entropy; the language that needs fewest normalised phrases wins (Ziv and
Merhav, 1993). A text is parsed in segments of ``SEGMENT`` letters; each goes to the language that
wins it, and the text to the language that wins most letters, so a quoted passage in another
language, whose letters cost very much in the language of the rest, does not decide it.

Text is seen as letters in lower case, every run of other signs as one space; every letter of any
sample is a class of its own. The steps of all states lie in one row, displaced so that none meet,
and each holds the state it belongs to; a step that is not there leads on from the root as a new
phrase. So two look-ups per letter parse a text, the number of classes costs next to nothing, and all
segments of a batch of texts are parsed in step with numpy. Every segment begins a phrase; all of a
text is parsed.

Learned is every language with labelled text, each from about ``SAMPLE_DOCS`` documents of the
learning fold, taken by a hash of the id, and up to ``SAMPLE_CHARS`` letters of them.
Language, source and id are no inputs of a prediction.

Scale: prediction is narrow, and its work grows with the number of languages. Automata are built in
one task per language and have at most 3 * ``SAMPLE_CHARS`` steps, some 2 MB, whatever the data.

Defined cases: null texts and texts without a letter are ``und`` with score 0; letters that are in
no sample count as one class that no automaton has; null languages teach nothing; without any labelled
text every prediction is ``und``; ties go to the first language in order; repeated rows get equal
predictions; an empty table gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from logjury.llm.shared import in_batches, in_learning_fold, of_texts, stored, table

SAMPLE_DOCS = 64
SAMPLE_CHARS = 30_000
SEGMENT = 256
# Letters parsed in step at once: a few tens of bytes of memory each.
LETTERS = 1 << 21
# Segments times languages at once: some fifty bytes of memory each.
CELLS = 1 << 21
UNKNOWN = "und"


def normalise(text: str) -> str:
    """Lower case letters; every run of other signs is one space; none at the ends."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@lru_cache(maxsize=2)
def code_table(letters: str) -> np.ndarray:
    """Class of every code point: 0 space, 1 a letter of no sample, then the letters in order."""
    known = {c: k + 2 for k, c in enumerate(letters)}
    codes = np.zeros(0x110000, dtype=np.min_scalar_type(len(letters) + 1))
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            codes[point] = known.get(low, 1) if len(low) == 1 else known.get(low[0], 1)
    return codes


def encode(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all texts in one row, one space between words, and the bounds of the texts."""
    points = np.frombuffer(" ".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    found = codes[points]
    letters = np.flatnonzero(found)
    cuts = np.searchsorted(letters, begins)
    apart = np.zeros(len(letters), dtype=np.int64)
    apart[1:] = np.diff(letters) > 1
    apart[cuts[:-1][cuts[:-1] < len(letters)]] = 0  # no space before the first letter of a text
    places = np.cumsum(apart + 1) - 1
    row = np.zeros(len(letters) + int(apart.sum()), dtype=codes.dtype)
    row[places] = found[letters]
    return row, np.append(0, places + 1)[cuts]


def automaton(sample: np.ndarray, classes: int) -> np.ndarray:
    """Suffix automaton of a row of classes as one row of steps.

    A state is a place, and its step by a class is that many entries on. An entry holds the state it
    belongs to in its upper half, or is -1, and in its lower half twice the next state, plus 1 if the
    step begins a new phrase. State 0 is the root, which has a step for every class.
    """
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sample.tolist():
        state = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    place = _places(step, classes)
    row = np.full(int(place.max()) + classes, -1, dtype=np.int64)
    row[:classes] = 1  # a class the sample lacks: a phrase of its own
    for c, q in step[0].items():  # at the root no phrase is open, so any step begins one
        row[c] = 2 * place[q] + 1
    at = np.repeat(place[1:], [len(s) for s in step[1:]])
    to = place[[q for s in step[1:] for q in s.values()]]
    row[at + np.array([c for s in step[1:] for c in s], dtype=np.int64)] = (at << 32) | (2 * to)
    return row


def _places(step: list[dict[int, int]], classes: int) -> np.ndarray:
    """A place for every state, such that the steps of no two states meet."""
    place = np.zeros(len(step), dtype=np.int64)
    # Three of four entries stay empty, so a few places tried at random are enough.
    draw = random.Random(0)
    wide = classes + 4 * sum(map(len, step))
    used: set[int] = set(range(classes))  # the root's
    taken = {0}
    none = []
    for state in sorted(range(1, len(step)), key=lambda s: -len(step[s])):
        own = step[state]
        if not own:
            none.append(state)
            continue
        tries = 0
        at = int(draw.random() * wide) + 1
        while at in taken or any(at + c in used for c in own):
            at = int(draw.random() * wide) + 1
            tries += 1
            if tries % 256 == 0:
                wide *= 2
        taken.add(at)
        place[state] = at
        used.update([at + c for c in own])
    # States without a step need no place of their own, only one that no entry names.
    place[none] = max(taken) + classes
    return place


class Model:
    """Automata of all languages in one table; small enough to hand to every task."""

    def __init__(self, letters: str, languages: list[str], tables: list[np.ndarray], sizes: list[int]):
        self.letters, self.languages = letters, languages
        self.roots = np.cumsum([0] + [len(t) for t in tables])[:-1]
        # The states of each language are moved on by those before it.
        moved = [np.where(t < 0, -1, t + (root << 32) + 2 * root) for t, root in zip(tables, self.roots, strict=True)]
        self.steps = np.concatenate(moved) if moved else np.zeros(0, np.int64)
        self.bits = np.log2(np.maximum(2, np.array(sizes, dtype=np.float64)))

    def phrases(self, found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every segment its text, its letters, and its phrases in every language."""
        lengths = np.diff(starts)
        parts = -(-lengths // SEGMENT)
        of = np.repeat(np.arange(len(lengths)), parts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = starts[of] + number * SEGMENT
        size = np.minimum(lengths[of] - number * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        place = np.tile(self.roots, (len(of), 1))
        count = np.zeros((len(of), len(self.languages)), dtype=np.int32)
        steps = int(size[0]) if len(size) else 0
        # How many segments are still being parsed at each step; the longest come first.
        active = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
        found = found.astype(np.int64)
        for t, m in enumerate(active.tolist()):
            letter = found[begin[:m] + t][:, None]
            entry = self.steps.take(place[:m] + letter)
            fails = np.nonzero(entry >> 32 != place[:m])
            entry[fails] = self.steps.take(self.roots[fails[1]] + letter[fails[0], 0])
            entry &= 0xFFFFFFFF
            count[:m] += entry & 1
            place[:m] = entry >> 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return of, size[back], count[back]

    def votes(self, found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner and score of every text that has letters."""
        of, size, count = self.phrases(found, starts)
        cost = count * self.bits
        best = cost.argmin(axis=1)
        lead = np.ones(len(of))
        if len(self.languages) > 1:
            two = np.partition(cost, 1, axis=1)
            lead = 1 - two[:, 0] / two[:, 1]
        won = np.zeros((len(starts) - 1, len(self.languages)))
        sure = np.zeros_like(won)
        np.add.at(won, (of, best), size)
        np.add.at(sure, (of, best), size * lead)
        winner = won.argmax(axis=1)
        letters = np.maximum(1, np.diff(starts))
        return winner, sure[np.arange(len(winner)), winner] / letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of every text.

        The score is the winner's lead over the next language, averaged over the letters of the text;
        segments that another language wins count as no lead.
        """
        names, scores = [], np.zeros(len(texts))
        codes = code_table(self.letters)
        at = 0
        while at < len(texts):
            stop, total, parts = at, 0, 0
            most = CELLS // max(1, len(self.languages))
            while stop < len(texts):
                more = -(-len(texts[stop]) // SEGMENT)
                if stop > at and (total + len(texts[stop]) >= LETTERS or parts + more > most):
                    break
                total, parts = total + len(texts[stop]), parts + more
                stop += 1
            found, starts = encode(texts[at:stop], codes)
            lettered = np.diff(starts) > 0
            if self.languages:
                best, scores[at:stop] = self.votes(found, starts)
                names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            else:
                names += [UNKNOWN] * (stop - at)
            at = stop
        return names, scores


def sample(docs: DataFrame, doc_id: str, text: str, lang: str, limit: int) -> DataFrame:
    """``(lang, order, text)``: about ``limit`` documents of each language, by a hash of the id.

    The share to take is known from counts of narrow columns, so no language meets in one task.
    """
    rows = docs.where(F.col(lang).isNotNull() & in_learning_fold(F.col(doc_id)) & F.col(text).isNotNull())
    order = F.xxhash64(F.lit(8), F.col(doc_id)).bitwiseAND(F.lit((1 << 53) - 1))
    counts = rows.groupBy(F.col(lang).alias("of")).agg(F.count("*").alias("rows"))
    # Written, as Catalyst broadcasts a table whose size it knows to be small: no text is dealt by its language.
    shares = stored(counts.select("of", (F.lit(limit) / F.col("rows")).alias("share")))
    picked = rows.select(F.col(lang).alias("lang"), order.alias("order"), F.col(text).alias("text"))
    joined = picked.join(shares, F.col("lang") == F.col("of"))
    return joined.where(F.col("order") < F.col("share") * float(1 << 53)).select("lang", "order", "text").distinct()


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {c.lower()[0] for text in batch.column(0).to_pylist() for c in set(text) if c.isalpha()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["letter"])


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    limit: int = SAMPLE_DOCS,
    chars: int = SAMPLE_CHARS,
) -> Model:
    """Automata built in one task per language from the bounded sample."""
    taken = stored(sample(docs, doc_id, text, lang, limit))
    # At most as many rows as there are letters.
    found = in_batches(taken.select("text"), _letters, "letter string").distinct().collect()
    letters = "".join(sorted(row["letter"] for row in found))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        codes = code_table(letters)
        kept, total = [], 0
        for own in rows.sort_values(["order", "text"])["text"]:
            if total < chars:
                found, _ = encode([own], codes)
                kept += [found[: chars - total], np.zeros(1, found.dtype)]
                total += len(found) + 1
        found = np.concatenate(kept)
        made = automaton(found, len(letters) + 2)
        return pd.DataFrame(
            {"lang": [rows["lang"].iloc[0]], "size": [len(found)], "steps": [made.astype("<i8").tobytes()]}
        )

    built = taken.groupBy("lang").applyInPandas(build, "lang string, size long, steps binary").collect()
    built.sort(key=lambda row: row["lang"])
    tables = [np.frombuffer(row["steps"], dtype="<i8") for row in built]
    return Model(letters, [row["lang"] for row in built], tables, [row["size"] for row in built])


def predict(
    docs: DataFrame,
    model: Model,
    keep: list[str],
    text: str = "text",
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep``, the language and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> list[pa.Array]:
        languages, scores = shared.value.predict([t or "" for t in texts])
        return [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]

    return of_texts(docs, keep, text, dict(zip(names, (StringType(), DoubleType()), strict=True)), run)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs), ["doc_id"]).select(
        "doc_id", (~in_learning_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score"
    )
