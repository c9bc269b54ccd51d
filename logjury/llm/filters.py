"""Operator 12: what filters do in any order, counted on sorted posting lists.

Every document has five filters it may fail. Rows get places in the order of part and id; every part keeps,
per filter and range of ``RANGE`` places, the sorted list of the places that fail it, and such lists of the
documents labelled good and toxic. What a filter removes behind a set of others is the difference of its
list and the union of theirs; unions are built filter by filter by galloping merges, so of two lists the shorter
one is looked up in the longer one, each look-up starting from the last. Sizes of the
differences of a range are summed over ranges, for each of the 16 sets of others of each filter; every order of the
filters is then read off these sums, as what a step removes depends on the set before it and not on its order.

Scale: texts are read once and become flags and a digest. Copies are found by digest: the smallest id per digest is
agreed in two steps over ``SALTS`` salts, so that a text which a third of all rows share is many tasks. A range of a
part is a unit of work of at most ``RANGE`` rows; a large part is many units. Results have 600 rows per part.

Defined cases: null text counts as empty, a null language as part ''; an empty text fails A alone (and E); documents
with a null id neither fail E nor make others fail it, and have no labels; rows with the same id do not make each other
fail E but count each; of repeated labels any 1 counts; other columns are not read; an empty table gives an empty
table. Texts with equal SHA-256 digests and lengths count as identical.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logjury.llm.shared import in_batches, stored, table, with_position

FILTERS = "ABCDE"
RANGE = 1 << 16  # places of a posting list
SALTS = 64
_SPACE = r"[\x20\x09-\x0D]+"
_SUMS = "part string, before int, filter string, docs long, gone long, failing long, removed long, good long, toxic long"


def failures(text: Column) -> dict[str, Column]:
    """The filters a text fails by itself, all but E."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * different < F.lit(80) * n,
        "C": F.lit(100) * capitals > F.lit(10) * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeats(marked: DataFrame) -> DataFrame:
    """Adds ``E``: another row of the same digest has a smaller ``id``."""
    salted = marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("id"), F.lit(SALTS)), F.lit(0)).cast("int"))
    part = salted.groupBy("digest", "_salt").agg(F.min("id").alias("least"))
    whole = part.groupBy("digest").agg(F.min("least").alias("_least"), F.collect_list("_salt").alias("_salts"))
    firsts = whole.select("digest", "_least", F.explode("_salts").alias("_salt"))
    joined = salted.join(firsts, ["digest", "_salt"])
    return joined.withColumn("E", F.coalesce(F.col("id") > F.col("_least"), F.lit(False))).drop("_salt", "_least", "digest")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``. Rows without an id are dealt by their place, as they find no label."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    nameless = rows.where(F.col("id").isNull()).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    named = rows.where(F.col("id").isNotNull()).join(known, "id", "left")
    named = named.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return named.unionByName(nameless)


def postings(rows: DataFrame, width: int = RANGE) -> DataFrame:
    """``(part, docs, A, ..., E, good, toxic)``: lists of places, one row per part and range of places."""
    placed = with_position(rows, "part", "id").withColumn("_range", F.floor(F.col("_position") / width))
    lists = [F.collect_list(F.when(F.col(c), F.col("_position"))).alias(c) for c in (*FILTERS, "good", "toxic")]
    return placed.groupBy("part", "_range").agg(F.count("*").alias("docs"), *lists).drop("_range")


def found_in(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which of the shorter sorted list are in the longer one."""
    if not len(long):
        return np.zeros(len(short), dtype=bool)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)  # begins at the place of the key before
    return long[at] == short


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What of the sorted list ``a`` is not in ``b``."""
    if len(a) <= len(b):
        return a[~found_in(a, b)]
    at = np.searchsorted(a, b)
    same = at < len(a)
    same[same] = a[at[same]] == b[same]
    return np.delete(a, at[same])


def merged(*lists: np.ndarray) -> np.ndarray:
    """The union of sorted lists: what the shorter ones add is put in its place in the longest."""
    longest, *others = sorted(lists, key=len, reverse=True)
    for other in others:
        new = minus(other, longest)
        longest = np.insert(longest, np.searchsorted(longest, new), new)
    return longest


def shared_size(a: np.ndarray, b: np.ndarray) -> int:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return int(found_in(short, long).sum())


def removals(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[int, ...]]:
    """``(before, filter, gone, failing, removed, good, toxic)`` for every set of filters and one behind it."""
    unions = {0: np.zeros(0, dtype=np.int64)}
    for before in range(1 << len(lists)):
        for k, own in enumerate(lists):
            if before >> k & 1:
                continue
            new = minus(own, unions[before])
            if before | 1 << k not in unions:
                unions[before | 1 << k] = merged(unions[before], new)
            yield before, k, len(unions[before]), len(own), len(new), shared_size(new, good), shared_size(new, toxic)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, docs = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            lists = [np.sort(batch.column(2 + k)[row].values.to_numpy()) for k in range(7)]
            found = np.array(list(removals(lists[:5], *lists[5:])), dtype=np.int64)
            arrays = [
                pa.array([part] * len(found), pa.string()),
                pa.array(found[:, 0].astype(np.int32)),
                pa.array([FILTERS[k] for k in found[:, 1]], pa.string()),
                pa.array([docs] * len(found), pa.int64()),
                *(pa.array(found[:, k]) for k in range(2, 7)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[field.split()[0] for field in _SUMS.split(", ")])


def orders(spark: SparkSession) -> DataFrame:
    """``(filter_order, step, filter, before)`` of all orders: 600 rows, whatever the data."""
    rows = [
        ("".join(order), step + 1, name, sum(1 << FILTERS.index(x) for x in order[:step]))
        for order in permutations(FILTERS)
        for step, name in enumerate(order)
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int")


def flags(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``(id, part, digest, A, B, C, D)`` of every row."""
    read = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    digest = F.concat(F.unhex(F.sha2("_text", 256)), F.unhex(F.lpad(F.hex(F.octet_length("_text").cast("long")), 16, "0")))
    return read.select("id", "part", digest.alias("digest"), *[c.alias(n) for n, c in failures(F.col("_text")).items()])


def audit(docs: DataFrame, labels: DataFrame, width: int = RANGE, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step."""
    marked = stored(flags(docs, **columns))
    lists = postings(labelled(repeats(marked), labels), width)
    sums = in_batches(lists, _sums, _SUMS).groupBy("part", "before", "filter")
    sums = stored(sums.agg(*[F.sum(c).alias(c) for c in ("docs", "gone", "failing", "removed", "good", "toxic")]))
    steps = sums.join(F.broadcast(orders(docs.sparkSession)), ["before", "filter"])
    own = Window.partitionBy("part", "filter")
    alone = F.bit_count("before") == len(FILTERS) - 1
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("docs") - F.col("gone") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        F.max(F.when(alone, F.col("removed"))).over(own).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("removed").over(own).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE rows_of AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS least FROM rows_of GROUP BY text
), marks AS (
  SELECT part, [len(words) < 100, 100 * list_unique(words) < 80 * len(words),
      100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM rows_of JOIN firsts USING (text)
), patterns AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM marks GROUP BY part, fails
), orders(filter_order) AS (
  SELECT ''
  UNION ALL
  SELECT filter_order || c FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(c)
  WHERE length(filter_order) < 5 AND NOT contains(filter_order, c)
), steps AS (
  SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS f,
    list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS before
  FROM orders, range(1, 6) AS r(step) WHERE length(filter_order) = 5
), told AS (
  SELECT part, filter_order, step::INTEGER AS step, f,
    sum(n) FILTER (NOT gone AND NOT fails[f]) AS kept, sum(n) FILTER (NOT gone AND fails[f]) AS removed,
    sum(n) FILTER (gone AND fails[f]) AS redundant,
    sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(n_good) FILTER (NOT gone AND fails[f]) AS good_lost, sum(n_toxic) FILTER (NOT gone AND fails[f]) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda b: fails[b])) > 0 AS gone FROM patterns, steps)
  GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
