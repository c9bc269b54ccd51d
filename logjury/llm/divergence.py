"""Operator 13: how far the sources of a language differ in their words, by run-length columns.

Every language keeps the terms that occur in at least ``SPREAD`` of its documents. Every source of the
language is a column of counts over these terms. The terms are ordered by a hash of their counts over all
sources, so that terms of equal counts stand together, and cut into blocks; within a block they are put in the order of
the counts themselves, and every column is encoded as runs of equal counts. Two sources are compared by intersecting the bounds of their runs: within
a piece both counts are constant, so the difference is taken once and multiplied by the length of
the piece. Sums over pieces and blocks are exact whole numbers.

Scale: words are counted per task in bounded tables (Python), so one row leaves a task per source and term and
not per occurrence, and one shuffle by (language, term) brings the counts together; a frequent term costs its
number of sources. The order is a range sort of the kept terms, a block of ``BLOCK`` terms is a unit of work,
and a block meets the sources of its language by its own key, so a large language is many tasks. The number of
pairs of sources is that of the rows returned; the sources of one language must fit a row.

Defined cases: null text, language and source count as ''; a group without kept terms has count 0
everywhere, which still gives it shares; a language that keeps no term has pairs of value 0 and no terms; a
language with one source has no pairs; repeated rows count as documents of their own; the id and other columns are not
read; an empty table gives an empty table. Texts are taken as UTF-8 and whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logjury.llm.shared import in_batches, ship, stored, table, with_position

SPREAD = 30  # documents of the language a term must be in
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50  # ranks of terms that are reported
BLOCK = 8192  # terms of a block
HELD = 200_000  # terms a task counts before it hands its counts on
CELLS = 1 << 21  # counts of a block laid out at once

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term, by language and source."""
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (times, docs) in tables.items():
            for column, values in zip(
                columns,
                ([lang] * len(times), [source] * len(times), times.keys(), times.values(), (docs[t] for t in times)),
                strict=True,
            ):
                column.extend(values)
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            times, docs = tables.setdefault((lang, source), (Counter(), Counter()))
            own = Counter(_TERM.findall(text.lower()))  # lower() of bytes changes A-Z alone
            held -= len(times)
            times.update(own)
            docs.update(own.keys())
            held += len(times)
            if held >= HELD:
                yield rows()
                tables.clear()
                held = 0
    yield rows()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, term, counts)`` of every kept term: its occurrences by source, sources in order."""
    read = docs.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))],
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
    )
    # Both groupings are by (lang, term) or more, so they need no shuffle of their own.
    counted = in_batches(read, _counted, _COUNTS).repartition("lang", "term")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts")
    )
    return by_term.where(F.col("docs") >= SPREAD).select("lang", "term", "counts")


def source_totals(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, terms, sources)``: the number of kept terms, and every source with its total, in order."""
    groups = docs.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))], F.lit(0).alias("n")
    ).distinct()
    totals = kept.select("lang", F.explode("counts").alias("of")).select("lang", "of.source", "of.n")
    totals = totals.union(groups).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    return sources.join(terms, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), "sources")


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The smoothed share of every count, in billionths. Exact: whole numbers of any size, once per different count."""
    found, place = np.unique(counts, return_inverse=True)
    whole = total + SMOOTHING * terms
    return np.array([1 + SCALE * (c + SMOOTHING) // whole for c in found.tolist()], dtype=np.int64)[place]


def runs(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start, and their values."""
    starts = np.append(0, np.flatnonzero(column[1:] != column[:-1]) + 1)
    return starts, column[starts]


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> int:
    """The sum over all rows of the difference of two columns given as runs."""
    starts = np.union1d(a[0], b[0])
    lengths = np.diff(np.append(starts, rows))
    values = [x[1][np.searchsorted(x[0], starts, side="right") - 1] for x in (a, b)]
    return int((np.abs(values[0] - values[1]) * lengths).sum())


def _compared(terms: pa.Table, header: pa.Table) -> pa.Table:
    """Sums of all pairs of sources over a block of terms, and the foremost terms of every source in it."""
    result: list[list] = [[], [], [], [], []]
    if terms.num_rows and header.num_rows:
        lang, number = header["of"][0].as_py(), header["terms"][0].as_py()
        sources = [(s["source"], s["total"]) for s in header["sources"][0].as_py()]
        names = terms["term"].to_pylist()
        counts = terms["counts"].combine_chunks()
        ends = counts.offsets.to_numpy() - counts.offsets[0].as_py()
        entries = counts.flatten()
        places = {source: k for k, (source, _) in enumerate(sources)}
        column = np.array([places[s] for s in entries.field("source").to_pylist()])
        given = entries.field("n").to_numpy()
        order = sorted(range(len(names)), key=lambda r: list(zip(column[ends[r] : ends[r + 1]], given[ends[r] : ends[r + 1]])))
        whole = sum(total for _, total in sources)
        sums: Counter = Counter()
        step = max(1, CELLS // len(sources))
        best: list[list] = [[] for _ in sources]
        for at in range(0, len(order), step):
            rows = order[at : at + step]
            cells = np.zeros((len(sources), len(rows)), dtype=np.int64)
            for k, r in enumerate(rows):
                cells[column[ends[r] : ends[r + 1]], k] = given[ends[r] : ends[r + 1]]
            usual = shares(cells.sum(axis=0), whole, number)
            encoded = []
            for k, (_, total) in enumerate(sources):
                starts, values = runs(cells[k])
                own = starts, shares(values, total, number)
                encoded.append(own)
                lead = np.repeat(own[1], np.diff(np.append(starts, len(rows)))) - usual
                ahead = np.flatnonzero((cells[k] > 0) & (lead > 0))
                if len(ahead) > TOP:  # all that tie with the last one stay, to be ordered by name
                    ahead = ahead[lead[ahead] >= np.partition(lead[ahead], -TOP)[-TOP]]
                best[k] += [(-int(lead[r]), names[rows[r]].encode(), names[rows[r]]) for r in ahead.tolist()]
            for a in range(len(sources)):
                for b in range(a + 1, len(sources)):
                    sums[a, b] += distance(encoded[a], encoded[b], len(rows))
        found = [("pair", sources[a][0], sources[b][0], v) for (a, b), v in sums.items()]
        for k, own in enumerate(best):
            found += [("term", sources[k][0], name, -value) for value, _, name in sorted(own)[:TOP]]
        for part, source, item, value in found:
            for values, x in zip(result, (lang, source, part, item, value), strict=True):
                values.append(x)
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    arrays = [pa.array(c, k) for c, k in zip(result, kinds, strict=True)]
    return pa.Table.from_arrays(arrays, names=["lang", "source", "part", "item", "value"])


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", block: int = BLOCK
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of sources and the terms that set them apart."""
    kept = stored(term_counts(docs, text, lang, source))
    known = stored(source_totals(docs, kept, lang, source))
    ordered = with_position(kept.withColumn("alike", F.xxhash64("counts")), "lang", "alike", "term")
    blocks = stored(ordered.withColumn("block", F.floor(F.col("_position") / block)).drop("_position", "alike"))
    headers = blocks.select("lang", "block").distinct().join(known, "lang").toDF("of", "at", "terms", "sources")
    ship(docs.sparkSession)
    units = blocks.groupBy("lang", "block").cogroup(headers.groupBy("of", "at"))
    found = stored(units.applyInArrow(_compared, "lang string, source string, part string, item string, value long"))
    one = found.where("part = 'pair'").select("lang", "source", "item", "value")
    names = known.select("lang", F.col("sources.source").alias("names"))
    every = names.select("lang", "names", F.explode("names").alias("source"))
    every = every.select("lang", "source", F.explode(F.array_remove("names", F.col("source"))).alias("item"))
    pairs = one.union(one.select("lang", "item", "source", "value"))
    pairs = pairs.union(every.withColumn("value", F.lit(0).cast("long")))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").select("lang", "source", "item", "value")
    parts = [
        pairs.withColumn("rank", place).withColumn("part", F.lit("pair")),
        terms.withColumn("rank", place).where(F.col("rank") <= TOP).withColumn("part", F.lit("term")),
    ]
    return parts[0].union(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), vocabulary AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counted USING (lang, source) GROUP BY g.lang, g.source
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v)::HUGEINT AS p
  FROM totals t JOIN kept k USING (lang) JOIN vocabulary USING (lang) LEFT JOIN counted c USING (lang, source, term)
), usual AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) //
    ((SELECT sum(total) FROM totals t WHERE t.lang = s.lang) + 5 * any_value(v))::HUGEINT AS q
  FROM shares s JOIN vocabulary USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY a.lang, a.source, b.source
), both_parts AS (
  SELECT lang, source, part, item, coalesce(value, 0) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares JOIN usual USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
