"""Operator 10: quality rules over whole texts, as built-in column expressions only.

Base rules count words, symbols, repeated lines and words in repeated windows of eight words. The
learned rule is a log-likelihood ratio of hashed token n-grams (n = 1, 2) between a multinomial of
trusted documents and one of the raw corpus, divided by the number of n-grams; a document below a
fixed threshold is not kept. Nothing is drawn at random.

* Tokens are runs of letters, of digits, and of other signs; an n-gram of two equal tokens is one
  n-gram of its own, so words said again and again count as such whatever the word is.
* The raw corpus counts cover every document, the trusted multinomial every labelled document of
  quality 1 that is not toxic; both are counted in one pass.
* Both are counts in buckets, smoothed by adding ``SMOOTH`` per bucket. Buckets grow with the corpus by one
  rule: the power of two next above ``PER_ROOT`` times the square root of the number of documents.

Scale: texts are read twice; the shuffles hold one row per bucket and task. The trusted ids are written as one bit
each, 64 neighbouring ids in a row, and join without a hint: Catalyst broadcasts them below its threshold (at 16
bytes a row, 10 MB hold 40 million ids without gaps) and deals documents by id beyond it, with the same result. Ids far
apart, or other than whole numbers, take a row each and reach the threshold at some hundred thousand. Of
all windows of a text only the repeated ones are looked at in detail. The table of ratios is a constant of the
plan, with half a million numbers at 15 million documents.

Defined cases: a null text has no words and fails the base rules; empty texts likewise; without any
trusted document all ratios are 0 and only the base rules decide; repeated rows are counted and
judged one by one; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from logjury.llm.shared import WORD, stored, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
WINDOW = 8
MIN_WORDS = 20
BUCKETS = 1 << 13
PER_ROOT = 80
TRUSTED = 4096
TRUSTED_PER_ROOT = 40
SMOOTH = 0.5
THRESHOLD = -0.25


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _pairs(items: Column, distance: int) -> Column:
    """Hashes of items that lie ``distance`` apart."""
    count = F.size(items) - distance
    return F.when(
        count > 0,
        F.zip_with(
            F.slice(items, F.lit(1), count), F.slice(items, F.lit(distance + 1), count), lambda a, b: F.xxhash64(a, b)
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that are found twice or more, the first included.

    Window hashes are built by doubling. Only if two are equal are they sorted with their places;
    places whose neighbour in that order has the same hash are the repeated ones, and between one
    place and the next at most ``window`` words are covered.
    """

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column, i: Column, other: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == F.get(s, other)["h"], F.lit(False))

        places = let(
            placed,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda x: x["i"].cast("long")
                )
            ),
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(
                    p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(window)), F.lit(window).cast("long"))
                ),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def of_windows(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    steps = let(let(let(hashed, lambda h: _pairs(h, 1)), lambda h: _pairs(h, 2)), lambda h: _pairs(h, 4))
    return F.when(F.size(words) > window, let(steps, of_windows)).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def ngrams(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the token unigrams and bigrams of a text, repeats included."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    def both(h: Column) -> Column:
        count = F.size(h) - 1
        pairs = F.when(
            count > 0,
            F.zip_with(
                F.slice(h, F.lit(1), count),
                F.slice(h, F.lit(2), count),
                lambda a, b: F.when(a == b, F.lit(2).cast("long")).otherwise(F.xxhash64(a, b)),
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))

    return let(tokens, both)


def bucket_counts(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """``(bucket, n)``; counted in the tasks before the shuffle."""
    return docs.select(F.explode(ngrams(F.coalesce(F.col(text), F.lit("")), buckets)).alias("bucket")).groupBy("bucket").count()


def buckets_for(documents: int) -> int:
    return 1 << max(10, math.ceil(math.log2(PER_ROOT * math.sqrt(max(1, documents)))))


def ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS, smooth: float = SMOOTH) -> DataFrame:
    """One row with ``ratios``: the log ratio of every bucket, in order."""
    raw = bucket_counts(docs, text, buckets).select("bucket", F.col("count").alias("raw"), F.lit(0).cast("long").alias("good"))
    good = bucket_counts(trusted, text, buckets).select("bucket", F.lit(0).cast("long"), F.col("count"))
    return _ratios(raw.union(good), buckets, smooth)


def trusted_for(documents: int) -> int:
    """A ``limit`` for callers that want a quick look; ``judge_quality`` sets none."""
    return max(TRUSTED, round(TRUSTED_PER_ROOT * math.sqrt(documents)))


def ratios_of_labelled(
    docs: DataFrame, labels: DataFrame, text: str, buckets: int, limit: int | None = None, smooth: float = SMOOTH
) -> DataFrame:
    """The same in one pass over the texts, for all trusted documents of ``labels``, or ``limit`` of them."""
    trusted = _trusted_ids(labels)
    if limit is not None:
        trusted = trusted.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    whole = all(isinstance(frame.schema["doc_id"].dataType, IntegralType) for frame in (docs, labels))
    row, bit = _place(F.col("doc_id"), whole)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = stored(trusted.groupBy(row.alias("_row")).agg(F.bit_or(one).alias("_bits")))
    known = docs.select(row.alias("_row"), bit.alias("_bit"), F.col(text).alias("_text")).join(bits, "_row", "left")
    grams = known.select(
        F.getbit("_bits", "_bit").cast("long").alias("_good"),
        F.explode(ngrams(F.coalesce("_text", F.lit("")), buckets)).alias("bucket"),
    )
    good = F.coalesce(F.sum("_good"), F.lit(0)).alias("good")
    return _ratios(grams.groupBy("bucket").agg(F.count("*").alias("raw"), good), buckets, smooth)


def _place(doc_id: Column, whole: bool) -> tuple[Column, Column]:
    """The row of 64 ids that holds a whole number and its bit there; other ids have a row of their own."""
    if not whole:
        return doc_id, F.lit(0)
    number = doc_id.cast("long")
    return F.shiftright(number, 6), number.bitwiseAND(F.lit(63)).cast("int")


def _ratios(found: DataFrame, buckets: int, smooth: float) -> DataFrame:
    every = found.sparkSession.range(buckets).select(F.col("id").cast("int"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    counts = found.union(every).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    lists = counts.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("all"),
        F.sum("raw").cast("double").alias("raws"),
        F.sum("good").cast("double").alias("goods"),
    )
    log_ratio = lambda x: F.when(
        F.col("goods") > 0,
        F.log((x["good"] + smooth) / (F.col("goods") + smooth * buckets))
        - F.log((x["raw"] + smooth) / (F.col("raws") + smooth * buckets)),
    ).otherwise(F.lit(0.0))
    return lists.select(F.transform("all", log_ratio).alias("ratios"))


def _trusted_ids(labels: DataFrame) -> DataFrame:
    trusted = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()
    return labels.where(trusted).select("doc_id")


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents labelled good."""
    return docs.join(_trusted_ids(labels), "doc_id", "left_semi")


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    buckets: int | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id``, the counts of the base rules, ``log_ratio``, ``base_failed`` and ``kept`` of every row.

    Without ``buckets`` their number follows the number of documents.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    text = "text"
    buckets = buckets or buckets_for(docs.count())
    # As text the figures fold into one constant.
    figures = ratios_of_labelled(docs, labels, text, buckets).first()[0]
    of = F.split(F.lit(",".join(map(repr, figures))), ",").cast("array<double>")
    whole = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(whole)

    def facts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    counted = docs.select(
        "doc_id",
        let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), facts).alias("_facts"),
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(whole).alias("n_dup_lines"),
        mean_ratio(ngrams(whole, buckets), of).alias("log_ratio"),
    )
    n_words, n_repeat = F.col("_facts")["n_words"], F.col("_facts")["n_repeat_words"]
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 30 * n_words)
    return counted.select(
        "*", n_words.alias("n_words"), n_repeat.alias("n_repeat_words"), failed.alias("base_failed")
    ).drop("_facts").withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


def mean_ratio(buckets: Column, of: Column) -> Column:
    return let(
        buckets,
        lambda b: F.when(
            F.size(b) > 0,
            F.aggregate(b, F.lit(0.0), lambda total, x: total + F.get(of, x)) / F.size(b),
        ).otherwise(F.lit(0.0)),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "log_ratio",
    )
