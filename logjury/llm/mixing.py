"""Operator 1: mixing sources to target weights by systematic sampling.

Every source gets a target number of words: a share of all words by weight, but at most ``cap``
times what it has; what a source cannot take is shared out again by weight. Within a source all
documents have the same expected number of copies (target / size of the source). Documents are put
in order of size, their expected copies are added up, one random offset of the source is added, and
a document comes once for every whole number its stretch of that line crosses. In order of size a
systematic sample takes every size class in proportion, so the words taken stay within about one
large document of the target.

Sums are kept in fixed point (2^-24), so a result depends neither on the partitioning nor on
rounding, and with at most ``cap`` expected copies no document can come more often than that.

Scale: one narrow shuffle by ranges of (source, size, id), which splits a hot source; per-source
figures are one row per source; texts are shuffled once, and only for the mixed corpus itself.

Defined cases: a null text has size 0; the null source is a source, last in order; documents of
size 0 take part but take no words; repeated rows are sampled one by one; an empty table gives an
empty table; further columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logjury.llm.shared import WORD, stored, table, with_position

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 17
ONE = 1 << 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """One row per ``_source`` with its size, target, expected copies and random offset.

    ``sizes`` has ``_source`` and ``_size``. The level at which sources fill up is found in closed
    form: in order of cap per weight, a source is full as long as the rest, shared by the weights
    from it on, would reach its cap. The windows run over one row per source.
    """
    per_source = sizes.groupBy("_source").agg(
        F.sum("_size").alias("_source_size"), F.count("*").alias("_rows")
    )
    in_order = Window.orderBy(F.col("_source").asc_nulls_last())
    row = F.row_number().over(in_order)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((row - 1) % len(weights) + 1).cast("int"))
    start = F.coalesce(F.sum("_rows").over(Window.orderBy(F.col("_source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = per_source.select("*", weight.alias("_weight"), start.alias("_start"), (F.col("_source_size") * cap).cast("double").alias("_cap"))
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("_weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("_source_size").over(everyone)
    levelled = weighed.select(
        "*",
        F.row_number().over(filling).alias("_place"),
        ((total * share - before) / weight_left).alias("_level"),
    )
    is_full = F.col("_cap") <= F.col("_level") * F.col("_weight")
    first_open = F.min(F.when(~is_full, F.col("_place"))).over(everyone)
    opened = levelled.withColumn("_open", first_open)
    level = F.max(F.when(F.col("_place") == F.col("_open"), F.col("_level"))).over(everyone)
    final = opened.withColumn("_final", level)
    target = F.when(
        F.col("_open").isNull() | (F.col("_place") < F.col("_open")), F.col("_cap")
    ).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_weight")))
    name = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("none"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name).cast("binary")), 1, 6), 16, 10)
    return final.withColumn("_target", target).select(
        "_source",
        "_source_size",
        "_start",
        "_target",
        F.when(
            F.col("_source_size") > 0,
            F.floor(F.col("_target") / F.col("_source_size") * ONE + 0.5),
        ).otherwise(F.lit(0)).cast("long").alias("_each"),
        offset.cast("long").alias("_offset"),
    )


def mix_counts(sized: DataFrame, ties: Sequence[str], **options) -> DataFrame:
    """``sized`` (``_source``, ``_size`` and columns of any other names) with ``_source_size``, ``_target``
    and ``_copies``. ``ties`` put documents of one size in order.
    """
    placed = with_position(sized, F.col("_source").asc_nulls_first(), F.col("_size"), *ties)
    targets = stored(source_targets(sized.select("_source", "_size"), **options)).withColumnRenamed("_source", "_of")
    joined = placed.join(targets, F.col("_source").eqNullSafe(F.col("_of")))
    rank = F.col("_position") - F.col("_start")
    crossed = lambda r: F.shiftright(F.col("_offset") + F.col("_each") * r, 24)
    return joined.withColumn("_copies", crossed(rank + 1) - crossed(rank)).drop(
        "_of", "_start", "_each", "_offset", "_position", "_source"
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: every document as often as the sample takes it, with the columns it had.

    Only ids, sizes and sources are sorted, as a sort by size would bring all long texts together.
    The texts are dealt once, by id and hash of the text; rows that share both take the copies of such
    rows in turn.
    """
    key = F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(text).cast("string"))
    sized = docs.select(key.alias("_key"), word_count(F.col(text)).alias("_size"), F.col(source).alias("_source"))
    copies = (
        mix_counts(stored(sized), ["_key"], **options)
        .groupBy(F.col("_key").alias("_of"))
        .agg(F.sort_array(F.collect_list("_copies"), asc=False).alias("_copies"))
        .where(F.col("_copies")[0] > 0)
    )
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key")).withColumn("_turn", turn)
    joined = rows.join(copies, F.col("_key") == F.col("_of"))
    own = F.coalesce(F.get("_copies", F.col("_turn") - 1), F.lit(0))
    taken = joined.select("_row", own.alias("_own")).where(F.col("_own") > 0)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_own").cast("int")))).select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = stored(
        docs.select("doc_id", word_count(F.col("text")).alias("_size"), F.col("source").alias("_source"))
    )
    return mix_counts(narrow, ["doc_id"]).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    (source_size * 2)::DOUBLE AS cap FROM per_source
), levelled AS (
  SELECT *, row_number() OVER filling AS place,
    ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (filling ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER (filling ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW filling AS (ORDER BY cap / weight, source NULLS LAST)
), opened AS (
  SELECT *, min(CASE WHEN NOT cap <= level * weight THEN place END) OVER () AS open FROM levelled
), final AS (
  SELECT *, CASE WHEN open IS NULL OR place < open THEN cap
    ELSE least(cap, (max(CASE WHEN place = open THEN level END) OVER ()) * weight) END AS target FROM opened
), targets AS (
  SELECT source, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS each_one,
    CAST('0x' || substr(md5('17|' || coalesce('s' || source, 'none')), 1, 6) AS BIGINT) AS shift
  FROM final
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.each_one, t.shift,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS r
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((((shift + each_one * r) >> 24) - ((shift + each_one * (r - 1)) >> 24)) * size)::BIGINT AS taken
FROM ranked
"""
