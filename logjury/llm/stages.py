"""Stages of the corpus pipeline: each takes what its predecessor kept and returns its columns.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``docs``; rows are
kept or repeated whole, so further columns pass through whatever their names. An empty table gives an empty table. Documents with a
null id are judged by their text; near-duplicates among them are not looked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.llm import language, mixing, packing, quality, simhash
from logjury.llm.shared import table, unused


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier scores at least ``quality.KEEP``."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "score")
    scored = quality.score(docs, weights, docs.columns, name=name)
    return scored.where(F.col(name) >= quality.KEEP).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters go, and all if no language is labelled."""
    names = unused(docs, "lang_pred"), unused(docs, "score")
    found = language.predict(docs, language.fit(docs), docs.columns, names=names)
    return found.where(F.col(names[0]) != language.UNKNOWN).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints (four-word shingles, four bits) the document that names it, once."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2,048 tokens."""
    return packing.pack(docs)
