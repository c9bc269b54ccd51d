"""Operator 4: quality classifier, a logistic regression on hashed word n-grams.

Features: words are runs of letters and digits, or runs of other signs. Hashed are every word, every
pair of words, and every pair of word shapes (lower case, capitalised, capitals, signs) with the
fact whether the two words are equal; each is a bucket of ``2**BITS``, and its value is its count
divided by the number of words and ``PRIOR_WORDS`` more, so a few words alone decide little.
Training: follow-the-regularised-leader with one learning rate per coordinate (McMahan et al., 2013),
document by document. Scoring: a sparse dot product.

Learned from are at most ``TRAINING`` labelled documents in order of a hash of the id, of ids in the
learning fold only; label, language, source and id are no inputs of a score. One task runs the
updates, since they follow each other; the sample bounds what it reads. All other work is narrow:
every document is scored where it is read.

Whole batches of text are cut into words with numpy: byte classes give the bounds, and prefix sums
of a polynomial give all word hashes at once.

Defined cases: null and empty texts have no features and get the score of the bias alone; labels
that are null or neither 0 nor 1 and repeated labels of an id that contradict each other are not
learned from; without any label every score is 0.5; repeated rows get equal scores; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from logjury.llm.shared import in_batches, in_learning_fold, of_texts, stored, table

BITS = 18
TRAINING = 4096
EPOCHS = 8
ALPHA = 0.5
BETA = 1.0
L1 = 0.02
L2 = 0.1
KEEP = 0.7
PRIOR_WORDS = 15
# Bytes cut into words at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def _classes() -> np.ndarray:
    """Of every byte: 0 white space, 1 part of a word, 2 another sign."""
    kinds = np.full(256, 2, dtype=np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
        kinds[ord(first) : ord(last) + 1] = 1
    kinds[128:] = 1
    return kinds


CLASSES = _classes()


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    back = pow(_BASE, -1, 1 << 64)
    return tuple(
        np.concatenate(
            [np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, base & _ALL, dtype=np.uint64))]
        )
        for base in (_BASE, back)
    )


def _mix(values: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hash and shape of every word of these bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    kinds = CLASSES[data]
    bounds = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(data)]])
    starts, stops = bounds[:-1], bounds[1:]
    real = kinds[starts] != 0
    starts, stops = starts[real], stops[real]
    size = 1 << max(10, (len(data) - 1).bit_length())
    power, back = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = _mix((sums[stops] - sums[starts]) * back[starts])
    is_upper = (data >= 65) & (data <= 90)
    uppers = np.concatenate([[0], np.cumsum(is_upper)])
    upper = uppers[stops] - uppers[starts]
    long = stops - starts > 1
    shape = np.where(kinds[starts] == 2, 3, np.where(long & (upper == stops - starts), 2, is_upper[starts]))
    return starts, hashes, shape.astype(np.uint8)


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts packed into runs of about ``size`` bytes, each with the first byte of every text in it."""
    at = 0
    while at < len(texts):
        total, stop = 0, at
        while stop < len(texts) and (stop == at or total + len(texts[stop]) < size):
            total += len(texts[stop]) + 1
            stop += 1
        joined = b"\n".join(texts[at:stop])
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[at : stop - 1]])
        yield np.frombuffer(joined, dtype=np.uint8), starts
        at = stop


def features(texts: list[bytes], bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: number of texts, number of words of each, and text and bucket of each n-gram."""
    mask = np.uint64((1 << bits) - 1)
    for data, starts in pieces(texts):
        at, hashes, shape = words(data)
        text = np.searchsorted(starts, at, side="right") - 1
        together = text[1:] == text[:-1]
        first, second = hashes[:-1][together], hashes[1:][together]
        pair = _mix(first * np.uint64(3) + second)
        shapes = (shape[:-1][together] * 4 + shape[1:][together]) * 2 + (first == second)
        buckets = np.concatenate([hashes, pair, _mix(shapes.astype(np.uint64) + np.uint64(1))]) & mask
        of = np.concatenate([text, text[1:][together], text[1:][together]])
        yield len(starts), np.bincount(text, minlength=len(starts)), of, buckets.astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[float, np.ndarray]:
    """Bias and weights after follow-the-regularised-leader passes over (buckets, values, label)."""
    size = (1 << bits) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        part = z[at]
        return np.where(
            np.abs(part) <= L1, 0.0, (np.sign(part) * L1 - part) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        )

    for _ in range(epochs):
        for at, value, label in rows:
            w = weights(at)
            gradient = (_sigmoid(w @ value) - label) * value
            square = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / ALPHA * w
            n[at] += square
    final = weights(np.arange(size))
    return float(final[-1]), final[:-1]


def _train_batches(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            labels = iter(batch.column(1).to_pylist())
            for count, lengths, of, buckets in features([(t or "").encode() for t in batch.column(0).to_pylist()], bits):
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(count + 1))
                for k in range(count):
                    own, counts = np.unique(buckets[order[cuts[k] : cuts[k + 1]]], return_counts=True)
                    value = np.append(counts / (lengths[k] + PRIOR_WORDS), 1.0)
                    rows.append((np.append(own, 1 << bits), value, next(labels)))
        bias, weights = train(rows, bits, epochs)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(used, 1 << bits), pa.int64()),
                pa.array(np.append(weights[used], bias), pa.float64()),
            ],
            names=["bucket", "weight"],
        )

    return run


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    """``(id, text, label)`` of the sample: at most ``limit`` ids, so its ids may be broadcast."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & in_learning_fold(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
        .select(F.col("doc_id").alias("id"), "label")
    )
    named = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    found = named.join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    # Repeated rows of an id teach once.
    return found.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    bits: int = BITS,
    epochs: int = EPOCHS,
    limit: int = TRAINING,
) -> np.ndarray:
    """Weights of all buckets, the bias last: at most ``2**bits + 1`` numbers come to the driver."""
    sample = stored(labelled(docs, labels, doc_id, text, limit))
    in_order = sample.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(1), "id"), "id").select("text", "label")
    model = in_batches(in_order, _train_batches(bits, epochs), "bucket long, weight double").toPandas()
    weights = np.zeros((1 << bits) + 1, dtype=np.float32)
    weights[model["bucket"].to_numpy()] = model["weight"].to_numpy()
    return weights


def score(
    docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text", name: str = "score"
) -> DataFrame:
    """The columns ``keep`` and the score under ``name``."""
    bits = (len(weights) - 2).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(texts: list) -> list[pa.Array]:
        w = shared.value
        scores = [np.zeros(0)]
        for count, lengths, of, buckets in features([(t or "").encode() for t in texts], bits):
            dots = np.bincount(of, weights=w[buckets], minlength=count) / (lengths + PRIOR_WORDS)
            scores.append(_sigmoid(dots + w[-1]))
        return [pa.array(np.concatenate(scores), pa.float64())]

    return of_texts(docs, keep, text, {name: DoubleType()}, run)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights, ["doc_id"]).select(
        "doc_id",
        (~in_learning_fold(F.col("doc_id"))).alias("held_out"),
        "score",
        F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"),
    )
