"""Operator 6: SimHash near-duplicates, linked by an exact tiled comparison.

Fingerprint: every shingle of four words is hashed by XXH64; a bit is set if more than half of the
shingle hashes have it. Fingerprints are linked if they differ in at most ``radius`` bits.

Equal fingerprints collapse to one row first, so a group of copies costs one row. The 64 bits are
seen as four quarters; fingerprints with equal population counts of all quarters form a cell, a
cell is split into tiles of about ``TILE`` fingerprints, and one row holds a whole tile. The counts
of two linked fingerprints differ by at most the radius in sum over the quarters, so a tile only
meets the tiles of cells that near; all other tile pairs are skipped, and none that matters. A tile
pair is compared with numpy (exclusive or, bit counts). Of the links found in a tile pair only a
spanning forest is written, which keeps every component and stays linear in large groups. The
forests meet in ``graph.components``.

Scale: fingerprinting is narrow; a fingerprint is sent to at most 321 tile pairs of its cell's
neighbourhood per tile there; the number of comparisons grows with the square of the number of
different fingerprints, with about a tenth of all pairs left by the skipping.

Defined cases: null and empty texts have no words and fingerprint zero, linked like any other;
texts of fewer than four words have one shingle; null ids take part but name no component unless
there is no other id; repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from logjury.llm.graph import components
from logjury.llm.shared import in_batches, of_texts, stored, table

SHINGLE = 4
SEED = 42
RADIUS = 4
TILE = 1 << 15
# Compared at once: rows of the left tile times rows of the right one.
AT_ONCE = 1 << 21
QUARTER = (1 << 16) - 1

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of a text."""
    words = _WORD.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(1, len(words) - shingle + 1)
    stops = ends[len(words) - last :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), stops, strict=True)], dtype="<u8"
    )


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # a very long text needs no large bit table
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row."""

    def run(texts: list) -> list[pa.Array]:
        return [pa.array([_signed(fingerprint(t)) for t in texts], pa.int64())]

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return of_texts(named, ["doc_id"], "text", {"fp": LongType()}, run)


def near(radius: int = RADIUS) -> list[int]:
    """Differences of packed quarter counts within the radius, one of each pair of signs.

    A cell packs the four counts into the bytes of a number, so neighbours differ by a number; a
    count below zero or above sixteen gives a number no cell has.
    """
    reach = range(-radius, radius + 1)
    found = {
        (p << 24) + (q << 16) + (r << 8) + s
        for p in reach
        for q in reach
        for r in reach
        for s in reach
        if abs(p) + abs(q) + abs(r) + abs(s) <= radius
    }
    return sorted(x for x in found if x >= 0)


def tiles(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """``(cell, block, fps)``: the different fingerprints ``fp`` packed into tiles."""
    quarters = [
        F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(QUARTER))).cast("long") for k in range(4)
    ]
    cell = sum((q * (1 << (8 * k)) for k, q in enumerate(quarters)), F.lit(0))
    celled = distinct.select("fp", cell.cast("long").alias("cell"))
    # At most 17^4 rows.
    blocks = celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("blocks"))
    return (
        celled.join(blocks, "cell")
        .select("cell", F.pmod(F.xxhash64("fp"), "blocks").alias("block"), "fp")
        .groupBy("cell", "block")
        .agg(F.collect_list("fp").alias("fps"))
    )


def tile_pairs(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(same, left, right)``: every pair of tiles whose counts are within the radius, once."""
    step = F.explode(F.array(*[F.lit(x).cast("long") for x in near(radius)])).alias("step")
    left = tiled.select(step, "cell", F.col("block").alias("left_block"), F.col("fps").alias("left"))
    left = left.select((F.col("cell") + F.col("step")).alias("cell"), "step", "left_block", "left")
    ordered = (F.col("step") > 0) | (F.col("left_block") <= F.col("block"))
    return left.join(tiled, "cell").where(ordered).select(
        ((F.col("step") == 0) & (F.col("left_block") == F.col("block"))).alias("same"),
        "left",
        F.col("fps").alias("right"),
    )


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the ends of the links: of every component its smallest label."""
    while True:
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        np.minimum.at(labels, before[i], low)
        np.minimum.at(labels, before[j], low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def compare(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs of the two tiles within the radius."""
    both = np.concatenate([left, right])
    labels = np.arange(len(both))
    step = max(1, AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        bits = np.bitwise_count(part[:, None] ^ right[None, :])
        hit = bits <= radius
        if hit.any():
            i, j = np.nonzero(hit)
            labels = forest(labels, i + at, j + len(left))
    moved = np.nonzero(labels != np.arange(len(both)))[0]
    return both[moved], both[labels[moved]]


def _compare_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            same = batch.column(0).to_numpy(zero_copy_only=False)
            sides = []
            for k in (1, 2):
                lists = batch.column(k)
                sides.append((lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)))
            (left_at, left), (right_at, right) = sides
            for n in range(batch.num_rows):
                a = left[left_at[n] : left_at[n + 1]]
                b = a if same[n] else right[right_at[n] : right_at[n + 1]]
                if len(a) * len(b) <= 64:  # most pairs are tiny: one look is enough
                    if not (np.bitwise_count(a[:, None] ^ b) <= radius).any():
                        continue
                    if same[n] and len(a) == 1:
                        continue
                x, y = compare(a, b, radius)
                if len(x):
                    found_a.append(x)
                    found_b.append(y)
            if found_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(f).view(np.int64)) for f in (found_a, found_b)], names=["a", "b"]
                )

    return run


def fingerprint_components(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(node, component)`` for every fingerprint ``fp`` that is linked to another one."""
    tiled = stored(tiles(distinct, tile))
    links = in_batches(tile_pairs(tiled, radius), _compare_batches(radius), "a long, b long")
    return components(links)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    marked = stored(fingerprints(docs, doc_id, text))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    grouped = fingerprint_components(distinct.select("fp"), radius, tile)
    named = distinct.join(grouped, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = stored(named.join(smallest, "component").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates, with their columns.

    Rows that share an id are one document, of which one row stays; rows without an id cannot stand
    for a group and are kept as they are.
    """
    named = docs.where(F.col(doc_id).isNotNull())
    groups = near_duplicates(named, doc_id, text, **options)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc_id))
    first = named.join(kept, doc_id, "left_semi").dropDuplicates([doc_id]).select(*docs.columns)
    return first.union(docs.where(F.col(doc_id).isNull()))


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
