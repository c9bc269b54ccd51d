"""Operator 7: near-duplicate embeddings by int8 tile products with error bounds.

Vectors of one label (and one dimension) are compared by cosine. Equal vectors collapse to one row
with a count. The vectors of a label are split into tiles of about ``TILE`` rows by a hash, one row
holds a tile, and every pair of tiles of a label is compared once:

* every unit vector x is rounded to x' = s q with int8 codes q and one scale s, and its error
  e = |x - x'| is computed, not estimated;
* the products of the codes are exact integers (float32 holds them for up to 1,040 dimensions,
  beyond that float64 is used), so s_x s_y <q_x, q_y> is x'y' up to rounding of the last place;
* |xy - x'y'| <= e_x + (1 + e_x) e_y, since x and y are unit vectors; a pair whose x'y' plus this
  bound is below the threshold cannot be linked and is dropped;
* the rest is computed in double precision from the original numbers.

A tile pair returns the number of links of each vector and a spanning forest of its links, so a
dense group costs no row per pair.

Scale: a tile is sent to all tiles of its label; comparisons grow with the square of a label's
different vectors. Pairs of tiles are listed by number and dealt by label and both numbers, so a hot label is
many tasks; a tile has about ``TILE`` rows.

Defined cases: null labels, null or empty vectors, null ids, zero vectors and vectors with null or
non-finite components link with nothing; vectors of different dimension are not compared; ids are
taken as names of vectors, repeated rows count as further vectors with links to each other; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.llm.graph import components
from logjury.llm.shared import in_batches, stored, table
from logjury.llm.simhash import forest

THRESHOLD = 0.93
TILE = 1024
EXACT_DIMS = (1 << 24) // (127 * 127)
# Doubles of rounding that the float scales and products may add to the bound.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """True for vectors that have a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and rounding errors of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def tile_links(
    left: np.ndarray, right: np.ndarray, same: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at or above the threshold; of one tile each pair once."""
    sides = []
    for raw in (left, right):
        # By a power of two, which changes no digit: squares of very large and small numbers stay in range.
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
        length = np.sqrt((raw * raw).sum(axis=1))
        sides.append((raw, length, *quantise(raw / length[:, None])))
    (a, a_len, a_code, a_scale, a_err), (b, b_len, b_code, b_scale, b_err) = sides
    kind = np.float32 if a.shape[1] <= EXACT_DIMS else np.float64
    close = (a_code.astype(kind) @ b_code.astype(kind).T) * (a_scale[:, None] * b_scale[None, :])
    bound = a_err[:, None] + (1 + a_err)[:, None] * b_err[None, :] + SLACK
    maybe = close + bound >= threshold
    if same:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        cosine = (a[x] * b[y]).sum(axis=1) / (a_len[x] * b_len[y])
        keep[at : at + (1 << 16)] = cosine >= threshold
    return i[keep], j[keep]


def _compare_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(batch, k):
            lists = batch.column(k)
            rows = lists.values
            return lists.offsets.to_numpy(), rows.field("node"), rows.field("copies"), rows.field("embedding")

        def cut(parts, n):
            at, node, copies, vector = parts
            a, b = int(at[n]), int(at[n + 1])
            own = vector.slice(a, b - a)
            flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1)
            return node.slice(a, b - a).to_numpy(), copies.slice(a, b - a).to_numpy(), flat

        for batch in batches:
            left, right = side(batch, 1), side(batch, 2)
            for n in range(batch.num_rows):
                same = batch.column(0)[n].as_py()
                a_node, a_copies, a = cut(left, n)
                b_node, b_copies, b = (a_node, a_copies, a) if same else cut(right, n)
                i, j = tile_links(a, b, same, threshold)
                if not len(i):
                    continue
                shift = 0 if same else len(a)
                node = a_node if same else np.concatenate([a_node, b_node])
                found = np.zeros(len(node), dtype=np.int64)
                np.add.at(found, i, b_copies[j])
                np.add.at(found, j + shift, a_copies[i])
                labels = forest(np.arange(len(node)), i, j + shift)
                at = np.nonzero(found)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.array(node[labels[at]]), pa.array(found[at])],
                    names=["node", "root", "links"],
                )

    return run


def tile_pairs(tiled: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(same, left, right)``: every pair of tiles of a label, once.

    The pairs are listed by number first and dealt by their whole key, so the comparisons within one label are as
    many units as it has pairs; each side joins by label and block.
    """
    key = ["label", "dims"]
    listed = blocks.select(*key, "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("left_block"))
    listed = listed.select(*key, "left_block", F.explode(F.sequence(F.col("left_block"), F.col("blocks") - 1)).alias("right_block"))
    listed = listed.repartition(*key, "left_block", "right_block")
    left, right = (tiled.select(*key, F.col("block").alias(f"{side}_block"), F.col("rows").alias(side)) for side in ("left", "right"))
    met = listed.join(left, [*key, "left_block"]).join(right, [*key, "right_block"])
    return met.select((F.col("left_block") == F.col("right_block")).alias("same"), "left", "right")


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    tile: int = TILE,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label")
    )
    able = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    marked = rows.withColumn("able", able)
    different = stored(
        marked.where("able")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    )
    grouped = different.withColumn("dims", F.size("embedding"))
    blocks = grouped.groupBy("label", "dims").agg(F.ceil(F.count("*") / tile).alias("blocks"))
    tiled = stored(
        grouped.join(blocks, ["label", "dims"])
        .withColumn("block", F.pmod(F.xxhash64("node", "embedding"), "blocks"))
        .groupBy("label", "dims", "block")
        .agg(F.collect_list(F.struct("node", "copies", "embedding")).alias("rows"))
    )
    pairs = tile_pairs(tiled, stored(blocks))
    found = stored(in_batches(pairs, _compare_batches(threshold), "node long, root long, links long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = components(found, "node", "root").withColumnRenamed("node", "of")
    by_vector = stored(
        different.join(counts, "node", "left")
        .join(named, F.col("node") == F.col("of"), "left")
        .select(
            F.col("label").alias("l"),
            F.col("embedding").alias("e"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked = marked.where("able").join(by_vector, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")))
    alone = marked.where(~F.col("able")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        linked.select("vec_id", "n_links", "component_id")
        .union(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH RECURSIVE able AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM able a JOIN able b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
), counted AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM embeddings v LEFT JOIN least m ON v.vec_id = m.x LEFT JOIN counted c ON v.vec_id = c.x
"""
