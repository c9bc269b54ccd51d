"""Operator 5: cost-balanced packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end mark. The attention cost of a piece is estimated as
``LINEAR`` per token plus ``QUADRATIC`` per token squared. Documents longer than a sequence give
full sequences first. What is left of a run of documents (about ``RUN`` tokens) is packed at once: as
many sequences as the tokens fill are opened, and the pieces, longest first, go to the sequence of
lowest cost that has room for the whole piece; if none has, the piece is cut to fill the sequence of
lowest cost that has any room, and its rest is placed next. All sequences but the last few end full;
the tokens beyond a multiple of the length go to sequences whose capacities are the powers of two
that add up to them, which need no padding either.

Scale: packing is narrow. A task reads its documents once, keeps one run of tokens, and writes
pieces; sequence ids hold the number of the partition, so they are unique and a task that is run
again after a loss gives the same ones.

Ids: those of the ``tokenizers`` library for ``byte_bpe_50k.json``. They are made by ``tiktoken``
from the same vocabulary, which is several times faster; tests hold the two against each other.
Strings of special tokens in a text are ordinary text.

Defined cases: null and empty texts are a single end mark; very long texts are cut; repeated rows
are packed one by one; null ids are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.llm.shared import in_batches, table

LENGTH = 2048
END = 1
LINEAR = 1.0
QUADRATIC = 1.0 / 2048
RUN = 1 << 21
TOKENIZER = "byte_bpe_50k.tiktoken"
# The same words as the tokenizer's own pattern, with quantifiers that never step back.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def assign(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Parts ``(piece, first token, tokens, sequence)`` of pieces of at most ``length`` tokens."""
    total = sum(sizes)
    tail = total % length
    powers = [1 << k for k in reversed(range(length.bit_length())) if tail >> k & 1]
    room = np.array([length] * (total // length) + powers, dtype=np.int64)
    cost = np.zeros(len(room))
    parts = []
    for piece in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at, left = 0, sizes[piece]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            sequence = int(fits.argmin())
            if fits[sequence] == np.inf:
                sequence = int(np.where(room > 0, cost, np.inf).argmin())
            taken = min(left, int(room[sequence]))
            parts.append((piece, at, taken, sequence))
            cost[sequence] += LINEAR * taken + QUADRATIC * taken * taken
            room[sequence] -= taken
            at, left = at + taken, left - taken
    return parts


class _Run:
    """Rests of documents waiting to be packed together."""

    def __init__(self, length: int):
        self.length = length
        self.rows: list[tuple[int, int, int, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        self.rows.append((doc, start, total, ids))
        self.tokens += len(ids)

    def pack(self, first: int) -> tuple[list[tuple], int]:
        """Rows of the result, and the next free sequence number."""
        offsets: dict[int, int] = {}
        made = []
        for piece, at, taken, sequence in assign([len(row[3]) for row in self.rows], self.length):
            doc, start, total, ids = self.rows[piece]
            offset = offsets.get(sequence, 0)
            offsets[sequence] = offset + taken
            made.append((doc, start + at, ids[at : at + taken], total, first + sequence, offset))
        self.rows, self.tokens = [], 0
        return made, first + len(offsets)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    length: int = LENGTH,
    run_tokens: int = RUN,
) -> DataFrame:
    """One row per piece. ``tokenizer`` is the path of a rank file that every executor has."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer is None:
            import public_tokenizers

            encode = encoder(public_tokenizers.path(TOKENIZER))
        else:
            encode = encoder(tokenizer)
        next_id = TaskContext.get().partitionId() << 33
        waiting = _Run(length)
        id_type = None

        def rows(made: list[tuple]) -> pa.RecordBatch:
            docs_, starts, ids, totals, sequences, offsets = zip(*made, strict=True)
            columns = [
                pa.array(docs_, id_type),
                pa.array(starts, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array(sequences, pa.int64()),
                pa.array(offsets, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=NAMES)

        for batch in batches:
            id_type = batch.schema.field(0).type
            full = []
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(own.as_py() or ""), END], dtype="<u4")
                whole = len(ids) // length * length
                for at in range(0, whole, length):
                    full.append((doc, at, ids[at : at + length], len(ids), next_id, 0))
                    next_id += 1
                if whole < len(ids):
                    waiting.add(doc, whole, len(ids), ids[whole:].copy())
                if waiting.tokens >= run_tokens:
                    made, next_id = waiting.pack(next_id)
                    yield rows(made)
                if len(full) >= 256:
                    yield rows(full)
                    full = []
            if full:
                yield rows(full)
        if waiting.rows:
            made, next_id = waiting.pack(next_id)
            yield rows(made)

    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return in_batches(
        named,
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
