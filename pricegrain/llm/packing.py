"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Only
lengths matter to a packing, so the plan is made for the histogram of lengths, whose size is bounded by
the token capacity, and says for each length which ranks go to which bins. Each piece then finds its
bin from its length and its rank among the pieces of that length; ranks are dealt by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.llm.shared import partitions, small_batches, written
from pricegrain.llm.tokenfile import text_chunks
from pricegrain.llm.tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """Of each bin. No packing that the default tokens allow is forbidden by the defaults for documents and attention; their residuals weigh in the choice of bins all the same."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    @property
    def piece(self) -> int:
        """Tokens of the longest piece that fits a bin."""
        return min(self.tokens, isqrt(self.attention))


@dataclass(frozen=True)
class Rule:
    """How a bin is chosen among those with room in every capacity: the least norm of what is left in it, or the largest dot product of what is left and what is needed.

    Both are of shares of the capacities for tokens, documents and attention, weighted in this order.
    """

    select: str = "residual_norm"
    weights: tuple[float, float, float] = (1.0, 0.5, 0.5)


@dataclass
class Plan:
    """Rows (length, first rank, first bin, pieces a bin, tokens used in it before), sorted; and the number of bins."""

    rows: np.ndarray
    bins: int


def plan(counts: dict[int, int], capacity: Capacity = Capacity(), rule: Rule = Rule()) -> Plan:
    """Vector best-fit decreasing over a histogram of lengths.

    Bins in the same state (tokens, documents, attention left) are one group, so the work depends on
    the capacities and not on the number of documents. Ties go to the group opened first.
    """
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights = np.array(rule.weights)
    left = np.zeros((0, 3))  # of each group
    first, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        todo, rank = counts[length], 0
        while todo:
            fits = np.flatnonzero((left >= need).all(1) & (size > 0))
            if len(fits):
                room = left[fits] / full
                if rule.select == "dot_product":
                    best = fits[np.argmax((room * weights * (need / full)).sum(1))]
                else:
                    best = fits[np.argmin((((left[fits] - need) / full) ** 2 * weights).sum(1))]
                state, at, n = left[best], first[best], size[best]
            else:
                best, state, at, n = -1, full, bins, todo
            each = int((state // need).min()) if rule.select == "residual_norm" or best < 0 else 1
            used = min(n, todo // each)
            each, used = (each, used) if used else (todo, 1)  # fewer are left than one bin takes
            rows.append((length, rank, at, each, int(capacity.tokens - state[0])))
            rank, todo = rank + each * used, todo - each * used
            if best < 0:
                bins += used
            else:
                first[best] += used
                size[best] -= used
            left = np.vstack([left, state - each * need])
            first, size = np.r_[first, at], np.r_[size, used]
            keep = (size > 0) & (left[:, 0] > 0)
            left, first, size = left[keep], first[keep], size[keep]
    return Plan(np.array(sorted(rows), np.int64).reshape(-1, 5), bins)


def _cut(tokenizer: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch):
                docs = batch.column("doc_id").slice(first, len(texts))
                ids, counts = encoder(tokenizer).encode(texts, ended=True)
                # The first piece takes what is over; counts are at least 1.
                number = -(-counts // most)
                of = np.repeat(np.arange(len(counts)), number)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
                over = (counts - (number - 1) * most)[of]
                start = np.where(piece > 0, over + (piece - 1) * most, 0)
                length = np.where(piece > 0, most, over)
                at = (np.cumsum(length) - length).tolist()
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def cut_documents(docs: DataFrame, capacity: Capacity = Capacity(), tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents as token ids, cut where longer than a bin; the first piece takes what is over."""
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer or default_tokenizer(), capacity.piece), PIECES)


def _place(made: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = made.rows
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), rule: Rule = Rule()) -> DataFrame:
    """Place pieces (columns of PIECES) into bins: adds sequence_id and offset.

    The driver gets one row for each different length, at most capacity.tokens of them. Ranks come from
    counts by (bucket, length), where buckets are dealt by a hash of doc_id, and from row numbers inside
    such a pair; a length that a third of all pieces share is so spread over all buckets. An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4 * partitions(spark))))
    counts = written(bucketed.groupBy("bucket", "length").agg(F.count("*").alias("n")), "lengths")
    made = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, rule)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = bucketed.withColumn("nth", F.row_number().over(inside) - 1).join(bases, ["bucket", "length"])
    ready = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ready.mapInArrow(_place(made), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), rule: Rule = Rule(), tokenizer: str | None = None) -> DataFrame:
    """Tokenize, cut and pack docs (doc_id, text): one row per piece with its sequence and its place there.

    Null texts are empty and have only the end id; a null doc_id is kept, and rows that repeat a doc_id
    are pieces of their own. An empty table gives an empty result; other columns are not read. Pieces are
    written once to the shared folder, so that no text is tokenized twice.
    """
    with small_batches(docs.sparkSession):
        pieces = written(cut_documents(docs, capacity, tokenizer), "pieces")
    return pack(pieces, capacity, rule)
