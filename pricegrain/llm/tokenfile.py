"""Token ids as Parquet list columns that allow reading single documents or only their counts.

Files are in ascending doc_id order. Each row holds a document's ids as a list column; the counts
stand in columns of their own, so start positions come from the metadata columns alone. The row
groups, pages and encoding are parameters; Parquet's page indexes let a filter on doc_id skip pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricegrain.llm.shared import crc32_ids, flat, partitions, runs
from pricegrain.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Bytes of text encoded at once; what is worked out of them takes some 20 times as much of a worker's memory.
CHUNK = 6_000_000


def text_chunks(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Place of the first row, and texts, of parts of a batch with about so many bytes each. Null is empty."""
    texts = batch.column("text").fill_null("")
    _, at = flat(texts)
    for a, b in runs(at, most):
        yield a, texts.slice(a, b - a)


def _writer(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in text_chunks(batch):
                ids, counts = encoder(tokenizer).encode(texts, ended=True)
                offsets = np.r_[0, np.cumsum(counts)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), pa.array(np.full(len(texts), part, np.int32)), pa.array(done + offsets[:-1]), pa.array(counts.astype(np.int32)), lists],
                    ["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                done += int(offsets[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 64 << 10) -> None:
    """Encode docs (doc_id, text) and write their ids to path in ascending doc_id order.

    encoding: "dictionary", or "delta" (binary packed differences). A null text is empty and has only
    the end id; a null doc_id comes first; rows with equal doc_ids stand in the order of their texts.
    The ranges are balanced by number of documents; any one document is one row. Other columns are not
    read; an empty table gives an empty one.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}")
    dealt = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
        "compression": "zstd",
    }
    dealt.mapInArrow(_writer(tokenizer or default_tokenizer()), SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The table at path: (doc_id, part, local_start, n_tokens, ids). Selecting fewer columns reads fewer."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(tokens: DataFrame) -> DataFrame:
    """(part, base): the ids in all files before each one, from the count columns alone; one row a file."""
    sizes = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, values = ids.offsets.to_numpy().tolist(), ids.values.to_numpy()
        sums = [crc32_ids(values[a:b]) for a, b in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sums, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from its ids.

    The table of file starts has a row of two numbers for each file written, at most one per shuffle
    partition, and is small enough to broadcast at any input.
    """
    sums = tokens.mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens int, ids_crc32 long")
    return sums.join(F.broadcast(starts(tokens)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
