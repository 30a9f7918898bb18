"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity drops documents that the classifier rejects; line_dedup takes repeated chunks of lines out of
the texts; near_duplicates keeps one document of each group; decontamination drops documents that hold
benchmark passages; packing places what is left into sequences of at most 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.llm import decontam, linededup, packing, simhash, toxicity
from pricegrain.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model fitted on the labelled ones that are not held out."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the chunks of lines that stand elsewhere before; n_chars is counted anew."""
    kept = linededup.without_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least doc_id, and what is less than 0.8 similar to it; rows without a doc_id stay.

    Fingerprints are of five-word shingles and link at 5 or fewer differing bits; similarity is Jaccard's,
    of the sets of shingles. Rows that repeat the doc_id which stays all stay, equal ones too.
    """
    return simhash.without_near_duplicates(docs, size=5, most=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places there."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The tokenizer and the fingerprints' hash are not in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
