"""One row for each key, by partial aggregation and not by sorting whole groups; and words by how rare they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], order: list[Column | str], pick) -> DataFrame:  # noqa: ANN001
    rest = [c for c in df.columns if c not in keys]
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    row = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(by)), F.struct(*rest).alias("row"))
    picked = df.groupBy(*keys).agg(pick(row).alias("picked"))
    return picked.select(*keys, *(F.col("picked.row")[c].alias(c) for c in rest)).select(*df.columns)


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row that comes first in order, for each key. Rows equal in order are told apart by all their columns."""
    return _one(df, keys, order, F.min)


def last_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return _one(df, keys, order, F.max)


def rare_first(rows: DataFrame, group: list[str], key: str, words: Column) -> DataFrame:
    """(group, key, ranked) of rows with any word: their words as (n, word), n being how many rows of the group have it; rarest first."""
    each = rows.select(*group, key, F.explode(F.array_distinct(words)).alias("word"))
    counts = each.groupBy(*group, "word").agg(F.count("*").alias("n"))
    return each.join(counts, [*group, "word"]).groupBy(*group, key).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
