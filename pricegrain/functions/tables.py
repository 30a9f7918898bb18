"""Table functions: the amounts of a text as rows, for lateral joins in DataFrames and SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pricegrain.functions.amounts import scanned


class PriceCandidates:
    """price_candidates(text): one row for each amount; none for a null text."""

    def eval(self, text: str) -> Iterator[tuple[int, int, int, float, bool]]:
        for nth, found in enumerate(scanned(text or "")):
            yield (nth, *found)


price_candidates = F.udtf(PriceCandidates, returnType="nth int, start int, stop int, value double, usd boolean", useArrow=True)


def register(spark: SparkSession) -> None:
    """Make price_candidates known to SQL: SELECT ... FROM t, LATERAL price_candidates(t.text)."""
    spark.udtf.register("price_candidates", price_candidates)
