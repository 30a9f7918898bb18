"""Intervals that overlap: of each key's, in order of their starts, those that begin before the last one kept has ended go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrain.operators.state import folded


def without_overlaps(rows: DataFrame, key: str, order: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """rows whose interval, from start to before stop, overlaps none kept before it in its key.

    Intervals are taken by start, those that begin together by order, and one is kept if it begins where the
    last kept one ends or later. An empty interval is kept like any other, and stops nothing after it. Rows without a bound go.
    """

    def step(state: list, begins: int, ends: int) -> tuple:
        kept = state[0] is None or begins >= state[0]
        if kept:
            state[0] = ends
        return (kept,)

    bounded = rows.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    return folded(bounded, "_kept boolean", lambda: [None], step, [start, stop], key, (start, order)).where("_kept").drop("_kept")
