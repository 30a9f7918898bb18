"""Dates and ages. The present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rounded(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


def age_minutes(then: Column, now: Column) -> Column:
    """Whole minutes between, rounded, never negative."""
    return F.greatest(F.lit(0).cast("long"), _rounded((F.unix_micros(now) - F.unix_micros(then)) / 60e6))


def relative(then: Column, now: Column) -> Column:
    """How long ago, in the largest fitting unit."""
    minutes = _rounded((F.unix_micros(now) - F.unix_micros(then)) / 60e6)
    hours, days, months = _rounded(minutes / 60), _rounded(_rounded(minutes / 60) / 24), _rounded(_rounded(_rounded(minutes / 60) / 24) / 30)
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(then.isNull(), "never")
        .when(minutes < 1, "just now")
        .when(minutes < 60, unit(minutes, "minute"))
        .when(hours < 24, unit(hours, "hour"))
        .when(days < 30, unit(days, "day"))
        .otherwise(unit(months, "month"))
    )


def period(ts: Column, kind: str = "month") -> Column:
    """The key of an allowance's period: the month in UTC, or one period for all time."""
    return F.date_format(ts, "yyyy-MM") if kind == "month" else F.lit("total")


def end_of_month(ts: Column) -> Column:
    return F.add_months(F.trunc(ts.cast("date"), "month"), 1)


def day_series(last: Column, days: int) -> Column:
    """The days up to and with the last one, as an array."""
    return F.sequence(F.date_sub(last, days - 1), last, F.expr("interval 1 day"))
