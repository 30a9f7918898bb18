"""Numbers and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(value: Column) -> Column:
    """To two decimals, halves toward plus infinity."""
    return F.floor(value * 100 + 0.5) / 100


def clamp_price(value: Column, most: float = 100_000) -> Column:
    """The value if it lies in (0, most], else null."""
    return F.when((value > 0) & (value <= most), value)


def units_for(successes: Column, per_unit: int = 5, depth: int = 1) -> Column:
    """Credits for so many pages: one for each started group of per_unit, times depth."""
    return (F.ceil(successes / per_unit) * depth).cast("long")


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old != 0, cents((new - old) / old * 100))


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def parse_price(text: Column) -> Column:
    """The first number in a price label, commas dropped; null without one."""
    return F.try_to_number(F.regexp_extract(F.regexp_replace(text, ",", ""), r"(\d+(?:\.\d+)?)", 1), F.lit("999999999D99")).cast("double")


def target_default(lowest: Column) -> Column:
    """The default target of an alert: nine tenths, rounded down."""
    return F.floor(lowest * 0.9).cast("long")


def containment(a: Column, b: Column) -> Column:
    """Shared members over the smaller set's size."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
