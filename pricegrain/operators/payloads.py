"""Cached answers with their payload as a VARIANT column: any JSON, typed when it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stored(answers: DataFrame, ttl_minutes: int) -> DataFrame:
    """(key, query, payload, fetched_at, expires_at) of answers (key, query, body, fetched_at): body's JSON as a VARIANT.

    A body that is no JSON gives a null payload, so that the entry is there but answers nothing.
    """
    expires = F.col("fetched_at") + F.make_dt_interval(mins=F.lit(ttl_minutes))
    return answers.select("key", "query", F.try_parse_json("body").alias("payload"), "fetched_at", expires.alias("expires_at"))


def live_payloads(cache: DataFrame, now: Column) -> DataFrame:
    """The entries that answer at now, with age_minutes, rounded and never negative."""
    age = F.greatest(F.round((F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) / 60).cast("long"), F.lit(0).cast("long"))
    return cache.where((F.col("expires_at") >= now) & F.col("payload").isNotNull()).withColumn("age_minutes", age)


def products_of(cache: DataFrame) -> DataFrame:
    """(key, seq, name, lowest, retailers) of the products in each payload; what has another type there is null."""
    rows = cache.select("key", F.posexplode(F.try_variant_get("payload", "$.products", "array<variant>")).alias("seq", "product"))
    field = lambda name, kind: F.try_variant_get("product", f"$.{name}", kind)
    return rows.select("key", "seq", field("name", "string").alias("name"), field("lowestPrice", "double").alias("lowest"), field("retailers", "array<string>").alias("retailers"))
