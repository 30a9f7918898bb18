"""Writes as functions from the existing and the incoming rows to the new table.

Without a table format that has transactions, an upsert is a rewrite: the caller writes the result
and swaps it in. Later rows win over earlier ones by their order columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.operators.rows import first_per, last_per


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by order; incoming rows come after existing ones."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return last_per(both, keys, ["_new", *order]).select(*existing.columns)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming whose key is not there yet, added; others do nothing."""
    new = incoming.join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(first_per(new, keys, [c for c in new.columns if c not in keys]))


def delete_rows(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def patch(existing: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite only what the matching change supplies; a null there leaves the old value."""
    new = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = existing.join(new, keys, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns))


def upsert_products(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Match by barcode, else by slug, else insert; a missing image or barcode never replaces a known one.

    Both have product_id, slug, name, upc, image_url; incoming ids are used for inserts only.
    """
    by_upc = existing.where("upc is not null").select("upc", F.col("product_id").alias("upc_id"))
    by_slug = existing.select("slug", F.col("product_id").alias("slug_id"))
    found = incoming.join(by_upc, "upc", "left").join(by_slug, "slug", "left").withColumn("match", F.coalesce("upc_id", "slug_id"))
    updates = first_per(found.where("match is not null").select(F.col("match").alias("product_id"), F.col("name").alias("_name"), F.col("upc").alias("_upc"), F.col("image_url").alias("_image")), ["product_id"], ["_name"])
    kept = existing.join(updates, "product_id", "left").select("product_id", "slug", F.coalesce("_name", "name").alias("name"), F.coalesce("_upc", "upc").alias("upc"), F.coalesce("_image", "image_url").alias("image_url"))
    new = first_per(found.where("match is null").select("product_id", "slug", "name", "upc", "image_url"), ["slug"], ["product_id"])
    return kept.unionByName(new)


def purge_expired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") >= now)


def cache_rows(responses: DataFrame, ttl_minutes: int, empty_ttl_minutes: int) -> DataFrame:
    """Cache entries with their expiry; empty responses are kept for a shorter time."""
    ttl = F.when(F.col("results") > 0, ttl_minutes).otherwise(empty_ttl_minutes)
    return responses.withColumn("expires_at", F.col("fetched_at") + F.make_dt_interval(mins=ttl))


def settings_upsert(existing: DataFrame, incoming: DataFrame, known_retailers: list[str]) -> DataFrame:
    """Valid settings replace those of the same user: the e-mail has the shape of one, and at least one known retailer is left."""
    known = F.array_intersect("retailers", F.array(*map(F.lit, known_retailers)))
    valid = incoming.withColumn("retailers", known).where(F.col("report_email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.size("retailers") > 0))
    return upsert(existing, valid, ["user_id"], ["updated_at"])


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """rows with the time of the write in updated_at."""
    return rows.withColumn("updated_at", now)
