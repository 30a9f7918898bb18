"""Structured Streaming forms: daily lows under a watermark, alerts on them, and the quota as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_lows(prices: DataFrame, late: str = "2 days") -> DataFrame:
    """(product_id, day, price, offers) of a stream of prices (product_id, ts, price): each day's least, open for rows so late."""
    day = F.window("ts", "1 day")
    rows = prices.withWatermark("ts", late).groupBy("product_id", day).agg(F.min("price").alias("price"), F.count("*").alias("offers"))
    return rows.select("product_id", F.col("window.start").cast("date").alias("day"), "price", "offers")


def alerts(prices: DataFrame, tracked: DataFrame) -> DataFrame:
    """(user_id, product_id, ts, price, target_price) of each price at or under a target; tracked is a plain table."""
    on = tracked.where(F.coalesce("alert_enabled", F.lit(True)) & F.col("target_price").isNotNull()).select("user_id", "product_id", "target_price")
    return prices.join(on, "product_id").where(F.col("price") <= F.col("target_price")).select("user_id", "product_id", "ts", "price", "target_price")


def quota(claims: DataFrame, limit: int, most: int = 5) -> DataFrame:
    """claims (key, seq, units) with allowed and total, by the rule of operators.state.quota: the count of each key is kept between batches.

    Within a batch a key's claims count in order of seq; a claim of a later batch counts after it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        log = pd.concat(list(batches)).sort_values("seq", kind="stable")
        allowed, totals = [], []
        for units in log["units"].tolist():
            good = True
            if abs(units) <= most:
                after = max(0, total + units)
                good = units <= 0 or after <= limit
                total = after if good else max(0, after - units)
            allowed.append(good)
            totals.append(total)
        state.update((total,))
        yield log.assign(allowed=allowed, total=totals)[["key", "seq", "units", "allowed", "total"]]

    schema = "key string, seq long, units int, allowed boolean, total long"
    return claims.select("key", F.col("seq").cast("long").alias("seq"), F.col("units").cast("int").alias("units")).groupBy("key").applyInPandasWithState(step, schema, "total long", "append", GroupStateTimeout.NoTimeout)
