"""Tracked products: offers, daily series, what changed, and reports.

Tables have these columns at least. offers: product_id, retailer, price, in_stock, checked_at, seq;
history: product_id, retailer, date, price; tracked: user_id, product_id, target_price, alert_enabled.
Days and times of reference are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.functions.numbers import cents
from pricegrain.operators.rows import first_per
from pricegrain.session import once


def since(history: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Points of the last days; the first day counts, so there may be days + 1 dates."""
    return history.where(F.col("date") >= F.date_sub(as_of, days))


def of_products(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the products in wanted."""
    return rows.join(wanted.select("product_id").distinct(), "product_id", "left_semi")


def best_offers(offers: DataFrame) -> DataFrame:
    """Of each product the cheapest offer in stock, else the cheapest; the earlier one on a tie."""
    in_stock = F.coalesce("in_stock", F.lit(True))
    return first_per(offers, ["product_id"], [~in_stock, F.col("price"), F.col("seq")])


def offer_summary(offers: DataFrame) -> DataFrame:
    """Counts and extremes over all offers of a product; the spread is 0 where there is one."""
    return offers.groupBy("product_id").agg(*_summary())


def _summary() -> list[Column]:
    spread = F.when(F.count("*") > 1, cents(F.max("price") - F.min("price"))).otherwise(0.0)
    in_stock = F.max(F.coalesce("in_stock", F.lit(True)).cast("int")) == 1
    return [F.count("*").alias("retailer_count"), spread.alias("spread"), in_stock.alias("in_stock"), F.max("checked_at").alias("last_checked")]


def daily_low(history: DataFrame) -> DataFrame:
    return history.groupBy("product_id", "date").agg(F.min("price").alias("price"))


def previous_low(history: DataFrame) -> DataFrame:
    """The daily low before the latest day, for products with two days at least."""
    newest = Window.partitionBy("product_id").orderBy(F.desc("date"))
    ranked = daily_low(history).withColumn("place", F.row_number().over(newest))
    return ranked.where("place = 2").select("product_id", F.col("price").alias("previous_low"))


def tracked_products(products: DataFrame, offers: DataFrame, history: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row for each tracked product that exists: its best offer, previous daily low, change, spread and counts.

    The change is the best offer's price, not the last point's, against the previous low; 0 if either is unknown.
    """
    return with_facts(products.join(tracked.select("product_id"), "product_id", "left_semi").select("product_id", "name", "brand"), offers, history)


def with_facts(products: DataFrame, offers: DataFrame, history: DataFrame, *more: Column) -> DataFrame:
    """products with what tracked_products() says of them. more: further aggregates of a product's offers."""
    # best_offers() and offer_summary() in one aggregation.
    first = F.min(F.struct((~F.coalesce("in_stock", F.lit(True))).alias("gone"), "price", "seq", "retailer"))
    facts = offers.groupBy("product_id").agg(first.alias("best"), *_summary(), *more)
    facts = facts.select("product_id", F.col("best.price").alias("lowest_price"), F.col("best.retailer").alias("lowest_retailer"), *facts.columns[2:])
    out = products
    for part in (facts, previous_low(history)):
        out = out.join(part, "product_id", "left")
    change = F.coalesce(cents(F.col("lowest_price") - F.col("previous_low")), F.lit(0.0))
    return out.select(
        *products.columns, "lowest_price", "lowest_retailer", "previous_low", change.alias("change"),
        F.coalesce("retailer_count", F.lit(0)).alias("retailer_count"), F.coalesce("spread", F.lit(0.0)).alias("spread"),
        F.coalesce("in_stock", F.lit(False)).alias("in_stock"), "last_checked", *facts.columns[7:],
    )


def price_stats(series: DataFrame) -> DataFrame:
    """Of each product's (date, price) series the lowest and highest point, each the earliest of its kind, the mean and the days."""
    low, high = F.min(F.struct("price", "date")), F.min(F.struct((-F.col("price")).alias("minus"), "date"))
    out = series.groupBy("product_id").agg(low.alias("low"), high.alias("high"), cents(F.sum("price") / F.count("*")).alias("average"), F.count("*").alias("days"))
    return out.select("product_id", F.col("low.price").alias("lowest"), F.col("low.date").alias("lowest_date"), (-F.col("high.minus")).alias("highest"), F.col("high.date").alias("highest_date"), "average", "days")


def price_as_of(series: DataFrame, targets: DataFrame) -> DataFrame:
    """The last price on or before each target (product_id, target); null where there is none.

    One pass over targets and points together, ordered by day: no pair of them is ever formed.
    """
    points = series.select("product_id", F.col("date").alias("at"), "price", F.lit(0).alias("kind"))
    asked = targets.select("product_id", F.col("target").alias("at"), F.lit(None).cast("double").alias("price"), F.lit(1).alias("kind"))
    upto = Window.partitionBy("product_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = points.unionByName(asked).withColumn("price", F.last("price", ignorenulls=True).over(upto))
    return joined.where("kind = 1").select("product_id", F.col("at").alias("target"), "price")


def last_points(series: DataFrame, n: int = 14) -> DataFrame:
    """The newest n points of each series, oldest first, with their places."""
    newest, oldest = Window.partitionBy("product_id").orderBy(F.desc("date")), Window.partitionBy("product_id").orderBy("date")
    return series.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).select("product_id", F.row_number().over(oldest).alias("place"), "date", "price")


def retailer_series(history: DataFrame) -> DataFrame:
    """Of each product and retailer its series as one array, by date."""
    points = F.array_sort(F.collect_list(F.struct("date", "price")))
    return history.groupBy("product_id", "retailer").agg(points.alias("series"))


def pivot_series(history: DataFrame, names: list[str], column: str = "retailer") -> DataFrame:
    """Dates against the named series; a missing cell is null."""
    return history.groupBy("date").pivot(column, names).agg(F.min("price"))


def change_counts(rows: DataFrame) -> DataFrame:
    """How many products fell and rose, the largest fall, and the stalest check."""
    return rows.agg(F.count_if(F.col("change") < 0).alias("drops"), F.count_if(F.col("change") > 0).alias("rises"), F.min(F.when(F.col("change") < 0, F.col("change"))).alias("best_drop"), F.min("last_checked").alias("stalest"))


def alerts(rows: DataFrame, tracked: DataFrame) -> DataFrame:
    """(user_id, product_id, lowest_price, target_price) whose lowest price reached the target and whose alert is on."""
    on = F.coalesce("alert_enabled", F.lit(True))
    joined = tracked.join(rows.select("product_id", "lowest_price"), "product_id")
    return joined.where(on & F.col("target_price").isNotNull() & (F.col("lowest_price") <= F.col("target_price"))).select("user_id", "product_id", "lowest_price", "target_price")


def classify(rows: DataFrame) -> DataFrame:
    """rows with the report's section: drop, increase, out_of_stock, or steady."""
    section = F.when(~F.col("in_stock"), "out_of_stock").when(F.col("change") < 0, "drop").when(F.col("change") > 0, "increase").otherwise("steady")
    return rows.withColumn("section", section)


#: The ways in which a list of tracked products is sorted; unknown prices come last, never checked ones first.
SORTS = {
    "name": ("name",), "price-asc": (F.asc_nulls_last, "lowest_price"), "price-desc": (F.desc_nulls_last, "lowest_price"), "drop": ("change",),
    "recent": (F.desc_nulls_last, "tracked_at"), "stale": (F.asc_nulls_first, "last_checked"),
}


def client_order(by: str) -> list[Column]:
    """The order columns of a way to sort; equal rows keep the order of product_id."""
    *how, column = SORTS[by]
    return [how[0](column) if how else F.asc(column), F.asc("product_id")]


def report_lists(rows: DataFrame, offers: DataFrame, most: int = 5) -> DataFrame:
    """(user_id, list, product_id, retailer, amount) of the lists of each user's report.

    rows: user_id, product_id, lowest_price, lowest_retailer, previous_low, change, alert_enabled, target_price.
    drops and increases have the change of products whose earlier low is known, out_of_stock the offers
    that are not in stock, lowest the `most` lowest prices, alerts the prices at or under their targets. A list is
    read by amount, then product_id.
    """
    rows = once(rows.select("user_id", "product_id", "lowest_price", "lowest_retailer", "previous_low", "change", "alert_enabled", "target_price"), "report")
    cheapest = F.row_number().over(Window.partitionBy("user_id").orderBy("lowest_price", "product_id"))
    entry = lambda df, name, amount, retailer="lowest_retailer": df.select("user_id", F.lit(name).alias("list"), "product_id", F.col(retailer).alias("retailer"), F.col(amount).cast("double").alias("amount"))
    moved = rows.where("lowest_price is not null and previous_low is not null")
    gone = rows.select("user_id", "product_id").join(offers.where("not in_stock").select("product_id", "retailer", "price"), "product_id")
    reached = rows.where("coalesce(alert_enabled, true) and lowest_price <= target_price")
    lists = [
        entry(moved.where("change < 0"), "drops", "change"), entry(moved.where("change > 0"), "increases", "change"), entry(gone, "out_of_stock", "price", "retailer"),
        entry(rows.where("lowest_price is not null").withColumn("_n", cheapest).where(F.col("_n") <= most), "lowest", "lowest_price"), entry(reached, "alerts", "lowest_price"),
    ]
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one)
    return out


def stalest_first(rows: DataFrame, n: int) -> DataFrame:
    """The next n to refresh: never checked first, then the longest ago."""
    return rows.orderBy(F.asc_nulls_first("last_checked"), "product_id").limit(n)


def carry_billing(events: DataFrame, per_unit: int = 5) -> DataFrame:
    """events (key, seq, successes) with the units each is billed: one for each per_unit successes, the rest carried on."""
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("successes").over(upto)
    return events.withColumn("billed", (F.floor(total / per_unit) - F.floor((total - F.col("successes")) / per_unit)).cast("long"))


def families(products: DataFrame) -> DataFrame:
    """Variants grouped by brand and model without regard to case, in the order first seen."""
    key = F.lower(F.concat_ws("|", "brand", "model"))
    return products.groupBy(key.alias("family")).agg(F.count("*").alias("variants"), F.min("seq").alias("first_seq"))


def first_owner(tracked: DataFrame) -> DataFrame:
    """Each product once, for the first user who tracks it."""
    return tracked.groupBy("product_id").agg(F.min("user_id").alias("user_id"))


def per_user(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("user_id").agg(F.countDistinct("product_id").alias("products"))
