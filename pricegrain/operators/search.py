"""Ranked comparison: from offers of products to filtered, summarised and ranked products.

Offers have product_id, retailer, price, category (major, specialty, other) and seq, which orders ties.
The order of a comparison is: allowed retailers, prices, outliers, details, relevance, rank, cap; an
outlier goes after the price filter, so a shown product's lowest price may then be above the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.functions import text
from pricegrain.functions.numbers import cents
from pricegrain.operators.rows import first_per

#: Lowest and highest price against the median, and how many offers a product needs for that test.
OUTLIER_LOW, OUTLIER_HIGH, OUTLIER_LEAST = 0.4, 2.5, 3
MOST_OFFERS, MOST_PRODUCTS, FULL_MATCH = 10, 10, 0.99


def category_rank(category: Column) -> Column:
    return F.when(category == "major", 0).when(category == "specialty", 1).otherwise(2)


def detail_trust(category: Column) -> Column:
    """Whose specifications count first: the brand's own store, then the large ones."""
    return F.when(category == "specialty", 0).when(category == "major", 1).otherwise(2)


def cheapest_per_retailer(offers: DataFrame) -> DataFrame:
    return first_per(offers, ["product_id", "retailer"], ["price", "seq"])


def summary(offers: DataFrame) -> DataFrame:
    return offers.groupBy("product_id").agg(
        F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"), F.count("*").alias("retailer_count"),
        cents(F.max("price") - F.min("price")).alias("spread"), F.bool_or(F.coalesce(F.col("category") == "major", F.lit(False))).alias("has_major"),
    )


def of_retailers(offers: DataFrame, allowed: list) -> DataFrame:
    """Offers of the allowed retailers and of unknown ones; an empty list allows all."""
    return offers.where(F.col("retailer").isNull() | F.col("retailer").isin(allowed)) if allowed else offers


def within_prices(offers: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Products whose lowest price is in the range, with all their offers."""
    lowest = offers.groupBy("product_id").agg(F.min("price").alias("lowest"))
    fits = lowest.where((F.lit(low is None) | (F.col("lowest") >= F.lit(low))) & (F.lit(high is None) | (F.col("lowest") <= F.lit(high))))
    return offers.join(fits, "product_id", "left_semi")


def without_outliers(offers: DataFrame) -> DataFrame:
    """Of products with enough offers those near the median price; all, if none is near."""
    per = Window.partitionBy("product_id")
    counted = offers.withColumns({"_median": F.median("price").over(per), "_n": F.count("*").over(per)})
    near = F.col("price").between(F.col("_median") * OUTLIER_LOW, F.col("_median") * OUTLIER_HIGH)
    return counted.withColumn("_near", near).withColumn("_some", F.max(F.col("_near").cast("int")).over(per)).where((F.col("_n") < OUTLIER_LEAST) | F.col("_near") | (F.col("_some") == 0)).select(*offers.columns)


def capped(offers: DataFrame, most: int = MOST_OFFERS) -> DataFrame:
    """All offers of large retailers and the cheapest others, up to most in all; place counts from the cheapest."""
    major = F.coalesce(F.col("category") == "major", F.lit(False))
    group = Window.partitionBy("product_id")
    counted = offers.withColumn("_major", major).withColumn("_majors", F.count_if("_major").over(group))
    nth = F.row_number().over(Window.partitionBy("product_id", "_major").orderBy("price", "seq"))
    kept = counted.withColumn("_nth", nth).where(F.col("_major") | (F.col("_nth") <= F.greatest(F.lit(0), F.lit(most) - F.col("_majors"))))
    return kept.withColumn("place", F.row_number().over(group.orderBy("price", "seq"))).select(*offers.columns, "place")


def by_price_and_rank(offers: DataFrame) -> DataFrame:
    return offers.withColumn("place", F.row_number().over(Window.partitionBy("product_id").orderBy("price", category_rank(F.col("category")), "seq")))


def merged_details(offers: DataFrame, fields: list[str]) -> DataFrame:
    """Of each field the first known value, by trust in the retailer and then by price."""
    order = (detail_trust(F.col("category")).alias("t"), F.col("price"), F.col("seq"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))["v"].alias(c)
    return offers.groupBy("product_id").agg(*map(first, fields))


def relevance(products: DataFrame, terms: Column) -> DataFrame:
    return products.withColumn("relevance", cents(text.query_match(F.concat_ws(" ", "brand", "name"), terms)))


def tier(name: Column, match: Column, terms: Column) -> Column:
    """0 where all words match, 1 where some do, 2 for accessories that were not asked for."""
    return F.when(~text.is_accessory(terms) & text.is_accessory(name), 2).when(F.coalesce(match, F.lit(1.0)) >= FULL_MATCH, 0).otherwise(1)


def ranked(products: DataFrame, terms: Column, most: int = MOST_PRODUCTS) -> DataFrame:
    """The best products (name, relevance, lowest_price, retailer_count) with their tier, in order."""
    rows = products.withColumn("tier", tier(F.col("name"), F.col("relevance"), terms))
    return rows.orderBy("tier", "lowest_price", F.desc("retailer_count"), "name", "product_id").limit(most)


def compare(products: DataFrame, offers: DataFrame, terms: Column, allowed: list, low: float | None, high: float | None, most: int = MOST_PRODUCTS) -> DataFrame:
    """The whole comparison on ready offers: one row for each of the best products."""
    kept = without_outliers(within_prices(of_retailers(cheapest_per_retailer(offers), allowed), low, high))
    return ranked(relevance(products.join(summary(kept), "product_id"), terms), terms, most)
