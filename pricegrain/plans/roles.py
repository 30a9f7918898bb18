"""The driver's tables in the roles that the operators ask for, and the same as SQL.

product: part; retailer: supplier; price history: lineitem, one row for each part, supplier and day;
offer: the latest such row; tracked: the parts that a customer ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions.numbers import cents
from pricegrain.operators.rows import last_per


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """table() dealt to all cores by a key: a small file is read by one task, which would also do all that is computed of its rows."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table(spark, sf_dir, name).repartition(tasks, key)


#: Rows of a task where rows are dealt by dealt(): a task then takes the same memory however large the tables are.
TASK_ROWS = 250_000


def tasks_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """By how many tasks the rows of a table, or as many others, are dealt; Parquet's metadata has the count."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // TASK_ROWS))


def dealt(spark: SparkSession, sf_dir: str, df: DataFrame, *keys: str) -> DataFrame:
    """df, which has about as many rows as lineitem, by keys: adaptive execution would put as many rows together as compress to its size, and a few small numbers compress well."""
    return df.repartition(tasks_of(spark, sf_dir, "lineitem"), *keys)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("model"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"), F.col("p_partkey").alias("seq"),
    )


def retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col("s_nationkey") % 3 == 0, "major").when(F.col("s_nationkey") % 3 == 1, "specialty").otherwise("other")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("retailer"), F.col("s_name").alias("retailer_name"), category.alias("category"))


def raw_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With repeats of a part, supplier and day, in the order of (ord, line)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("retailer"), F.col("l_shipdate").cast("date").alias("date"),
        cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_returnflag") != "R").alias("in_stock"),
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
    )


def history(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """by: keys by which rows are dealt first; what is then grouped or joined by these, alone or with others, moves no row again."""
    raw = raw_history(spark, sf_dir)
    return last_per(dealt(spark, sf_dir, raw, *by) if by else raw, ["product_id", "retailer", "date"], ["ord", "line"])


def offers(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    latest = last_per(history(spark, sf_dir, *by), ["product_id", "retailer"], ["date"])
    return latest.select("product_id", "retailer", "price", "in_stock", F.col("date").alias("checked_at"), F.col("retailer").alias("seq"))


def offers_with_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers(spark, sf_dir).join(retailers(spark, sf_dir), "retailer")


def tracked(spark: SparkSession, sf_dir: str, *more: Column, by: tuple[str, ...] = ("user_id", "product_id")) -> DataFrame:
    """more: further aggregates of the orders of a user and product. by: keys by which rows are dealt."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderstatus", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"))
    pairs = dealt(spark, sf_dir, orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")), *by).groupBy("user_id", "product_id")
    # Whether the least status is P, in numbers: strings would be aggregated by sorting all rows.
    status = F.col("o_orderstatus")
    rows = pairs.agg((F.min(F.when(status < "P", 0).when(status == "P", 1).when(status > "P", 2)) != 1).alias("alert_enabled"), *more)
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("target_price"))
    return rows.join(prices, "product_id").select("user_id", "product_id", "target_price", *rows.columns[2:])


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the last day of the history."""
    return table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").cast("date").alias("as_of"))


SQL = """
WITH products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS model, p_size AS size, p_retailprice AS list_price, p_partkey AS seq FROM part
), retailers AS (
  SELECT s_suppkey AS retailer, s_name AS retailer_name,
    CASE s_nationkey % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'specialty' ELSE 'other' END AS category FROM supplier
), raw_history AS (
  SELECT l_partkey AS product_id, l_suppkey AS retailer, CAST(l_shipdate AS DATE) AS date,
    floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_returnflag <> 'R' AS in_stock, l_orderkey AS ord, l_linenumber AS line FROM lineitem
), history AS (
  SELECT * FROM raw_history QUALIFY row_number() OVER (PARTITION BY product_id, retailer, date ORDER BY ord DESC, line DESC, price DESC) = 1
), offers AS (
  SELECT product_id, retailer, price, in_stock, date AS checked_at, retailer AS seq FROM history
  QUALIFY row_number() OVER (PARTITION BY product_id, retailer ORDER BY date DESC) = 1
), full_offers AS (
  SELECT o.*, r.retailer_name, r.category FROM offers o JOIN retailers r USING (retailer)
), tracked AS (
  SELECT user_id, product_id, p_retailprice AS target_price, alert_enabled FROM (
    SELECT o_custkey AS user_id, l_partkey AS product_id, min(o_orderstatus) <> 'P' AS alert_enabled
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) JOIN part ON p_partkey = product_id
), daily AS (
  SELECT product_id, date, min(price) AS price FROM history GROUP BY 1, 2
), best AS (
  SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY in_stock DESC, price, seq) = 1
), previous AS (
  SELECT product_id, price AS previous_low FROM daily QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY date DESC) = 2
), summary AS (
  SELECT product_id, count(*) AS retailer_count, CASE WHEN count(*) > 1 THEN floor((max(price) - min(price)) * 100 + 0.5) / 100 ELSE 0.0 END AS spread,
    bool_or(in_stock) AS in_stock, max(checked_at) AS last_checked FROM offers GROUP BY 1
), rows AS (
  SELECT p.product_id, name, brand, b.price AS lowest_price, b.retailer AS lowest_retailer, previous_low,
    coalesce(floor((b.price - previous_low) * 100 + 0.5) / 100, 0.0) AS change, coalesce(retailer_count, 0) AS retailer_count,
    coalesce(spread, 0.0) AS spread, coalesce(s.in_stock, false) AS in_stock, last_checked
  FROM products p LEFT JOIN best b USING (product_id) LEFT JOIN summary s USING (product_id) LEFT JOIN previous USING (product_id)
  WHERE product_id IN (SELECT product_id FROM tracked)
), as_of AS (SELECT CAST(max(l_shipdate) AS DATE) AS as_of FROM lineitem)
"""
