"""Queries on tracked products, their series and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricegrain.functions import numbers
from pricegrain.operators import decisions as decide
from pricegrain.operators import sinks
from pricegrain.operators import tracking as op
from pricegrain.plans import roles
from pricegrain.plans.registering import Queries

Q = Queries(roles.SQL)
USER, PRODUCT = 7, 11


def tracked_rows(spark: SparkSession, d: str) -> DataFrame:
    return op.tracked_products(roles.products(spark, d), roles.offers(spark, d), roles.history(spark, d), roles.tracked(spark, d))


def _recent(spark: SparkSession, d: str, days: int = 365) -> DataFrame:
    day = roles.as_of(spark, d)
    return op.since(roles.history(spark, d).crossJoin(F.broadcast(day)), F.col("as_of"), days).drop("as_of")


Q.add("tracked_products", tracked_rows, "SELECT * FROM rows")
Q.add("s1_tracked_of_user", lambda s, d: roles.tracked(s, d).where(F.col("user_id") == USER), f"SELECT * FROM tracked WHERE user_id = {USER}")
Q.add(
    "s2_history_of_user",
    lambda s, d: op.of_products(_recent(s, d), roles.tracked(s, d).where(F.col("user_id") == USER)).select("product_id", "retailer", "date", "price"),
    f"SELECT product_id, retailer, date, price FROM history, as_of WHERE date >= as_of - 365 AND product_id IN (SELECT product_id FROM tracked WHERE user_id = {USER})",
)
Q.add("s3_point_lookup", lambda s, d: roles.products(s, d).where(F.col("product_id") == PRODUCT).limit(1), f"SELECT * FROM products WHERE product_id = {PRODUCT} LIMIT 1")
Q.add("s4_all_tracked", lambda s, d: roles.tracked(s, d).select("user_id", "product_id"), "SELECT user_id, product_id FROM tracked")
Q.add("j1_tracked_join_products", lambda s, d: roles.tracked(s, d).join(roles.products(s, d), "product_id").select("user_id", "product_id", "name"), "SELECT user_id, product_id, name FROM tracked JOIN products USING (product_id)")
Q.add(
    "j2_products_left_offers",
    lambda s, d: roles.products(s, d).join(roles.offers(s, d).groupBy("product_id").agg(F.count("*").alias("offers")), "product_id", "left").select("product_id", F.coalesce("offers", F.lit(0)).alias("offers")),
    "SELECT product_id, count(o.retailer) AS offers FROM products LEFT JOIN offers o USING (product_id) GROUP BY 1",
)
Q.add("j3_offers_in_keys", lambda s, d: op.of_products(roles.offers(s, d), roles.tracked(s, d)), "SELECT * FROM offers WHERE product_id IN (SELECT product_id FROM tracked)")
Q.add(
    "j4_not_tracked",
    lambda s, d: roles.products(s, d).join(roles.tracked(s, d).where(F.col("user_id") <= 300), "product_id", "left_anti").select("product_id", "name"),
    "SELECT product_id, name FROM products WHERE product_id NOT IN (SELECT product_id FROM tracked WHERE user_id <= 300)",
)


def _as_of(s: SparkSession, d: str) -> DataFrame:
    days = F.explode(F.array(F.lit(0), F.lit(30), F.lit(90), F.lit(365)))
    targets = roles.products(s, d).select("product_id").crossJoin(F.broadcast(roles.as_of(s, d))).select("product_id", "as_of", days.alias("back"))
    return op.price_as_of(op.daily_low(roles.history(s, d)), targets.select("product_id", F.expr("date_sub(as_of, back)").alias("target")))


Q.add(
    "j11_price_as_of",
    _as_of,
    """SELECT p.product_id, t.target, (SELECT arg_max(price, date) FROM daily h WHERE h.product_id = p.product_id AND h.date <= t.target) AS price
    FROM products p, (SELECT CAST(as_of - b AS DATE) AS target FROM as_of, unnest([0, 30, 90, 365]) AS u(b)) t""",
)
Q.add(
    "j13_settings_of_users",
    lambda s, d: roles.tracked(s, d).select("user_id").distinct().join(roles.table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")), "user_id", "left").select("user_id", F.coalesce("segment", F.lit("default")).alias("segment")),
    "SELECT user_id, coalesce(c_mktsegment, 'default') AS segment FROM (SELECT DISTINCT user_id FROM tracked) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id",
)
Q.add("j15_recent_history", lambda s, d: _recent(s, d, 30).select("product_id", "retailer", "date", "price"), "SELECT product_id, retailer, date, price FROM history, as_of WHERE date >= as_of - 30")
Q.add("a3_daily_low", lambda s, d: op.daily_low(roles.history(s, d)), "SELECT * FROM daily")
Q.add(
    "a4_retailer_series",
    lambda s, d: op.retailer_series(roles.history(s, d)).select("product_id", "retailer", F.size("series").cast("long").alias("points"), F.array_join(F.transform("series", lambda x: x["date"].cast("string")), ",").alias("dates")),
    "SELECT product_id, retailer, count(*) AS points, string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) AS dates FROM history GROUP BY 1, 2",
)
Q.add(
    "a5_price_stats",
    lambda s, d: op.price_stats(op.daily_low(roles.history(s, d))).drop("average"),
    """SELECT product_id, min(price) AS lowest, arg_min(date, (price, date)) AS lowest_date, max(price) AS highest, arg_min(date, (-price, date)) AS highest_date, count(*) AS days FROM daily GROUP BY 1""",
)
Q.add(
    "a5_price_average",
    lambda s, d: op.price_stats(op.daily_low(roles.history(s, d)).withColumn("price", (F.col("price") * 100).cast("decimal(18,0)").cast("double"))).select("product_id", F.floor("average").cast("long").alias("average_cents")),
    "SELECT product_id, CAST(floor(floor(sum(CAST(round(price * 100) AS BIGINT))::DOUBLE / count(*) * 100 + 0.5) / 100) AS BIGINT) AS average_cents FROM daily GROUP BY 1",
)
Q.add("a6_spread", lambda s, d: op.offer_summary(roles.offers(s, d)).select("product_id", "retailer_count", "spread"), "SELECT product_id, retailer_count, spread FROM summary")
Q.add(
    "a7_latest_check",
    lambda s, d: roles.products(s, d).join(op.offer_summary(roles.offers(s, d)), "product_id", "left").select("product_id", F.coalesce("last_checked", F.lit("1970-01-01").cast("date")).alias("last_checked")),
    "SELECT product_id, coalesce(last_checked, DATE '1970-01-01') AS last_checked FROM products LEFT JOIN summary USING (product_id)",
)
Q.add("a8_distinct_retailers", lambda s, d: op.of_products(roles.offers(s, d), roles.tracked(s, d)).agg(F.countDistinct("retailer").alias("retailers")), "SELECT count(DISTINCT retailer) AS retailers FROM offers WHERE product_id IN (SELECT product_id FROM tracked)")
Q.add("a9_change_counts", lambda s, d: op.change_counts(tracked_rows(s, d)), "SELECT count(*) FILTER (change < 0) AS drops, count(*) FILTER (change > 0) AS rises, min(change) FILTER (change < 0) AS best_drop, min(last_checked) AS stalest FROM rows")
Q.add(
    "a10_facets",
    lambda s, d: roles.products(s, d).select(F.explode(F.array(F.struct(F.lit("brand").alias("facet"), F.trim("brand").alias("value")), F.struct(F.lit("type").alias("facet"), F.trim("model").alias("value")), F.struct(F.lit("size").alias("facet"), F.col("size").cast("string").alias("value")))).alias("f")).select("f.*").where("value <> ''").distinct(),
    "SELECT DISTINCT 'brand' AS facet, trim(brand) AS value FROM products UNION SELECT 'type', trim(model) FROM products UNION SELECT 'size', CAST(size AS VARCHAR) FROM products",
)
Q.add("a11_families", lambda s, d: op.families(roles.products(s, d)), "SELECT lower(brand || '|' || model) AS family, count(*) AS variants, min(seq) AS first_seq FROM products GROUP BY 1")
Q.add("a12_products_per_user", lambda s, d: op.per_user(roles.tracked(s, d)), "SELECT user_id, count(DISTINCT product_id) AS products FROM tracked GROUP BY 1")
Q.add(
    "a13_job_summary",
    lambda s, d: roles.tracked(s, d).join(tracked_rows(s, d), "product_id").groupBy("user_id").agg(F.count("*").alias("checked"), F.count_if(F.col("change") != 0).alias("updated"), F.count_if(~F.col("in_stock")).alias("failed")).agg(F.sum("checked").alias("checked"), F.sum("updated").alias("updated"), F.sum("failed").alias("failed"), F.count("*").alias("users")),
    "SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (change <> 0) AS BIGINT) AS updated, CAST(count(*) FILTER (NOT in_stock) AS BIGINT) AS failed, count(DISTINCT user_id) AS users FROM tracked JOIN rows USING (product_id)",
)
Q.add("a14_refresh_summary", lambda s, d: tracked_rows(s, d).agg(F.count_if(F.col("previous_low").isNotNull()).alias("updated"), F.count_if(F.col("change") < 0).alias("drops"), F.greatest(F.lit(0), F.count("*") - 8).alias("remaining")), "SELECT count(*) FILTER (previous_low IS NOT NULL) AS updated, count(*) FILTER (change < 0) AS drops, greatest(0, count(*) - 8) AS remaining FROM rows")
Q.add("a15_median", lambda s, d: roles.offers(s, d).groupBy("product_id").agg(F.median("price").alias("median")), "SELECT product_id, median(price) AS median FROM offers GROUP BY 1")
Q.add(
    "a16_upper_median",
    lambda s, d: roles.offers(s, d).groupBy("product_id").agg(F.array_sort(F.collect_list("price")).alias("p")).select("product_id", F.element_at("p", (F.floor(F.size("p") / 2) + 1).cast("int")).alias("upper_median")),
    "SELECT product_id, list_sort(list(price))[len(list(price)) // 2 + 1] AS upper_median FROM offers GROUP BY 1",
)
Q.add("a28_best_offer", lambda s, d: op.best_offers(roles.offers(s, d)), "SELECT * FROM best")
Q.add("w1_previous_low", lambda s, d: op.previous_low(roles.history(s, d)), "SELECT * FROM previous")
Q.add("w2_change", lambda s, d: tracked_rows(s, d).select("product_id", "change", F.when(F.abs("change") < 0.005, "flat").when(F.col("change") < 0, "down").otherwise("up").alias("trend")), "SELECT product_id, change, CASE WHEN abs(change) < 0.005 THEN 'flat' WHEN change < 0 THEN 'down' ELSE 'up' END AS trend FROM rows")
Q.add(
    "w5_last_points",
    lambda s, d: op.last_points(op.daily_low(roles.history(s, d))),
    "SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY date)::INT AS place, date, price FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY date DESC) <= 14)",
)
Q.add(
    "w9_carry_billing",
    lambda s, d: op.carry_billing(roles.table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.pmod("event_id", F.lit(4)).alias("successes"))),
    """SELECT key, seq, successes, CAST(floor(total / 5.0) - floor((total - successes) / 5.0) AS BIGINT) AS billed FROM (
    SELECT user_id AS key, event_id AS seq, event_id % 4 AS successes, sum(event_id % 4) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM events)""",
)
Q.add(
    "w12_offer_minus_best",
    lambda s, d: roles.offers(s, d).join(op.best_offers(roles.offers(s, d)).select("product_id", F.col("price").alias("best")), "product_id").select("product_id", "retailer", numbers.cents(F.col("price") - F.col("best")).alias("over_best")),
    "SELECT o.product_id, o.retailer, floor((o.price - b.price) * 100 + 0.5) / 100 AS over_best FROM offers o JOIN best b USING (product_id)",
)
Q.add("r3_pivot", lambda s, d: op.pivot_series(roles.history(s, d), [str(i) for i in range(1, 6)]), "SELECT date, " + ", ".join(f'min(price) FILTER (retailer = {i}) AS "{i}"' for i in range(1, 6)) + " FROM history GROUP BY 1")
Q.add("t1_offers_by_price", lambda s, d: roles.offers(s, d).withColumn("place", F.row_number().over(Window.partitionBy("product_id").orderBy("price", "seq"))).select("product_id", "retailer", "place"), "SELECT product_id, retailer, row_number() OVER (PARTITION BY product_id ORDER BY price, seq)::INT AS place FROM offers")
Q.add("t5_stalest_first", lambda s, d: op.stalest_first(tracked_rows(s, d), 8).select("product_id", "last_checked"), "SELECT product_id, last_checked FROM rows ORDER BY last_checked NULLS FIRST, product_id LIMIT 8")
Q.add(
    "t6_report",
    lambda s, d: op.classify(tracked_rows(s, d)).where("section = 'drop'").orderBy("change", "product_id").limit(5).select("product_id", "change").withColumn("list", F.lit("drops")).unionByName(tracked_rows(s, d).orderBy("lowest_price", "product_id").limit(5).select("product_id", F.col("lowest_price").alias("change"), F.lit("lowest").alias("list"))),
    "(SELECT product_id, change, 'drops' AS list FROM rows WHERE in_stock AND change < 0 ORDER BY change, product_id LIMIT 5) UNION ALL (SELECT product_id, lowest_price AS change, 'lowest' AS list FROM rows ORDER BY lowest_price, product_id LIMIT 5)",
)
Q.add(
    "t7_client_sorts",
    lambda s, d: roles.tracked(s, d).select("user_id", "product_id").join(tracked_rows(s, d), "product_id").select(
        "user_id",
        "product_id",
        F.row_number().over(Window.partitionBy("user_id").orderBy("name", "product_id")).alias("by_name"),
        F.row_number().over(Window.partitionBy("user_id").orderBy(F.asc_nulls_last("lowest_price"), "product_id")).alias("by_price"),
        F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("lowest_price"), "product_id")).alias("by_price_down"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("change", "product_id")).alias("by_drop"),
    ),
    """SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY name, product_id)::INT AS by_name, row_number() OVER (PARTITION BY user_id ORDER BY lowest_price NULLS LAST, product_id)::INT AS by_price,
    row_number() OVER (PARTITION BY user_id ORDER BY lowest_price DESC NULLS LAST, product_id)::INT AS by_price_down, row_number() OVER (PARTITION BY user_id ORDER BY change, product_id)::INT AS by_drop FROM tracked JOIN rows USING (product_id)""",
)
Q.add("f14_client_filters", lambda s, d: decide.filtered(tracked_rows(s, d), "Brand#11", "in", "down").select("product_id", "change"), "SELECT product_id, change FROM rows WHERE brand = 'Brand#11' AND in_stock AND change < 0")
Q.add("f15_facet_filters", lambda s, d: decide.faceted(roles.products(s, d), model="all", size=10).select("product_id", "model"), "SELECT product_id, model FROM products WHERE size = 10")
Q.add("f19_price_alerts", lambda s, d: op.alerts(tracked_rows(s, d), roles.tracked(s, d)), "SELECT user_id, t.product_id, lowest_price, target_price FROM tracked t JOIN rows r USING (product_id) WHERE alert_enabled AND lowest_price <= target_price")
Q.add(
    "f27_change_badge",
    lambda s, d: tracked_rows(s, d).select("product_id", F.when(F.abs("change") < 0.005, "=").when(F.col("change") < 0, "-").otherwise("+").alias("badge"), numbers.cents(F.abs("change")).alias("amount")),
    "SELECT product_id, CASE WHEN abs(change) < 0.005 THEN '=' WHEN change < 0 THEN '-' ELSE '+' END AS badge, floor(abs(change) * 100 + 0.5) / 100 AS amount FROM rows",
)
Q.add("n7_target_default", lambda s, d: tracked_rows(s, d).select("product_id", numbers.target_default(F.col("lowest_price")).alias("target")), "SELECT product_id, CAST(floor(lowest_price * 0.9) AS BIGINT) AS target FROM rows")
Q.add("u6_first_owner", lambda s, d: op.first_owner(roles.tracked(s, d)), "SELECT product_id, min(user_id) AS user_id FROM tracked GROUP BY 1")


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = roles.raw_history(s, d)
    return h.where("ord % 3 <> 0"), h.where("ord % 3 = 0")


LAST = "QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY (ord % 3 = 0) DESC, {order}) = 1"
Q.add(
    "k2_upsert_offers",
    lambda s, d: sinks.upsert(*_split(s, d), ["product_id", "retailer"], ["date", "ord", "line"]).select("product_id", "retailer", "price", "date"),
    "SELECT product_id, retailer, price, date FROM raw_history " + LAST.format(keys="product_id, retailer", order="date DESC, ord DESC, line DESC"),
)
Q.add(
    "k3_upsert_history",
    lambda s, d: sinks.upsert(*_split(s, d), ["product_id", "retailer", "date"], ["ord", "line"]).select("product_id", "retailer", "date", "price"),
    "SELECT product_id, retailer, date, price FROM raw_history " + LAST.format(keys="product_id, retailer, date", order="ord DESC, line DESC"),
)
Q.add(
    "k4_upsert_tracking",
    lambda s, d: sinks.upsert(roles.tracked(s, d), roles.tracked(s, d).where("product_id % 5 = 0").withColumn("target_price", F.lit(None).cast("double")), ["user_id", "product_id"], ["alert_enabled"]),
    "SELECT user_id, product_id, CASE WHEN product_id % 5 <> 0 THEN target_price END AS target_price, alert_enabled FROM tracked",
)
Q.add("k5_delete_tracking", lambda s, d: sinks.delete_rows(roles.tracked(s, d), roles.tracked(s, d).where("user_id % 2 = 0 and product_id % 2 = 0"), ["user_id", "product_id"]), "SELECT * FROM tracked WHERE NOT (user_id % 2 = 0 AND product_id % 2 = 0)")
Q.add(
    "k6_partial_update",
    lambda s, d: sinks.patch(roles.tracked(s, d), roles.tracked(s, d).where("product_id % 3 = 0").select("user_id", "product_id", (F.col("target_price") / 2).alias("target_price"), F.lit(None).cast("boolean").alias("alert_enabled")), ["user_id", "product_id"], ["target_price", "alert_enabled"]),
    "SELECT user_id, product_id, CASE WHEN product_id % 3 = 0 THEN target_price / 2 ELSE target_price END AS target_price, alert_enabled FROM tracked",
)


def _settings(s: SparkSession, d: str) -> DataFrame:
    c = roles.table(s, d, "customer")
    some = F.transform(F.array(*(F.lit(i) for i in range(4))), lambda i: F.concat(F.lit("r"), (i + F.col("c_custkey") % 3).cast("string")))
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.lit("old@x.ca").alias("report_email"), F.array(F.lit("r1")).alias("retailers"), F.lit(0).alias("updated_at"))
    new = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 5 == 0, "bad mail").otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.ca"))).alias("report_email"), some.alias("retailers"), F.lit(1).alias("updated_at"))
    out = sinks.settings_upsert(old, new, ["r1", "r4", "r5"])
    return out.select("user_id", "report_email", F.array_join("retailers", ",").alias("retailers"))


Q.add(
    "k7_settings_upsert",
    _settings,
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'old@x.ca' ELSE 'u' || c_custkey || '@x.ca' END AS report_email,
    CASE WHEN c_custkey % 5 = 0 THEN 'r1' WHEN c_custkey % 3 = 0 THEN 'r1' WHEN c_custkey % 3 = 1 THEN 'r1,r4' ELSE 'r4,r5' END AS retailers
    FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0""",
)


def _cache(s: SparkSession, d: str) -> DataFrame:
    e = roles.table(s, d, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("cache_key"), F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("results"))
    return sinks.cache_rows(sinks.upsert(e.limit(0), e, ["cache_key"], ["fetched_at", "seq"]), 360, 30)


CACHE = """SELECT event_type || ':' || user_id AS cache_key, ts AS fetched_at, event_id AS seq, event_id % 3 AS results,
    ts + CASE WHEN event_id % 3 > 0 THEN INTERVAL 360 MINUTE ELSE INTERVAL 30 MINUTE END AS expires_at
    FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1"""
Q.add("k8_cache_write", _cache, CACHE)
Q.add(
    "k9_purge_cache",
    lambda s, d: sinks.purge_expired(_cache(s, d).crossJoin(F.broadcast(roles.table(s, d, "events").agg(F.max("ts").alias("now")))), F.expr("now - interval 1 day")).drop("now"),
    f"SELECT c.* FROM ({CACHE}) c, (SELECT max(ts) AS now FROM events) WHERE expires_at >= now - INTERVAL 1 DAY",
)
Q.add("k10_dedup_delete", roles.history, "SELECT * FROM history")
Q.add(
    "k11_insert_missing",
    lambda s, d: sinks.insert_missing(roles.tracked(s, d).where("user_id % 2 = 0").select("product_id").distinct(), roles.tracked(s, d).select("product_id"), ["product_id"]),
    "SELECT DISTINCT product_id FROM tracked",
)


def _product_upsert(s: SparkSession, d: str) -> DataFrame:
    p = roles.table(s, d, "part")
    shape = lambda rows, tag, image: rows.select(F.col("p_partkey").alias("product_id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug"), F.concat(F.lit(tag), F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("u"), F.col("p_partkey").cast("string"))).alias("upc"), image.alias("image_url"))
    old = shape(p.where("p_partkey % 2 = 0"), "", F.lit("old.png"))
    new = shape(p.where("p_partkey % 3 = 0"), "new ", F.when(F.col("p_partkey") % 5 == 0, "new.png"))
    return sinks.upsert_products(old, new.withColumn("slug", F.when(F.col("upc").isNotNull(), F.lit("other")).otherwise(F.col("slug"))))


Q.add(
    "k1_upsert_products",
    _product_upsert,
    """SELECT p_partkey AS product_id, 's' || p_partkey AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'new ' ELSE '' END || p_name AS name,
    CASE WHEN p_partkey % 4 = 0 THEN 'u' || p_partkey END AS upc,
    CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 = 0 THEN 'new.png' WHEN p_partkey % 2 = 0 THEN 'old.png' END AS image_url
    FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
)
