"""Queries on ready offers: filters, outliers, caps and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators import search as op
from pricegrain.plans import roles
from pricegrain.plans.registering import Queries

Q = Queries(roles.SQL.rstrip() + """, near AS (
  SELECT o.*, m.median, m.n, price BETWEEN median * 0.4 AND median * 2.5 AS near
  FROM full_offers o JOIN (SELECT product_id, median(price) AS median, count(*) AS n FROM full_offers GROUP BY 1) m USING (product_id)
), sane AS (
  SELECT * FROM near QUALIFY n < 3 OR near OR NOT bool_or(near) OVER (PARTITION BY product_id)
)""")
TERMS, LOW, HIGH = "red widget", 100.0, 900.0
ALLOWED = list(range(1, 60))


def _offers(s: SparkSession, d: str) -> DataFrame:
    return roles.offers_with_category(s, d)


_KEY = "product_id, retailer, price"
Q.add("a1_offer_summary", lambda s, d: op.summary(_offers(s, d)), """SELECT product_id, min(price) AS lowest_price, max(price) AS highest_price, count(*) AS retailer_count,
  floor((max(price) - min(price)) * 100 + 0.5) / 100 AS spread, bool_or(category = 'major') AS has_major FROM full_offers GROUP BY 1""")
Q.add("a2_cheapest_per_retailer", lambda s, d: op.cheapest_per_retailer(roles.history(s, d).withColumn("seq", F.col("ord") * 8 + F.col("line"))).select("product_id", "retailer", "price", "seq"), """SELECT product_id, retailer, price, ord * 8 + line AS seq FROM history
  QUALIFY row_number() OVER (PARTITION BY product_id, retailer ORDER BY price, ord * 8 + line) = 1""")
Q.add("a25_offers_kept", lambda s, d: _offers(s, d).agg(F.count("*").alias("found")).crossJoin(op.without_outliers(_offers(s, d)).agg(F.count("*").alias("kept"))), "SELECT (SELECT count(*) FROM full_offers) AS found, (SELECT count(*) FROM sane) AS kept")
Q.add("f8_allowed_retailers", lambda s, d: op.of_retailers(_offers(s, d), ALLOWED).select("product_id", "retailer", "price"), f"SELECT {_KEY} FROM full_offers WHERE retailer BETWEEN 1 AND 59")
Q.add("f10_price_filter", lambda s, d: op.within_prices(_offers(s, d), LOW, HIGH).select("product_id", "retailer", "price"), f"SELECT {_KEY} FROM full_offers WHERE product_id IN (SELECT product_id FROM full_offers GROUP BY 1 HAVING min(price) BETWEEN {LOW} AND {HIGH})")
Q.add("f11_without_outliers", lambda s, d: op.without_outliers(_offers(s, d)).select("product_id", "retailer", "price"), f"SELECT {_KEY} FROM sane")
Q.add("t2_offers_by_price_and_rank", lambda s, d: op.by_price_and_rank(_offers(s, d)).select("product_id", "retailer", "place"), """SELECT product_id, retailer, CAST(row_number() OVER (PARTITION BY product_id
  ORDER BY price, CASE category WHEN 'major' THEN 0 WHEN 'specialty' THEN 1 ELSE 2 END, seq) AS INT) AS place FROM full_offers""")
Q.add("t4_protected_cap", lambda s, d: op.capped(_offers(s, d)).select("product_id", "retailer", "price", "place"), """SELECT product_id, retailer, price, CAST(row_number() OVER (PARTITION BY product_id ORDER BY price, seq) AS INT) AS place FROM (
  SELECT * FROM full_offers QUALIFY category = 'major' OR row_number() OVER (PARTITION BY product_id, category = 'major' ORDER BY price, seq)
    <= greatest(0, 10 - count(*) FILTER (category = 'major') OVER (PARTITION BY product_id)))""")
Q.add("a17_merged_details", lambda s, d: op.merged_details(_offers(s, d).withColumn("weight", F.when(F.col("retailer") % 2 == 0, F.col("retailer"))).withColumn("material", F.when(F.col("retailer") % 3 == 0, F.col("retailer_name"))), ["weight", "material"]),
  """SELECT product_id, arg_min(retailer, row(CASE category WHEN 'specialty' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, price, seq)) FILTER (retailer % 2 = 0) AS weight,
  arg_min(retailer_name, row(CASE category WHEN 'specialty' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, price, seq)) FILTER (retailer % 3 = 0) AS material FROM full_offers GROUP BY 1""")
Q.add("w3_ranked_search", lambda s, d: op.compare(roles.products(s, d), _offers(s, d), F.lit(TERMS), ALLOWED, LOW, HIGH).select("product_id", "name", "lowest_price", "retailer_count", "relevance", "tier"), f"""
SELECT product_id, name, lowest_price, retailer_count, relevance, CASE WHEN relevance >= 0.99 THEN 0 ELSE 1 END AS tier FROM (
  SELECT p.product_id, p.name, min(price) AS lowest_price, count(*) AS retailer_count,
    floor(((list_contains(string_split(lower(p.brand || ' ' || p.name), ' '), 'red'))::INT + (list_contains(string_split(lower(p.brand || ' ' || p.name), ' '), 'widget'))::INT) / 2.0 * 100 + 0.5) / 100 AS relevance
  FROM (SELECT o.*, median(price) OVER w AS m, count(*) OVER w AS n FROM full_offers o WHERE retailer BETWEEN 1 AND 59
          AND product_id IN (SELECT product_id FROM full_offers WHERE retailer BETWEEN 1 AND 59 GROUP BY 1 HAVING min(price) BETWEEN {LOW} AND {HIGH})
        WINDOW w AS (PARTITION BY product_id)) o JOIN products p USING (product_id)
  WHERE n < 3 OR price BETWEEN m * 0.4 AND m * 2.5 GROUP BY 1, 2, p.brand)
ORDER BY tier, lowest_price, retailer_count DESC, name, product_id LIMIT 10""")
