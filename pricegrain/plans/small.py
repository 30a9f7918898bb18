"""Queries of small rules: functions of titles, addresses, numbers and dates, and the decisions around a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import dates, numbers
from pricegrain.functions import text as x
from pricegrain.functions import urls as u
from pricegrain.operators import decisions as op
from pricegrain.operators import search
from pricegrain.plans.registering import Queries
from pricegrain.plans.roles import spread, table

Q = Queries("WITH p AS (SELECT p_partkey AS id, * FROM part)")


def _parts(s: SparkSession, d: str, **columns: str) -> DataFrame:
    return spread(s, d, "part", "p_partkey").select(F.col("p_partkey").alias("id"), *(F.expr(e).alias(n) for n, e in columns.items()))


def _value(name: str, column: Column | object, sql: str, **columns: str) -> None:
    """A query of one value for each part; column is a function of the made-up columns, since columns need a session."""
    Q.add(name, lambda s, d: _parts(s, d, **columns).select("id", column(*(F.col(n) for n in columns)).alias("value")), f"SELECT id, {sql} AS value FROM p")  # type: ignore[operator]


_SIZE = "cast(p_size AS VARCHAR(9))"
_value("x3_cache_key", lambda q, r, n: x.cache_key(q, r, n), "substr(sha256(concat(array_to_string(list_sort(list_distinct(string_split(concat(p_name, ' bag ', p_size), ' '))), ' '), '|a,b|', p_size)), 1, 48)", q=f"concat(p_name, ' BAG  ', {_SIZE})", r="array('b', 'a')", n="p_size")
_value("x4_query_words", lambda q: F.array_join(x.query_words(q), " "), "concat(lower(p_type), CASE WHEN p_size % 2 = 0 THEN ' x9' ELSE '' END)", q="concat('cheap ', p_type, ' luggage under $', cast(p_size AS VARCHAR(9)), CASE WHEN p_size % 2 = 0 THEN ' x9 z' ELSE ' q' END, ' the ', p_type)")
_value("x7_size_tags", lambda t: F.array_join(x.size_tags(t), ","), "CASE p_size % 5 WHEN 0 THEN '21 inch,carry-on' WHEN 1 THEN 'carry-on,small' WHEN 2 THEN 'check-in' WHEN 3 THEN 'underseat,large,medium' ELSE '' END", t="CASE p_size % 5 WHEN 0 THEN 'bag 21\" carry on' WHEN 1 THEN 'Small cabin' WHEN 2 THEN 'checked-in' WHEN 3 THEN 'medium or large underseat' ELSE 'plain' END")
_value("x8_colours", lambda t: x.colour_of(t), "CASE p_size % 5 WHEN 0 THEN 'Graphite' WHEN 1 THEN 'Ice Blue' WHEN 2 THEN 'Rose Gold' WHEN 3 THEN 'Jet Black' ELSE '' END", t="CASE p_size % 5 WHEN 0 THEN 'Graphite Black case' WHEN 1 THEN 'case ICE blue, red' WHEN 2 THEN 'a rose gold one' WHEN 3 THEN 'jet   black' ELSE 'plain' END")
_value("x11_stores", lambda t: x.without_stores(t), "CASE WHEN p_size % 2 = 0 THEN concat('Bag ', p_name) ELSE concat(p_name, ' at') END", t="CASE WHEN p_size % 2 = 0 THEN concat('Bag ', p_name, ' | walmart.ca') ELSE concat('Canadian Tire - ', p_name, ' at London Drugs') END")
_value("x12_with_brand", lambda t: x.with_brand(t, F.lit("Maker")), "CASE p_size % 3 WHEN 0 THEN concat('my maker ', p_name) WHEN 1 THEN concat('Delsey ', p_name) ELSE concat('Maker ', p_name) END", t="CASE p_size % 3 WHEN 0 THEN concat('my maker ', p_name) WHEN 1 THEN concat('Delsey ', p_name) ELSE p_name END")
_LADDER = "concat('maker alpha ', cast(p_size AS VARCHAR(9)), CASE WHEN p_size % 2 = 0 THEN ' black' ELSE ' hardside spinner black medium' END)"
_value("x13_ladder", lambda q: F.array_join(x.broader(q), "|"), f"concat({_LADDER}, '|maker alpha ', p_size, '|maker luggage')", q=_LADDER)
_value("x15_min_price", lambda q: x.min_price(q), "CASE WHEN p_size % 2 = 0 THEN 1100.0 + p_size END::DOUBLE", q="CASE WHEN p_size % 2 = 0 THEN concat('bags over $1,', cast(100 + p_size AS VARCHAR(9))) ELSE p_name END")
_value("x17_canonical", lambda t: u.canonical(t), "CASE p_size % 4 WHEN 0 THEN concat('https://a.ca/p?x=', p_size) WHEN 1 THEN 'https://a.ca/p' WHEN 2 THEN 'https://a.ca/p?a=1&b=2' ELSE 'https://a.ca/p/' END", t="CASE p_size % 4 WHEN 0 THEN concat('https://a.ca/p?utm_source=f&x=', cast(p_size AS VARCHAR(9)), '#top') WHEN 1 THEN 'https://a.ca/p?ref=abc' WHEN 2 THEN 'https://a.ca/p?a=1&utm_medium=m&b=2' ELSE 'https://a.ca/p/#x' END")
_value("x19_identities", lambda t: F.array_join(x.identity_words(t), " "), "concat('maker7 alphaline', CASE WHEN p_size % 2 = 0 THEN ' 3' ELSE ' 360' END, ' voyage')", t="concat('Maker7 Alphaline 21\" ', CASE WHEN p_size % 2 = 0 THEN '3' ELSE '360' END, ' Spinner carry-on ice BLUE voyage. 28 xy Voyage')")
_value("x1_accents", lambda t: x.slug(t), "CASE WHEN p_size % 2 = 0 THEN 'skoda-elite' ELSE 'zow-nandu-2' END", t="CASE WHEN p_size % 2 = 0 THEN 'Škoda  Élite!' ELSE '-ŻÓW ñandú 2-' END")
_value("x23_spec_line", lambda a, b, c: x.spec_line(a, b, c), "concat(p_brand, ' · ', p_type)", a="p_brand", b="CASE WHEN p_size % 2 = 0 THEN '' END", c="p_type")
_value("x24_title_case", lambda t: x.title_case(t), "concat('Ice-Blue ', upper(substr(p_name, 1, 1)), substr(p_name, 2, strpos(p_name, ' ') - 1), upper(substr(p_name, strpos(p_name, ' ') + 1, 1)), substr(p_name, strpos(p_name, ' ') + 2))", t="concat('ICE-blue ', upper(p_name))")
_value("x25_research_query", lambda t: x.research_query(t), "CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' Price list') ELSE concat(p_name, ' price') END", t="CASE WHEN p_size % 2 = 0 THEN concat(p_name, ' Price list') ELSE concat(' ', p_name, ' ') END")
_value("x26_refresh_query", lambda a, b, c: x.refresh_query(a, b, c), "CASE p_size % 3 WHEN 0 THEN concat(p_brand, ' luggage') WHEN 1 THEN concat(p_brand, ' ', p_type, ' luggage') ELSE concat(p_name, ' luggage') END", a="CASE WHEN p_size % 3 < 2 THEN p_brand ELSE '' END", b="CASE WHEN p_size % 3 = 1 THEN p_type END", c="p_name")
_value("x27_numeric_id", lambda t: x.numeric_id(t), "CASE WHEN p_size % 2 = 0 THEN cast(p_partkey AS VARCHAR) END", t="CASE WHEN p_size % 2 = 0 THEN concat('gid://shop/Variant/', cast(p_partkey AS VARCHAR(12)), ' ') ELSE 'none 5 x' END")
_value("f29_shorter_query", lambda q: x.shorter_query(q), "CASE WHEN p_size % 2 = 0 THEN 'maker luggage' END", q="CASE WHEN p_size % 2 = 0 THEN concat('maker ', p_name) ELSE 'maker' END")
_value("f16_plain_queries", lambda q: x.is_plain_query(q), "p_size % 6 = 0", q="CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' $50') WHEN 2 THEN concat('best ', p_name) WHEN 3 THEN concat(p_name, '?') WHEN 4 THEN ' ' ELSE 'one two three four five six seven' END")
_value("f6_accessories", lambda t: x.is_accessory(t), "p_size % 4 IN (0, 1)", t="CASE p_size % 4 WHEN 0 THEN 'Luggage Straps' WHEN 1 THEN 'organiser, TSA lock' WHEN 2 THEN 'Bag with TSA-approved locks' ELSE p_name END")
_value("f3_home", lambda t: u.is_home(t), "p_size % 4 < 2", t="CASE p_size % 4 WHEN 0 THEN 'https://a.ca' WHEN 1 THEN 'https://a.ca/EN/' WHEN 2 THEN 'https://a.ca/english' ELSE 'none' END")
_value("f3_listing_title", lambda t: u.is_listing_title(t), "p_size % 4 < 3", t="CASE p_size % 4 WHEN 0 THEN 'Summer Collection' WHEN 1 THEN 'Best bags of 2023' WHEN 2 THEN 'Luggage Sets | Shop' ELSE p_name END")
_value("f7_price_band", lambda t: t.between(15.0, 6000.0), "p_size BETWEEN 15 AND 40", t="CASE WHEN p_size > 40 THEN 6000.01 ELSE cast(p_size AS DOUBLE) END")
_value("f2_storefronts", lambda a, b: u.is_canadian(a, b), "p_size % 6 IN (0, 1, 3, 5)", a="CASE p_size % 6 WHEN 0 THEN 'https://www.rimowa.com/ca/en/1' WHEN 1 THEN 'https://www.thebay.com/p' WHEN 2 THEN 'https://www.samsonite.com/p' WHEN 3 THEN 'https://www.amazon.com/fr_CA/p' ELSE 'https://www.travelpro.com/p' END", b="CASE WHEN p_size % 6 = 5 THEN 'CA$219.00' WHEN p_size % 6 = 2 THEN 'CA$1' ELSE '$219.00' END")
_value("j7_retailer_of_host", lambda t: u.retailer_of_url(t), "CASE p_size % 5 WHEN 0 THEN 'Amazon.ca' WHEN 1 THEN 'Hudson''s Bay' WHEN 2 THEN 'Briggs & Riley' WHEN 3 THEN NULL ELSE 'TUMI.ca' END", t="CASE p_size % 5 WHEN 0 THEN 'https://www.amazon.com/x' WHEN 1 THEN 'http://m.thebay.com' WHEN 2 THEN 'https://briggs-riley.ca/' WHEN 3 THEN 'https://notamazon.ca/' ELSE 'https://TUMI.com/a' END")
_value("j8_retailer_of_label", lambda t: u.retailer_of(t, F.lit("")), "CASE p_size % 5 WHEN 0 THEN 'Walmart.ca' WHEN 1 THEN 'Best Buy Canada' WHEN 2 THEN 'Costco.ca' WHEN 3 THEN NULL ELSE 'RIMOWA' END", t="CASE p_size % 5 WHEN 0 THEN ' Walmart - Canada ' WHEN 1 THEN 'Best Buy Canada - Seller 5' WHEN 2 THEN 'costco.CA' WHEN 3 THEN 'Far Away Bags' ELSE 'rimowa' END")
_value("t14_longest_alias", lambda t: u.retailer_of(t, F.lit("")), "CASE WHEN p_size % 2 = 0 THEN 'Amazon.ca' ELSE 'Canadian Tire' END", t="CASE WHEN p_size % 2 = 0 THEN 'sold by amazon - canada store' ELSE 'the canadiantire.ca outlet' END")
_value("n2_clamped_price", lambda t: numbers.clamp_price(t), "CASE WHEN p_size % 3 = 1 THEN p_retailprice END", t="CASE p_size % 3 WHEN 0 THEN 0.0 WHEN 1 THEN p_retailprice ELSE 100000.5 END")
_value("n3_units", lambda t: numbers.units_for(t, 5, 2), "((p_size + 4) // 5 * 2)::BIGINT", t="p_size")
_value("n4_jaccard", lambda a, b: F.round(numbers.jaccard(a, b) + numbers.containment(a, b), 6), "round((1.0 + (p_size % 2 = 0)::INT) / (4 - (p_size % 2 = 0)::INT)::DOUBLE + (1.0 + (p_size % 2 = 0)::INT) / 2, 6)::DOUBLE", a="array('a', 'b')", b="CASE WHEN p_size % 2 = 0 THEN array('a', 'b', 'c') ELSE array('a', 'd', 'e') END")
_value("n5_parsed_price", lambda t: numbers.parse_price(t), "CASE WHEN p_size % 2 = 0 THEN 1100.5 + p_size END::DOUBLE", t="CASE WHEN p_size % 2 = 0 THEN concat('CA$1,', cast(100 + p_size AS VARCHAR(9)), '.50') ELSE 'n/a' END")
_value("x28_labels", lambda a, b: F.concat_ws(" ", numbers.money(b), numbers.percent_change(a, b).cast("string")), "concat('$1,', 200 + p_size, '.50 ', CAST((floor(((1200.5 + p_size - 1000) / 1000 * 100)::DOUBLE * 100 + 0.5) / 100) AS VARCHAR))", a="1000.0D", b="1200.5D + p_size")
_TS = "cast('2024-03-10 12:00:00' AS TIMESTAMP)"
_AGO = "CASE p_size % 6 WHEN 0 THEN 20 WHEN 1 THEN 5 * 60 WHEN 2 THEN 3600 WHEN 3 THEN 30 * 3600 WHEN 4 THEN 86400 * 100 ELSE 60 END"
_value("d2_relative", lambda t: dates.relative(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-10 12:00:00")) - t), F.lit("2024-03-10 12:00:00").cast("timestamp")), "CASE p_size % 6 WHEN 0 THEN 'just now' WHEN 1 THEN '5 minutes ago' WHEN 2 THEN '1 hour ago' WHEN 3 THEN '1 day ago' WHEN 4 THEN '3 months ago' ELSE '1 minute ago' END", t=_AGO)
_value("d3_period", lambda t: F.concat_ws(" ", dates.period(t), dates.end_of_month(t).cast("string")), "concat('2024-0', 1 + p_size % 8, ' 2024-0', 2 + p_size % 8, '-01')", t="cast(concat('2024-0', cast(1 + p_size % 8 AS VARCHAR(2)), '-17 10:00:00') AS TIMESTAMP)")
_value("d4_day_series", lambda t: F.array_join(F.transform(dates.day_series(t, 3), lambda x_: x_.cast("string")), ","), "'2024-02-28,2024-02-29,2024-03-01'", t="cast('2024-03-01' AS DATE)")
_value("d5_age_minutes", lambda t: dates.age_minutes(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-10 12:00:00")) - t), F.lit("2024-03-10 12:00:00").cast("timestamp")), "greatest(0, floor((p_size * 20 - 100) / 60.0 + 0.5))::BIGINT", t="p_size * 20 - 100")
_value("f9_allow_list", lambda a, b, c: F.array_join(op.allow_list(a, b, c), ","), "CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'Away,Amazon.ca,Walmart.ca,Samsonite.ca,Briggs & Riley' ELSE 'Away,Amazon.ca,Walmart.ca,Samsonite.ca' END", a="array('Away')", b="CASE WHEN p_size % 3 = 1 THEN 'briggs baseline' ELSE p_name END", c="p_size % 3 = 0")
_value("u2_union", lambda a, b: F.array_join(F.array_union(a, b), ","), "concat('a,b', CASE WHEN p_size % 2 = 0 THEN '' ELSE ',c' END)", a="array('a', 'b', 'a')", b="CASE WHEN p_size % 2 = 0 THEN array('b') ELSE array('c', 'a') END")
_value("t17_chosen_series", lambda a, b: F.array_join(op.chosen_series(a, b, 2), ","), "CASE WHEN p_size % 2 = 0 THEN 'c' ELSE 'a,b' END", a="CASE WHEN p_size % 2 = 0 THEN array('z', 'c') ELSE array('z') END", b="array('a', 'b', 'c')")
_value("r2_merged_map", lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)["x"] + F.size(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)), "p_size + 2", a="map('x', 1, 'y', 2)", b="map('x', p_size)")


def _valid(s: SparkSession, d: str) -> DataFrame:
    rows = _parts(s, d, url="CASE WHEN p_size % 5 = 0 THEN 'ftp://x' ELSE ' https://x.ca ' END", price="CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN 'abc' ELSE concat(cast(p_size AS VARCHAR(9)), '.126') END", retailer="CASE WHEN p_size % 7 = 0 THEN ' ' ELSE 'R' END", title="CASE WHEN p_size % 2 = 0 THEN repeat('t', 400) END")
    return op.valid_offers(rows).select("id", "url", "price", "retailer", F.length("title").alias("title_length"))


Q.add("f12_valid_offers", _valid, "SELECT id, 'https://x.ca' AS url, (p_size + 0.13)::DOUBLE AS price, 'R' AS retailer, CASE WHEN p_size % 2 = 0 THEN 300 ELSE 1 END AS title_length FROM p WHERE p_size % 5 <> 0 AND p_size % 4 > 1 AND p_size % 7 <> 0")


def _valid_products(s: SparkSession, d: str) -> DataFrame:
    products = _parts(s, d, name="CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END", upc="concat('0-', cast(100000000000 + p_partkey AS VARCHAR(12)), CASE WHEN p_size % 2 = 0 THEN '99' ELSE '' END)").withColumnRenamed("id", "product_id")
    offers = table(s, d, "part").select(F.col("p_partkey").alias("product_id"), F.lit("https://x.ca").alias("url"), F.explode(F.array(F.col("p_size"), F.lit(10), F.lit(-1))).alias("price"), F.lit("R").alias("retailer"), F.lit("t").alias("title"))
    return op.valid_products(products, offers)


Q.add("f13_valid_products", _valid_products, "SELECT id AS product_id, p_name AS name, CASE WHEN p_size % 2 = 1 THEN concat('0', 100000000000 + p_partkey) END AS upc, least(p_size, 10)::DOUBLE AS lowest_price, greatest(p_size, 10)::DOUBLE AS highest_price, 2 AS retailer_count, abs(p_size - 10)::DOUBLE AS spread FROM p WHERE p_size % 3 <> 0")


def _settings(s: SparkSession, d: str) -> DataFrame:
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    own = table(s, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'UTC' END").alias("timezone"), F.expr("CASE WHEN c_custkey % 3 = 1 THEN false END").alias("daily_report"), F.lit(None).cast("string").alias("report_email"), F.expr("CASE WHEN c_custkey % 3 = 1 THEN array('Away') END").alias("retailers"))
    return op.with_defaults(users, own, "email").select("user_id", "timezone", "daily_report", "report_email", F.size("retailers").alias("n_retailers"))


Q.add("f26_settings_defaults", _settings, "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN 'UTC' ELSE 'America/Edmonton' END AS timezone, c_custkey % 3 <> 1 AS daily_report, c_name AS report_email, CASE WHEN c_custkey % 3 = 1 THEN 1 ELSE 17 END AS n_retailers FROM customer")


def _pages(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d, query_id="p_partkey div 10", seq="p_partkey % 10", url="CASE WHEN p_partkey % 2 = 0 THEN 'https://x.ca/about' ELSE concat('https://x.ca/products/', cast(p_partkey AS VARCHAR(9)), '#a') END", title="CASE WHEN p_partkey % 10 = 7 THEN 'other' ELSE 'red widget' END", retailer="CASE p_partkey % 3 WHEN 0 THEN 'Samsonite.ca' WHEN 1 THEN 'Walmart.ca' ELSE 'X.ca' END", retailer_key="CASE p_partkey % 3 WHEN 0 THEN 'Samsonite.ca' WHEN 1 THEN 'Walmart.ca' END", reason="CASE WHEN p_partkey % 10 = 5 THEN 'page has no title' ELSE 'no clear price on the page' END")


Q.add("f17_worth_reading", lambda s, d: op.worth_reading(_pages(s, d), F.lit("red widget"), 4).select("query_id", "seq", "place"), "SELECT id // 10 AS query_id, id % 10 AS seq, row_number() OVER (PARTITION BY id // 10 ORDER BY id % 3, id % 2 = 0, id)::INT AS place FROM p WHERE id % 10 NOT IN (5, 7) QUALIFY place <= 4")
Q.add("t11_also_check", lambda s, d: op.also_check(_pages(s, d), F.lit("red widget"), 1).select("query_id", "retailer", "seq"), "SELECT query_id, retailer, seq FROM (SELECT id // 10 AS query_id, CASE id % 3 WHEN 0 THEN 'Samsonite.ca' ELSE 'Walmart.ca' END AS retailer, min(id % 10) AS seq FROM p WHERE id % 3 < 2 AND id % 10 <> 7 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY seq) = 1")
Q.add("j5_unread", lambda s, d: op.unread(_pages(s, d).where("id % 2 = 1"), _parts(s, d, url="concat('https://x.ca/products/', cast(p_partkey AS VARCHAR(9)), '?ref=z')").where("id % 3 = 0")).select("id"), "SELECT id FROM p WHERE id % 2 = 1 AND id % 3 <> 0")
Q.add("u4_leftovers", lambda s, d: _parts(s, d, a="p_size").join(_parts(s, d, b="p_size").where("id % 4 = 0").select("id"), "id", "left_anti").select("id"), "SELECT id FROM p EXCEPT SELECT id FROM p WHERE id % 4 = 0")
Q.add("u1_all_offers", lambda s, d: _parts(s, d, kind="'page'").unionByName(_parts(s, d, kind="'tile'").where("id % 2 = 0")), "SELECT id, 'page' AS kind FROM p UNION ALL SELECT id, 'tile' FROM p WHERE id % 2 = 0")
Q.add("j10_read_texts", lambda s, d: op.with_texts(_pages(s, d).where("id % 2 = 1").select("id", "url"), _parts(s, d, url="concat('https://x.ca/products/', cast(p_partkey AS VARCHAR(9)))", text="p_name").where("id % 5 = 0").drop("id")).select("id", "read_text"), "SELECT id, CASE WHEN id % 5 = 0 THEN p_name END AS read_text FROM p WHERE id % 2 = 1")


def _by_words(s: SparkSession, d: str) -> DataFrame:
    found = _parts(s, d, key="p_partkey div 4", seq="p_partkey % 4", title="CASE p_partkey % 4 WHEN 1 THEN 'Red-Widget' WHEN 2 THEN 'widget red blue' ELSE 'blue' END", handle="concat('h', cast(p_partkey AS VARCHAR(9)))")
    asked = _parts(s, d, query="'red widget q'", handle="CASE WHEN p_partkey % 2 = 0 THEN concat('h', cast(p_partkey * 4 + 3 AS VARCHAR(9))) END").withColumnRenamed("id", "key")
    return op.best_by_words(found.drop("id"), asked).select("key", F.col("seq").cast("long").alias("seq"), F.col("score").cast("long").alias("score"))


Q.add("j14_best_by_words", _by_words, "SELECT key, seq, score FROM (SELECT id // 4 AS key, id % 4 AS seq, (CASE WHEN id % 4 IN (1, 2) THEN 2 ELSE 0 END + CASE WHEN id // 4 % 2 = 0 AND id % 4 = 3 THEN 100 ELSE 0 END)::BIGINT AS score FROM p) QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, seq) = 1")


def _searches(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("user_id", F.col("event_id").alias("ts"), F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("query"))


_LATEST = "SELECT user_id, ts, query, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC)::INT AS place FROM (SELECT user_id, event_id AS ts, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS query FROM events {0} QUALIFY row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id DESC) = 1) QUALIFY place <= {1}"
Q.add("t10_recent_searches", lambda s, d: op.latest_once(_searches(s, d), 3), _LATEST.format("", 3))
Q.add("f18_suggestions", lambda s, d: op.suggestions(_searches(s, d), F.lit("E"), 2), _LATEST.format("WHERE lower(event_type) LIKE '%e%' AND lower(event_type) <> 'e'", 2))
Q.add("t16_last_messages", lambda s, d: op.last_rows(table(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3), "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d, query_id="p_partkey div 8", seq="p_partkey % 8", tier="p_partkey % 3 % 2", lowest_price="cast(p_size AS DOUBLE)", retailer_count="p_partkey % 5", relevance="CASE WHEN p_partkey % 3 % 2 = 0 THEN 1.0D ELSE 0.5D END")


Q.add("t8_shop_sorts", lambda s, d: op.shop_sorted(_ranked(s, d), "price_down").select("id", F.col("place").alias("by_price")).join(op.shop_sorted(_ranked(s, d), "stores").select("id", F.col("place").alias("by_stores")), "id"), "SELECT id, row_number() OVER (PARTITION BY id // 8 ORDER BY id % 3 % 2, p_size DESC, id)::INT AS by_price, row_number() OVER (PARTITION BY id // 8 ORDER BY id % 3 % 2, id % 5 DESC, id)::INT AS by_stores FROM p")
Q.add("w4_badges", lambda s, d: op.badges(op.shop_sorted(_ranked(s, d), "rank")).select("id", "place", "lowest", "related_from"), "SELECT *, min(CASE WHEN tier > 0 THEN place END) OVER (PARTITION BY id // 8) AS related_from FROM (SELECT id, row_number() OVER (PARTITION BY id // 8 ORDER BY id % 3 % 2, id)::INT AS place, place = 1 AND id % 3 % 2 = 0 AS lowest, id % 3 % 2 AS tier FROM p)".replace("SELECT *, min", "SELECT id, place, lowest, min"))
Q.add("t9_all_stores", lambda s, d: op.all_stores(_ranked(s, d).withColumnRenamed("lowest_price", "price")).select("id", "place"), "SELECT id, row_number() OVER (PARTITION BY id // 8 ORDER BY id % 3 % 2, p_size, id)::INT AS place FROM p")
Q.add("t3_top_products", lambda s, d: search.ranked(_ranked(s, d).select(F.col("id").alias("product_id"), F.lit("bag").alias("name"), "relevance", "lowest_price", "retailer_count"), F.lit("bag"), 20).select("product_id", "tier"), "SELECT id AS product_id, CASE WHEN id % 3 % 2 = 0 THEN 0 ELSE 1 END AS tier FROM p ORDER BY tier, p_size, id % 5 DESC, id LIMIT 20")
Q.add("a21_rejections", lambda s, d: op.rejections(_pages(s, d)), "SELECT CASE WHEN id % 10 = 5 THEN 'page has no title' ELSE 'no clear price on the page' END AS reason, count(*) AS n FROM p GROUP BY 1")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    rows = _parts(s, d, key="p_partkey div 3", price="CASE WHEN p_partkey % 5 > 0 THEN cast(p_size AS DOUBLE) END", compare_at="CASE WHEN p_partkey % 4 = 0 THEN 30.0D END", barcode="CASE WHEN p_partkey div 3 % 2 = 0 THEN 'b' END")
    return op.coverage(rows, ["barcode", "compare_at"]).withColumn("missing", F.array_join("missing", ","))


Q.add("a22_coverage", _coverage, """SELECT key, count(price) AS priced, count(*) AS variants, array_to_string(list_filter([CASE WHEN count(barcode) = 0 THEN 'barcode' END, CASE WHEN count(compare_at) = 0 THEN 'compare_at' END], lambda m: m IS NOT NULL), ',') AS missing,
  coalesce(bool_or(compare_at > price), false) AS on_sale, count(DISTINCT price) > 1 AS unstable FROM (SELECT id // 3 AS key, CASE WHEN id % 5 > 0 THEN p_size END AS price, CASE WHEN id % 4 = 0 THEN 30.0 END AS compare_at, CASE WHEN id // 3 % 2 = 0 THEN 'b' END AS barcode FROM p) GROUP BY 1""")


def _identities(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _parts(s, d, slug="concat('s', cast(p_partkey AS VARCHAR(9)))", upc="CASE WHEN p_partkey % 2 = 0 THEN cast(p_partkey div 4 AS VARCHAR(9)) END")
    return rows, rows.where("id % 6 = 0").select("slug", "upc")


Q.add("j4_untracked", lambda s, d: op.untracked(*_identities(s, d)).select("id"), "SELECT id FROM p WHERE id % 6 <> 0 AND NOT (id % 2 = 0 AND id // 4 IN (SELECT id // 4 FROM p WHERE id % 6 = 0))")
Q.add("t13_retailer_order", lambda s, d: table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), search.category_rank(F.when(F.col("s_nationkey") % 3 == 0, "major").when(F.col("s_nationkey") % 3 == 1, "specialty").otherwise("other")).alias("rank")), "SELECT s_suppkey AS id, s_nationkey % 3 AS rank FROM supplier")
Q.add("a20_shared_barcodes", lambda s, d: _shared(s, d), "SELECT CAST(id // 3 AS VARCHAR) AS barcode, count(DISTINCT p_size % 2) AS stores, count(DISTINCT p_size % 2) > 1 AS shared FROM p GROUP BY 1")
Q.add("j12_price_agreement", lambda s, d: _agreement(s, d), "SELECT id AS key, cast(id AS VARCHAR) AS numeric_id, p_size::DOUBLE AS price, p_size + CASE WHEN id % 2 = 0 THEN 0.004 ELSE 0.1 END::DOUBLE AS other_price, id % 2 = 0 AS agrees FROM p WHERE id % 3 > 0")


def _shared(s: SparkSession, d: str) -> DataFrame:
    from pricegrain.sources.shops import shared_barcodes

    return shared_barcodes(_parts(s, d, barcode="cast(p_partkey div 3 AS VARCHAR(9))", store="p_size % 2"))


def _agreement(s: SparkSession, d: str) -> DataFrame:
    from pricegrain.sources.shops import same_prices

    a = table(s, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("gid://v/"), F.col("p_partkey")).alias("id"), F.col("p_size").cast("double").alias("price"))
    b = table(s, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("key"), F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") + F.when(F.col("p_partkey") % 2 == 0, 0.004).otherwise(0.1)).alias("price"))
    return same_prices(a, b)
