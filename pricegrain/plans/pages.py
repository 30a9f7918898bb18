"""Queries on page texts, clusters and structured sources, over pages made up from parts and suppliers.

The texts are made by expressions that both Spark and the SQL evaluate; the SQL then states what each kind
of text must give, by how it was made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.operators import clusters as c
from pricegrain.operators import pages as p
from pricegrain.plans.registering import Queries
from pricegrain.plans.roles import spread, table
from pricegrain.sources import crawling as cr
from pricegrain.sources import jsons as j
from pricegrain.sources import shops as sh
from pricegrain.sources import structured as st

_TITLE = "concat('Traveller ', p_name, ' ', p_type)"
_PRICE = "cast(100 + p_partkey % 900 AS VARCHAR(9))"
_MORE = "cast(180 + p_partkey % 900 AS VARCHAR(9))"
_N = "chr(10)"
_TEXT = f"""CASE p_partkey % 8
  WHEN 0 THEN concat({_TITLE}, {_N}, 'List Price: $', {_MORE}, '.99', {_N}, 'Price: $', {_PRICE}, '.99', {_N}, 'You Save: $80.00 (23%)')
  WHEN 1 THEN concat({_TITLE}, {_N}, 'Was $', {_MORE}, '.99', {_N}, 'Now $', {_PRICE}, '.99')
  WHEN 2 THEN concat({_TITLE}, {_N}, '$', {_PRICE}, '.99', {_N}, 'or 4 payments of $37.50')
  WHEN 3 THEN concat('Free shipping on orders over $75', {_N}, {_TITLE}, {_N}, '$', {_PRICE}, '.99', {_N}, 'Add to cart')
  WHEN 4 THEN concat({_TITLE}, {_N}, 'Prix 164,97 $', {_N}, 'Ajouter au panier')
  WHEN 5 THEN concat({_TITLE}, {_N}, 'See price in cart', {_N}, 'Customers also viewed', {_N}, 'Other $199.99')
  WHEN 6 THEN concat({_TITLE}, {_N}, 'US$179.99')
  ELSE 'Choose a size: from $199.99 to $249.99' END"""
_URL = """CASE p_partkey % 7 WHEN 1 THEN 'https://www.google.ca/shopping' WHEN 3 THEN concat('https://www.amazon.com/dp/', cast(p_partkey AS VARCHAR(9)))
  WHEN 4 THEN 'https://www.shop.ca/' WHEN 5 THEN 'https://www.shop.ca/collections/all' WHEN 6 THEN concat('https://www.bentley.ca/products/', cast(p_partkey AS VARCHAR(9)))
  ELSE concat('https://www.shop.ca/products/', cast(p_partkey AS VARCHAR(9))) END"""
_RAW = f"CASE WHEN p_partkey % 7 = 6 THEN concat({_TEXT}, {_N}, 'Sold out online') ELSE {_TEXT} END"
_TILES = f"concat({_TITLE}, {_N}, 'Sale price $', {_PRICE}, '.99 CAD    Regular price $', {_MORE}, '.99 CAD')"
_SPECS = f"""concat({_TITLE}, {_N}, 'Dimensions: 21.5 x 15 x ', cast(p_size AS VARCHAR(9)), CASE WHEN p_size % 2 = 0 THEN ' in' ELSE ' cm' END, {_N}, 'Airline weight limit 50 lb', {_N},
  CASE WHEN p_size % 3 = 0 THEN 'Weighs 3.1 kg' ELSE 'Item weight: 6.8 lbs' END, {_N}, 'Capacity ', cast(30 + p_size AS VARCHAR(9)), ' L', {_N},
  CASE p_size % 4 WHEN 0 THEN 'ABS shell, 8-wheels' WHEN 1 THEN 'Polycarbonate shell with 4 spinner wheels' WHEN 2 THEN 'ballistic nylon, upright' ELSE 'plain' END, {_N},
  CASE WHEN p_size % 5 = 0 THEN '10-year limited warranty' WHEN p_size % 5 = 1 THEN 'Limited lifetime warranty' ELSE 'Expandable. TSA lock.' END, {_N}, 'Colours: Ice Blue, jet black, BLUE, rose gold')"""
_PAGE_TITLE = """CASE p_partkey % 4 WHEN 0 THEN concat('Traveller ', p_name, ' Spinner | Walmart Canada') WHEN 1 THEN concat('Amazon.ca: Traveller ', p_name, ' Spinner, Model Number: 143310-1041')
  WHEN 2 THEN concat('Pro ', p_brand, ' - 28 inch Large Spinner') ELSE concat('Traveller ', p_name, ' Spinner : Amazon.ca: Luggage') END"""
_PARTS = "SELECT p_partkey AS id, * FROM part"
Q = Queries()


def _parts(s: SparkSession, d: str, **columns: str) -> DataFrame:
    return spread(s, d, "part", "p_partkey").select(F.col("p_partkey").alias("id"), *(F.expr(e).alias(n) for n, e in columns.items()))


_NONE = "CAST(NULL AS DOUBLE)"
_EXPECTED = f"CASE WHEN p_partkey % 8 <= 3 THEN round(100 + p_partkey % 900 + 0.99, 2) WHEN p_partkey % 8 = 4 THEN 164.97 ELSE {_NONE} END"


def _amounts(s: SparkSession, d: str) -> DataFrame:
    df = p.held(_parts(s, d, text=_TEXT), a=p.amounts(F.col("text")))
    return df.select("id", F.size("a").cast("long").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda t, x: t + x["value"]), 2).alias("total"), F.exists("a", lambda x: x["usd"]).alias("any_usd"))


Q.add("e1_amounts", _amounts, f"""SELECT id, CAST(CASE p_partkey % 8 WHEN 0 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 2 END AS BIGINT) AS n,
  round(CASE p_partkey % 8 WHEN 0 THEN 2 * (p_partkey % 900) + 361.98 WHEN 1 THEN 2 * (p_partkey % 900) + 281.98 WHEN 2 THEN p_partkey % 900 + 138.49 WHEN 3 THEN p_partkey % 900 + 175.99
    WHEN 4 THEN 164.97 WHEN 5 THEN 199.99 WHEN 6 THEN 179.99 ELSE 449.98 END::DOUBLE, 2) AS total, p_partkey % 8 = 6 AS any_usd FROM ({_PARTS})""")
Q.add("e2_anchor", lambda s, d: _parts(s, d, text=_TEXT, title=_TITLE).select("id", p.anchor(F.col("text"), F.col("title")).cast("long").alias("place")), f"SELECT id, CAST(CASE p_partkey % 8 WHEN 3 THEN 33 WHEN 7 THEN -1 ELSE 0 END AS BIGINT) AS place FROM ({_PARTS})")
Q.add("e3_listing_price", lambda s, d: p.listing_price(_parts(s, d, text=_TEXT, title=_TITLE), "text", "title", "pick").select("id", "pick.price"), f"SELECT id, {_EXPECTED} AS price FROM ({_PARTS})")


def _rows(s: SparkSession, d: str) -> DataFrame:
    text = "concat('| Traveller | A | B |', chr(10), '| Price | $', cast(100 + p_size AS VARCHAR(9)), '.95 | $', CASE WHEN p_size % 2 = 0 THEN cast(100 + p_size AS VARCHAR(9)) ELSE '359' END, '.95 |')"
    df = p.held(_parts(s, d, text=text), a=p.amounts(F.col("text")))
    return df.select("id", F.size(F.filter("a", lambda x: p.in_price_row(F.col("text"), x))).cast("long").alias("in_rows"))


Q.add("e4_price_rows", _rows, f"SELECT id, CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE 2 END AS BIGINT) AS in_rows FROM ({_PARTS})")
Q.add("e5_title_spots", lambda s, d: _parts(s, d, text=f"concat('x ', {_TITLE}, ' and ', {_TITLE}, ', again')", title=_TITLE).select("id", F.array_join(p.title_spots(F.col("text"), F.col("title")), ",").alias("spots")), f"SELECT id, concat('2,', cast(7 + length({_TITLE}) AS VARCHAR)) AS spots FROM ({_PARTS})")


def _details(s: SparkSession, d: str) -> DataFrame:
    x = p.details(_parts(s, d, text=_SPECS, title=_TITLE), "text", "title", "x")
    return x.select("id", *(F.col(f"x.{n}").alias(n) for n in ("dimensions", "weight", "capacity", "material", "wheels", "expandable", "tsa_lock", "warranty")), F.array_join("x.colours", ",").alias("colours"))


Q.add("e6_details", _details, f"""SELECT id, concat('21.5 x 15 x ', p_size, CASE WHEN p_size % 2 = 0 THEN ' in' ELSE ' cm' END) AS dimensions, CASE WHEN p_size % 3 = 0 THEN '3.1 kg' ELSE '6.8 lb' END AS weight,
  concat(30 + p_size, ' L') AS capacity, CASE p_size % 4 WHEN 0 THEN 'ABS' WHEN 1 THEN 'Polycarbonate' WHEN 2 THEN 'Ballistic Nylon' END AS material,
  CASE p_size % 4 WHEN 0 THEN '8 wheels (double spinner)' WHEN 1 THEN 'Spinner (4 wheels)' WHEN 2 THEN '2 wheels' END AS wheels, CASE WHEN p_size % 5 > 1 THEN true END AS expandable, CASE WHEN p_size % 5 > 1 THEN true END AS tsa_lock,
  CASE p_size % 5 WHEN 0 THEN '10-year' WHEN 1 THEN 'Limited Lifetime' END AS warranty, 'Ice Blue,Jet Black,Blue,Rose Gold' AS colours FROM ({_PARTS})""")
_REASON = """CASE p_partkey % 7 WHEN 1 THEN 'not a retailer page' WHEN 2 THEN 'page has no title' WHEN 3 THEN 'not a Canadian storefront (prices likely USD)' WHEN 4 THEN 'home page, not a single product'
  WHEN 5 THEN 'search or category page, not a single product' END"""


def _analysed(s: SparkSession, d: str) -> DataFrame:
    pages = _parts(s, d, url=_URL, title=f"CASE WHEN p_partkey % 7 = 2 THEN '' ELSE {_TITLE} END", content="cast(NULL AS VARCHAR(9))", raw=_RAW)
    return p.analysed(pages).select("id", "retailer", F.col("offer.price").alias("price"), F.col("offer.in_stock").alias("in_stock"), "reason")


Q.add("e7_page_decisions", _analysed, f"""SELECT id, CASE p_partkey % 7 WHEN 1 THEN 'Google.ca' WHEN 3 THEN 'Amazon.ca' WHEN 6 THEN 'Bentley' ELSE 'Shop.ca' END AS retailer,
  CASE WHEN reason IS NULL THEN price END AS price, CASE WHEN reason IS NULL AND price IS NOT NULL THEN p_partkey % 7 <> 6 END AS in_stock,
  coalesce(reason, CASE WHEN price IS NULL THEN 'no clear price on the page' END) AS reason FROM (SELECT *, {_EXPECTED} AS price, {_REASON} AS reason FROM ({_PARTS}))""")
Q.add("f4_listing_page", lambda s, d: _parts(s, d, url=_URL, text=_TEXT, title=_TITLE).select("id", p.is_listing_page(F.col("url"), F.col("text"), F.col("title")).alias("value")), f"SELECT id, p_partkey % 7 IN (4, 5) AS value FROM ({_PARTS})")
Q.add("f5_in_stock", lambda s, d: _parts(s, d, text=_RAW, title=_TITLE).select("id", p.in_stock(F.col("text"), F.col("title")).alias("value")), f"SELECT id, p_partkey % 7 <> 6 AS value FROM ({_PARTS})")
Q.add("x10_page_title", lambda s, d: _parts(s, d, title=_PAGE_TITLE).select("id", p.clean_title(F.col("title")).alias("t")).select("id", "t.name", "t.site"), f"""SELECT id, CASE WHEN p_partkey % 4 = 2 THEN concat('Pro ', p_brand, ' 28 inch Large Spinner') ELSE concat('Traveller ', p_name, ' Spinner') END AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'Walmart Canada' WHEN 2 THEN '28 inch Large Spinner' WHEN 3 THEN 'Amazon.ca: Luggage' END AS site FROM ({_PARTS})""")
Q.add("x16_evidence", lambda s, d: _parts(s, d, text="concat(repeat('ab ', 40), '$', cast(p_size AS VARCHAR(9)), '.00', repeat(' cd', 40))").select("id", p.evidence(F.col("text"), F.lit(120), F.lit(124)).alias("value")), f"SELECT id, concat('…', trim(substr(t, 51, 114)), '…') AS value FROM (SELECT *, concat(repeat('ab ', 40), '$', p_size, '.00', repeat(' cd', 40)) AS t FROM ({_PARTS}))")


def _tiles(s: SparkSession, d: str) -> DataFrame:
    return p.tiles(_parts(s, d, text=_TILES), "text", F.lit("traveller widget")).select("id", F.inline("tiles")).drop("evidence")


Q.add("e8_tiles", _tiles, f"SELECT id, {_TITLE} AS name, round((100 + p_partkey % 900 + 0.99)::DOUBLE, 2) AS price FROM ({_PARTS}) WHERE p_name LIKE '% widget' OR p_name LIKE 'widget %'")


def _tile_offers(s: SparkSession, d: str) -> DataFrame:
    base = spread(s, d, "part", "p_partkey")
    title = F.expr(_TITLE)
    listing = base.select(F.col("p_partkey").alias("query_id"), F.lit(0).alias("seq"), F.lit("https://www.shop.ca/collections/all").alias("url"), F.lit("All bags").alias("title"), F.lit(None).cast("string").alias("content"), F.expr(_TILES).alias("raw"))
    own = base.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("query_id"), F.lit(1).alias("seq"), F.concat(F.lit("https://www.shop.ca/products/"), F.col("p_partkey")).alias("url"), title.alias("title"), F.lit(None).cast("string").alias("content"), F.lit("").alias("raw"))
    pages = listing.union(own)
    found = p.analysed(pages)
    return p.tile_offers(pages, found, F.lit("traveller widget")).select("query_id", "retailer", "title", "price", "url")


Q.add("e9_tile_offers", _tile_offers, f"""SELECT p_partkey AS query_id, 'Shop.ca' AS retailer, {_TITLE} AS title, round((100 + p_partkey % 900 + 0.99)::DOUBLE, 2) AS price,
  CASE WHEN p_partkey % 2 = 0 THEN concat('https://www.shop.ca/products/', p_partkey) ELSE 'https://www.shop.ca/collections/all' END AS url FROM part WHERE p_name LIKE '% widget'""")

_SEQ = "p_partkey % 6"
_LISTED = """concat('Maker', cast(p_partkey div 6 AS VARCHAR(9)), CASE p_partkey % 6 WHEN 0 THEN ' Alphaline Voyage 21\" Spinner Black' WHEN 1 THEN ' Voyage Alphaline 21 inch Suitcase ice blue' WHEN 2 THEN ' Alphaline Voyage 28\" Spinner'
  WHEN 3 THEN ' Basecamp 3 Duffel Walmart.ca' WHEN 4 THEN ' Alphaline Voyage Luggage Cover' ELSE ' Basecamp 2 Duffel' END)"""


def _offers(s: SparkSession, d: str) -> DataFrame:
    price = "cast(100 + 10 * (p_partkey % 6) + p_partkey div 6 % 50 AS DOUBLE)"
    key = "CASE p_partkey % 6 WHEN 1 THEN 'Samsonite.ca' WHEN 0 THEN 'Walmart.ca' END"
    return _parts(s, d, query_id="p_partkey div 6", seq=_SEQ, title=_LISTED, retailer="cast(p_partkey % 6 AS VARCHAR(9))", retailer_key=key, price=price)


Q.add("x20_clusters", lambda s, d: c.clusters(_offers(s, d)).select("query_id", "seq", "founder"), "SELECT p_partkey // 6 AS query_id, p_partkey % 6 AS seq, CASE p_partkey % 6 WHEN 1 THEN 0 ELSE p_partkey % 6 END AS founder FROM part")
Q.add("e10_products", lambda s, d: c.products(c.clusters(_offers(s, d))).select("query_id", "founder", "name", "brand", "colour", "size", F.array_join("colours", ",").alias("colours"), "lowest_price", "highest_price", "retailer_count", "spread", "has_major"), """
WITH o AS (SELECT p_partkey // 6 AS query_id, p_partkey % 6 AS seq, CASE p_partkey % 6 WHEN 1 THEN 0 ELSE p_partkey % 6 END AS founder, CAST(100 + 10 * (p_partkey % 6) + p_partkey // 6 % 50 AS DOUBLE) AS price FROM part
), g AS (SELECT query_id, founder, count(*) AS n, min(price) AS lo, max(price) AS hi, bool_or(seq = 0) AS major, bool_or(seq = 1) AS store FROM o GROUP BY 1, 2)
SELECT query_id, founder, concat('Maker', query_id, CASE WHEN store THEN ' Voyage Alphaline 21 inch Suitcase ice blue' WHEN founder = 0 THEN ' Alphaline Voyage 21" Spinner Black' WHEN founder = 2 THEN ' Alphaline Voyage 28" Spinner'
    WHEN founder = 3 THEN ' Basecamp 3 Duffel' WHEN founder = 4 THEN ' Alphaline Voyage Luggage Cover' ELSE ' Basecamp 2 Duffel' END) AS name, concat('Maker', query_id) AS brand,
  CASE founder WHEN 0 THEN 'Black' ELSE '' END AS colour, CASE founder WHEN 0 THEN '21 inch' WHEN 2 THEN '28 inch' ELSE '' END AS size, CASE WHEN founder = 0 AND store THEN 'Black,Ice Blue' WHEN founder = 0 THEN 'Black' ELSE '' END AS colours,
  lo AS lowest_price, hi AS highest_price, n AS retailer_count, CASE WHEN founder = 0 AND store THEN 10.0 ELSE 0.0 END::DOUBLE AS spread, major AS has_major FROM g""")


def _matches(s: SparkSession, d: str) -> DataFrame:
    found = _parts(s, d, product_id="p_partkey div 4", seq="p_partkey % 4", name="p_name", upc="CASE WHEN p_partkey % 4 = 3 AND p_partkey % 8 = 3 THEN cast(p_partkey div 4 AS VARCHAR(9)) END", brand="CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE 'MAKER inc' END", model="CASE WHEN p_partkey % 4 = 1 THEN 'alpha one' ELSE 'beta' END", retailer_count="cast(p_partkey % 12 AS BIGINT)")
    known = _parts(s, d, product_id="p_partkey", upc="cast(p_partkey AS VARCHAR(9))", brand="CASE WHEN p_partkey % 5 = 0 THEN 'zzz' ELSE 'maker' END", model="CASE WHEN p_partkey % 3 = 0 THEN 'Alpha One xy' ELSE 'gamma' END")
    return c.best_matches(found, known, "product_id").select("product_id", F.col("seq").cast("long").alias("seq"), F.col("score").cast("long").alias("score"))


Q.add("n6_best_match", _matches, """
WITH f AS (SELECT p_partkey // 4 AS product_id, p_partkey % 4 AS seq, p_partkey % 8 = 3 AS coded, p_partkey % 12 AS stores FROM part), s AS (
  SELECT product_id, seq, CASE WHEN coded THEN 100 ELSE 0 END + CASE WHEN seq <> 0 AND product_id % 5 <> 0 THEN 20 ELSE 0 END + CASE WHEN seq = 1 AND product_id % 3 = 0 THEN 16 ELSE 0 END + least(stores, 8) AS score
  FROM f WHERE product_id IN (SELECT p_partkey FROM part))
SELECT product_id, seq, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY score DESC, seq) = 1 AND score >= 12""")

_LD = """concat('<html><head><meta property="og:type" content="product"><meta content="', cast(p_partkey AS VARCHAR(9)), '.5" property="og:price:amount"><meta name="other" content="x"></head>
<script type="application/ld+json">', CASE p_partkey % 4 WHEN 0 THEN concat('{"@type":"Product","name":"', p_name, '","brand":{"@type":"Brand","name":"', p_brand, '"},"gtin12":"0432-', cast(p_partkey AS VARCHAR(9)), '","offers":[{"@type":"Offer","price":"$1,', cast(100 + p_size AS VARCHAR(9)), '.5","priceCurrency":"CAD"}]}')
  WHEN 1 THEN concat('{"@graph":[{"@type":"BreadcrumbList"},{"@type":["ProductGroup"],"name":"', p_name, '","offers":{"@type":"AggregateOffer","lowPrice":', cast(p_size AS VARCHAR(9)), ',"highPrice":99,"priceCurrency":"CAD"}}]}')
  WHEN 2 THEN concat('{"@type":"ItemPage","mainEntity":{"@type":"Product","name":"', p_name, '","sku":7,"offers":{"price":', cast(p_size AS VARCHAR(9)), ',"priceSpecification":{"priceType":"StrikethroughPrice","price":120,"priceCurrency":"USD"}}}}')
  ELSE '{oops' END, '</script></html>')"""


def _structured(s: SparkSession, d: str) -> DataFrame:
    x = st.extracted(_parts(s, d, html=_LD))
    one = F.try_element_at("products", F.lit(1))
    offer = F.try_element_at(one["offers"], F.lit(1))
    return x.select("id", "parse_errors", F.col("meta")["og:price:amount"].alias("amount"), F.size("meta").alias("tags"), one["name"].alias("name"), one["brand"].alias("brand"), one["gtin"].alias("gtin"), offer["price"].alias("price"), offer["currency"].alias("currency"), offer["list_price"].alias("list_price"))


Q.add("s12_structured", _structured, f"""SELECT id, CASE WHEN p_partkey % 4 = 3 THEN 1 ELSE 0 END AS parse_errors, concat(p_partkey, '.5') AS amount, 2 AS tags, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS name, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 4 = 0 THEN concat('0432', p_partkey) END AS gtin, CASE p_partkey % 4 WHEN 0 THEN 1100.5 + p_size WHEN 1 THEN p_size WHEN 2 THEN p_size END::DOUBLE AS price,
  CASE p_partkey % 4 WHEN 0 THEN 'CAD' WHEN 1 THEN 'CAD' WHEN 2 THEN 'USD' END AS currency, CASE p_partkey % 4 WHEN 1 THEN 99.0 WHEN 2 THEN 120.0 END::DOUBLE AS list_price FROM ({_PARTS})""")
_SHOP = """concat('{"product":{"id":', cast(p_partkey AS VARCHAR(9)), ',"title":"', p_name, '","variants":[{"id":1,"price":"', cast(p_size AS VARCHAR(9)), '.25","compare_at_price":"","sku":"s"},{"id":2,"price":"9","barcode":"b"}]}}')"""
_SHOP_CENTS = """concat('{"id":', cast(p_partkey AS VARCHAR(9)), ',"title":"', p_name, '","variants":[{"id":1,"price":', cast(p_size AS VARCHAR(9)), '25,"available":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}]}')"""


def _shop(s: SparkSession, d: str) -> DataFrame:
    x = _parts(s, d, a=_SHOP, b=_SHOP_CENTS).select("id", sh.variants(F.col("a"), False).alias("a"), sh.variants(F.col("b"), True).alias("b"))
    return x.select("id", F.col("a.title").alias("title"), F.col("a.variants")[0]["price"].alias("price"), F.col("b.variants")[0]["price"].alias("cents_price"), F.col("b.variants")[0]["available"].alias("available"), F.array_join("a.fields", ",").alias("fields"))


Q.add("s13_shop_documents", _shop, f"SELECT id, p_name AS title, (p_size + 0.25)::DOUBLE AS price, (p_size + 0.25)::DOUBLE AS cents_price, p_size % 2 = 0 AS available, 'product.id,product.title,product.variants,variant.barcode,variant.compare_at_price,variant.id,variant.price,variant.sku' AS fields FROM ({_PARTS})")
_STREAM = """CASE p_partkey % 3 WHEN 0 THEN concat('event: message', chr(10), 'data: {"result":{"structuredContent":{"n":', cast(p_partkey AS VARCHAR(9)), '}}}', chr(10), 'data: {oops', chr(10)) WHEN 1 THEN '{"error":{"code":-32602,"message":"Invalid profile"}}' ELSE 'nothing' END"""


def _stream(s: SparkSession, d: str) -> DataFrame:
    t = _parts(s, d, body=_STREAM).select("id", j.tool_result(j.stream_message(F.col("body"), F.lit(None).cast("string"))).alias("t"))
    return t.select("id", "t.ok", "t.error", F.get_json_object("t.result", "$.n").cast("long").alias("n"))


Q.add("s14_stream_results", _stream, f"SELECT id, p_partkey % 3 = 0 AS ok, CASE p_partkey % 3 WHEN 1 THEN '-32602 Invalid profile' WHEN 2 THEN 'unparseable response' END AS error, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS n FROM ({_PARTS})")
Q.add("js1_tolerant_json", lambda s, d: _parts(s, d, t="CASE p_size % 3 WHEN 0 THEN concat('{\"a\":', cast(p_size AS VARCHAR(9)), '}') WHEN 1 THEN concat('see: {\"a\":', cast(p_size AS VARCHAR(9)), '} ok') ELSE 'a: 5' END").select("id", F.get_json_object(j.tolerant(F.col("t")), "$.a").cast("long").alias("a")), f"SELECT id, CASE WHEN p_size % 3 < 2 THEN p_size::BIGINT END AS a FROM ({_PARTS})")
_ROBOTS = """CASE s_suppkey % 4 WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /cart', chr(10), 'Allow: /cart$', chr(10), 'Disallow: /*sort=', chr(10), 'Crawl-delay: 7', chr(10), 'Sitemap: https://x.ca/s.xml')
  WHEN 1 THEN concat('User-agent: *', chr(10), 'Disallow:', chr(10), chr(10), 'User-agent: other', chr(10), 'User-agent: PriceReader', chr(10), 'Disallow: / # all') ELSE '' END"""


def _robots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = table(s, d, "supplier").select(F.col("s_suppkey").alias("host"), F.expr("CASE s_suppkey % 4 WHEN 2 THEN 404 WHEN 3 THEN 503 ELSE 200 END").alias("status"), F.expr(_ROBOTS).alias("text"))
    return files, cr.robots_rules(files, "PriceReader/1.0")


Q.add("s15_robots", lambda s, d: _robots(s, d)[1].select("host", "grp", "delay", F.array_join("sitemaps", ",").alias("sitemaps"), F.size("rules").alias("n_rules")), "SELECT s_suppkey AS host, CASE s_suppkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'named' ELSE 'none' END AS grp, CASE WHEN s_suppkey % 4 = 0 THEN 7.0 END::DOUBLE AS delay, CASE WHEN s_suppkey % 4 = 0 THEN 'https://x.ca/s.xml' ELSE '' END AS sitemaps, CASE s_suppkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n_rules FROM supplier")


def _may(s: SparkSession, d: str) -> DataFrame:
    files, rules = _robots(s, d)
    paths = F.explode(F.array(*map(F.lit, ("/cart", "/cart/x", "/p?sort=1", "/p%20a", "/")))).alias("path")
    return cr.allowed(files.select("host", paths).select("host", F.concat(F.lit("https://x.ca"), "path").alias("url")), rules)


Q.add("f20_robots_allow", _may, "SELECT s_suppkey AS host, 'https://x.ca' || path AS url, CASE s_suppkey % 4 WHEN 0 THEN path NOT IN ('/cart/x', '/p?sort=1') WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS allowed FROM supplier, (SELECT unnest(['/cart', '/cart/x', '/p?sort=1', '/p%20a', '/']) AS path)")
Q.add("s16_sitemap", lambda s, d: _parts(s, d, t="concat('<urlset><url><loc> https://x.ca/products/', cast(p_partkey AS VARCHAR(9)), '?a=1&amp;b=2 </loc>', CASE WHEN p_size % 2 = 0 THEN '<lastmod>2024</lastmod>' ELSE '' END, '</url><url><loc>https://x.ca/blog/</loc></url></urlset>')").select("id", cr.sitemap(F.col("t")).alias("m")).select("id", F.col("m.locations")[0].alias("first_url"), F.size("m.locations").alias("n"), "m.products", "m.dated"), f"SELECT id, concat('https://x.ca/products/', p_partkey, '?a=1&b=2') AS first_url, 2 AS n, 1 AS products, p_size % 2 = 0 AS dated FROM ({_PARTS})")
_STATUS = "CASE p_size % 7 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 403 WHEN 4 THEN 503 WHEN 5 THEN 401 ELSE 422 END"
_BODY = "CASE WHEN p_partkey % 2 = 0 THEN '<title>Just a moment' ELSE 'credit' END"
Q.add("f23_fetch_outcome", lambda s, d: _parts(s, d, status=_STATUS, body=_BODY).select("id", cr.outcome(F.col("status"), F.col("body")).alias("value")), f"SELECT id, CASE p_size % 7 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'challenge' ELSE 'ok' END WHEN 1 THEN 'not_found' WHEN 2 THEN 'rate_limited' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'challenge' ELSE 'blocked' END WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 'challenge' ELSE 'error' END WHEN 5 THEN 'blocked' ELSE 'error' END AS value FROM ({_PARTS})")
Q.add("f22_http_failure", lambda s, d: _parts(s, d, status=_STATUS, body=_BODY).select("id", cr.http_failure(F.col("status"), F.col("body")).alias("x")).select("id", "x.*"), f"SELECT id, kind, kind IN ('quota', 'timeout', 'server', 'unknown') AS consumed, kind IN ('timeout', 'server', 'network', 'rate_limit') AS retryable FROM (SELECT id, CASE p_size % 7 WHEN 2 THEN 'rate_limit' WHEN 3 THEN 'auth' WHEN 4 THEN 'server' WHEN 5 THEN 'auth' WHEN 6 THEN 'bad_request' ELSE CASE WHEN p_partkey % 2 = 1 THEN 'quota' ELSE 'unknown' END END AS kind FROM ({_PARTS}))")
Q.add("f24_needs_script", lambda s, d: _parts(s, d, html="concat('<noscript>You need to enable JavaScript</noscript>', CASE WHEN p_size % 2 = 0 THEN '<script type=\"application/ld+json\">' ELSE '' END)").select("id", st.needs_script(F.col("html")).alias("value")), f"SELECT id, p_size % 2 = 1 AS value FROM ({_PARTS})")
_CHANNEL, _TERMS = "CASE p_size % 3 WHEN 0 THEN 'ucp' WHEN 1 THEN 'json' ELSE 'html' END", "CASE p_partkey % 4 WHEN 0 THEN 'restricts' WHEN 1 THEN 'silent' WHEN 2 THEN 'unknown' ELSE 'sanctions_json' END"
Q.add("f28_permission", lambda s, d: _parts(s, d, a=_CHANNEL, b=_TERMS, ok="p_size % 5 <> 0").select("id", cr.permission(F.col("a"), F.col("b"), F.col("ok")).alias("value")), f"""SELECT id, CASE WHEN p_size % 5 = 0 THEN 'no: robots' WHEN p_size % 3 = 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 'yes: agent channel, with sign-off' ELSE 'yes: agent channel' END
  WHEN p_partkey % 4 = 0 THEN 'no: terms' WHEN p_partkey % 4 = 1 THEN 'likely' WHEN p_partkey % 4 = 2 THEN 'unclear' WHEN p_size % 3 = 1 THEN 'yes: listed for agents' ELSE 'likely' END AS value FROM ({_PARTS})""")


def _feed(s: SparkSession, d: str) -> DataFrame:
    link = "CASE p_partkey % 4 WHEN 0 THEN concat('https://shop.ca/p/', cast(p_partkey AS VARCHAR(9))) WHEN 1 THEN concat('https://www.google.ca/url?x=1&q=https%3A%2F%2Fwalmart.ca%2Fip%2F', cast(p_partkey AS VARCHAR(9))) WHEN 2 THEN 'https://www.google.ca/shopping/1' END"
    rows = _parts(s, d, title="CASE WHEN p_size % 9 = 0 THEN ' ' ELSE p_name END", link=link, product_link="cast(NULL AS VARCHAR(9))", price="CASE WHEN p_size % 2 = 0 THEN concat('CA$1,', cast(100 + p_size AS VARCHAR(9)), '.50') END", extracted_price="CASE WHEN p_size % 2 = 1 THEN cast(p_size AS DOUBLE) END", source="CASE WHEN p_partkey % 4 = 2 THEN 'Costco Canada' END")
    return sh.feed_offers(rows).select("id", "title", "url", "price", "retailer")


Q.add("s7_feed_offers", _feed, f"""SELECT id, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN concat('https://shop.ca/p/', p_partkey) WHEN 1 THEN concat('https://walmart.ca/ip/', p_partkey) ELSE 'https://www.google.ca/shopping/1' END AS url,
  CASE WHEN p_size % 2 = 0 THEN 1100.5 + p_size ELSE p_size END::DOUBLE AS price, CASE p_partkey % 4 WHEN 0 THEN 'shop.ca' WHEN 1 THEN 'Walmart.ca' ELSE 'Costco.ca' END AS retailer FROM ({_PARTS}) WHERE p_partkey % 4 < 3 AND p_size % 9 <> 0""")
Q.add("s8_merchant_feed", lambda s, d: sh.feed_offers(_feed_rows(s, d), need_link=True).select("id", "url", "price"), f"SELECT id, concat('https://shop.ca/p/', p_partkey) AS url, p_size::DOUBLE AS price FROM ({_PARTS}) WHERE p_partkey % 3 = 0")
Q.add("s10_known_retailer_lows", lambda s, d: sh.known_retailer_lows(_feed_rows(s, d)), f"SELECT CASE p_partkey % 3 WHEN 1 THEN 'Costco.ca' ELSE 'Walmart.ca' END AS retailer, min(p_size)::DOUBLE AS price FROM ({_PARTS}) WHERE p_partkey % 3 > 0 GROUP BY 1")
Q.add("a18_colour_union", lambda s, d: c.products(_coloured(s, d)).select("query_id", F.array_join("colours", ",").alias("colours")), """SELECT p_partkey // 3 AS query_id, array_to_string(list_filter(['Navy', CASE WHEN count(*) > 1 THEN 'Ice Blue' END, CASE WHEN count(*) > 2 THEN 'teal' END], lambda v: v IS NOT NULL), ',') AS colours FROM part GROUP BY 1""")
Q.add("a23_fields_seen", lambda s, d: _parts(s, d, t=_SHOP).select(F.explode(sh.variants(F.col("t"), False)["fields"]).alias("field")).groupBy("field").agg(F.count("*").alias("n")), f"SELECT unnest(['product.id', 'product.title', 'product.variants', 'variant.barcode', 'variant.compare_at_price', 'variant.id', 'variant.price', 'variant.sku']) AS field, count(*) AS n FROM ({_PARTS}) GROUP BY 1")
Q.add("j6_same_product", lambda s, d: _pairs(s, d), "SELECT p_partkey AS id, p_partkey % 6 IN (0, 3) AS value FROM part")


def _feed_rows(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d, title="p_name", link="CASE WHEN p_partkey % 3 = 0 THEN concat('https://shop.ca/p/', cast(p_partkey AS VARCHAR(9))) ELSE 'https://www.google.ca/shopping/1' END", product_link="cast(NULL AS VARCHAR(9))", price="cast(NULL AS VARCHAR(9))", extracted_price="cast(p_size AS DOUBLE)", source="CASE p_partkey % 3 WHEN 1 THEN 'Costco Canada' WHEN 2 THEN 'Walmart Canada - Seller' ELSE 'shop' END")


def _coloured(s: SparkSession, d: str) -> DataFrame:
    title = "CASE p_partkey % 3 WHEN 0 THEN 'Maker Alphaline navy' WHEN 1 THEN 'Maker Alphaline NAVY' ELSE 'Maker Alphaline' END"
    own = "CASE p_partkey % 3 WHEN 1 THEN array('Ice Blue', 'navy') WHEN 2 THEN array('teal', 'ice blue') END"
    return _parts(s, d, query_id="p_partkey div 3", seq="p_partkey % 3", founder="0", title=title, colours=own, retailer="'x'", retailer_key="cast(NULL AS VARCHAR(9))", price="1.0D")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    other = """CASE p_partkey % 6 WHEN 0 THEN 'Alphaline Maker spinner 21 inch red Voyage' WHEN 1 THEN 'Maker Alphaline Voyage 28 inch' WHEN 2 THEN 'Other Alphaline Voyage' WHEN 3 THEN 'maker voyage alphaline with many further selling words here' WHEN 4 THEN 'Maker Alphaline Voyage Cover' ELSE 'Maker Basecamp' END""".replace("'Alphaline Maker spinner", "'Maker Alphaline spinner")
    return _parts(s, d, a="'Maker Alphaline Voyage 21 inch'", b=other).select("id", c.same_product(c.identity(F.col("a")), c.identity(F.col("b"))).alias("value"))
_AGENT = """concat('{"products":[{"id":"gid://shopify/Product/', cast(p_partkey AS VARCHAR(9)), '","title":"', p_name, '","variants":[{"id":"v","sku":"s","barcodes":[{"type":"UPC","value":"0', cast(p_partkey AS VARCHAR(9)), '"}],"price":{"amount":', cast(p_size AS VARCHAR(9)), '50,"currency":"CAD"},"availability":{"available":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}}]},{"id":"other"}]}')"""


def _agent(s: SparkSession, d: str) -> DataFrame:
    x = _parts(s, d, t=_AGENT).select("id", sh.agent_products(F.col("t")).alias("p"))
    v = F.col("p")[0]["variants"][0]
    return x.select("id", F.size("p").alias("n"), F.col("p")[0]["title"].alias("title"), v["price"].alias("price"), v["currency"].alias("currency"), v["barcode"].alias("barcode"), v["available"].alias("available"))


Q.add("js4_agent_products", _agent, f"SELECT id, 1 AS n, p_name AS title, (p_size + 0.5)::DOUBLE AS price, 'CAD' AS currency, concat('0', p_partkey) AS barcode, p_size % 2 = 0 AS available FROM ({_PARTS})")
Q.add("js5_meta_tags", lambda s, d: _parts(s, d, html=_LD).select("id", F.explode(st.meta_tags(F.col("html"))).alias("key", "value")), f"SELECT id, 'og:type' AS key, 'product' AS value FROM ({_PARTS}) UNION ALL SELECT id, 'og:price:amount', concat(p_partkey, '.5') FROM ({_PARTS})")
Q.add("js2_product_nodes", lambda s, d: st.extracted(_parts(s, d, html=_LD)).select("id", F.size("products").alias("n"), "blocks"), f"SELECT id, CASE WHEN p_partkey % 4 < 3 THEN 1 ELSE 0 END AS n, 1 AS blocks FROM ({_PARTS})")
Q.add("x9_colour_options", lambda s, d: _parts(s, d, text=_SPECS).select("id", F.array_join(p.colour_options(F.col("text")), ",").alias("value")), f"SELECT id, 'Ice Blue,Jet Black,Blue,Rose Gold' AS value FROM ({_PARTS})")
