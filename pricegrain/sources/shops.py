"""Product documents of shops: variants with prices as decimals or in cents, agent tool results, feeds of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.functions import urls
from pricegrain.functions.numbers import parse_price
from pricegrain.sources.jsons import items, keys, strict_number, valid, words

_VARIANT = "struct<id:string,title:string,sku:string,barcode:string,price:string,compare_at_price:string,price_currency:string,available:string,inventory_quantity:string,option1:string,option2:string,option3:string,options:string>"
_SHOP = "struct<id:string,title:string,vendor:string,product_type:string,type:string,updated_at:string,variants:string>"
_UCP = "struct<id:string,title:string,vendor:string,variants:string>"
_UCP_VARIANT = "struct<id:string,title:string,sku:string,barcodes:array<struct<type:string,value:string>>,price:struct<amount:string,currency:string>,list_price:struct<amount:string,currency:string>,availability:struct<available:boolean>,options:array<struct<name:string,label:string>>>"
#: Wrappers of a merchant's address in a feed's link, in the order they are tried.
LINK_FIELDS = ("q", "url", "adurl", "dest")


def _plain(value: Column) -> Column:
    return F.when(~F.ltrim(value).rlike(r"^[\[{]"), F.nullif(F.trim(value), F.lit("")))


def variants(document: Column, cents: bool) -> Column:
    """A shop's product document as a struct, null if it is none.

    With cents the product is the document itself and prices are in cents; else it stands under "product"
    and prices are decimals. fields: all names of fields that occur, sorted.
    """
    inner = document if cents else F.get_json_object(document, "$.product")
    p = F.from_json(inner, _SHOP)
    scale = 100.0 if cents else 1.0
    texts = F.filter(items(p["variants"]), lambda v: F.ltrim(v).startswith("{"))

    def one(text: Column) -> Column:
        v = F.from_json(text, _VARIANT)
        options = items(v["options"]) if cents else F.array(v["option1"], v["option2"], v["option3"])
        available = F.when(v["available"].isin("true", "false"), v["available"] == "true")
        fields = {
            "id": F.coalesce(v["id"], F.lit("")), "title": _plain(v["title"]), "sku": _plain(v["sku"]), "barcode": _plain(v["barcode"]), "price": strict_number(v["price"]) / scale,
            "compare_at": strict_number(v["compare_at_price"]) / scale, "currency": F.lit(None).cast("string") if cents else _plain(v["price_currency"]), "available": available,
            "inventory": strict_number(v["inventory_quantity"]), "options": F.filter(F.transform(options, _plain), lambda o: o.isNotNull()),
        }
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    names = F.array_union(F.transform(keys(inner), lambda k: F.concat(F.lit("product."), k)), F.transform(F.array_distinct(F.flatten(F.transform(texts, keys))), lambda k: F.concat(F.lit("variant."), k)))
    good = valid(inner).isNotNull() & ((p["variants"].isNotNull() & F.ltrim(p["variants"]).startswith("[")) if cents else F.ltrim(inner).startswith("{"))
    kind = p["type"] if cents else p["product_type"]
    updated = F.lit(None).cast("string") if cents else _plain(p["updated_at"])
    return F.when(good, F.struct(_plain(p["id"]).alias("id"), _plain(p["title"]).alias("title"), _plain(p["vendor"]).alias("vendor"), _plain(kind).alias("type"), updated.alias("updated_at"), F.transform(texts, one).alias("variants"), F.array_sort(names).alias("fields")))


def agent_products(result: Column) -> Column:
    """Products in a tool's result: objects under "products" (or the result itself) whose id is a shop's product id; prices are in minor units."""
    listed = F.concat(items(F.get_json_object(result, "$.products")), items(F.get_json_object(result, "$.product")), F.array(result))
    mine = F.filter(listed, lambda p: F.coalesce(F.get_json_object(p, "$.id"), F.lit("")).rlike(r"^gid://shopify/Product/\d+"))

    def variant(text: Column) -> Column:
        v = F.from_json(text, _UCP_VARIANT)
        code = F.try_element_at(v["barcodes"], F.lit(1))["value"]
        return F.struct(
            v["id"].alias("id"), v["sku"].alias("sku"), code.alias("barcode"), (strict_number(v["price"]["amount"]) / 100).alias("price"), v["price"]["currency"].alias("currency"),
            (strict_number(v["list_price"]["amount"]) / 100).alias("compare_at"), v["availability"]["available"].alias("available"), F.transform(v["options"], lambda o: o["label"]).alias("options"),
        )

    def product(text: Column) -> Column:
        p = F.from_json(text, _UCP)
        return F.struct(p["id"].alias("id"), p["title"].alias("title"), F.transform(items(p["variants"]), variant).alias("variants"))

    return F.transform(mine, product)


def same_prices(a: DataFrame, b: DataFrame, slack: float = 0.005) -> DataFrame:
    """(key, numeric_id, price, other_price, agrees) of variants (key, id, price) that two channels have by the digits at the end of their ids."""
    numeric = lambda df: df.withColumn("numeric_id", F.regexp_extract("id", r"(\d+)$", 1)).where("numeric_id <> ''")
    other = numeric(b).select("key", "numeric_id", F.col("price").alias("other_price"))
    return numeric(a).join(other, ["key", "numeric_id"]).select("key", "numeric_id", "price", "other_price", (F.abs(F.col("price") - F.col("other_price")) <= slack).alias("agrees"))


def shared_barcodes(listings: DataFrame) -> DataFrame:
    """(barcode, stores, shared) of each barcode in listings (barcode, store)."""
    known = listings.where(F.coalesce("barcode", F.lit("")) != "").groupBy("barcode").agg(F.countDistinct("store").alias("stores"))
    return known.withColumn("shared", F.col("stores") > 1)


def merchant_link(link: Column, product_link: Column) -> Column:
    """(url, direct): the merchant's own address, as it is or as an aggregator's link carries it, else the aggregator's; null without one."""
    web = lambda u: F.when(u.rlike("(?i)^https?://"), u)
    inner = lambda u: [F.try_url_decode(F.try_parse_url(u, F.lit("QUERY"), F.lit(k))) for k in LINK_FIELDS]
    direct = F.coalesce(*(F.when(urls.is_merchant(c), c) for u in (web(link), web(product_link)) for c in (u, *inner(u))))
    found = F.coalesce(direct, web(link), web(product_link))
    return F.when(found.isNotNull(), F.struct(found.alias("url"), direct.isNotNull().alias("direct")))


def feed_offers(rows: DataFrame, need_link: bool = False) -> DataFrame:
    """Offers from a shopping feed (title, link, product_link, price text, extracted_price, source): those with an address (with need_link a merchant's own), a title and a price above zero."""
    price = F.coalesce(F.col("extracted_price"), parse_price(F.col("price")))
    made = rows.select("*", merchant_link(F.col("link"), F.col("product_link")).alias("_link"), price.alias("_price"), F.trim("title").alias("_title")).withColumn("url", F.col("_link.url"))
    good = made.where((F.col("_link.direct") if need_link else F.col("url").isNotNull()) & (F.col("_price") > 0) & (F.coalesce("_title", F.lit("")) != ""))
    return good.select(*(c for c in rows.columns if c not in ("price", "title", "url")), F.col("_title").alias("title"), "url", F.col("_price").alias("price"), F.coalesce(urls.retailer_of(F.col("source"), F.col("url")), words(F.col("source")), urls.host(F.col("url"))).alias("retailer"))


def known_retailer_lows(rows: DataFrame) -> DataFrame:
    """(retailer, price) of feed rows by known retailers: each one's least price."""
    return rows.select(urls.retailer_of(F.col("source"), F.col("link")).alias("retailer"), F.coalesce(F.col("extracted_price"), parse_price(F.col("price"))).alias("price")).where("retailer is not null and price > 0").groupBy("retailer").agg(F.min("price").alias("price"))
