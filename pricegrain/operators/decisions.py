"""Small decisions around a search: what is valid, allowed, worth reading, shown first or suggested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.functions import text, urls
from pricegrain.functions.numbers import cents
from pricegrain.functions.vocabulary import RETAILERS

# Retailers that count whatever a user's settings say, and defaults of the settings.
ALWAYS = ("Amazon.ca", "Walmart.ca", "Samsonite.ca")
SETTINGS = {"timezone": "America/Edmonton", "daily_report": True, "include_drops": True, "include_increases": True, "include_oos": True, "include_summary": True}
MOST_PRICE, LONGEST_TITLE = 100_000, 300


def brand_store(query: Column) -> Column:
    """The store of the brand that a query names; null if it names none."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower(query), r"[^a-z0-9&\s]", " "), r"\s+", " "), F.lit(" "))
    out = F.lit(None).cast("string")
    for r in reversed([r for r in RETAILERS if r.category == "specialty"]):
        brand = r.name.lower().removesuffix(".ca").removesuffix(".com")
        first = brand.split()[0]
        named = padded.contains(f" {brand} ") | (padded.contains(f" {first} ") if len(first) >= 5 else F.lit(False))
        out = F.when(named, r.name).otherwise(out)
    return out


def allow_list(user_list: Column, query: Column, whole: Column) -> Column:
    """The retailers that count for a query: the user's, those that always do, and the brand's store; none (all count) if whole or the user has none."""
    listed = F.array_distinct(F.array_compact(F.concat(user_list, F.array(*map(F.lit, ALWAYS), brand_store(query)))))
    return F.when(whole | (F.size(F.coalesce(user_list, F.array().cast("array<string>"))) == 0), F.array().cast("array<string>")).otherwise(listed)


def valid_offers(offers: DataFrame) -> DataFrame:
    """Offers with a web address, a price in (0, MOST_PRICE] and a retailer; prices in cents, long titles cut, a missing title is the retailer."""
    url, retailer = F.trim(F.coalesce("url", F.lit(""))), F.trim(F.coalesce("retailer", F.lit("")))
    price = F.col("price").try_cast("double")
    good = url.startswith("http") & price.isNotNull() & ~F.isnan(price) & (price > 0) & (price <= MOST_PRICE) & (retailer != "")
    return offers.where(good).withColumns({"url": url, "retailer": retailer, "price": cents(price), "title": F.coalesce(F.substring("title", 1, LONGEST_TITLE), retailer)})


def valid_products(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products (product_id, name, upc) with a name and a valid offer; a barcode counts with 12 to 14 digits. Adds the prices' range."""
    name, upc = F.trim(F.coalesce("name", F.lit(""))), F.regexp_replace(F.coalesce("upc", F.lit("")), r"\D", "")
    ranges = valid_offers(offers).groupBy("product_id").agg(F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"), F.count("*").alias("retailer_count"))
    kept = products.where(name != "").withColumns({"name": F.substring(name, 1, 200), "upc": F.when(F.length(upc).between(12, 14), upc)})
    return kept.join(ranges, "product_id").withColumn("spread", cents(F.col("highest_price") - F.col("lowest_price")))


def with_defaults(users: DataFrame, settings: DataFrame, email: str) -> DataFrame:
    """Every user's settings, with defaults where there is no row or no value; email names the users' own address column."""
    rows = users.join(settings, "user_id", "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in SETTINGS.items() if c in settings.columns}
    filled["report_email"] = F.coalesce("report_email", email, F.lit(""))
    filled["retailers"] = F.coalesce("retailers", F.array(*(F.lit(r.name) for r in RETAILERS)))
    return rows.withColumns(filled)


def _rank(retailer: Column) -> Column:
    of = lambda kind: retailer.isin([r.name for r in RETAILERS if r.category == kind])
    return F.when(of("specialty"), 0).when(of("major"), 1).otherwise(2)


def worth_reading(analysed: DataFrame, terms: Column, most: int = 10) -> DataFrame:
    """Of each query the pages (query_id, seq, url, title, retailer, reason) to read in full: brand stores, then large ones, product pages first."""
    wanted = F.size(text.query_words(terms))
    least = F.when(wanted <= 1, 1.0).otherwise(F.least(F.lit(1.0), 2.0 / wanted))
    match = text.query_match(F.concat_ws(" ", "retailer", F.coalesce("title", F.lit(""))), terms)
    rows = analysed.where((F.col("reason") == "no clear price on the page") & (match >= least))
    order = Window.partitionBy("query_id").orderBy(_rank(F.col("retailer")), F.when(urls.is_product_url(F.col("url")), 0).otherwise(1), "seq")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def unread(pages: DataFrame, priced: DataFrame) -> DataFrame:
    """pages whose address, in any spelling, has no price yet."""
    mark = lambda df: df.withColumn("_page", urls.canonical(F.col("url")))
    return mark(pages).join(mark(priced).select("_page").distinct(), "_page", "left_anti").select(*pages.columns)


def with_texts(pages: DataFrame, read: DataFrame) -> DataFrame:
    """pages with the text that was read for their address in any spelling; null where none was."""
    texts = read.groupBy(urls.canonical(F.col("url")).alias("_page")).agg(F.min("text").alias("read_text"))
    return pages.withColumn("_page", urls.canonical(F.col("url"))).join(texts, "_page", "left").drop("_page")


def also_check(unread_pages: DataFrame, terms: Column, most: int = 4) -> DataFrame:
    """Links to known stores' pages that match all words and have no readable price: one a store, the first few."""
    match = text.query_match(F.concat_ws(" ", "retailer", F.coalesce("title", F.lit(""))), terms)
    rows = unread_pages.where(F.col("retailer_key").isNotNull() & (match >= 0.99))
    first = rows.groupBy("query_id", "retailer").agg(F.min_by(F.struct("seq", "url", F.substring("title", 1, 120).alias("title")), "seq").alias("f")).select("query_id", "retailer", "f.*")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))).where(F.col("place") <= most)


def best_by_words(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (key, query, handle) the candidate (key, seq, title, handle) that shares most words, an equal handle counting 100; the first of equals."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 1)
    rows = candidates.join(queries.withColumnRenamed("handle", "_handle"), "key")
    hits = F.size(F.filter(words(F.col("query")), lambda w: F.array_contains(words(F.col("title")), w)))
    score = hits + F.when((F.col("_handle") != "") & (F.col("_handle") == F.col("handle")), 100).otherwise(0)
    best = rows.groupBy("key").agg(F.min(F.struct((-score).alias("minus"), "seq")).alias("b"))
    return best.select("key", F.col("b.seq").alias("seq"), (-F.col("b.minus")).alias("score"))


def suggestions(history: DataFrame, typed: Column, most: int = 8) -> DataFrame:
    """Of each user's past searches (user_id, query, ts) those that hold what is typed and are not it, the latest few."""
    fits = (typed == "") | (F.contains(F.lower("query"), F.lower(typed)) & (F.lower("query") != F.lower(typed)))
    return latest_once(history.where(fits), most)


def latest_once(history: DataFrame, most: int = 15) -> DataFrame:
    """Of each user the last searches, each once without regard to case, latest first."""
    last = history.groupBy("user_id", F.lower("query").alias("_q")).agg(F.max(F.struct("ts", "query")).alias("l")).select("user_id", "l.*")
    return last.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "query"))).where(F.col("place") <= most)


def last_rows(rows: DataFrame, by: str, order: str, most: int = 12) -> DataFrame:
    """The last rows of each group, such as a conversation's messages."""
    return rows.withColumn("_back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_back") <= most).drop("_back")


def chosen_series(wanted: Column, available: Column, most: int = 8) -> Column:
    """The chosen series that still exist, else the first few."""
    still = F.array_intersect(wanted, available)
    return F.slice(F.when(F.size(still) > 0, still).otherwise(available), 1, most)


def shop_sorted(products: DataFrame, by: str) -> DataFrame:
    """Of each query its products with their place: in their order, by price from the top, or by number of stores; the best tier always first."""
    order = {"rank": ["seq"], "price_down": [F.desc("lowest_price"), "seq"], "stores": [F.desc("retailer_count"), "seq"]}[by]
    return products.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", *order)))


def badges(ranked: DataFrame) -> DataFrame:
    """Ranked products (query_id, place, tier, relevance) with lowest (the badge of the first, if it fully matches) and related_from, where other products begin."""
    related = F.min(F.when(F.col("tier") > 0, F.col("place"))).over(Window.partitionBy("query_id"))
    return ranked.withColumns({"lowest": (F.col("place") == 1) & (F.col("relevance") >= 0.99), "related_from": related})


def all_stores(offers: DataFrame) -> DataFrame:
    """All offers of each query's products in one list, by tier and price."""
    return offers.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "price", "seq")))


def rejections(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """How many rows were refused for each reason."""
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def coverage(variants: DataFrame, fields: list[str]) -> DataFrame:
    """Of each product's variants (key, price, compare_at, ...): priced ones, all, the fields that none has, whether any is on sale, and whether prices differ."""
    missing = F.array_compact(F.array(*(F.when(F.count(f) == 0, F.lit(f)) for f in fields)))
    return variants.groupBy("key").agg(F.count("price").alias("priced"), F.count("*").alias("variants"), missing.alias("missing"), F.coalesce(F.bool_or(F.col("compare_at") > F.col("price")), F.lit(False)).alias("on_sale"), (F.countDistinct("price") > 1).alias("unstable"))


def untracked(products: DataFrame, tracked: DataFrame) -> DataFrame:
    """products (slug, upc) that no tracked one equals in slug, or in barcode where both have one."""
    by_slug = products.join(tracked.select("slug").distinct(), "slug", "left_anti")
    codes = tracked.where(F.coalesce("upc", F.lit("")) != "").select("upc").distinct()
    return by_slug.join(codes, "upc", "left_anti").select(*products.columns)


def filtered(rows: DataFrame, brand: str | None = None, stock: str | None = None, trend: str | None = None) -> DataFrame:
    """Tracked rows of a brand, in or out of stock, with a price that went up, down or stayed flat; None (or "all") leaves a filter out."""
    trends = {"up": F.col("change") > 0, "down": F.col("change") < 0, "flat": F.col("change") == 0}
    tests = [brand not in (None, "all") and (F.col("brand") == brand), stock not in (None, "all") and (F.col("in_stock") == (stock == "in")), trend not in (None, "all") and trends.get(trend)]
    for test in tests:
        rows = rows.where(test) if test is not False and test is not None else rows
    return rows


def faceted(products: DataFrame, **facets: object) -> DataFrame:
    """products with the wanted value in each facet; "all" takes any."""
    for name, value in facets.items():
        products = products if value == "all" else products.where(F.col(name) == value)
    return products
