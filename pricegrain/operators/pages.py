"""From page texts to offers: money amounts, the page's own price, stock, specifications, and why a page gives no offer.

A page has a url, a title, an excerpt (content) and a text (raw), any of which may be null. All of this
is a row's own affair: arrays of amounts are cut, judged and chosen from by expressions, so that no
operator here moves a row. An amount is a struct (start, stop, value, usd, in_row), in characters from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.functions import text as words
from pricegrain.functions import urls
from pricegrain.functions.amounts import AMOUNT, LOW, NUMBER, SCANNED, TRAILING, found
from pricegrain.functions.numbers import cents
from pricegrain.functions.vocabulary import ANCHOR_STOPWORDS, COLOUR_MODIFIERS, COLOURS, RETAILERS
from pricegrain.session import once

#: Prices that are believed, characters of a page that are looked at (what follows are footers), and of it those that tell a list of products.
HIGH, MOST_TEXT, LIST_TEXT, LIST_PRICES = 6000.0, 60_000, 12_000, 8

# Shapes of amounts, and what stands around those that are the price, or are not.
NEGATIVE_BEFORE = r"(?iu)(?:\bto|\d\s*[-–—]|save|you save|savings|off|reg\.?|regular(?: price)?|was|compare at|compared at|list price|list|original price|msrp|orders?(?: of| over)?|spend|over|shipping|delivery|gift card|coupon|rebate|reward|points|deposit|as low as|up to|payments? of|installments? of|valued at|value|économisez|prix courant|prix régulier|avant)\s*[:\-–]?\s*\z"
NEGATIVE_AFTER = r"(?iu)^\s*(?:(?:to|[-–—])\s*(?:CA\$|C\$|CAD|\$)\s?\d|/\s*(?:mo|month|wk|week|yr)\b|per\s+(?:mo|month|week|year)\b|a\s+month\b|monthly\b|x\s*\d|×\s*\d|off\b|savings?\b|discount\b|or more\b|and up\b|\+|/mois\b|par mois\b|de rabais\b)"
POSITIVE_BEFORE = r"(?iu)(?:price|sale|sale price|now|our price|your price|current price|special|today|deal|one-time purchase|prix|prix de vente|maintenant|solde)\s*[:\-–]?\s*\z"
WEAK_BEFORE = r"(?iu)(?:from|starting at|starts at|à partir de)\s*[:\-–]?\s*\z"
US_NEAR = r"(?i)\bUSD\b|\bUS\s?\$"
RELATED = r"(?iu)customers (?:also|who)|frequently bought|related products|you may also like|similar (?:items|products)|recently viewed|sponsored|more from|people also|complete the (?:set|look)|you might also|products related|compare with similar|shop similar|vous aimerez aussi|produits similaires|articles similaires"
GAP = r"\.\.\.|…|\[\s*\.\.\.\s*\]"
OWN_PRICE = r"(?iu)\bselected\b|add to (?:cart|bag|basket)|\bin stock\b|\bcolou?r\s*:|\bqty\b|\bquantity\b|\bsold by\b|\bships?\b|\bpickup\b|\bajouter au panier\b|\ben stock\b"
OUT_OF_STOCK = r"(?iu)\b(?:out of stock|sold out|currently unavailable|no longer available|discontinued|not available online|rupture de stock|épuisé|non disponible)\b"
CONNECTOR = r"(?iu)[\s.,·•|:–—-]*(?:(?:sale|our|your|special|now|current)\s+)?(?:price|prix)?[\s.,·•|:–—-]*\z"
BOUNDARY = r"(?:[.;·•|!?]\s|\n|\s{2,}|\bCAD\b|\$\s?\d[\d,.]*\s)"
TITLE_MARKS, TITLE_CUT = r"[™®©]", r"\s+[|–—]\s+|\s+-\s+|\s+:\s+|:\s+(?=Amazon)"
MODEL_INSIDE = r"(?i),?\s*\b(?:item\s*)?model\s*(?:number|no\.?|#)\s*[-:]?\s*[\w.-]*\d[\w.-]*"
MODEL_TAIL = r"(?is)[,\s]*\b(?:model\s*(?:number|no\.?|#)|item\s*model\s*number)\b.*$"
SECOND_HALF, NOT_SECOND = r"(?i)\b(?:carry[- ]?on|check(?:ed)?[- ]in|large|medium|small|\d{2}\s*(?:''|\"|in\b|inch))", r"(?i)amazon|walmart|canada|\.ca\b|\.com\b"
DIMENSIONS = r"""(?i)(\d{1,3}(?:\.\d+)?)\s*(?:"|''|in(?:ches|\.)?)?\s*[x×]\s*(\d{1,3}(?:\.\d+)?)\s*(?:"|''|in(?:ches|\.)?)?\s*[x×]\s*(\d{1,3}(?:\.\d+)?)\s*("|''|in(?:ches|\.)?|cm|centimet(?:er|re)s?)(?![a-z])"""
WEIGHT = r"(?i)(?:\b(?:item |product |bag |luggage )?weight\b(?!\s*(?:limit|allowance|capacity|restriction))|\bweighs\b|\bpoids\b)[^0-9]{0,25}(\d{1,2}(?:\.\d{1,2})?)\s*(lbs?|pounds?|kg|kilograms?)\b"
CAPACITY = r"\b(\d{2,3}(?:\.\d)?)\s*(?:L|litres?|liters?)\b(?![a-z])"
MATERIAL = r"(?i)\b(polycarbonate|polypropylene|ABS|aluminum|aluminium|ballistic nylon|nylon|polyester|curv|leather|canvas)\b"
WHEELS = ((r"(?i)\b(?:8|eight)[- ]?(?:double[- ])?(?:spinner[- ])?wheels?\b|\bdouble[- ]spinner\b", "8 wheels (double spinner)"), (r"(?i)\b(?:4|four)[- ]?(?:spinner[- ])?wheels?\b|\bspinner\b", "Spinner (4 wheels)"), (r"(?i)\b(?:2|two)[- ]?wheel(?:s|ed)?\b|\bupright\b", "2 wheels"))
EXPANDABLE, TSA = r"(?i)\bexpandable\b|\bexpansion\b|\bextensible\b", r"\bTSA\b"
WARRANTY = r"(?i)\b(\d{1,2})[- ]year\b[^.\n]{0,25}warrant(?:y|ie)|\b(limited lifetime|lifetime)\s+warrant(?:y|ie)"
COLOUR_LABEL = r"(?i)\b(?:colou?rs?|couleurs?)\b\s*(?::|\(|available|options?)"
MOST_COLOURS, MOST_SPOTS, MOST_TOKENS = 12, 20, 6

_CUT = "\u0001"


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: a generator keeps Spark from copying them into each later use."""
    for name, column in columns.items():
        df = df.select(*(c for c in df.columns if c != name), F.inline(F.array(F.struct(column.alias(name)))))
    return df


def part(text: Column, start: Column, stop: Column) -> Column:
    """Characters from start to before stop, both from 0 and held to the text."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(F.least(stop, F.length(text)) - low, F.lit(0)))


def place(text: Column, pattern: Column | str) -> Column:
    """Where the first match begins, or -1."""
    return F.regexp_instr(text, F.lit(pattern) if isinstance(pattern, str) else pattern) - 1


def amount_value(amount: Column) -> Column:
    number = F.regexp_replace(F.regexp_extract(amount, rf"{NUMBER}(?:\.\d{{1,2}})?", 0), ",", "")
    french = F.regexp_replace(F.regexp_replace(F.regexp_extract(amount, r"^[\d,\s  ]+", 0), r"[\s  ]", ""), ",", ".")
    return F.when(amount.rlike(r"^\d.*\$$"), french).otherwise(number).try_cast("double")


def amounts(text: Column) -> Column:
    """All amounts of a text, from left to right, without overlaps, as (start, stop, value, usd, in_row); none for a null text.

    in_row tells whether an amount stands in a table row with several prices. The text is read once.
    """
    return found(text)


def amounts_expression(text: Column) -> Column:
    """The same, without in_row, as an expression of Spark's own functions; it takes many times as long."""
    pieces = F.split(F.regexp_replace(text, f"({SCANNED})", f"{_CUT}$1{_CUT}"), _CUT)
    sizes = F.transform(pieces, F.length)
    # Two by two: what stands before an amount, and the amount.
    nth = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        whole = F.element_at(pieces, i + 1)
        own = F.when(whole.rlike(rf"^(?:{TRAILING})"), F.regexp_extract(whole, rf"^(?:{TRAILING})", 0)).otherwise(whole)
        start = F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, x: s + x)
        usd = F.when(own.rlike(r"^\d"), own.endswith("USD")).otherwise(own.startswith("US"))
        return F.struct(start.alias("start"), (start + F.length(own)).alias("stop"), amount_value(own).alias("value"), usd.alias("usd"))

    return F.filter(F.transform(nth, one), lambda c: c["value"].isNotNull())


def believed(c: Column) -> Column:
    return ~c["usd"] & c["value"].between(LOW, HIGH)


def in_price_row(text: Column, c: Column) -> Column:
    """Whether the amount stands in a table row with several prices."""
    line = F.concat(F.substring_index(part(text, F.lit(0), c["start"]), "\n", -1), part(text, c["start"], c["stop"]), F.substring_index(part(text, c["stop"], F.length(text)), "\n", 1))
    values = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(line, F.lit(f"({AMOUNT})"), F.lit(1)), amount_value), lambda v: v >= LOW))
    return (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 3) & (F.size(values) >= 2)


def anchor_tokens(title: Column) -> Column:
    """The first distinctive words of a title."""
    stop = F.array(*map(F.lit, ANCHOR_STOPWORDS))
    return F.slice(F.filter(words.words_of(title), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w) & ~w.rlike(r"^\d+$")), 1, MOST_TOKENS)


def anchor(text: Column, title: Column) -> Column:
    """Where the product begins on its page: where two words of its title stand within 120 characters; -1 if nowhere."""
    tokens = anchor_tokens(title)
    pair = lambda t: F.concat(F.lit("(?="), t, F.lit(")(?=.{0,120}?(?:"), F.array_join(F.filter(tokens, lambda o: o != t), "|"), F.lit("))"))
    pattern = F.concat(F.lit("(?s)"), F.array_join(F.transform(tokens, pair), "|"))
    lower = F.lower(text)
    return F.when(F.size(tokens) == 0, -1).when(F.size(tokens) == 1, F.instr(lower, tokens[0]) - 1).otherwise(place(lower, pattern))


def title_spots(text: Column, title: Column) -> Column:
    """Where the title's words before its first comma stand."""
    head = F.lower(F.trim(F.substring_index(title, ",", 1)))
    pieces = F.split(F.lower(text), F.concat(F.lit(r"\Q"), head, F.lit(r"\E")))
    at = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda s, x: s + F.length(x)) + (i - 1) * F.length(head)
    found = F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.least(F.size(pieces) - 1, F.lit(MOST_SPOTS))), at)).otherwise(F.array().cast("array<int>"))
    return F.when(F.length(head) >= 12, found).otherwise(F.array().cast("array<int>"))


def evidence(text: Column, start: Column, stop: Column) -> Column:
    """The words around an amount, as they stand there."""
    low, high = F.greatest(start - 70, F.lit(0)), F.least(stop + 40, F.length(text))
    return F.concat(F.when(low > 0, "…").otherwise(""), words.squeezed(part(text, low, high)), F.when(high < F.length(text), "…").otherwise(""))


def listing_price(df: DataFrame, text: str, title: str, to: str, snippet: bool = False, product_url: Column | None = None) -> DataFrame:
    """df with `to`: (price, evidence, score) of the text's own price, or null where it can't be told from the other amounts.

    Amounts after words like "list price" or "save", of other products, in US dollars or in a table row of
    prices are out; what is left is scored by the words before it and its distance from the product's
    name. With snippet the text is an excerpt with gaps: only an amount joined to the product's name counts
    or, on a product's page, the first one beside the page's own controls.
    """
    t = F.col("_text")
    product_url = F.lit(False) if product_url is None else product_url
    df = held(df, _text=F.substring(F.coalesce(F.col(text), F.lit("")), 1, MOST_TEXT))
    df = held(df, _anchor=anchor(t, F.col(title)), _spots=title_spots(t, F.col(title)), _all=amounts(t))
    a, zero = F.col("_anchor"), F.lit(0)
    related = place(part(t, F.greatest(a, zero), F.length(t)), RELATED)
    df = held(df, _cutoff=F.when(related >= 0, F.greatest(a, zero) + related).otherwise(F.length(t)))

    def marked(c: Column) -> Column:
        before = part(t, c["start"] - 40, c["start"])
        labelled = before.rlike(POSITIVE_BEFORE)
        boxed = labelled & F.exists("_spots", lambda s: (c["start"] > s) & (c["start"] - s <= 400))
        return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["value"].alias("value"), c["usd"].alias("usd"), c["in_row"].alias("in_row"), before.alias("before"), labelled.alias("labelled"), boxed.alias("boxed"))

    df = held(df, _all=F.filter(F.transform("_all", marked), lambda c: ((c["start"] < F.col("_cutoff")) | c["boxed"]) & believed(c) & ~c["in_row"]))
    if snippet:
        def joined(c: Column, i: Column) -> Column:
            alone = (i == 0) & part(t, c["start"] - 80, c["stop"] + 80).rlike(OWN_PRICE) & ~part(t, zero, c["start"]).rlike(GAP)
            return F.when(a >= 0, (c["start"] >= a) & ~part(t, a, c["start"]).rlike(GAP)).otherwise(alone)

        df = held(df, _all=F.when((a < 0) & ~product_url, F.slice("_all", 1, 0)).otherwise(F.filter("_all", joined)))
    fair = lambda c: ~c["before"].rlike(NEGATIVE_BEFORE) & ~part(t, c["stop"], c["stop"] + 30).rlike(NEGATIVE_AFTER) & ~part(t, c["start"] - 12, c["stop"] + 12).rlike(US_NEAR)
    df = held(df, _all=F.filter("_all", fair))

    def scored(c: Column, i: Column) -> Column:
        near = F.when(a < 0, 0).when(c["start"] < a, -2).when(c["start"] - a <= 2500, 2).otherwise(0)
        score = F.when(c["labelled"], 3).otherwise(0) + F.when(c["boxed"], 2).otherwise(0) - F.when(c["before"].rlike(WEAK_BEFORE), 1).otherwise(0) + near + F.when(i == 0, 1).otherwise(0)
        return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["value"].alias("value"), c["labelled"].alias("labelled"), score.alias("score"))

    df = held(df, _all=F.transform("_all", scored))
    first = F.try_element_at("_all", F.lit(1))
    df = held(df, _best=F.aggregate("_all", first, lambda best, c: F.when(c["score"] > best["score"], c).otherwise(best)))
    b = F.col("_best")
    rival = F.exists("_all", lambda c: (c["start"] != b["start"]) & (c["score"] >= b["score"]) & (F.abs(c["value"] - b["value"]) / b["value"] > 0.03))
    sure = (b["score"] >= 0) & (b["labelled"] | ~rival)
    pick = F.when(sure, F.struct(cents(b["value"]).alias("price"), evidence(t, b["start"], b["stop"]).alias("evidence"), b["score"].alias("score")))
    return held(df, **{to: pick}).drop("_text", "_anchor", "_spots", "_all", "_cutoff", "_best")


def in_stock(text: Column, title: Column) -> Column:
    at = F.greatest(anchor(text, title), F.lit(0))
    return ~part(text, at, at + 3000).rlike(OUT_OF_STOCK)


def colour_options(text: Column) -> Column:
    """The colours within 400 characters of the page's colour label, each once."""
    at = place(text, COLOUR_LABEL)
    found = F.regexp_extract_all(part(text, at, at + 400), F.lit(rf"(?i)((?:[A-Za-z]+\s+)?\b(?:{'|'.join(COLOURS)})\b)"), F.lit(1))
    modifiers = F.array(*map(F.lit, dict.fromkeys(COLOUR_MODIFIERS)))

    def named(hit: Column) -> Column:
        # Without the word before, unless that is a modifier or belongs to the colour's own name.
        own = F.regexp_extract(hit, rf"(?i)^(?:{'|'.join(COLOURS)})$", 0)
        modified = F.array_contains(modifiers, F.lower(F.regexp_extract(hit, r"^[A-Za-z]+", 0)))
        return words.title_case(F.regexp_replace(F.when((own != "") | modified, hit).otherwise(F.regexp_replace(hit, r"^[A-Za-z]+\s+", "")), r"\s+", " "))

    return F.when(at >= 0, F.slice(F.array_distinct(F.transform(found, named)), 1, MOST_COLOURS)).otherwise(F.array().cast("array<string>"))


def details(df: DataFrame, text: str, title: str, to: str) -> DataFrame:
    """df with `to`: the specifications that the product's own part of the text states; a field is null where it says nothing."""
    df = held(df, _text=F.substring(F.coalesce(F.col(text), F.lit("")), 1, MOST_TEXT))
    df = held(df, _text=part(F.col("_text"), anchor(F.col("_text"), F.col(title)), F.length("_text")))
    related = place(F.col("_text"), RELATED)
    df = held(df, _text=F.substring(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.when(related >= 0, part(F.col("_text"), F.lit(0), related)).otherwise(F.col("_text"))), 1, 25_000))
    t = F.col("_text")
    said = lambda pattern, group=1: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))
    unit = F.when(said(DIMENSIONS, 4).rlike("(?i)cm|centim"), "cm").otherwise("in")
    wheels = F.lit(None).cast("string")
    for pattern, name in reversed(WHEELS):
        wheels = F.when(t.rlike(pattern), name).otherwise(wheels)
    lifetime = words.title_case(said(WARRANTY, 2))
    columns = [
        F.concat(said(DIMENSIONS), F.lit(" x "), said(DIMENSIONS, 2), F.lit(" x "), said(DIMENSIONS, 3), F.lit(" "), unit).alias("dimensions"),
        F.concat(said(WEIGHT), F.when(said(WEIGHT, 2).rlike("(?i)^k"), " kg").otherwise(" lb")).alias("weight"),
        F.concat(said(CAPACITY), F.lit(" L")).alias("capacity"),
        F.when(F.upper(said(MATERIAL)) == "ABS", "ABS").otherwise(words.title_case(said(MATERIAL))).alias("material"),
        wheels.alias("wheels"),
        F.when(t.rlike(EXPANDABLE), True).alias("expandable"),
        F.when(t.rlike(TSA), True).alias("tsa_lock"),
        F.nullif(colour_options(t), F.array().cast("array<string>")).alias("colours"),
        F.coalesce(F.concat(said(WARRANTY), F.lit("-year")), lifetime).alias("warranty"),
    ]
    return held(df, **{to: F.struct(*columns)}).drop("_text")


def clean_title(title: Column) -> Column:
    """(name, site): the product's name and the store's, as a page title joins them; site is null where it can't be told."""
    raw = words.squeezed(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), TITLE_MARKS, ""), MODEL_INSIDE, ""))
    parts = F.filter(F.transform(F.split(raw, TITLE_CUT), lambda x: F.trim(x)), lambda p: p != "")
    first, second, last = F.coalesce(F.try_element_at(parts, F.lit(1)), raw), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(-1))
    short = second.isNotNull() & (F.size(F.split(first, r"\s+")) <= 3) & second.rlike(SECOND_HALF) & ~second.rlike(NOT_SECOND)
    name = F.when((F.length(first) < 8) & second.isNotNull(), second).when(short, F.concat_ws(" ", first, second)).otherwise(first)
    name = F.regexp_replace(name, r"(?i)^Amazon\.(?:ca|com)\s*:\s*(?=.)", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\s*(?:\.{3,}|…)\s*$", ""), MODEL_TAIL, "")
    site = F.when((F.size(parts) > 1) & last.rlike("(?i)[a-z]") & (F.length(last) <= 40), last)
    return F.struct(F.trim(F.regexp_replace(name, r"\s{2,}", " ")).alias("name"), site.alias("site"))


def is_listing_page(url: Column, text: Column, title: Column) -> Column:
    """Whether a page shows many products: by its address, its title, or the number of different prices on it."""
    prices = F.array_distinct(F.transform(F.filter(amounts(F.substring(text, 1, LIST_TEXT)), lambda c: c["value"].between(LOW, HIGH)), lambda c: c["value"]))
    by_address = urls.is_home(url) | urls.is_listing_url(url) | F.coalesce(urls.is_listing_title(title), F.lit(False))
    return by_address | (~urls.is_product_url(url) & (F.size(prices) >= LIST_PRICES))


def _brand(retailer: Column) -> Column:
    """The brand of a brand's own store, else null."""
    stores = [r.name for r in RETAILERS if r.category == "specialty"]
    return F.when(retailer.isin(stores), F.regexp_replace(retailer, r"(?i)\.(?:ca|com)$", ""))


def branded(name: Column, retailer: Column) -> Column:
    brand = _brand(retailer)
    return F.when(brand.isNotNull() & ~F.contains(F.lower(name), F.lower(brand)), F.concat_ws(" ", brand, name)).otherwise(name)


def analysed(pages: DataFrame) -> DataFrame:
    """Each page with retailer, retailer_key, name, and an offer (price, evidence, in_stock, colour, details) or the reason for none."""
    url, raw, content = F.col("url"), F.coalesce("raw", F.lit("")), F.coalesce("content", F.lit(""))
    df = held(pages, _cleaned=clean_title(F.col("title")), _key=urls.retailer_of(F.lit(""), url))
    site, key = F.col("_cleaned.site"), F.col("_key")
    own_site = F.when((F.length(site) <= 30) & ~site.rlike("(?i)amazon|walmart|samsonite"), site)
    source = F.when(raw != "", raw).otherwise(content)
    df = held(df, retailer=F.coalesce(key, own_site, urls.pretty_host(urls.host(url))), name=branded(F.col("_cleaned.name"), key), _source=source)
    reason = (
        F.when(~urls.is_merchant(url), "not a retailer page")
        .when(F.col("name") == "", "page has no title")
        .when(~urls.is_canadian(url, F.concat(content, F.lit("\n"), raw)), "not a Canadian storefront (prices likely USD)")
        .when(urls.is_home(url), "home page, not a single product")
        .when(is_listing_page(url, F.col("_source"), F.col("title")), "search or category page, not a single product")
    )
    df = held(df, _reason=reason)
    # Texts of pages that have a reason by now are not read for prices and specifications.
    left = lambda column: F.when(F.col("_reason").isNull(), column)
    df = held(df, _product=urls.is_product_url(url), _raw=left(F.col("raw")), _content=left(F.col("content")), _left=left(F.col("_source")))
    df = listing_price(df, "_raw", "name", "_full", product_url=F.col("_product"))
    df = listing_price(df, "_content", "name", "_excerpt", snippet=True, product_url=F.col("_product"))
    full, excerpt = F.col("_full"), F.col("_excerpt")
    df = details(held(df, _pick=F.when(excerpt["score"] > F.coalesce(full["score"], F.lit(-1)), excerpt).otherwise(full)), "_left", "name", "_details")
    pick = F.when(F.col("_reason").isNull(), F.col("_pick"))
    offer = F.when(pick.isNotNull(), F.struct(pick["price"].alias("price"), pick["evidence"].alias("evidence"), in_stock(F.col("_source"), F.col("name")).alias("in_stock"), words.colour_of(F.col("name")).alias("colour"), F.col("_details").alias("details")))
    why = F.coalesce("_reason", F.when(F.col("_pick").isNull(), "no clear price on the page"))
    return df.select(*pages.columns, "retailer", key.alias("retailer_key"), "name", offer.alias("offer"), why.alias("reason"))


TILE = "array<struct<name:string,price:double,evidence:string>>"


def tiles(df: DataFrame, text: str, terms: Column, to: str = "tiles") -> DataFrame:
    """df with `to`: (name, price, evidence) of each product that a listing names with all asked words right before its price."""
    df = held(df, _text=F.substring(F.coalesce(F.col(text), F.lit("")), 1, MOST_TEXT))
    t = F.col("_text")
    df = held(df, _all=F.filter(amounts(t), lambda c: believed(c) & ~c["in_row"]))

    def with_before(c: Column) -> Column:
        before = part(t, c["start"] - 200, c["start"])
        join = F.regexp_extract(before, CONNECTOR, 0)
        return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["value"].alias("value"), F.length(join).alias("join"), part(before, F.lit(0), F.length(before) - F.length(join)).alias("head"))

    def named(c: Column) -> Column:
        last = F.element_at(F.split(c["head"], BOUNDARY), -1)
        return F.struct(*(c[x].alias(x) for x in ("start", "stop", "value", "join", "head")), words.squeezed(F.regexp_replace(last, TITLE_MARKS, "")).alias("name"))

    def fair(c: Column) -> Column:
        count = F.size(F.split(c["name"], r"\s+"))
        odd = c["name"].rlike(r"\d[\d,]*\.\d{2}") | c["name"].rlike(r"(?i)\bout of 5\b|\breviews?\b") | F.concat(c["head"], F.lit(" ")).rlike(NEGATIVE_BEFORE) | part(t, c["stop"], c["stop"] + 30).rlike(NEGATIVE_AFTER)
        return (c["join"] <= 25) & F.length(c["name"]).between(8, 140) & count.between(2, 16) & ~odd & (words.query_match(c["name"], terms) >= 0.99)

    df = held(df, _all=F.transform(F.transform("_all", with_before), named))
    df = held(df, _all=F.filter("_all", fair))
    df = held(df, _keys=F.transform("_all", lambda c: F.concat(F.lower(c["name"]), F.lit("|"), c["value"].cast("string"))))
    once = F.filter("_all", lambda c, i: F.array_position("_keys", F.element_at("_keys", i + 1)) == i + 1)
    shown = lambda c: F.struct(c["name"].alias("name"), cents(c["value"]).alias("price"), evidence(t, F.greatest(c["start"] - F.least(F.length(c["name"]) + c["join"], F.lit(70)), F.lit(0)), c["stop"]).alias("evidence"))
    return held(df, **{to: F.transform(once, shown)}).drop("_text", "_all", "_keys")


def tile_offers(pages: DataFrame, found: DataFrame, terms: Column) -> DataFrame:
    """(query_id, seq, retailer, retailer_key, title, price, url, evidence): tiles of pages without an offer, linked to the product's own page.

    pages are analysed() rows with query_id and seq. A tile goes to the first product page of its host with the
    same words in its name, else to the listing itself; what an offer or an earlier tile has already is left out.
    """
    found = once(found.select("query_id", "seq", "url", "content", "raw", "retailer", "retailer_key", "name", F.col("offer.price").isNotNull().alias("has_offer"), "reason"), "found")
    asked = found.where("not has_offer").where(~F.coalesce("reason", F.lit("")).rlike("not a Canadian storefront|not a retailer page|no title"))
    seen = tiles(tiles(asked, "content", terms, "_short"), "raw", terms, "_long")
    rows = seen.select("query_id", "seq", "url", "retailer", "retailer_key", F.posexplode(F.concat("_short", "_long")).alias("nth", "tile"))
    title = branded(F.col("tile.name"), F.col("retailer_key"))
    rows = rows.select("*", title.alias("title"), words.name_key(title).alias("name_key"), words.name_key(F.col("tile.name")).alias("tile_key"), urls.host(F.col("url")).alias("host"))
    key = ["query_id", "retailer", "name_key"]
    taken = found.where("has_offer").select("query_id", "retailer", words.name_key(F.col("name")).alias("name_key")).distinct()
    order = F.struct("seq", "nth")
    first = rows.join(taken, key, "left_anti").groupBy(*key).agg(F.min_by(F.struct("seq", "nth", "url", "retailer_key", "title", "tile", "tile_key", "host"), order).alias("f")).select(*key, "f.*")
    first = once(first, "tiles")
    own = pages.where(urls.is_product_url(F.col("url"))).select("query_id", "seq", F.col("url").alias("own_url"), urls.host(F.col("url")).alias("host"), words.name_key(clean_title(F.col("title"))["name"]).alias("own_key"))
    own = own.groupBy("query_id", "host", "own_key").agg(F.min_by("own_url", "seq").alias("own_url"), F.min("seq").alias("own_seq"))
    by = lambda name: first.join(own.withColumnRenamed("own_key", name), ["query_id", "host", name], "left").select(*key, F.struct("own_seq", "own_url").alias(f"by_{name}"))
    linked = first.join(by("name_key"), key).join(first.select(*key, "tile_key", "host").join(own.withColumnRenamed("own_key", "tile_key"), ["query_id", "host", "tile_key"], "left").select(*key, F.struct("own_seq", "own_url").alias("by_tile_key")), key)
    nearest = F.array_sort(F.filter(F.array("by_name_key", "by_tile_key"), lambda x: x["own_url"].isNotNull()))
    return linked.select("query_id", "seq", "retailer", "retailer_key", "title", F.col("tile.price").alias("price"), F.coalesce(F.try_element_at(nearest, F.lit(1))["own_url"], F.col("url")).alias("url"), F.col("tile.evidence").alias("evidence"))
