"""Hosts, kinds of pages by their addresses, and which retailer a page or label belongs to."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricegrain.functions.vocabulary import ALIASES, CANADIAN_DOT_COM, LEAST_ALIAS, NON_MERCHANT_HOSTS, RETAILERS, US_STOREFRONTS

# Shapes of addresses and titles.
PRODUCT_URL = r"(?i)/dp/|/gp/product/|/ip/|/products?/|/pdp/|/p/|\.product\.|/item/|/itm/|/sku/|-p-\d|/\d{6,}(?:[/?#.]|$)|\.html(?:[?#]|$)"
LISTING_URL = r"(?i)/b/|/sch/|/search\b|[?&](?:q|query|k|keyword|keywords|text|searchterm)=|/s\?|/browse/|/category/|/categories/|/c/[^/]+/?$|/collections/[^/]+/?(?:[?#]|$)|/brands?/[^/]*/?$|/blog/|/reviews?/|/compare/|/deals/?$|/sale/?$"
ONE_PRODUCT = r"(?i)/products?/[^/]+"
HOME_PATH = r"(?i)^(?:/(?:en|fr|en-ca|fr-ca|ca))?$"
LISTING_TITLE = r"(?i)\bcollection\b|\bfor sale\b|\bbest\b[^|]*\b20\d\d\b|\bsets\s*(?:$|\|)|\bshop all\b|\bcategory\b|\bdeals? on\b"
CANADIAN_PATH = r"(?i)/(?:en|fr)[-_]ca(?:/|$)|/ca/(?:en|fr)(?:/|$)"
CAD_TEXT = r"\bCAD\b|\bCA\$|\bC\$|\$\s?CAD\b|\d,\d{2}\s?\$"
TRACKING = r"(?i)[?&](?:utm_[^=&#]*|ref)=[^&#]*"


def host(url: Column) -> Column:
    """The lower-cased host without a leading www., or an empty string."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def hosts_pattern(domains: tuple[str, ...]) -> str:
    """Matches the domains and what is under them."""
    return rf"(?:^|\.)(?:{'|'.join(map(re.escape, domains))})$"


def is_merchant(url: Column, others: tuple[str, ...] = NON_MERCHANT_HOSTS) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://") & (host(url) != "") & ~host(url).rlike(hosts_pattern(others)), F.lit(False))


def is_canadian(url: Column, text: Column) -> Column:
    """By the host and path first, then by currency marks in the text; US stores only under a Canadian path."""
    by_path = url.rlike(CANADIAN_PATH)
    return (
        F.when(host(url) == "", False)
        .when(host(url).rlike(hosts_pattern(US_STOREFRONTS)), by_path)
        .when(host(url).endswith(".ca") | host(url).rlike(hosts_pattern(CANADIAN_DOT_COM)) | by_path, True)
        .otherwise(F.coalesce(text, F.lit("")).rlike(CAD_TEXT))
    )


def is_product_url(url: Column) -> Column:
    return url.rlike(PRODUCT_URL) & ~url.rlike(LISTING_URL)


def is_listing_url(url: Column) -> Column:
    return url.rlike(LISTING_URL) & ~url.rlike(ONE_PRODUCT)


def is_home(url: Column) -> Column:
    return (host(url) != "") & F.regexp_replace(path(url), "/+$", "").rlike(HOME_PATH)


def is_listing_title(title: Column) -> Column:
    return title.rlike(LISTING_TITLE)


def canonical(url: Column) -> Column:
    """The address without fragment and tracking parameters; two spellings of a page then are equal."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), TRACKING, "")
    return F.regexp_replace(F.regexp_replace(bare, r"^([^?&]*)&", "$1?"), r"[?&]$", "")


def pretty_host(name: Column) -> Column:
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))


def _first_of(choices: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, value in reversed(choices):
        out = F.when(condition, value).otherwise(out)
    return out


#: The longest known domain that a host is or is under, and the first retailer that has it or one above it: so has any such host.
_DOMAINS = [d for r in RETAILERS for d in r.domains]
_DOMAIN = rf"(?:^|\.)({'|'.join(map(re.escape, _DOMAINS))})$"
_NAMES = [x for d in dict.fromkeys(_DOMAINS) for x in (d, next(r.name for r in RETAILERS if re.search(hosts_pattern(r.domains), d)))]


def retailer_of_url(url: Column) -> Column:
    """The first retailer whose domain the host is or is under."""
    return F.try_element_at(F.create_map(*map(F.lit, _NAMES)), F.regexp_extract(host(url), _DOMAIN, 1))


def retailer_of(label: Column, url: Column) -> Column:
    """By exact name, alias, name in any case, host, then the longest alias inside the label."""
    known = F.create_map(*(F.lit(x) for r in RETAILERS for x in (r.name.lower(), r.name)))
    aliases = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    bare = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    inside = [(bare.contains(a), name) for a, name in sorted(ALIASES.items(), key=lambda x: -len(x[0])) if len(a) >= LEAST_ALIAS]
    exact = F.when(F.trim(label).isin([r.name for r in RETAILERS]), F.trim(label))
    return F.coalesce(exact, F.try_element_at(aliases, bare), F.try_element_at(known, bare), retailer_of_url(url), _first_of(inside))
