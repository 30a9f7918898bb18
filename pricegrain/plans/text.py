"""Queries on titles, queries and addresses, over made-up titles of parts and the addresses of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import text as x
from pricegrain.functions import urls as u
from pricegrain.functions.vocabulary import COLOUR_MODIFIERS, COLOURS
from pricegrain.plans.registering import Queries
from pricegrain.plans.roles import spread, table

_TAIL = "CASE p_size % 5 WHEN 0 THEN ' inch Carry-On' WHEN 1 THEN ' Large Check-In' WHEN 2 THEN ' ice Blue TSA lock' WHEN 3 THEN ' Luggage Cover' ELSE ' rose gold Walmart.ca' END"
TITLE = f"concat(p_brand, ' ', p_name, ' ', p_type, ' ', cast(p_size + 10 AS VARCHAR(9)), {_TAIL})"
_QUERY = "concat(p_name, ' under $', cast(p_size * 100 AS VARCHAR(9)), ' luggage')"
Q = Queries(f"WITH titles AS (SELECT p_partkey AS id, {TITLE} AS title, {_QUERY} AS query FROM part)")


def _titles(s: SparkSession, d: str) -> DataFrame:
    return spread(s, d, "part", "p_partkey").select(F.col("p_partkey").alias("id"), F.expr(TITLE).alias("title"), F.expr(_QUERY).alias("query"))


def _add(name: str, column, sql: str | None, of: str = "title") -> None:  # noqa: ANN001
    Q.add(name, lambda s, d: _titles(s, d).select("id", column(F.col(of)).alias("value")), sql and f"SELECT id, {sql} AS value FROM titles")


_WORDS = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_add("x1_slug", x.slug, "substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80)")
_add("x2_normal_query", x.normal_query, "array_to_string(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9$.:\\s-]', ' ', 'g'), '\\s+'), lambda w: w <> ''))), ' ')", "query")
_add("x6_name_key", x.name_key, f"array_to_string(list_sort(list_distinct({_WORDS.format('title')})), ' ')")
_add("x7_size", x.size_of, r"""CASE WHEN regexp_extract(title, '(?i)\b(\d{2}(?:\.\d)?)\s*(?:"|''''|inch|inches|in\b)', 1) <> '' THEN regexp_extract(title, '(?i)\b(\d{2}(?:\.\d)?)\s*(?:"|''''|inch|inches|in\b)', 1) || ' inch'
  WHEN regexp_matches(title, '(?i)\bcarry[-\s]?on\b') THEN 'Carry-On' WHEN regexp_matches(title, '(?i)\bcheck(?:ed)?[-\s]?in\b') THEN 'Check-In' WHEN regexp_matches(title, '(?i)\bunderseat\b') THEN 'Underseat'
  WHEN regexp_matches(title, '(?i)\blarge\b') THEN 'Large' WHEN regexp_matches(title, '(?i)\bmedium\b') THEN 'Medium' WHEN regexp_matches(title, '(?i)\bsmall\b') THEN 'Small' ELSE '' END""")
_COLOURS = "|".join(COLOURS)
_BEFORE = f"regexp_extract(regexp_extract(title, '(?i)^(.*?)\\b({_COLOURS})\\b', 1), '([A-Za-z]+)\\s+$', 1)"
_CAPITALS = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
_FIRST = f"regexp_extract(title, '(?i)\\b({_COLOURS})\\b', 1)"
_add("x8_colour", x.colour_of, f"CASE WHEN {_FIRST} = '' THEN '' WHEN list_contains({list(COLOUR_MODIFIERS)}, lower({_BEFORE})) THEN {_CAPITALS.format(f'concat({_BEFORE}, chr(32), {_FIRST})')} ELSE {_CAPITALS.format(_FIRST)} END")
_add("x11_without_stores", x.without_stores, "regexp_replace(title, ' Walmart\\.ca$', '')")
_add("x13_broader", lambda c: F.array_join(x.broader(c), " | "), None, "query")
_add("x14_with_category", x.with_category, "CASE WHEN regexp_matches(title, '(?i)\\b(luggage|carry[-\\s]?on|check[-\\s]?in)\\b') THEN title ELSE title || ' luggage' END")
_add("x15_max_price", x.max_price, "CAST(regexp_extract(query, 'under \\$(\\d+)', 1) AS DOUBLE)", "query")
_add("x15_without_prices", x.without_prices, "trim(regexp_replace(regexp_replace(query, 'under \\$\\d+', ''), '\\s{2,}', ' ', 'g'))", "query")
_add("x19_identity", lambda c: F.array_join(x.identity_words(c), " "), None)
_add("f6_accessory", x.is_accessory, "regexp_matches(title, '(?i)\\bcover\\b')")
_add("f16_plain_query", x.is_plain_query, "false", "query")
_add("x5_query_match", lambda c: x.query_match(c, F.lit("red widget for sale")), f"(list_contains({_WORDS.format('title')}, 'red')::INT + list_contains({_WORDS.format('title')}, 'widget')::INT) / 2.0")
_add("x18_escaped", lambda c: x.decoded(x.escaped(F.concat(c, F.lit(' <"&">')))), "title || ' <\"&\">'")

_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '')"


def _url(name: str, column, sql: str) -> None:  # noqa: ANN001
    Q.add(name, lambda s, d: table(s, d, "pages").select("page_id", column(F.col("url")).alias("value")), f"SELECT page_id, {sql} AS value FROM pages")


_url("x17_host", u.host, _HOST)
_url("x17_pretty_host", lambda c: u.pretty_host(u.host(c)), f"upper(substr({_HOST}, 1, 1)) || substr({_HOST}, 2)")
_url("f1_merchant", u.is_merchant, f"regexp_matches(url, '(?i)^https?://') AND {_HOST} <> '' AND NOT regexp_matches({_HOST}, '(^|\\.)(google\\.com|google\\.ca|googleusercontent\\.com|gstatic\\.com|bing\\.com|duckduckgo\\.com)$')")
_url("f3_product_url", u.is_product_url, f"regexp_matches(url, '{u.PRODUCT_URL}') AND NOT regexp_matches(url, '{u.LISTING_URL}')")
_url("f3_listing_url", u.is_listing_url, f"regexp_matches(url, '{u.LISTING_URL}') AND NOT regexp_matches(url, '{u.ONE_PRODUCT}')")
_url("f2_canadian", lambda c: u.is_canadian(c, F.col("html")), f"{_HOST} <> '' AND ({_HOST} LIKE '%.ca' OR regexp_matches(url, '{u.CANADIAN_PATH}') OR regexp_matches(html, '{u.CAD_TEXT}'))")
Q.add(
    "u5_distinct_pages",
    lambda s, d: table(s, d, "pages").groupBy(u.canonical(F.col("url")).alias("address")).agg(F.min("page_id").alias("page_id")),
    f"""SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '{u.TRACKING}', '', 'g'), '^([^?&]*)&', '\\1?'), '[?&]$', '') AS address, min(page_id) AS page_id FROM pages GROUP BY 1""",
)
