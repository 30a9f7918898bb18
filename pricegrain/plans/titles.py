"""Queries on pairs of titles: which parts' titles name one product, over all parts and within a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricegrain.functions import text as x
from pricegrain.functions.vocabulary import COLOUR_MODIFIERS, COLOURS, NOISE_WORDS
from pricegrain.operators import similar
from pricegrain.operators.clusters import CONTAINED, CONTAINED_LEAST, SAME_WORDS
from pricegrain.plans.registering import Queries
from pricegrain.plans.roles import spread
from pricegrain.plans.text import TITLE

_quoted = lambda s: s.replace("'", "''")
_matches = lambda pattern, of="t": f"regexp_matches({of}, '{_quoted(pattern)}')"
_INCHES = f"regexp_extract(t, '{_quoted(x.INCHES)}', 1)"
_IGNORED = "[" + ", ".join(f"'{w}'" for w in sorted({*NOISE_WORDS, *COLOUR_MODIFIERS, *(w for c in COLOURS for w in c.split())})) + "]"
_SIZE = f"CASE WHEN {_INCHES} <> '' THEN {_INCHES} || ' inch' " + " ".join(f"WHEN {_matches(p)} THEN '{n}'" for p, n in x.SIZES) + " ELSE '' END"
_TAGS = f"list_filter([CASE WHEN {_INCHES} <> '' THEN {_INCHES} || ' inch' END, " + ", ".join(f"CASE WHEN {_matches(p)} THEN '{n}' END" for p, n in x.SIZE_TAGS) + "], lambda v: v IS NOT NULL)"
_IDENTITIES = f"""
WITH cut AS (
  SELECT id, query_id, t, list_filter(list_transform(string_split_regex(regexp_replace(lower(t), '[^a-z0-9\\s".]', ' ', 'g'), '\\s+'), lambda w: regexp_replace(regexp_replace(w, '"+$', ''), '^\\.+|\\.+$', '', 'g')),
    lambda w: regexp_matches(w, '[a-z0-9]') AND NOT list_contains({_IGNORED}, w) AND CASE WHEN regexp_full_match(w, '\\d+') THEN len(w) <> 2 ELSE len(w) > 2 END) AS ws
  FROM (SELECT p_partkey AS id, p_size % 10 AS query_id, regexp_replace({TITLE}, ' Walmart\\.ca$', '') AS t FROM part)
), identities AS (
  SELECT id, query_id, list_sort(list_distinct(ws)) AS words, coalesce(list_filter(ws, lambda w: NOT regexp_full_match(w, '\\d+'))[1], '') AS brand, {_SIZE} AS size,
    list_sort(CASE WHEN len({_TAGS}) = 0 AND {_matches(x.SIZES[1][0])} THEN ['check-in'] ELSE {_TAGS} END) AS sizes, list_sort(list_distinct(list_filter(ws, lambda w: regexp_full_match(w, '\\d+')))) AS numbers,
    regexp_matches(regexp_replace(t, '{_quoted(x.TSA_LOCK)}', '', 'g'), '{_quoted(x.ACCESSORY)}') AS accessory FROM cut
)"""
_SHARED = "len(list_intersect(a.words, b.words))"
_SAME = f"""(a.brand = '' OR b.brand = '' OR a.brand = b.brand) AND a.accessory = b.accessory
  AND (len(a.sizes) = 0 OR len(b.sizes) = 0 OR list_has_any(a.sizes, b.sizes)) AND (len(a.numbers) = 0 OR len(b.numbers) = 0 OR list_has_any(a.numbers, b.numbers)) AND {_SHARED} > 0
  AND ({_SHARED} / len(list_distinct(list_concat(a.words, b.words))) >= {SAME_WORDS} OR ({_SHARED} >= {CONTAINED_LEAST} AND {_SHARED} / least(len(a.words), len(b.words)) >= {CONTAINED})
    OR (a.size <> '' AND a.size = b.size AND {_SHARED} >= 2 AND {_SHARED} = least(len(a.words), len(b.words))))"""
Q = Queries()


def _classes(s: SparkSession, d: str, group: list[str]) -> DataFrame:
    titles = spread(s, d, "part", "p_partkey").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).alias("query_id"), F.expr(TITLE).alias("title"))
    return similar.title_classes(titles.select("id", *group, "title"), group)


def _sql(group: str, select: str) -> str:
    reps = f"reps AS (SELECT {group}words, brand, size, sizes, numbers, accessory, min(id) AS rep FROM identities GROUP BY ALL)"
    return f"{_IDENTITIES}, {reps}\n{select}"


_ALL = ("words", "brand", "size", "sizes", "numbers", "accessory")
Q.add("j6_title_classes", lambda s, d: _classes(s, d, []).select("id", "rep"), _sql("", f"SELECT id, rep FROM identities JOIN reps USING ({', '.join(_ALL)})"))
Q.add("j6_title_pairs", lambda s, d: similar.similar_titles(_classes(s, d, []), []), _sql("", f"SELECT a.rep AS a, b.rep AS b FROM reps a JOIN reps b ON a.rep < b.rep AND {_SAME}"))
Q.add(
    "j6_pairs_in_search",
    lambda s, d: similar.similar_titles(_classes(s, d, ["query_id"]), ["query_id"]),
    _sql("query_id, ", f"SELECT a.query_id, a.rep AS a, b.rep AS b FROM reps a JOIN reps b ON a.query_id = b.query_id AND a.rep < b.rep AND {_SAME}"),
)
