"""From a flat list of offers to products: grouping by founders, product rows, and matches with a known product.

Offers of a search have query_id, seq (their order in it), title, retailer, retailer_key and price. The
order matters: an offer joins the first group whose founding offer is the same product, and else founds
one, so these groups are not the components of a graph.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrain.functions import text
from pricegrain.functions.numbers import cents, containment, jaccard
from pricegrain.functions.vocabulary import RETAILERS
from pricegrain.operators.pages import held
from pricegrain.operators.rows import rare_first
from pricegrain.session import once

#: Overlap that makes two titles one product: of all words, or of the shorter title's if it has enough of them.
SAME_WORDS, CONTAINED, CONTAINED_LEAST = 0.6, 0.85, 3
#: Points of a match: equal barcode, brand, each shared word of the model; retailers count one each up to a limit; what is enough.
BARCODE_POINTS, BRAND_POINTS, WORD_POINTS, RETAILER_POINTS, ENOUGH = 100, 20, 8, 8, 12
MOST_COLOURS, LONGEST_NAME = 16, 140


def identity(title: Column, brand: Column | None = None) -> Column:
    """What tells products apart: words, their brand, sizes, colour, and whether it is an accessory."""
    full = text.with_brand(title, brand) if brand is not None else title
    of = lambda t, words: F.struct(
        words.alias("words"), text.brand_word(words).alias("brand"), text.size_of(t).alias("size"), text.size_tags(t).alias("sizes"),
        F.lower(text.colour_of(t)).alias("colour"), text.is_accessory(t).alias("accessory"), F.filter(words, lambda w: w.rlike(r"^\d+$")).alias("numbers"),
    )
    return text.let(full, lambda t: text.let(text.identity_words(t), lambda words: of(t, words)))


def same_product(a: Column, b: Column, by_colour: bool = False) -> Column:
    """Whether two identities are one product: no conflict in brand, kind, size or model number, and enough words in common."""
    conflict = ((a["brand"] != "") & (b["brand"] != "") & (a["brand"] != b["brand"])) | (a["accessory"] != b["accessory"])
    for field in ("sizes", "numbers"):
        conflict = conflict | ((F.size(a[field]) > 0) & (F.size(b[field]) > 0) & ~F.arrays_overlap(a[field], b[field]))
    if by_colour:
        conflict = conflict | (a["colour"] != b["colour"])
    shared = F.size(F.array_intersect(a["words"], b["words"]))
    whole = containment(a["words"], b["words"])
    alike = (jaccard(a["words"], b["words"]) >= SAME_WORDS) | ((shared >= CONTAINED_LEAST) & (whole >= CONTAINED)) | ((a["size"] != "") & (a["size"] == b["size"]) & (shared >= 2) & (whole == 1))
    return ~conflict & (shared > 0) & alike


class _Founders:
    """The founders of one part of a search, in order, under their words.

    A title that is one product with another shares enough of the shorter one's words (as similar.py says
    it), so a title is compared only with founders that have one of its rarest words, or one of whose
    rarest words it has; these come in the order of founding, until one fits.
    """

    def __init__(self, by_colour: bool):
        self.by_colour = by_colour
        self.founders: list[tuple] = []
        self.all: dict[str, list[int]] = {}
        self.first: dict[str, list[int]] = {}
        self.known: dict[tuple, int] = {}

    def home(self, seq: int, e: dict) -> int:
        words = [w["word"] for w in e["ranked"] or []]
        one = (frozenset(words), frozenset(e["sizes"]), frozenset(e["numbers"]), e["brand"], e["accessory"], e["size"], e["colour"])
        found = self.known.get(one)
        if found is None:
            found = self._search(one, words)
            if found is None:
                found = len(self.founders)
                self.founders.append((seq, one))
                for w in words:
                    self.all.setdefault(w, []).append(found)
                for w in words[: _looked_at(len(words))]:
                    self.first.setdefault(w, []).append(found)
            if words:
                self.known[one] = found
        return self.founders[found][0]

    def _search(self, one: tuple, words: list[str]) -> int | None:
        lists = [self.all[w] for w in words[: _looked_at(len(words))] if w in self.all] + [self.first[w] for w in words if w in self.first]
        last = -1
        for i in heapq.merge(*lists):
            if i != last and self._fits(self.founders[i][1], one):
                return i
            last = i
        return None

    def _fits(self, a: tuple, b: tuple) -> bool:
        """same_product() of two identities as tuples."""
        if (a[3] and b[3] and a[3] != b[3]) or a[4] != b[4] or (self.by_colour and a[6] != b[6]):
            return False
        if any(x and y and x.isdisjoint(y) for x, y in ((a[1], b[1]), (a[2], b[2]))):
            return False
        shared, least = len(a[0] & b[0]), min(len(a[0]), len(b[0]))
        if not shared:
            return False
        alike = shared / (len(a[0]) + len(b[0]) - shared) >= SAME_WORDS
        return alike or (shared >= CONTAINED_LEAST and shared / least >= CONTAINED) or (a[5] != "" and a[5] == b[5] and shared >= 2 and shared == least)


def _looked_at(n: int) -> int:
    """Of n words, rarest first, how many hold a word of every title that shares SAME_WORDS of them."""
    return n - math.ceil(n * SAME_WORDS - 1e-9) + 1 if n else 0


def _homes(by_colour: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, founders = None, _Founders(by_colour)
        for batch in batches:
            keys, homes = batch.column("_key").to_pylist(), []
            for key, seq, e in zip(keys, batch.column("seq").to_pylist(), batch.column("_e").to_pylist(), strict=True):
                if key != part:
                    part, founders = key, _Founders(by_colour)
                homes.append(founders.home(seq, e))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("seq"), pa.array(homes, batch.schema.field("seq").type)], ["query_id", "seq", "founder"])

    return run


def clusters(offers: DataFrame, by_colour: bool = False, brand: str | None = None) -> DataFrame:
    """offers with founder: the seq of the offer that founded their group, within each query_id.

    Two brands are never one product, so a search is cut by brand; offers whose titles name no brand but
    have a number share a part with the brands that have one of these numbers. Within a part an order
    is followed: its offers come sorted, a batch at a time, and its founders are what is kept of them. So
    a large search costs memory for its different products, and time in proportion to its offers.
    """
    hint = F.lit(brand) if brand is not None else None
    rows = once(held(offers.select("query_id", "seq", "title"), _id=identity(text.without_stores(F.coalesce("title", F.lit(""))), hint)).drop("title"), "identities")
    # Numbers of titles that name no brand, and the brands with such a number.
    number = lambda some: some.select("query_id", F.col("_id.brand").alias("brand"), F.explode("_id.numbers").alias("number"))
    open_ = number(rows.where(F.col("_id.brand") == "")).select("query_id", "number").distinct()
    joined = number(rows.where(F.col("_id.brand") != "")).join(open_, ["query_id", "number"], "left_semi").select("query_id", "brand").distinct().withColumn("_joined", F.lit(True))
    rows = rows.withColumn("brand", F.col("_id.brand")).join(joined, ["query_id", "brand"], "left")
    rows = rows.withColumn("_part", F.when(F.col("_joined"), "").otherwise(F.col("brand"))).drop("brand", "_joined")
    ranked = rare_first(rows, ["query_id"], "seq", F.col("_id.words"))
    full = rows.join(ranked, ["query_id", "seq"], "left")
    e = F.struct("ranked", *(F.col("_id")[n].alias(n) for n in ("brand", "accessory", "size", "colour", "sizes", "numbers")))
    dealt = full.select(F.struct("query_id", "_part").alias("_key"), "query_id", "seq", e.alias("_e")).repartition("_key").sortWithinPartitions("_key", "seq")
    kinds = {f.name: f.dataType for f in offers.schema}
    schema = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("seq", kinds["seq"]), T.StructField("founder", kinds["seq"])])
    return offers.join(dealt.mapInArrow(_homes(by_colour), schema), ["query_id", "seq"])


def _of_kind(key: Column, category: str) -> Column:
    return F.coalesce(key.isin([r.name for r in RETAILERS if r.category == category]), F.lit(False))


def products(grouped: DataFrame, brand: str | None = None) -> DataFrame:
    """One row for each group of clusters(): its name, brand, model, size, colours and price summary.

    The title is that of the brand's own store, else the shortest of at least three words, else the
    founder's. A retailer's cheapest offer counts; colours (an array, may be absent) come from all offers.
    """
    title = text.without_stores(F.coalesce("title", F.lit("")))
    colours = F.filter(F.concat(F.array(text.colour_of(F.col("title"))), F.coalesce("colours", F.array().cast("array<string>")) if "colours" in grouped.columns else F.array().cast("array<string>")), lambda c: c != "")
    rows = held(grouped, _title=title, _size=text.size_of(F.col("title")), _colours=colours)
    key, first = ["query_id", "founder"], lambda *c: F.min(F.struct(*c))
    words = F.size(F.split("_title", r"\s+"))
    store = _of_kind(F.col("retailer_key"), "specialty")
    agg = rows.groupBy(*key).agg(
        F.min(F.when(store, F.struct("seq", "_title")))["_title"].alias("_store"),
        F.min(F.when(words >= 3, F.struct(F.length("_title").alias("n"), "seq", "_title")))["_title"].alias("_short"),
        first("seq", "_title")["_title"].alias("_first"),
        first("seq", text.colour_of(F.col("title")).alias("c"))["c"].alias("colour"),
        F.coalesce(F.min(F.when(F.col("_size") != "", F.struct("seq", "_size")))["_size"], F.lit("")).alias("size"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_colours"))), lambda x: x["_colours"])).alias("_all"),
    )
    cheapest = rows.groupBy(*key, "retailer").agg(F.min("price").alias("price"), F.max(_of_kind(F.col("retailer_key"), "major")).alias("major"))
    money = cheapest.groupBy(*key).agg(F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"), F.count("*").alias("retailer_count"), cents(F.max("price") - F.min("price")).alias("spread"), F.max("major").alias("has_major"))
    shown = held(agg.join(money, key), _title=F.coalesce("_store", "_short", "_first"))
    cut, hint = F.split("_title", r"\s+"), F.lit(brand)
    hinted = F.lit(False) if brand is None else text.with_brand(F.col("_title"), hint) != F.col("_title")
    model = F.array_join(F.when(hinted, F.slice(cut, 1, 3)).otherwise(F.slice(cut, 2, 3)), " ")
    name = F.when(hinted, F.concat_ws(" ", hint, "_title")).otherwise(F.col("_title"))
    shown = held(shown, name=F.coalesce(F.nullif(F.substring(name, 1, LONGEST_NAME), F.lit("")), F.lit("Unknown product")), brand=F.when(hinted, hint).otherwise(cut[0]), model=F.coalesce(F.nullif(model, F.lit("")), F.col("_title")))
    lowered = F.transform("_all", F.lower)
    once = F.slice(F.filter("_all", lambda c, i: F.array_position(lowered, F.lower(c)) == i + 1), 1, MOST_COLOURS)
    slug = F.coalesce(F.nullif(text.slug(F.trim(F.concat_ws(" ", "brand", "model", "colour"))), F.lit("")), text.slug(F.col("name")))
    return shown.select(*key, slug.alias("key"), "name", "brand", "model", "colour", "size", once.alias("colours"), "lowest_price", "highest_price", "retailer_count", "spread", "has_major")


def match_score(c: Column, t: Column) -> Column:
    """How well a found product c (upc, brand, model, retailer_count) fits a known one t (upc, brand, model)."""
    brands, models = (F.lower(c["brand"]), F.lower(t["brand"])), (F.lower(c["model"]), F.lower(t["model"]))
    brand = (brands[0] != "") & (brands[1] != "") & (F.contains(brands[0], brands[1]) | F.contains(brands[1], brands[0]))
    shared = F.size(F.filter(F.split(models[1], r"\s+"), lambda w: (F.length(w) > 2) & F.contains(models[0], w)))
    points = F.when((c["upc"] != "") & (c["upc"] == t["upc"]), BARCODE_POINTS).otherwise(0) + F.when(brand, BRAND_POINTS).otherwise(0) + F.when((models[0] != "") & (models[1] != ""), shared * WORD_POINTS).otherwise(0)
    return points + F.least(c["retailer_count"], F.lit(RETAILER_POINTS)).cast("int")


def best_matches(candidates: DataFrame, known: DataFrame, key: str, least: int = ENOUGH) -> DataFrame:
    """For each row of known the candidate of the same key with the most points, the first of equals; none if it has too few."""
    fields = lambda df, names: F.struct(*(F.coalesce(df[n], F.lit("")).alias(n) for n in names))
    c = candidates.select(key, "seq", F.struct(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("upc", "brand", "model")), "retailer_count").alias("c"), F.col("name").alias("found_name"))
    t = known.select(key, fields(known, ("upc", "brand", "model")).alias("t"))
    scored = c.join(t, key).select(key, "seq", "found_name", match_score(F.col("c"), F.col("t")).alias("score"))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "seq", "found_name")).alias("b"))
    return best.select(key, F.col("b.seq").alias("seq"), "b.found_name", (-F.col("b.minus")).alias("score")).where(F.col("score") >= least)
