"""Pairs of titles that name one product, by an inverted index over their rarest words.

Whatever makes two titles one product, they share at least SAME_WORDS of the shorter one's words. So, words
being in one order for all, rarest first, the shorter title's first words, one more than it may miss, hold
a word of the longer one: only titles that meet so are compared. A word that very many titles have is
cut into cells, and hardly ever among the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.functions import text
from pricegrain.operators.clusters import CONTAINED, CONTAINED_LEAST, SAME_WORDS, identity, same_product
from pricegrain.operators.pages import held
from pricegrain.operators.rows import rare_first
from pricegrain.session import once

#: Titles of one word that meet in one cell, about.
CELL = 4_096


def prefix(n: Column, share: float, least: int = 1) -> Column:
    """How many of n words, rarest first, must be looked at so that a title with `share` of them, or at least so many, is met; 0 if none can."""
    needed = F.greatest(F.ceil(n * share - 1e-9), F.lit(least))
    return F.greatest(n - needed + 1, F.lit(0))


def title_classes(titles: DataFrame, group: list[str], by_colour: bool = False, brand: str | None = None) -> DataFrame:
    """titles (group, id, title) with rep, the least id of their group whose title has the same identity, and identity itself."""
    hint = F.lit(brand) if brand is not None else None
    rows = held(titles, _id=identity(text.without_stores(F.coalesce("title", F.lit(""))), hint))
    i = F.col("_id")
    fields = {n: F.array_sort(i[n]) for n in ("words", "sizes", "numbers")} | {n: i[n] for n in ("brand", "size", "accessory")} | {"colour": i["colour"] if by_colour else F.lit("")}
    rows = once(rows.select(*titles.columns, F.struct(*(c.alias(n) for n, c in fields.items())).alias("identity")), "identities")
    reps = rows.groupBy(*group, "identity").agg(F.min("id").alias("rep"))
    return rows.join(reps, [*group, "identity"])


def similar_titles(classes: DataFrame, group: list[str], by_colour: bool = False) -> DataFrame:
    """(group, a, b) of title_classes(): the pairs, a before b, of representatives that are the same product.

    Titles of one class are one product by themselves where they have any word, and are not paired. A title without a word is no
    product's. Every pair is found; none is formed that shares no word of the shorter title's first.
    """
    reps = once(classes.where("id = rep").select(*group, "rep", "identity").dropDuplicates([*group, "rep"]).where(F.size("identity.words") > 0), "representatives")
    ranked = rare_first(reps, group, "rep", F.col("identity.words")).join(reps, [*group, "rep"])
    n = F.size("ranked")
    ranked = ranked.withColumns({"size": n, "alike": prefix(n, SAME_WORDS), "inside": F.when(n == 2, 1).otherwise(prefix(n, CONTAINED, CONTAINED_LEAST))})
    # The struct goes along, so that a pair is judged where it is formed.
    words = ranked.select(*group, "rep", "identity", "size", "alike", "inside", F.posexplode("ranked").alias("at", "w"))
    cells = F.ceil(F.col("w.n") / CELL).cast("int")
    first = words.where(F.col("at") < F.greatest("alike", "inside"))
    short = first.select(*group, F.col("w.word").alias("word"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"), F.struct("rep", "identity", "size", "alike", "inside", "at").alias("s"))
    asked = first.select(*group, F.col("w.word").alias("word")).distinct()
    long = words.select(*group, F.col("w.word").alias("word"), F.pmod(F.xxhash64("rep"), cells).cast("int").alias("cell"), F.struct("rep", "identity", "size", "alike", "at").alias("l"))
    long = long.join(asked, [*group, "word"], "left_semi")
    s, other = F.col("s"), F.col("l")
    order = (s["size"] < other["size"]) | ((s["size"] == other["size"]) & (s["rep"] < other["rep"]))
    near = (other["size"] * SAME_WORDS <= s["size"] + 1e-9) & (other["at"] < other["alike"]) & (s["at"] < s["alike"])
    met = short.join(long, [*group, "word", "cell"]).where(order & (near | (s["at"] < s["inside"])))
    good = met.where(same_product(s["identity"], other["identity"], by_colour))
    return good.select(*group, F.least(s["rep"], other["rep"]).alias("a"), F.greatest(s["rep"], other["rep"]).alias("b")).distinct()
