"""Mixing sources to target weights by weighted fair queueing, with built-in functions only.

The documents of each source queue in an order shuffled by a hash of doc_id, as often as the mix may repeat
them. A copy's virtual finish time is the words of its source's queue up to its end, divided by the
source's weight. All copies in the order of these times are the mix, cut where its words reach the budget:
so sources are served by weight, and one whose queue has ended leaves its share to the others.

Sums along an order are never one task's work: rows are cut into ranges, and a range begins with the sum
of those before it. The words of a source's queue are summed within cells of the shuffled order.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.llm.shared import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the shuffled order in which a source's words are summed: a hot source is so many tasks' work. They leave no trace in results.
CELLS = 4_096
_HEX = 15


def shuffled(doc_id: Column, seed: int = SEED) -> Column:
    """60 bits of the md5 of seed and doc_id: the place in the shuffled order; null ids have one place."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, _HEX), 16, 10).cast("long")


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of columns over all rows up to and with each, in order.

    Rows are sorted into ranges; the sums of whole ranges, a row for each, are what is added up in one place.
    """
    df = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    names = list(sums)
    by = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = whole.select("_range", *(F.coalesce(F.sum(f"_{n}").over(by), F.lit(0)).alias(f"_{n}") for n in names))
    along = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # As many rows as ranges: broadcast.
    out = df.join(F.broadcast(before), "_range").withColumns({n: F.sum(c).over(along) + F.col(f"_{n}") for n, c in sums.items()})
    return out.drop("_range", *(f"_{n}" for n in names))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, weight, source_size, target, budget) of sizes (source, source_size).

    Sources in the order of their code points, null last, have the weights in turn and share the budget,
    `share` times all words, by weight; a source gets no more than `repeats` times its words, and the
    others share what is over. A source is full if at the level of its own limit, for each unit of weight,
    all sources together would take no more than the budget.
    """
    parts = lcm(*weights)
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1).cast("int") % len(weights) + 1).cast("long")
    ranked = ranked.select("source", "rank", weight.alias("weight"), "source_size")
    most = F.col("source_size") * repeats
    ranked = ranked.withColumn("level", most * (F.lit(parts) / F.col("weight")).cast("long"))
    ranked = written(running(ranked, ["level", "rank"], {"filled": most, "heavy": F.col("weight")}), "sources")
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    held = F.col("filled") - most + F.col("level") / parts * (F.col("weights") - F.col("heavy") + F.col("weight")) <= F.col("words") * share
    judged = ranked.crossJoin(F.broadcast(total)).withColumn("full", held)
    rest = judged.groupBy().agg(F.sum(F.when(F.col("full"), most).otherwise(0)).alias("given"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open"))
    target = F.when(F.col("full"), most.cast("double")).otherwise((F.col("words") * share - F.col("given")) / F.col("open") * F.col("weight"))
    return judged.crossJoin(F.broadcast(rest)).select("source", "rank", "weight", "source_size", target.alias("target"), (F.col("words") * share).alias("budget"))


#: What places a copy in the mix: its virtual finish time, and for equal ones its source, its document, and which copy it is.
_ORDER = ["finish", "rank", "place", "doc_id", "hash", "nth", "round"]


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, text) without text, but with size, hash, nth, source_size, target, budget, rank, place, last, whole.

    place is that in the shuffled order. last is the virtual finish time of a document's first copy, and
    whole what each later copy adds, the time of the whole source; the unit is a word at weight
    lcm(weights). Rows equal in doc_id, source and text are counted before they are dealt, so that a hot
    one is one row then, and told apart by nth.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), size.alias("size"))
    cell = F.shiftrightunsigned("place", 4 * _HEX - CELLS.bit_length() + 1).cast("int")
    # A struct is equal to another where both hold null; so the null source is one.
    alike = rows.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n")).withColumn("place", shuffled(F.col("doc_id"), seed))
    alike = written(alike.select(F.struct("source").alias("of"), cell.alias("cell"), "doc_id", "hash", "size", "n", "place"), "sizes")
    cells = written(alike.groupBy("of", "cell").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "cells")
    aims = targets(cells.groupBy("of").agg(F.sum("words").alias("source_size")).select("of.source", "source_size"), weights, share, repeats)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = written(cells.select("of", "cell", before.alias("before")).join(aims.withColumn("of", F.struct("source")).drop("source"), "of"), "cells")
    along = Window.partitionBy("of", "cell").orderBy("place", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.join(begun, ["of", "cell"]).withColumn("earlier", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(along), F.lit(0)))
    unit = (F.lit(lcm(*weights)) / F.col("weight")).cast("long")
    each = placed.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
    last = (F.col("earlier") + F.col("nth") * F.col("size")) * unit
    return each.select("doc_id", "of.source", "hash", "size", "nth", "source_size", "target", "budget", "rank", "place", last.alias("last"), (F.col("source_size") * unit).alias("whole"))


def _copies(queue: DataFrame, repeats: int) -> DataFrame:
    """Every copy of a queue with the words of the mix up to its end."""
    copies = queue.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("round")).withColumn("finish", F.col("last") + (F.col("round") - 1) * F.col("whole"))
    return running(copies.select(*_ORDER, "source", "size", "budget"), _ORDER, {"upto": F.col("size")})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, hash, size, nth, source_size, target, taken) of each row of docs: taken are the words of its copies in the mix.

    A null or blank text has no word, and takes none. A null doc_id is an id like any other; the null source is one source, the
    last. Rows that repeat are rows of their own. An empty table gives an empty result, and where no text
    has a word targets are zero. The taken words of a source differ from its target by less than its
    longest document and its share of the other sources' longest ones.
    """
    queue = written(queued(docs, weights, share, repeats, seed), "queue")
    # One row: where the mix is cut.
    cut = _copies(queue, repeats).where(F.col("upto") <= F.col("budget")).agg(F.max(F.struct(*_ORDER)).alias("cut"))
    place = lambda k: F.struct((F.col("last") + (k - 1) * F.col("whole")).alias("finish"), "rank", "place", "doc_id", "hash", "nth", F.lit(k).alias("round"))
    times = sum((F.coalesce(place(k) <= F.col("cut"), F.lit(False)).cast("long") for k in range(1, repeats + 1)), F.lit(0).cast("long"))
    return queue.crossJoin(F.broadcast(cut)).select("doc_id", "source", "hash", "size", "nth", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of docs for every copy taken, with at, the words of the mix before it.

    Sorting by at, and by nothing where a text has no word, gives the training order. A column of docs
    named at is replaced.
    """
    queue = written(queued(docs, weights, share, repeats, seed), "queue")
    taken = _copies(queue, repeats).where(F.col("upto") <= F.col("budget"))
    key = lambda source, hashed: F.struct("doc_id", source, hashed, "nth").alias("_key")
    taken = taken.select(key("source", "hash"), (F.col("upto") - F.col("size")).alias("_at"))
    rest = [c for c in docs.columns if c != "at"]
    rows = docs.select(F.struct(*rest).alias("_row"), "doc_id", "source", F.xxhash64("text").alias("hash"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "hash").orderBy(F.xxhash64("_row"))))
    return numbered.select("_row", key("source", "hash")).join(taken, "_key").select(*(F.col("_row")[c].alias(c) for c in rest), F.col("_at").alias("at"))


#: The same rows as the registered query, in DuckDB's SQL.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {_HEX}) AS BIGINT) AS place FROM documents
), sources AS (
  SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1] AS BIGINT) AS weight, source_size * {REPEATS} AS most
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) AS rank FROM sized GROUP BY source)
), levels AS (
  SELECT *, most * ({lcm(*WEIGHTS)} // weight) AS level, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights FROM sources
), judged AS (
  SELECT *, sum(most) OVER w - most + level / {lcm(*WEIGHTS)} * (weights - sum(weight) OVER w + weight) <= words * {SHARE} AS fills
  FROM levels WINDOW w AS (ORDER BY level, rank)
), aims AS (
  SELECT *, CASE WHEN fills THEN CAST(most AS DOUBLE) ELSE (CAST(words AS DOUBLE) * {SHARE} - coalesce(sum(most) FILTER (fills) OVER (), 0)) / sum(weight) FILTER (NOT fills) OVER () * weight END AS target FROM judged
), queue AS (
  SELECT s.*, rank, source_size, target, words, ({lcm(*WEIGHTS)} // weight) AS unit,
    sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id) AS upto FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), copies AS (
  SELECT *, (upto + (k - 1) * source_size) * unit AS finish FROM queue, range(1, {REPEATS} + 1) r(k)
), cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, place, doc_id, k) <= words * {SHARE} AS taken FROM copies
)
SELECT doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(CASE WHEN taken THEN size ELSE 0 END) AS BIGINT) AS taken
FROM cut GROUP BY doc_id, size
"""
