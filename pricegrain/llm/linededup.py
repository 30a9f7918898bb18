"""Line deduplication by content-defined chunks of lines, with built-in functions only.

A polynomial hash rolls over the hashes of a line and the one before; a chunk ends after a line where it
is less than at the line before and not greater than at the next. So boundaries lie two lines apart or
more, every third line on average, and an inserted or deleted line moves none but those beside it. A
chunk of several lines that stands in more than one place is removed everywhere but in the first, after
its bytes were compared. Of a repeated passage the lines before its first boundary and after its last
one stay, as their chunks also hold foreign lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricegrain.llm.shared import written

#: The rolling hash: its base and prime.
BASE, PRIME = 31, 1_000_003
LEAST_LINES = 2
_KEY = ["doc", "row"]


def line_hash(line: Column) -> Column:
    """28 bits of the line's md5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _at(values: Column, i: Column) -> Column:
    return F.when(i < 1, F.lit(0)).otherwise(F.element_at(values, F.greatest(i, F.lit(1))))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a generator is what keeps Spark from copying them into each use inside a lambda."""
    for name, column in columns.items():
        df = df.select("*", F.inline(F.array(F.struct(column.alias(name)))))
    return df


def with_chunks(docs: DataFrame) -> DataFrame:
    """docs (doc, row, text) with lines, and chunks: an array of (start, n, text), start being the first line's place from 0."""
    count = F.size("lines")
    hashes, rolls = F.col("hashes"), F.col("rolls")
    rolled = F.transform(F.sequence(F.lit(1), count), lambda i: (F.element_at(hashes, i) + BASE * _at(hashes, i - 1)) % PRIME)
    least = lambda i: (i > 1) & (F.element_at(rolls, i) < _at(rolls, i - 1)) & (F.element_at(rolls, i) <= F.try_element_at(rolls, i + 1))
    ends = F.filter(F.sequence(F.lit(1), count), lambda i: (i == count) | least(i))
    # The lines between one end and the next.
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)).alias("start"), F.col("ends").alias("end"))
    pieces = F.transform(
        "bounds",
        lambda b: F.struct(b["start"].alias("start"), (b["end"] - b["start"]).alias("n"), F.array_join(F.slice("lines", b["start"] + 1, b["end"] - b["start"]), "\n").alias("text")),
    )
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return _held(docs, lines=split, hashes=F.transform("lines", line_hash), rolls=rolled, ends=ends, bounds=bounds, chunks=pieces).drop("hashes", "rolls", "ends", "bounds")


def _located(docs: DataFrame) -> DataFrame:
    """One row for each chunk of several lines that is not blank."""
    chunk = with_chunks(docs).select(*_KEY, F.explode("chunks").alias("c"))
    return chunk.where((F.col("c.n") >= LEAST_LINES) & (F.trim(F.regexp_replace("c.text", "\n", "")) != "")).select(*_KEY, "c.start", "c.n", F.xxhash64("c.text").alias("hash"), "c.text")


def _repeats(places: DataFrame, by: list[str]) -> DataFrame:
    """Places (by, doc, row, start, n) that are not the first of those with equal values in by.

    The first places are written before they are joined: a chunk that a third of all documents share is
    one row there, and its other side can be split.
    """
    spot = F.struct(*_KEY, "start")
    first = written(places.groupBy(*by).agg(F.count("*").alias("times"), F.min(spot).alias("first")).where("times > 1").select(*by, "first"), "first")
    return places.join(first, by).where(spot != F.col("first")).select(*_KEY, "start", "n")


def removed_chunks(docs: DataFrame) -> DataFrame:
    """(doc, row, start, n) of every chunk to remove from docs (doc, row, text).

    Chunks are brought together by hash, and the least and greatest bytes under each hash compared. Hashes
    under which texts differ, if there are any, are grouped by the texts themselves.
    """
    chunks = _located(docs)
    spot = F.struct(*_KEY, "start")
    first = chunks.groupBy("hash").agg(F.count("*").alias("times"), F.min(spot).alias("first"), (F.min("text") == F.max("text")).alias("same"))
    first = written(first.where("times > 1"), "first")
    out = chunks.select(*_KEY, "start", "n", "hash").join(first.where("same").select("hash", "first"), "hash").where(spot != F.col("first")).select(*_KEY, "start", "n")
    mixed = first.where("not same").select("hash")
    if not mixed.isEmpty():
        out = out.union(_repeats(chunks.join(mixed, "hash", "left_semi"), ["hash", "text"]))
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks taken out of their texts, and n_lines, n_removed_lines, n_removed_chunks.

    The first place of a chunk is the one in the least doc_id (null before all), and there the least
    line; rows equal in doc_id and text are one document and stay alike. A null text has no line and stays
    null; an empty one has one line. A text all of whose lines go becomes empty, and its row stays. Other
    columns stay as they are; columns of docs named like the three counts are replaced.
    """
    counts = ("n_lines", "n_removed_lines", "n_removed_chunks")
    keyed = docs.drop(*counts).select(F.struct(*(c for c in docs.columns if c not in counts and c != "text")).alias("rest"), "text", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("row"))
    gone = removed_chunks(keyed.where("text is not null").select(*_KEY, "text")).distinct()
    lists = gone.groupBy(*_KEY).agg(F.sort_array(F.collect_list("start")).alias("gone"), F.sum("n").alias("lines_gone"))
    joined = with_chunks(keyed).join(lists.hint("shuffle_hash"), _KEY, "left")
    kept = F.array_join(F.transform(F.filter("chunks", lambda c: ~F.array_contains("gone", c["start"])), lambda c: c["text"]), "\n")
    own = [F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns if c not in counts]
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines"))
    return joined.select(*own, lines.cast("long").alias(counts[0]), F.coalesce("lines_gone", F.lit(0)).cast("long").alias(counts[1]), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(counts[2]))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks taken out of their texts; rows and columns stay as they are."""
    # Other columns go under numbers, which clash with nothing.
    names = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)}
    return deduplicate(docs.select(*(F.col(c).alias(n) for c, n in names.items()))).select(*(F.col(n).alias(c) for c, n in names.items()))


#: The same rows as the registered query, in DuckDB's SQL.
SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line, len(l) AS n_lines
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM lines
), rolled AS (
  SELECT *, (h + {BASE} * coalesce(lag(h) OVER w, 0)) % {PRIME} AS roll FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT *, coalesce(roll < lag(roll) OVER w AND roll <= lead(roll) OVER w, false) AS ends FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended
), chunks AS (
  SELECT doc_id, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM numbered GROUP BY 1, 2
), judged AS (
  SELECT *, n >= {LEAST_LINES} AND trim(replace(text, chr(10), '')) <> ''
    AND row_number() OVER (PARTITION BY text ORDER BY doc_id, start) > 1 AS gone
  FROM chunks
)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS n_removed_lines,
  CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed_chunks,
  sha256(coalesce(string_agg(text, chr(10) ORDER BY start) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""
