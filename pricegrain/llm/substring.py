"""Repeated passages by relative Lempel-Ziv parsing against content-defined reference blocks.

Every document is reference and parsed text at once. A seed is a hash of SEED words; of the seeds in
each window of WINDOW words the least is the window's seed, which depends on the window's words alone.
The consecutive windows that share a seed at one place make a block: its text is the seed with the
words around it that those windows cover. The index of all reference blocks is a table keyed by seed,
with the first document that has each block, and where; blocks that no smaller document has whole are
indexed window by window. A document is then parsed greedily from left to right: a factor (reference
document, place there, length) begins at the first word that the index knows in a smaller document, and
goes on over blocks and windows as long as the same reference goes on with them at the same distance.
Every factor is at least one window long. At last the words of each factor are compared with those of
its reference, by digests of both; documents with a factor that differs are parsed again under another
hash. The words in factors are the duplicates.

Equal windows have equal seeds at equal places, so they always meet under one seed: nothing is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrain.llm.shared import flat, forget, runs, written

WINDOW = 50
SEED = 12
#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK = 1_000_000
#: Bits for the place of a seed beside its hash; longer texts are searched for seeds run by run.
PLACE_BITS = 26
_PLACE = 0xD1342543DE82EF95
BLOCKS = "seed long, block long, doc_id long, row long, first int, last int"


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 64; kept by the worker."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _tables[base] = have = np.cumprod(out)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash, modulo 2 ** 64, of values[start:end] for each span, then mixed."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    out = (sums[ends] - sums[starts]) * _powers(_inverse(base), len(values) + 1)[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class WordHash:
    """XXH64 with a seed; only the tests keep fewer bits, so that hashes of different words are equal."""

    seed: int = 0
    bits: int = 64

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in words), np.uint64, len(words))
        return out & np.uint64((1 << self.bits) - 1)


def _words(data: np.ndarray, at: np.ndarray, salt: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where each text's words begin (and the last one's end)."""
    raw, at = data.tobytes(), at.tolist()
    found = [raw[a:b].split() for a, b in zip(at, at[1:], strict=False)]
    return salt.of([w for words in found for w in words]), np.r_[0, np.cumsum([len(words) for words in found], dtype=np.int64)]


def _windows_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _spans_hash(words, starts, ends, _PLACE)


def _least(hashes: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each span consecutive hashes, the leftmost of equal ones; at most 2 ** PLACE_BITS hashes."""
    n, low = len(hashes), np.uint64((1 << PLACE_BITS) - 1)
    least = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - span + 1], least[span - width : span - width + n - span + 1])
    return (least & low).astype(np.int64)


def _seeds(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one text, the place of each one's seed, and the hashes of all seeds.

    Of equal seeds in a window the leftmost counts.
    """
    n = len(words) - SEED + 1
    hashes = _windows_hash(words, np.arange(n), np.arange(SEED, n + SEED))
    span = WINDOW - SEED + 1
    # Runs share span - 1 hashes, so that each window lies in one whole.
    run = (1 << PLACE_BITS) - span + 1
    place = np.concatenate([a + _least(hashes[a : a + run + span - 1], span) for a in range(0, n - span + 1, run)])
    text = np.searchsorted(begin, np.arange(len(words)), "right")
    inside = np.flatnonzero(text[: len(words) - WINDOW + 1] == text[WINDOW - 1 :])
    return inside, place[inside], hashes


def _blocks(batches: Iterator[pa.RecordBatch], salt: WordHash) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column("text"))
        docs, row = batch.column("doc_id"), batch.column("row")
        for a, b in runs(at, CHUNK):
            words, begin = _words(data[at[a] : at[b]], at[a : b + 1] - at[a], salt)
            if len(words) < WINDOW:
                continue
            window, place, hashes = _seeds(words, begin)
            if not len(window):
                continue
            new = np.r_[True, (np.diff(window) != 1) | (np.diff(place) != 0)]
            first = window[new]
            last = np.r_[window[:-1][new[1:]], window[-1]]
            block = _windows_hash(words, first, last + WINDOW)
            text = np.searchsorted(begin, first, "right") - 1
            of = pa.array(text + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[place[new]].view(np.int64)), pa.array(block.view(np.int64)), docs.take(of), row.take(of), pa.array((first - begin[text]).astype(np.int32)), pa.array((last - begin[text]).astype(np.int32))],
                ["seed", "block", "doc_id", "row", "first", "last"],
            )


def _open_windows(batches: Iterator[pa.RecordBatch], salt: WordHash) -> Iterator[pa.RecordBatch]:
    """(seed, window, doc_id, row, first) of each window of the listed blocks of each text."""
    for batch in batches:
        data, at = flat(batch.column("text"))
        lists = batch.column("open")
        cuts, rows = lists.offsets.to_numpy().astype(np.int64), lists.values
        seeds, firsts, lasts = (rows.field(i).to_numpy() for i in range(3))
        docs, row = batch.column("doc_id"), batch.column("row")
        for a, b in runs(at, CHUNK):
            words, begin = _words(data[at[a] : at[b]], at[a : b + 1] - at[a], salt)
            blocks = slice(cuts[a], cuts[b])
            text = np.repeat(np.arange(a, b), np.diff(cuts[a : b + 1]))
            size = (lasts[blocks] - firsts[blocks] + 1).astype(np.int64)
            of = np.repeat(np.arange(len(size)), size)
            first = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + firsts[blocks][of]
            start = begin[text - a][of] + first
            window = _windows_hash(words, start, start + WINDOW)
            at_doc = pa.array(text[of])
            yield pa.RecordBatch.from_arrays([pa.array(seeds[blocks][of]), pa.array(window.view(np.int64)), docs.take(at_doc), row.take(at_doc), pa.array(first.astype(np.int32))], ["seed", "window", "doc_id", "row", "first"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def _first_place() -> list[Column]:
    """The first place of what a group holds: its parts come from one row, since they are chosen by the same values in the same order."""
    return [F.min("doc_id").alias("ref_doc"), F.min_by("row", "doc_id").alias("ref_row"), F.min_by("first", "doc_id").alias("ref_first")]



_FOUND = ("doc_id", "row", "first", "last", "ref_doc", "ref_row", "ref_first")


def known_windows(docs: DataFrame, salt: WordHash) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of _FOUND: ranges of windows, by first word, that also stand in a document of smaller doc_id, from ref_first on there.

    Also the tables that it reads, to forget when it was read. row is a hash of the document's text, so
    that rows which share a doc_id are kept apart. Null doc_ids have no order: such rows are never
    reference and lose nothing. Blocks that many documents share are counted by partial aggregation, and
    looked up by joins of two plain tables, whose skew Spark splits.
    """
    texts = _keyed(docs).where("doc_id is not null and text is not null")
    blocks = written(texts.mapInArrow(partial(_blocks, salt=salt), BLOCKS), "blocks")
    index = blocks.groupBy("seed").agg(*_first_place(), F.max("doc_id").alias("most"), (F.min("block") == F.max("block")).alias("alike"))
    index = written(index.where("ref_doc < most").drop("most"), "index")
    met = written(blocks.join(index, "seed").where("not alike or doc_id > ref_doc"), "met")
    forget(blocks, index)
    whole = met.where("alike").select(*_FOUND)
    # Seeds with several blocks: the parse goes on over blocks that a smaller document has whole, and stops inside the others.
    several = met.where("not alike").select("seed", "block", "doc_id", "row", "first", "last")
    first = written(several.groupBy("seed", "block").agg(*_first_place()), "first")
    parsed = written(several.join(first, ["seed", "block"]), "parsed")
    forget(first)
    whole = whole.union(parsed.where("doc_id > ref_doc").select(*_FOUND))
    stopped = parsed.where("doc_id = ref_doc").groupBy("doc_id", "row").agg(F.collect_list(F.struct("seed", "first", "last")).alias("open"))
    ends = texts.join(stopped.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "row", "text", "open")
    windows = written(ends.mapInArrow(partial(_open_windows, salt=salt), "seed long, window long, doc_id long, row long, first int"), "windows")
    earliest = windows.groupBy("seed", "window").agg(*_first_place(), F.max("doc_id").alias("most")).where("ref_doc < most").drop("most")
    earliest = written(earliest, "earliest")
    single = windows.join(earliest, ["seed", "window"]).where("doc_id > ref_doc").withColumn("last", F.col("first")).select(*_FOUND)
    return whole.union(single), [met, parsed, windows, earliest]


def factors(known: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Greedy factors (start, length, reference doc, its row, start there), in words, of one text, from left to right.

    known are ranges of windows (first, last, reference doc, its row, first there). A factor goes on while
    a further range of the same reference lies at the same distance and leaves no window between.
    """
    out: list[list[int]] = []  # first and last window, reference, distance
    for first, last, doc, row, there in sorted(known):
        now = out[-1] if out else None
        if now and (now[2], now[3], now[4]) == (doc, row, there - first) and first <= now[1] + 1:
            now[1] = max(now[1], last)
        else:
            out.append([first, last, doc, row, there - first])
    return [(a, b - a + WINDOW, doc, row, a + shift) for a, b, doc, row, shift in out]


def words_digest(words: list[bytes], start: int, length: int) -> bytes:
    """128 bits of the sha256 of a run of words. No word holds a blank, so that joined words tell them apart."""
    return hashlib.sha256(b" ".join(words[start : start + length])).digest()[:16]


PLACES = "array<struct<start:int,length:int>>"
FACTORS = "array<struct<start:int,length:int,ref_doc:long,ref_row:long,ref_start:int>>"
_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_row", pa.int64()), ("ref_start", pa.int32())])


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse each document: what is known of its windows becomes factors."""
    for batch in batches:
        found = batch.column("found")
        cuts, columns = found.offsets.to_numpy(), [found.values.field(i).to_numpy() for i in range(5)]
        own = [factors(list(zip(*(c[x:y].tolist() for c in columns), strict=True))) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        lists = pa.array([[dict(zip(_FACTOR.names, f, strict=True)) for f in each] for each in own], pa.list_(_FACTOR))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), lists], ["doc_id", "row", "factors"])


def _digests(words: list[bytes], places: pa.ListScalar) -> list[bytes]:
    return [words_digest(words, p["start"], p["length"]) for p in places.as_py() or ()]


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the words in factors out of each text; also the digests of its factors, and of the places that factors of others refer to."""
    for batch in batches:
        data, at = flat(batch.column("text"))
        own, asked = batch.column("factors"), batch.column("asked")
        kept, counts, gone, spans, mine, answers = [], [], [], [], [], []
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            words = data[a:b].tobytes().split()
            covered = np.zeros(len(words), bool)
            for f in own[i].as_py() or ():
                covered[f["start"] : f["start"] + f["length"]] = True
            edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
            counts.append(len(words))
            gone.append(int(covered.sum()))
            kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c] if gone[-1] else words).decode())
            mine.append(_digests(words, own[i]))
            answers.append(_digests(words, asked[i]))
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        made = [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(mine, pa.list_(pa.binary())), pa.array(answers, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*rest, *made], [*(n for n in batch.schema.names if n != "text"), *OWN, "mine", "answers"])


def parse(docs: DataFrame, salt: WordHash) -> DataFrame:
    """(rest, doc_id, row, factors, asked, kept_text, n_words, n_removed, spans, mine, answers) of every row, before words are compared.

    rest holds the row's own columns; asked are the places in this text that factors of others refer to,
    mine and answers the digests of its factors and of these places. Equal requests for a place are one.
    Factors follow from what is known of windows alone, so that texts move once for all of this.
    """
    known, read = known_windows(docs, salt)
    found = known.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*_FOUND[2:])).alias("found"))
    own = written(found.mapInArrow(_factors, f"doc_id long, row long, factors {FACTORS}"), "factors")
    forget(*read)
    places = own.select(F.explode("factors").alias("f")).select(F.col("f.ref_doc").alias("doc_id"), F.col("f.ref_row").alias("row"), F.col("f.ref_start").alias("start"), "f.length").distinct()
    asked = places.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "length")).alias("asked"))
    kept = [c for c in docs.columns if c not in OWN]
    keyed = docs.select(F.struct(*kept).alias("rest"), "doc_id", F.xxhash64("text").alias("row"), "text")
    both = own.join(asked, ["doc_id", "row"], "full")
    joined = keyed.join(both.hint("shuffle_hash"), ["doc_id", "row"], "left").select("rest", "doc_id", "row", "text", "factors", F.col("asked").cast(PLACES).alias("asked"))
    fields = T._parse_datatype_string("kept_text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>, mine array<binary>, answers array<binary>").fields
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != "text"), *fields])
    return written(joined.mapInArrow(_cutter, schema), "parse", compression="zstd")


def differing(parsed: DataFrame) -> DataFrame:
    """(doc_id, row) of documents with a factor whose words are not those of its reference.

    The digests of the places are written before they are joined, so that factors of a passage that many
    documents share can be split.
    """
    place = [F.col("p.asked.start").alias("ref_start"), F.col("p.asked.length").alias("length")]
    there = parsed.select(F.col("doc_id").alias("ref_doc"), F.col("row").alias("ref_row"), F.explode(F.arrays_zip("asked", "answers")).alias("p"))
    there = there.select("ref_doc", "ref_row", *place, F.col("p.answers").alias("digest"))
    by = ["ref_doc", "ref_row", "ref_start", "length"]
    there = written(there.groupBy(*by).agg(F.min("digest").alias("right")), "digests")
    every = parsed.select("doc_id", "row", F.explode(F.arrays_zip("factors", "mine")).alias("f"))
    every = every.select("doc_id", "row", *(F.col(f"f.factors.{c}").alias(c) for c in by), F.col("f.mine").alias("digest"))
    return every.join(there, by, "left").where("right is null or right <> digest").select("doc_id", "row").distinct()


OWN = ("kept_text", "n_words", "n_removed", "spans")


def deduplicate(docs: DataFrame, salt: WordHash = WordHash()) -> DataFrame:
    """docs with kept_text, n_words, n_removed and spans: (start, end) of removed runs, in words.

    Words are the runs of characters other than blanks, unchanged. A word goes if a window of WINDOW words
    over it also starts in a document of smaller doc_id, judged on the texts as given. kept_text joins the
    other words by single spaces; a null text has none. Rows with a null doc_id lose nothing; rows that
    repeat a doc_id are judged each, and none of them against another. An empty table gives an empty
    result. Columns of docs with these names are replaced.
    """
    done = parse(docs, salt)
    wrong = written(differing(done), "differing")
    while not wrong.isEmpty():
        salt = WordHash(salt.seed + 1)
        again = parse(docs, salt)
        still = differing(again)
        keys = ["doc_id", "row"]
        done = written(done.join(wrong.hint("shuffle_hash"), keys, "left_anti").select(*again.columns).union(again.join(wrong.hint("shuffle_hash"), keys, "left_semi").select(*again.columns)), "parse", compression="zstd")
        wrong = written(still.join(wrong, keys, "left_semi"), "differing")
    return done.select("rest.*", *OWN)


#: The same rows as the registered query, in DuckDB's SQL.
SQL = f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW} + 2)) AS i, w FROM docs WHERE len(w) >= {WINDOW}
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS least FROM windows GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM windows JOIN firsts USING (h) WHERE doc_id > least
), words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM docs
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(hit.k) AS n_removed,
    sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (hit.k IS NULL), '')) AS kept_sha256
  FROM words LEFT JOIN hit USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
