"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds a word of bits at each position, one bit for each language: setting an
n-gram sets its languages' bits at each of its positions, and one lookup, the AND of the words at its
positions, returns all languages that contain it. Over a text, each language's number of n-grams found
is corrected for its share of false positives; the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.llm.features import fold_table, grams
from pricegrain.llm.shared import flat, forget, held_out, runs, written

SIZES = (2, 3, 4)
#: Documents of each language that the filters are fitted on, about: those with the least hashed ids.
PER_LANGUAGE = 1_500
#: An n-gram is a language's if it is so common there, against the language where it is most common.
SHARE = 0.35
LEAST = 3
HASHES = 3
WORD_BITS = 64
#: N-grams of a language in the filter, about: the most frequent ones. The filter's size follows from how many there are.
MOST_GRAMS = 1 << 18
CHUNK = 1_000_000
UNKNOWN = "und"
_FOLD = fold_table(letters_only=True)


@dataclass
class Filters:
    """words: one array of positions for each 64 languages; false: each language's rate of false positives."""

    languages: list[str]
    words: np.ndarray
    false: np.ndarray

    def positions(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(self.words.shape[1] - 1)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield (hashes + np.uint64(k) * step) & size

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Of each n-gram the languages that contain it, as bits."""
        out = None
        for at in self.positions(hashes):
            found = self.words[:, at]
            out = found if out is None else out & found
        return out


def _spread(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, at = flat(batch.column("text"))
        for a, b in runs(at, CHUNK):
            part, offsets = _FOLD[data[at[a] : at[b]]], at[a : b + 1] - at[a]
            own = langs[a:b]
            for _, hashes, spans in grams(part, offsets, SIZES):
                for lang in sorted(set(own)):
                    rows = np.flatnonzero(own == lang)
                    values, counts = np.unique(np.concatenate([hashes[s:e] for s, e in spans[rows]]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Fit on about per_language documents of each language, never on held-out ones.

    The sample takes documents whose hashed id is under a threshold that the language's number of
    documents sets, so its size does not grow with the input. Its n-grams are counted by Spark.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)).alias("draw"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))))
    counted = known.where(F.col("draw") < share[F.col("lang")]).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    grouped = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    # Only the n-grams to keep come to the driver.
    grouped = written(grouped, "grams")
    rates = grouped.join(F.broadcast(grouped.groupBy("lang").agg(F.sum("n").alias("total"))), "lang").withColumn("rate", F.col("n").cast("double") / F.col("total"))
    leading = rates.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("most"))
    leading = written(leading.select("lang", "gram", "n"), "leading")
    floors = _floors([(r.lang, r.n, r.grams) for r in leading.groupBy("lang", "n").agg(F.count("*").alias("grams")).collect()])
    floor = F.create_map(*(F.lit(x) for pair in floors.items() for x in pair)) if floors else F.create_map()
    found = leading.where(F.col("n") >= floor[F.col("lang")]).select("lang", "gram").toArrow() if floors else leading.select("lang", "gram").limit(0).toArrow()
    forget(grouped, leading)
    number = {lang: i for i, lang in enumerate(languages)}
    of = np.fromiter((number[x] for x in found.column("lang").to_pylist()), np.int64, found.num_rows)
    gram = _spread(found.column("gram").to_numpy().view(np.uint64))
    largest = int(np.bincount(of, minlength=len(languages)).max()) if len(of) else 1
    size = 1 << int(np.ceil(np.log2(max(1024, 8 * largest))))
    out = Filters(languages, np.zeros((-(-len(languages) // WORD_BITS), size), np.uint64), np.zeros(len(languages)))
    for lang in range(len(languages)):
        word, bit = divmod(lang, WORD_BITS)
        for at in out.positions(gram[of == lang]):
            out.words[word, at.astype(np.int64)] |= np.uint64(1) << np.uint64(bit)
        out.false[lang] = float(((out.words[word] >> np.uint64(bit)) & np.uint64(1)).mean()) ** HASHES
    return out


def _floors(counts: list[tuple[str, int, int]]) -> dict[str, int]:
    """Each language's least count of an n-gram to keep, from (lang, count, n-grams with it): LEAST where any has that much, and more where too many do."""
    out: dict[str, int] = {}
    for lang in sorted({c[0] for c in counts}):
        own = sorted(((n, grams_) for name, n, grams_ in counts if name == lang), reverse=True)
        frequent = [x for x in own if x[0] >= LEAST] or own
        total, out[lang] = 0, frequent[0][0]
        for n, number in frequent:
            total += number
            if total > MOST_GRAMS:
                break
            out[lang] = n
    return out


def _popcounts(filters: Filters, hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of each text and language the n-grams found: rows are texts."""
    found = filters.lookup(_spread(hashes))
    out = np.zeros((len(cuts) - 1, len(filters.languages)))
    for lang in range(len(filters.languages)):
        word, bit = divmod(lang, WORD_BITS)
        on = np.r_[0, np.cumsum((found[word] >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        out[:, lang] = on[cuts[1:]] - on[cuts[:-1]]
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _predictor(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = broadcast.value
        for batch in batches:
            data, at = flat(batch.column("text"))
            counts, totals = np.zeros((batch.num_rows, len(filters.languages))), np.zeros(batch.num_rows)
            for a, b in runs(at, CHUNK) if filters.languages else []:
                part, offsets = _FOLD[data[at[a] : at[b]]], at[a : b + 1] - at[a]
                for _, hashes, spans in grams(part, offsets, SIZES):
                    # n-grams that cross into the next text are put out of every text's range
                    inside = np.concatenate([np.arange(s, e) for s, e in spans]) if len(spans) else np.zeros(0, np.int64)
                    cuts = np.r_[0, np.cumsum(spans[:, 1] - spans[:, 0])]
                    counts[a:b] += _popcounts(filters, hashes[inside], cuts)
                    totals[a:b] += cuts[1:] - cuts[:-1]
            share = np.maximum(0, (counts / np.maximum(totals, 1)[:, None] - filters.false) / np.maximum(1 - filters.false, 1e-9)) if filters.languages else counts
            letters = [_has_letter(t) for t in batch.column("text").to_pylist()]
            best = share.argmax(1) if share.size else np.zeros(batch.num_rows, np.int64)
            known = [x and bool(filters.languages) for x in letters]
            value = [float(share[i, best[i]] / max(share[i].sum(), 1e-12)) if k else 0.0 for i, k in enumerate(known)]
            names = [filters.languages[best[i]] if k else UNKNOWN for i, k in enumerate(known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(value, pa.float64())], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text: a learned language, or `und` for null or without a letter.

    The score is the language's share among all languages' corrected shares of n-grams. Ties go to the
    language that is first in order. Rows that repeat are rows of their own with equal results; an empty
    table gives an empty result; other columns are not read.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select("doc_id", "text").mapInArrow(_predictor(broadcast), "doc_id long, lang_pred string, score double")
