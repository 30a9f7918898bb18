"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Each text is a set of hashed n-grams of its lower-cased bytes. The features' weights are a logistic
regression's on values that are the naive Bayes log-count ratio where the n-gram is present, and zero
elsewhere. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricegrain.llm.features import fold_table, grams
from pricegrain.llm.shared import flat, forget, held_out, kept_for, runs, written

SIZES = (3, 4, 5, 6, 7, 8)
BITS = 20
#: Labelled documents of each class that the model is fitted on, at most: those with the least hashed ids.
PER_CLASS = 2_500
THRESHOLD = 0.7
#: Scale of the summed features; epochs and step of the fit.
SCALE, EPOCHS, STEP = 0.05, 150, 0.1
#: How many n-grams weigh: those whose shares of toxic and of clean training documents differ by the most standard errors.
FEATURES = 1_024
#: Weight of the squared weights in the fit.
DECAY = 1e-6
#: Bytes of text hashed at once.
CHUNK = 250_000
_FOLD = fold_table()


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _run_features(column: pa.Array, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of each used feature that is present, once for each text, sorted by text; one run of texts at a time."""
    data, at = flat(column)
    for a, b in runs(at, CHUNK):
        part, offsets = _FOLD[data[at[a] : at[b]]], at[a : b + 1] - at[a]
        keys = []
        for n, hashes, _ in grams(part, offsets, SIZES):
            features = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
            places = np.flatnonzero(used[features])
            texts = np.searchsorted(offsets, places, "right") - 1
            inside = places + n <= offsets[texts + 1]
            keys.append(((texts[inside] + a) << BITS) | features[places[inside]])
        if keys:
            found = np.unique(np.concatenate(keys))
            yield found >> BITS, found & ((1 << BITS) - 1)


def _present(column: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of a whole batch, for few used features."""
    found = list(_run_features(column, used)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many toxic and clean texts of this partition each feature is present."""
    kept_for("toxicity")
    toxic, clean, every = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), np.ones(1 << BITS, bool)
    for batch in batches:
        label = batch.column("toxic").to_numpy() == 1
        for text, feature in _run_features(batch.column("text"), every):
            of = label[text]
            toxic += np.bincount(feature[of], minlength=1 << BITS)
            clean += np.bincount(feature[~of], minlength=1 << BITS)
    seen = np.flatnonzero(toxic + clean)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(toxic[seen]), pa.array(clean[seen])], ["feature", "toxic", "clean"])


def _chosen(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("toxicity")
        used = broadcast.value
        for batch in batches:
            text, feature = _present(batch.column("text"), used)
            cuts = np.r_[0, np.cumsum(np.bincount(text, minlength=batch.num_rows))]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists], ["toxic", "features"])

    return rows


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, text, toxic) of at most per_class documents of each class, the least by a hash of doc_id.

    Held-out documents and null labels take no part; of several labels of a document the largest counts,
    and of several texts the least.
    The chosen ids are at most twice per_class rows, which is what may be broadcast.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].union(parts[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded, documented sample of labelled rows.

    Spark counts the features and returns the FEATURES that tell the classes apart best, then each
    document's list of these; the driver gets so many counts and 2 * per_class lists, and fits on them.
    """
    spark = docs.sparkSession
    sample = written(training_rows(docs, labels, per_class).select("toxic", "text"), "toxicity")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    size, n_toxic, n_clean = 1 << BITS, sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        # One class or none: nothing to tell apart, and every text scores as that class.
        return Model(np.zeros(size, np.float32), 20.0 if n_toxic else -20.0)
    counted = sample.mapInArrow(_count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Shares are moved toward a half by one document each, so that n-grams of few documents do not come before all others.
    with_, total = F.col("toxic") + F.col("clean"), n_toxic + n_clean
    pooled = (with_ + 1) / (total + 2)
    apart = F.abs(F.col("toxic") / n_toxic - F.col("clean") / n_clean) / F.sqrt(pooled * (1 - pooled))
    kept = counted.where(apart > 0).orderBy(apart.desc(), with_.desc(), "feature").limit(FEATURES).toArrow().sort_by("feature")
    feature, with_, without = (kept.column(c).to_numpy() for c in ("feature", "toxic", "clean"))
    ratio = np.log((with_ + 1) / (n_toxic + 2)) - np.log((without + 1) / (n_clean + 2))
    used = np.zeros(size, bool)
    used[feature] = True
    rows = sample.mapInArrow(_chosen(spark.sparkContext.broadcast(used)), "toxic int, features array<int>").toArrow()
    forget(sample)
    y, lists = rows.column("toxic").to_numpy().astype(np.float64), rows.column("features").combine_chunks()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    column = np.searchsorted(feature, lists.values.to_numpy())
    weight = np.where(y > 0, 0.5 / n_toxic, 0.5 / n_clean)  # both classes count alike
    w, bias = np.zeros(len(feature)), 0.0
    first, second = np.zeros(len(feature)), np.zeros(len(feature))
    for epoch in range(1, EPOCHS + 1):
        z = np.bincount(row, (w * ratio)[column], len(y)) * SCALE + bias
        error = (1 / (1 + np.exp(-z)) - y) * weight
        slope = np.bincount(column, (error * SCALE)[row], len(feature)) * ratio + DECAY * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        w -= STEP * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
        bias -= 0.5 * error.sum()
    weights = np.zeros(size, np.float32)
    weights[feature] = w * ratio * SCALE
    return Model(weights, float(bias))


def _scorer(broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("toxicity")
        model = broadcast.value
        used = model.weights != 0
        for batch in batches:
            text, feature = _present(batch.column("text"), used)
            z = np.bincount(text, model.weights[feature].astype(np.float64), batch.num_rows) + model.bias
            out = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    return score


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text; a null or empty text has the score of no n-gram.

    A column of docs with the same name is replaced; rows that repeat are rows of their own with equal
    scores; an empty table gives an empty result. The model has 2 ** BITS weights whatever the input.
    """
    rest = [c for c in docs.columns if c not in ("text", column)]
    inner = docs.select(F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"), "text")
    schema = T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType())])
    made = inner.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return made.select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns if c != column), F.col("score").alias(column))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that score below the threshold by a model fitted on them; the columns stay as they are."""
    mark = "score" if "score" not in docs.columns else "toxicity_score"
    return score(docs, fit(docs, labels), mark).where(F.col(mark) < threshold).select(*docs.columns)
