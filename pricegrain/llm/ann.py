"""Nearest neighbours by largest inner product over balanced posting lists.

Centroids come from balanced bisection of a bounded sample. A vector goes to the list of its nearest
centroid and, near a boundary, also to those of others that are hardly farther. Centroids are searched
by best-first search over a graph of their neighbours, held in memory; a query takes the lists whose
centroids are within a ratio of the nearest one's distance, the nearest of them first, and as many as a
trial of some queries against all vectors shows to be needed.
Inner products become distances by one more component, which gives all vectors the same norm.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.llm.shared import partitions, written


@dataclass(frozen=True)
class Settings:
    """lists: vectors to a list, about, and how many lists there are at most (this bounds what is broadcast).

    The sample has at most sample_factor vectors to a list, and sample_bytes in all. A vector has at most replicas lists, and a
    further one only up to closure times the nearest distance. A query reads lists only up to ratio times
    the nearest distance, and of these the probes nearest ones: both are where calibrated() begins, and
    grow until the trial queries find the share recall of their neighbours.
    """

    vectors_per_list: int = 100
    most_lists: int = 65_536
    sample_factor: int = 16
    sample_bytes: int = 256 << 20
    neighbours: int = 24
    entries: int = 64
    replicas: int = 4
    closure: float = 1.1
    probes: int = 96
    ratio: float = 1.25
    trial: int = 256
    recall: float = 0.95
    block: int = 512
    query_block: int = 1024


@dataclass
class Index:
    """Centroids of augmented vectors, the graph over them, and the norm that all vectors are given."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float

    def augmented(self, vectors: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(0, self.norm**2 - (vectors.astype(np.float64) ** 2).sum(1)))
        return np.hstack([vectors, extra[:, None]]).astype(np.float32)

    def nearest(self, points: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search for all points at once: (centroids, squared distances) of each, nearest first.

        Each point keeps the best `breadth` centroids seen; the nearest one whose neighbours were not yet
        looked at is expanded, until none is left. A place that is not filled has an infinite distance.
        """
        own = (self.centroids**2).sum(1)
        rows = np.arange(len(points))[:, None]
        seen = np.zeros((len(points), len(self.centroids)), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (len(points), 1))
        far = own[self.entries] - 2 * points @ self.centroids[self.entries].T
        done = np.zeros(ids.shape, bool)
        while True:
            if ids.shape[1] > breadth:
                keep = np.argpartition(far, breadth - 1, 1)[:, :breadth]
                ids, far, done = ids[rows, keep], far[rows, keep], done[rows, keep]
            open_ = np.where(done, np.inf, far)
            at = open_.argmin(1)
            active = np.flatnonzero(np.isfinite(open_[rows[:, 0], at]))
            if not len(active):
                break
            done[active, at[active]] = True
            new = self.graph[ids[active, at[active]]]
            fresh = ~seen[active[:, None], new]
            seen[active[:, None], new] = True
            dist = np.where(fresh, own[new] - 2 * np.einsum("nd,ngd->ng", points[active], self.centroids[new]), np.inf)
            wide = np.full((len(points), new.shape[1]), np.inf, far.dtype)
            wide[active] = dist
            names = np.zeros(wide.shape, ids.dtype)
            names[active] = new
            ids, far, done = np.hstack([ids, names]), np.hstack([far, wide]), np.hstack([done, ~np.isfinite(wide)])
        order = np.argsort(far, 1, kind="stable")
        ids, far = ids[rows, order], far[rows, order]
        return ids, np.where(np.isfinite(far), np.maximum(0, far + (points**2).sum(1)[:, None]), np.inf)


def _halves(points: np.ndarray, which: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size: split at the median along the line between two means."""
    own = points[which]
    direction = own[rng.integers(len(own))] - own[rng.integers(len(own))]
    for _ in range(5):
        along = own @ direction
        order = np.argsort(along, kind="stable")
        left, right = order[: len(order) // 2], order[len(order) // 2 :]
        step = own[right].mean(0) - own[left].mean(0)
        if not step.any():
            break
        direction = step
    return which[left], which[right]


def build(sample: np.ndarray, total: int, norm: float, settings: Settings = Settings()) -> Index:
    """An index for `total` vectors from a sample of them: 2 ** k lists with equal shares of the sample."""
    index = Index(np.zeros((1, sample.shape[1] + 1), np.float32), np.zeros((1, 1), np.int64), np.zeros(1, np.int64), norm)
    points = index.augmented(sample)
    rng = np.random.default_rng(0)
    wanted = min(settings.most_lists, max(1, total // settings.vectors_per_list), max(1, len(points) // 2))
    leaves = [np.arange(len(points))]
    while 2 * len(leaves) <= wanted:
        leaves = [half for leaf in leaves for half in _halves(points, leaf, rng)]
    index.centroids = np.stack([points[leaf].mean(0) for leaf in leaves])
    count = len(leaves)
    own = (index.centroids**2).sum(1)
    width = min(settings.neighbours, max(1, count - 1))
    graph = np.zeros((count, width), np.int64)
    for a in range(0, count, 1024) if count > 1 else []:
        far = own[None, :] - 2 * index.centroids[a : a + 1024] @ index.centroids.T
        far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
        graph[a : a + 1024] = np.argpartition(far, width - 1, 1)[:, :width]
    # Every centroid is some other one's neighbour too: the last places hold links back to each in turn.
    graph[:, -1] = np.roll(np.arange(count), 1)
    index.graph, index.entries = graph, np.sort(rng.permutation(count)[: settings.entries])
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


STEP = 512
WIDEST = 16


def lists_of(index: Index, vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list) pairs: the nearest list, and for vectors near a boundary the others up to the closure ratio."""
    ids, far = index.nearest(index.augmented(vectors), 4 * settings.replicas)
    ids, far = ids[:, : settings.replicas], far[:, : settings.replicas]
    row, place = np.nonzero(np.isfinite(far) & (far <= settings.closure**2 * far[:, :1]))
    return row, ids[row, place]


def probes_of(index: Index, vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(query, list) pairs: lists whose centroids are within the ratio of the nearest one's distance."""
    points = np.hstack([vectors, np.zeros((len(vectors), 1))]).astype(np.float32)
    ids, far = index.nearest(points, settings.probes)
    row, place = np.nonzero(np.isfinite(far) & (far <= settings.ratio**2 * np.maximum(far[:, :1], np.finfo(np.float32).tiny)))
    return row, ids[row, place]


def calibrated(index: Index, asked: np.ndarray, owner: np.ndarray, near: np.ndarray, settings: Settings) -> Settings:
    """settings with enough probes for the queries asked: near are their true neighbours, owner says whose each is.

    While too few neighbours are found, probes are doubled if they are what bounds most reads, and else
    the ratio is widened; if no ratio is enough, all lists are read.
    """
    if not len(near):
        return settings
    row, lists = lists_of(index, near, settings)
    stored, count = owner[row] * len(index.centroids) + lists, len(index.centroids)
    while settings.ratio < math.inf:
        query, read = probes_of(index, asked, settings)
        if len(np.unique(row[np.isin(stored, query * count + read)])) >= settings.recall * len(near):
            break
        if settings.probes < count and 2 * len(query) > len(asked) * settings.probes:
            settings = replace(settings, probes=2 * settings.probes)
        elif settings.ratio < WIDEST:
            settings = replace(settings, ratio=1.1 * settings.ratio)
        else:
            settings = replace(settings, probes=count, ratio=math.inf)
    return settings


def _nearest_of_all(broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """The k nearest vectors of each trial query in one task, by comparison with all; a query is not its own neighbour."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = broadcast.value
        scores, nodes, near = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0, asked.shape[1]))
        at = np.arange(len(names))[:, None]
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                vectors, own = _matrix(part.column("embedding")), part.column("node").to_numpy()
                new = np.where(names[:, None] == own, -np.inf, asked @ vectors.T)
                top = np.argsort(-new, 1, kind="stable")[:, :k]
                scores, nodes, near = np.hstack([scores, new[at, top]]), np.hstack([nodes, own[top]]), np.concatenate([near, vectors[top]], 1)
                top = np.argsort(-scores, 1, kind="stable")[:, :k]
                scores, nodes, near = scores[at, top], nodes[at, top], near[at, top]
        row, place = np.nonzero(np.isfinite(scores))
        kept = near[row, place]
        cuts = np.arange(len(row) + 1, dtype=np.int32) * kept.shape[1]
        vectors = pa.ListArray.from_arrays(pa.array(cuts), pa.array(kept.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(-scores[row, place]), pa.array(nodes[row, place]), vectors], ["query", "minus", "node", "embedding"])

    return rows


def _tried(index: Index, classes: DataFrame, once: DataFrame, k: int, settings: Settings) -> Settings:
    """settings calibrated on a bounded sample of the queries, whose neighbours among all vectors come from comparison with each."""
    if len(index.centroids) == 1:
        return settings
    trial = once.orderBy(F.xxhash64("query"), "query").limit(settings.trial).toArrow().combine_chunks()
    names = trial.column("query").to_numpy()
    if not len(names):
        return settings
    order = np.argsort(names)
    names, asked = names[order], _matrix(trial.column("embedding").combine_chunks())[order]
    broadcast = classes.sparkSession.sparkContext.broadcast((names, asked))
    near = classes.select("node", "embedding").mapInArrow(_nearest_of_all(broadcast, k), "query long, minus double, node long, embedding array<double>")
    place = F.row_number().over(Window.partitionBy("query").orderBy("minus", "node"))
    near = near.withColumn("place", place).where(F.col("place") <= k).select("query", "embedding").toArrow()
    return calibrated(index, asked, np.searchsorted(names, near.column("query").to_numpy()), _matrix(near.column("embedding").combine_chunks()), settings)


def _mapper(broadcast, settings: Settings, rule: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                row, lists = rule(index, _matrix(part.column("embedding")), settings)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), *taken.columns], ["list", *taken.schema.names])

    return rows


FOUND = "array<struct<minus:double,vec_id:long>>"


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of one block of a list and the queries that read it: a row for each query with its k best, exactly scored.

    They are (minus, vec_id) with minus the negated score, so that their order is nearest first.
    """

    def best(postings: pa.Table, queries: pa.Table) -> pa.Table:
        names, cuts, found, scores = [], [0], [np.zeros(0, np.int64)], [np.zeros(0)]
        if postings.num_rows and queries.num_rows:
            lists = postings.column("ids").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            owner, ids = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()
            vectors, asked = _matrix(postings.column("embedding").combine_chunks()), _matrix(queries.column("embedding").combine_chunks())
            names = queries.column("query").to_pylist()
            # How far the product of matrices may be from the sum of products, which alone decides.
            slack = 1e-13 * vectors.shape[1] * np.sqrt((vectors**2).sum(1).max()) * np.sqrt((asked**2).sum(1))
            for a in range(0, len(asked), STEP):
                rough = asked[a : a + STEP] @ vectors.T
                for q in range(len(rough)):
                    near = np.arange(len(vectors))
                    if len(vectors) > k:
                        floor = np.partition(rough[q], len(vectors) - k)[len(vectors) - k]
                        near = np.flatnonzero(rough[q] >= floor - slack[a + q])
                    exact = np.full(len(vectors), -np.inf)
                    exact[near] = (vectors[near] * asked[a + q]).sum(1)
                    places = np.flatnonzero(np.isfinite(exact[owner]))
                    order = places[np.lexsort((ids[places], -exact[owner[places]]))][:k]
                    found.append(ids[order])
                    scores.append(-exact[owner[order]])
                    cuts.append(cuts[-1] + len(order))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.array(np.concatenate(found))], ["minus", "vec_id"])
        return pa.table([pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)], names=["query", "found"])

    return best


def _merged(k: int) -> Callable[[pa.Table], pa.Table]:
    """Of all that was found for one query the k best, each vec_id once."""

    def merged(rows: pa.Table) -> pa.Table:
        pairs = rows.column("found").combine_chunks().flatten()
        minus, ids = pairs.field("minus").to_numpy(), pairs.field("vec_id").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        minus = minus[first]
        order = np.lexsort((ids, minus))[:k]
        return pa.table([pa.repeat(rows.column("query")[0], len(order)), pa.array(minus[order]), pa.array(ids[order])], names=["query", "minus", "vec_id"])

    return merged


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without rows that take no part: null, zero, or with null or non-finite components.

    Of vectors of several lengths only those of the most frequent one take part (the shorter on a tie).
    Of several vectors of one vec_id the least takes part.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    size = F.size("embedding")
    common = good.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    return good.where(size == (common["size"] if common else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings(), exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query its k nearest found among all other vectors.

    vectors and queries have vec_id and embedding; queries are rows of vectors. Ties go to the smaller
    vec_id. Equal vectors are one class of which the k + 1 least ids are kept, which are all that can be
    returned; equal queries are searched for once. Long lists, and lists that many queries read, are cut
    into blocks by a hash, and every block is read. With exact every query reads every list. An empty
    table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    keep = k + 1
    good = written(usable(vectors), "usable")
    ids = F.slice(F.array_sort(F.collect_list("vec_id")), 1, keep).alias("ids")
    salted = good.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(partitions(spark))).alias("salt")).agg(ids)
    classes = salted.groupBy("embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    classes = written(classes.select(F.col("ids")[0].alias("node"), "embedding", "ids"), "vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, norm, width = classes.agg(F.count("*"), F.sqrt(F.max(square)), F.max(F.size("embedding"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    lists = min(settings.most_lists, max(1, total // settings.vectors_per_list))
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(min(settings.sample_factor * lists, max(1024, settings.sample_bytes // (8 * width)))).select("embedding").toArrow()
    index = build(_matrix(sample.column("embedding").combine_chunks()), total, norm, settings)
    broadcast = spark.sparkContext.broadcast(index)
    kind = dict(good.dtypes)["embedding"]
    postings = written(classes.mapInArrow(_mapper(broadcast, settings, lists_of), f"list int, node long, embedding {kind}, ids array<long>"), "postings")
    asked = written(good.select("vec_id", "embedding").join(queries.select("vec_id").distinct(), "vec_id", "left_semi").distinct(), "queries")
    named = written(asked.join(classes.select("embedding", "node"), "embedding").select(F.col("vec_id").alias("query_id"), "node"), "named")
    once = classes.select("node", "embedding").join(named.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "embedding")
    settings = replace(settings, probes=len(index.centroids), ratio=math.inf) if exact else _tried(index, classes, once, k, settings)
    probes = written(once.mapInArrow(_mapper(broadcast, settings, probes_of), f"list int, query long, embedding {kind}"), "probes")
    # One row a list, at most most_lists rows.
    blocks = postings.groupBy("list").agg(F.ceil(F.count("*") / settings.block).alias("blocks"))
    asks = probes.groupBy("list").agg(F.ceil(F.count("*") / settings.query_block).alias("asks"))
    cuts = F.broadcast(blocks.join(asks, "list"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = postings.join(cuts, "list").select("list", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), spread("asks").alias("ask"), "embedding", "ids")
    right = probes.join(cuts, "list").select("list", spread("blocks").alias("block"), F.pmod(F.xxhash64("query"), F.col("asks")).alias("ask"), "query", "embedding")
    key = ["list", "block", "ask"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(keep), f"query long, found {FOUND}")
    top = written(found.groupBy("query").applyInArrow(_merged(keep), "query long, minus double, vec_id long"), "top")
    each = named.join(top, named["node"] == top["query"]).where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("minus", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score"))
