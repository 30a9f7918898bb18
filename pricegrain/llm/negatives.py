"""Hard-negative mining by ball trees: exact best inner products, within score windows, by branch and bound.

Rows are dealt to parts and anchors to blocks, by hashes; each pair of a part and a block is one task's
work, of bounded size, which builds the part's tree and sends the block's anchors through it together. A node's
ball bounds its inner products with an anchor both above and below: it is left out if it lies wholly
outside the anchor's score window, wholly beneath the anchor's present k-th best, or holds no row of a
label in question. A first search over a share of the rows gives each anchor a k-th best to begin with,
so that no part returns more than may still count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricegrain.llm.shared import partitions, written

#: A component x counts as floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Hundredths of a positive's score that its negatives' scores lie between, both included.
LOW, HIGH = 80, 100
#: Rows of a part's tree, anchors of a block, and rows of a leaf, about and at most.
PART, BLOCK, LEAF = 32_768, 8_192, 256
#: One of so many rows is searched first.
FIRST = 16
#: Up to so many labels in a node it is cut between labels, else by place.
FEW_LABELS = 32
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1


@dataclass
class Node:
    first: int
    end: int
    center: np.ndarray
    radius: float
    labels: tuple[int, int]
    below: tuple[Node, Node] | None = None


class Tree:
    """A ball tree over rows of integers; the rows are put in the order of its leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.root = self._node(0, len(ids))

    def _node(self, first: int, end: int) -> Node:
        rows, labels = self.rows[first:end], self.labels[first:end]
        center = rows.mean(0)
        # A little over the distance, for what its computation rounds away.
        radius = float(np.sqrt(((rows - center) ** 2).sum(1).max())) * (1 + 1e-9)
        node = Node(first, end, center, radius, (int(labels.min()), int(labels.max())))
        if end - first > LEAF:
            middle = self._cut(first, end)
            node.below = self._node(first, middle), self._node(middle, end)
        return node

    def _cut(self, first: int, end: int) -> int:
        """Put the rows of a node in the order of its children; return where the second begins."""
        part = slice(first, end)
        labels, rows, half = self.labels[part], self.rows[part], (end - first) // 2
        different = np.unique(labels[:: max(1, len(labels) // 4096)])
        if 1 < len(different) <= FEW_LABELS:
            order = np.argsort(labels, kind="stable")
            bounds = np.flatnonzero(np.diff(labels[order])) + 1
            half = int(bounds[np.argmin(np.abs(bounds - half))])
        else:
            order = np.argpartition(rows[:, int(np.argmax(rows.var(0)))], half)
        for values in (self.ids, self.labels, self.rows):
            values[part] = values[part][order]
        return first + half


@dataclass
class Asked:
    """Searches: their anchors, windows, k-th bests to begin with, and whether rows of the anchor's label are meant or all others."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    same: bool


def _products(a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    """Exact inner products: doubles, where none can reach 2 ** 53, or of Python's integers (object)."""
    if kind is float:
        return a @ b.T
    whole = [np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T


def search(tree: Tree, asked: Asked, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, id, score) of the k best rows of each search in a tree, higher scores and then smaller ids first; some more may come."""
    norms = np.sqrt((asked.rows**2).sum(1))
    small = np.abs(asked.rows).max(initial=0) * np.abs(tree.rows).max(initial=0) * tree.rows.shape[1] < _EXACT
    kind = float if small else object
    low, high, kth = (x.astype(kind) for x in (asked.low, asked.high, asked.least))
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)]
    waiting = [(tree.root, np.arange(len(asked.ids)))]
    while waiting:
        node, who = waiting.pop()
        mine = asked.labels[who]
        meant = (mine >= node.labels[0]) & (mine <= node.labels[1]) if asked.same else (mine != node.labels[0]) | (mine != node.labels[1])
        who = who[meant]
        center, reach = asked.rows[who] @ node.center, norms[who] * node.radius
        slack = 1e-9 * (norms[who] * np.sqrt((node.center**2).sum()) + reach) + 1e-6
        with np.errstate(invalid="ignore"):
            out = (center + reach + slack < np.maximum(low[who], kth[who])) | (center - reach - slack > high[who])
        who = who[~out.astype(bool)]
        if not len(who):
            continue
        if node.below:
            # The child nearer to the searches on the whole is looked into first.
            one, two = node.below
            if (asked.rows[who] @ (one.center - two.center)).sum() > 0:
                one, two = two, one
            waiting += [(one, who), (two, who)]
            continue
        part = slice(node.first, node.end)
        ids, labels = tree.ids[part], tree.labels[part]
        scores = _products(asked.rows[who], tree.rows[part], kind)
        counts = (labels == asked.labels[who, None]) if asked.same else (labels != asked.labels[who, None])
        counts &= (ids != asked.ids[who, None]) & (scores >= low[who, None]).astype(bool) & (scores <= high[who, None]).astype(bool)
        scores = np.where(counts, scores, -np.inf)
        limit = kth[who]
        if len(ids) > k:
            limit = np.maximum(limit, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
        of, at = np.nonzero(counts & (scores >= limit[:, None]).astype(bool))
        if not len(of):
            continue
        fresh = np.isin(held[0], who[np.unique(of)], assume_unique=False)
        joined = [np.concatenate([h[fresh], new]) for h, new in zip(held, (who[of], ids[at], scores[of, at]), strict=True)]
        order = np.lexsort((joined[1], -joined[2], joined[0]))
        joined = [j[order] for j in joined]
        begins = np.flatnonzero(np.r_[True, np.diff(joined[0]) != 0])
        rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
        full = rank == k - 1
        kth[joined[0][full]] = np.maximum(kth[joined[0][full]], joined[2][full])
        held = [np.concatenate([h[~fresh], j[rank < k]]) for h, j in zip(held, joined, strict=True)]
    return held[0], held[1], held[2]


def _quantised(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of one length as whole numbers in doubles."""
    lists = column.combine_chunks()
    values = np.asarray(lists.flatten(), np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -1e300, 1e300).reshape(len(lists), -1)


def _searcher(k: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    kind = pa.schema([("anchor_id", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        none = pa.Table.from_batches([], kind)
        if not rows.num_rows or not anchors.num_rows:
            return none
        out = [none]
        # Inner products are of vectors of one length.
        lengths = [pa.compute.list_value_length(t.column("embedding")) for t in (rows, anchors)]
        for size in pa.compute.unique(lengths[1]).to_pylist():
            r, a = (t.filter(pa.compute.equal(n, size)) for t, n in zip((rows, anchors), lengths, strict=True))
            if not r.num_rows or not size:
                continue
            number = lambda t, c: t.column(c).to_numpy()
            tree = Tree(number(r, "vec_id").copy(), number(r, "label").copy(), _quantised(r.column("embedding")))
            bound = lambda c, none: a.column(c).fill_null(none).to_numpy()
            asked = Asked(number(a, "vec_id"), number(a, "label"), _quantised(a.column("embedding")), bound("low", -_LONG - 1), bound("high", _LONG), bound("least", -_LONG - 1), same)
            of, ids, scores = search(tree, asked, k)
            found = pa.array([max(-_LONG - 1, min(_LONG, int(s))) for s in scores] if scores.dtype == object else scores.astype(np.int64), pa.int64())
            out.append(pa.Table.from_arrays([pa.array(asked.ids[of]), pa.array(number(a, "window")[of]), pa.array(ids), found], schema=kind))
        return pa.concat_tables(out)

    return run


def _best(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k best of each key with their rank, from 1."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(rows: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, vec_id, score, rank) of the k best of each search: a share of the rows first, then all.

    rows: vec_id, label, embedding, part, of parts(rows). asked: vec_id, label, embedding, window, low, high.
    """
    spark = rows.sparkSession
    parts = max(partitions(spark), -(-rows.count() // PART))
    blocks = max(1, -(-asked.count() // BLOCK))

    def over(some: DataFrame, asked: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
        left = some.select(part, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "label", "embedding")
        # New names for columns that come from the same table as the rows'.
        right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), *(F.col(c).alias(c) for c in asked.columns))
        made = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_searcher(k, same), "anchor_id long, window long, vec_id long, score long")
        return _best(made, ["anchor_id", "window"], k)

    none = F.lit(None).cast("long").alias("least")
    share = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(FIRST)) == 0)
    first = over(share, asked.select("*", none)).where(F.col("rank") == k).select(F.col("anchor_id").alias("vec_id"), "window", F.col("score").alias("least"))
    begun = written(asked.join(first, ["vec_id", "window"], "left"), "asked")
    return over(rows, begun)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    An anchor's positives are the rows of its label with the highest inner products, and each positive's
    negatives the best rows of other labels whose scores are low to high hundredths of the positive's,
    ties by smaller vec_id. Rows with a null vec_id, label or vector, or with a null, infinite or NaN
    component, take no part; of rows that share a vec_id the one of least label, and then vector, counts.
    A vector is compared with those of its own length. A positive without negatives, or an anchor without
    positives, has no row; an empty table gives an empty result. Scores beyond a long are cut to its range.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    one = known.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("row"))
    one = written(one.select("vec_id", "row.*", is_anchor.alias("anchor")), "vectors")
    anchors, rows = one.where("anchor").drop("anchor"), one.drop("anchor")
    unbounded = F.lit(None).cast("long")
    asked = anchors.withColumns({"window": F.lit(0).cast("long"), "low": unbounded, "high": unbounded})
    found = written(_searched(rows, asked, positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("window")), "positives")
    # One search for each score that a positive has: its window's bounds are whole numbers.
    window = F.col("window").cast("decimal(20,0)")
    bounds = {"low": F.ceil(window * low / 100).cast("long"), "high": F.floor(window * high / 100).cast("long")}
    scores = found.select(F.col("anchor_id").alias("vec_id"), "window").distinct().where(bounds["low"] <= bounds["high"])
    worst = _searched(rows, anchors.join(scores, "vec_id").withColumns(bounds), negatives, False)
    out = found.join(worst, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score"))


#: The same rows as the registered query, in DuckDB's SQL, by comparing every anchor with every row.
SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
