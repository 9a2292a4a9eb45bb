"""Hard negatives by vantage-point trees over norm-augmented vectors.

Each component becomes floor(256 x). A row x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, an anchor
gets a zero: their squared distance is then M^2 + |anchor|^2 - 2 <x, anchor>, so nearer means a larger inner product, and
a window of scores is an annulus around the anchor. A tree splits its rows by their median distance to a row of theirs
and keeps the least and greatest distance of each side; by the triangle inequality these bound the scores on that side. An
incremental traversal takes nodes and rows from a heap, best bound first: a node outside the annulus goes, a row leaves the
heap when no node could hold a better one, and k rows of the wanted labels end it. Scores are exact integers.

Spark deals: rows go by a hash of their row number into blocks of about BLOCK rows, anchors into slots of about BLOCK;
each pair of block and slot is a group of its own (cogroup), builds the block's tree and answers the slot's anchors. The k
best of each anchor's groups follow. So no task holds more than one block and one slot, whatever labels or vectors are
frequent, nothing passes through the driver but counts, and all pairs run in one job. First come the positives (same label, no
window), then the windows that follow from them.

Cases: rows with a null id, label or vector, or with null or non-finite components take no part; nor does a vector whose
length is not that of the most frequent length; rows with the anchor's id are no candidates; an id that repeats is one
anchor (its smallest label and vector) and as many candidates; equal scores go to the smaller id; fewer rows than asked
for give all; an anchor without positives, or a positive whose window holds no row, gives no rows (a window whose lower bound passes
its upper one, as for negative scores, is empty); an empty table gives no rows; extra columns are ignored. Vectors too long or
wide for exact products of doubles are scored by Python's integers; a returned score that passes 64 bits is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitslice import integers
from .common import plain_schema, save
from .rabitq import dimensions, usable

#: Rows of a block and anchors of a slot; rows of a leaf; anchors whose bounds are computed together.
BLOCK, LEAF, TOGETHER = 16384, 128, 64


class Tree:
    """Vantage-point tree of rows (ids, integer vectors as doubles, label numbers)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, labels: np.ndarray) -> None:
        self.ids, self.values, self.labels = ids, values, labels
        square = (values * values).sum(1)
        self.reach = float(square.max(initial=0))  # M^2
        rest = np.sqrt(self.reach - square)
        #: parent, vantage row of the parent, least and greatest distance to it; children; rows of leaves
        self.parent, self.point, self.least, self.most = [-1], [-1], [0.0], [np.inf]
        self.children: dict[int, tuple[int, int]] = {}
        self.rows: dict[int, np.ndarray] = {}
        waiting = [(0, np.arange(len(ids)))]
        while waiting:
            node, rows = waiting.pop()
            if len(rows) <= LEAF:
                self.rows[node] = rows
                continue
            v = rows[(node * 7919) % len(rows)]
            gap = np.sqrt(((values[rows] - values[v]) ** 2).sum(1) + (rest[rows] - rest[v]) ** 2)
            order = np.argpartition(gap, len(rows) // 2)
            made = []
            for own in (order[: len(rows) // 2], order[len(rows) // 2 :]):
                made.append(len(self.parent))
                for column, x in ((self.parent, node), (self.point, v), (self.least, gap[own].min()), (self.most, gap[own].max())):
                    column.append(x)
                waiting.append((made[-1], rows[own]))
            self.children[node] = (made[0], made[1])

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(worst, best) scores that nodes can hold, for each anchor: [anchor, node]."""
        size = (anchors * anchors).sum(1)[:, None] + self.reach
        points = np.array(self.point[1:], int)
        known, place = np.unique(points, return_inverse=True)
        to = np.sqrt(np.maximum(size - 2 * (anchors @ self.values[known].T), 0)) if len(known) else np.empty((len(anchors), 0))
        near, far = np.zeros((len(anchors), len(self.parent))), np.full((len(anchors), len(self.parent)), np.inf)
        for node in range(1, len(self.parent)):  # parents come first
            d, up = to[:, place[node - 1]], self.parent[node]
            near[:, node] = np.maximum(near[:, up], np.maximum(d - self.most[node], self.least[node] - d))
            far[:, node] = np.minimum(far[:, up], d + self.most[node])
        slack = 1e-9 * size + 1  # of rounding, far above it
        return (size - far * far) / 2 - slack, (size - near * near) / 2 + slack


class Asked:
    """Scores of the leaves for some anchors, computed when one of them comes to a leaf."""

    def __init__(self, tree: Tree, anchors: np.ndarray) -> None:
        self.tree, self.anchors = tree, anchors
        self.worst, self.best = tree.bounds(anchors)
        self.leaves: dict[int, np.ndarray] = {}

    def leaf(self, node: int) -> np.ndarray:
        if node not in self.leaves:
            self.leaves[node] = self.anchors @ self.tree.values[self.tree.rows[node]].T
        return self.leaves[node]

    def nearest(self, i: int, wanted: Callable[[np.ndarray], np.ndarray], least: float, most: float) -> Iterator[tuple[int, int]]:
        """(id, score) of the rows inside the annulus least <= score <= most of anchor i that are wanted, best first, ties by
        id; incremental, as far as it is read."""
        tree, best, worst = self.tree, self.best[i].tolist(), self.worst[i].tolist()
        heap = [(-min(best[0], most), 0, 0)]  # nodes come before rows of the same score
        while heap:
            key, kind, x = heapq.heappop(heap)
            if kind:
                yield x, int(-key)
            elif x in tree.children:
                for c in tree.children[x]:
                    if best[c] >= least and worst[c] <= most:
                        heapq.heappush(heap, (-min(best[c], most), 0, c))
            else:
                rows, score = tree.rows[x], self.leaf(x)[i]
                at = np.flatnonzero((score >= least) & (score <= most) & wanted(rows))
                for r, s in zip(tree.ids[rows[at]].tolist(), score[at].tolist(), strict=True):
                    heapq.heappush(heap, (-s, 1, r))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    rows = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.empty(0), *rows]).reshape(-1, dims)


def _groups(rows: DataFrame, asks: DataFrame, n: int, k: int, dims: int, same: bool) -> DataFrame:
    """Answers of every pair of block and slot. rows: (block, id, label, vector); asks: (slot, id, label, vector, windows), windows
    being (mark, least, most); same: rows of the anchor's label are wanted, else those of others."""
    blocks, slots = n
    fits = float(np.sqrt(2**53 / dims))  # integers below it have exact products as doubles

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asked = left.column("id").to_numpy(), right.column("id").to_numpy()
        texts = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks], pa.string()).combine_chunks()
        labels = texts.dictionary_encode().indices.to_numpy() if len(texts) else np.empty(0, int)
        labels, own = labels[: len(ids)], labels[len(ids) :]
        rows, anchors = (_matrix(t.column("vector"), dims) for t in (left, right))
        values, wants = np.floor(rows * 256), np.floor(anchors * 256)
        windows = right.column("windows").to_pylist()
        narrow, plain = (np.abs(values) < fits).all(1), (np.abs(wants) < fits).all(1)
        tree = Tree(ids[narrow], values[narrow], labels[narrow])
        out: list[tuple[int, int, int, int]] = []

        def found(i: int, near: Callable[[int, int], Iterator[tuple[int, int]]], exact: tuple[np.ndarray, list[int]]) -> None:
            at, scores = exact  # rows beyond the tree
            rest = sorted(((int(ids[r]), s) for r, s in zip(at.tolist(), scores, strict=True) if ids[r] != asked[i] and (labels[r] == own[i]) == same), key=lambda x: (-x[1], x[0]))
            for w in windows[i]:
                inside = [x for x in rest if w["least"] is None or w["least"] <= x[1] <= w["most"]]
                best: list[tuple[int, int]] = []
                for x in near(w["least"], w["most"]):
                    best.append(x)
                    if len(best) == k:
                        break
                best = sorted(best + inside, key=lambda x: (-x[1], x[0]))[:k]
                out.extend((int(asked[i]), w["mark"], r, s) for r, s in best)

        far = integers(rows[~narrow])
        for at in range(0, len(asked), TOGETHER):
            block = np.arange(at, min(at + TOGETHER, len(asked)))
            block = block[plain[block]]
            ready = Asked(tree, wants[block])
            for j, i in enumerate(block.tolist()):
                wanted = lambda r, i=i: ((tree.labels[r] == own[i]) == same) & (tree.ids[r] != asked[i])
                near = lambda lo, hi, j=j, wanted=wanted: ready.nearest(j, wanted, -np.inf if lo is None else lo, np.inf if hi is None else hi)
                scores = (far @ integers(anchors[i][None])[0]).tolist() if len(far) else []
                found(i, near, (np.flatnonzero(~narrow), scores))
        for i in np.flatnonzero(~plain).tolist():  # an anchor too wide for the tree
            ask = integers(anchors[i][None])[0]
            scores = [s for b in range(0, len(ids), 4096) for s in (integers(rows[b : b + 4096]) @ ask).tolist()]
            found(i, lambda lo, hi: iter(()), (np.arange(len(ids)), scores))
        return pa.table({n: pa.array([x[c] for x in out], pa.int64()) for c, n in enumerate(("anchor", "mark", "id", "score"))})

    many = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    every = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    got = many.groupBy("block", "slot").cogroup(every.groupBy("block", "slot")).applyInArrow(answer, plain_schema("anchor long, mark long, id long, score long"))
    w = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row for which `anchors` holds and each
    of its best `positives` rows of its label, the best k rows of other labels whose score is low to high percent of the
    positive's."""
    spark = df.sparkSession
    dims = dimensions(df, vector_col)
    if not dims:
        return spark.createDataFrame([], plain_schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
    label = F.col("label") if label is None else label
    own = df.where(usable(F.col(vector_col), zero=True) & (F.size(vector_col) == dims) & F.col(id_col).isNotNull())
    own = own.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), anchors.alias("asks"), F.monotonically_increasing_id().alias("n"))
    own = save(own.where("label IS NOT NULL"), "vectors")
    first = own.where("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a"))
    total, asking = own.count(), own.where("asks").select("id").distinct().count()
    n = (-(-total // block) or 1, -(-asking // block) or 1)
    rows = own.select(F.pmod(F.xxhash64("n"), F.lit(n[0])).cast("int").alias("block"), "id", "label", "vector")
    first = save(first.select(F.pmod(F.xxhash64("id"), F.lit(n[1])).cast("int").alias("slot"), "id", "a.label", "a.vector"), "anchors")
    window = lambda mark, lo, hi: F.struct(mark.cast("long").alias("mark"), lo.cast("long").alias("least"), hi.cast("long").alias("most"))
    none = F.lit(None)
    best = _groups(rows, first.withColumn("windows", F.array(window(none, none, none))), n, positives, dims, True)
    best = save(best.select("anchor", F.col("id").alias("positive"), "score"), "positives")
    score = F.col("score").cast("decimal(38,0)")
    bounds = window(F.col("score"), F.ceil(score * low / 100), F.floor(score * high / 100))
    spans = best.groupBy("anchor").agg(F.collect_set(bounds).alias("windows"))  # at most `positives` each
    asks = first.join(spans.withColumnRenamed("anchor", "id"), "id").select("slot", "id", "label", "vector", "windows")
    found = _groups(rows, asks, n, k, dims, False).select("anchor", F.col("mark").alias("score"), "rank", F.col("id").alias("negative"), F.col("score").alias("by"))
    out = best.join(found, ["anchor", "score"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), F.col("score").alias("positive_score"), F.col("by").alias("negative_score"))
