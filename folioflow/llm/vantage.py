"""Hard negatives by score windows: vantage-point trees over norm-augmented vectors, searched nearest first inside an annulus."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.bitslices import blocks_of, matrix, met, quantised, ranked
from folioflow.llm.shared import stored

#: Rows of a tree, and of a leaf at most.
TREE, LEAF = 8192, 128
#: Anchors and trees that meet in one group, on average.
ANCHORS, TREES = 256, 4


class Tree:
    """A vantage-point tree of vectors, each made as long as the longest by one more component, so that a query's nearest rows are those with the highest inner products.

    With M the longest norm and q made as long, 2 M^2 - 2 q.x is the squared distance of q, whose added component
    is zero, to x. Rows are held in the order of the tree: a node is a stretch of rows, its first one the vantage
    point, the nearer half of the others the first child and the farther half the second.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, comps: np.ndarray) -> None:
        self.ids, self.rows, self.labels, self.comps = ids, rows, labels, comps.astype(np.float64)
        norms = (self.comps**2).sum(axis=1)
        self.longest = float(norms.max(initial=0))
        self.added = np.sqrt(np.maximum(self.longest - norms, 0))
        self.first, self.stop, self.near, self.far = [], [], [], []
        self.ranges: list[tuple[float, float, float, float]] = []
        if len(ids):
            self._node(0, len(ids))

    def _node(self, first: int, stop: int) -> None:
        """The tree of the rows from first to stop, in a loop with a list of what waits."""
        waiting = [(first, stop, -1, False)]
        while waiting:
            first, stop, parent, is_far = waiting.pop()
            k = len(self.first)
            if parent >= 0:
                (self.far if is_far else self.near)[parent] = k
            for x, v in ((self.first, first), (self.stop, stop), (self.near, -1), (self.far, -1)):
                x.append(v)
            self.ranges.append((0.0, 0.0, 0.0, 0.0))
            if stop - first <= LEAF:
                continue
            away = self._squares(first, first, stop)  # the vantage point is the row farthest from any
            self._swap(first, first + int(np.argmax(away)))
            away = np.sqrt(self._squares(first, first + 1, stop))
            order = np.argsort(away, kind="stable")
            self._order(first + 1, stop, order)
            away = away[order]
            middle = len(away) // 2
            self.ranges[k] = (away[0], away[middle - 1], away[middle], away[-1])
            waiting += [(first + 1 + middle, stop, k, True), (first + 1, first + 1 + middle, k, False)]

    def _squares(self, of: int, first: int, stop: int) -> np.ndarray:
        product = self.comps[first:stop] @ self.comps[of] + self.added[first:stop] * self.added[of]
        return np.maximum(2 * (self.longest - product), 0)

    def _order(self, first: int, stop: int, order: np.ndarray) -> None:
        for x in (self.ids, self.rows, self.labels, self.comps, self.added):
            x[first:stop] = x[first:stop][order]

    def _swap(self, a: int, b: int) -> None:
        for x in (self.ids, self.rows, self.labels, self.comps, self.added):
            x[[a, b]] = x[[b, a]]

    def stored(self) -> dict[str, bytes]:
        arrays = {
            "ids": self.ids.astype("<i8"), "rows": self.rows.astype("<i8"), "labels": self.labels.astype("<i8"), "comps": self.comps.astype("<i4"), "added": self.added.astype("<f8"),
            "nodes": np.array([self.first, self.stop, self.near, self.far], "<i4"), "ranges": np.array(self.ranges, "<f8"),
        }
        return {k: v.tobytes() for k, v in arrays.items()} | {"longest": self.longest}

    @classmethod
    def read(cls, held: dict) -> Tree:
        self = cls.__new__(cls)
        for name in ("ids", "rows", "labels"):
            setattr(self, name, np.frombuffer(held[name], "<i8"))
        self.comps = np.frombuffer(held["comps"], "<i4").reshape(len(self.ids), -1).astype(np.float64)
        self.added, self.longest = np.frombuffer(held["added"], "<f8"), held["longest"]
        self.first, self.stop, self.near, self.far = np.frombuffer(held["nodes"], "<i4").reshape(4, -1).tolist()
        self.ranges = np.frombuffer(held["ranges"], "<f8").reshape(-1, 4)
        return self


class Asked:
    """One query on one tree. Scores of leaves are kept for its further windows."""

    def __init__(self, tree: Tree, vector: np.ndarray) -> None:
        width = tree.comps.shape[1]
        self.tree, self.vector = tree, np.pad(vector[:width], (0, max(0, width - len(vector)))).astype(np.float64)
        self.known: dict[int, np.ndarray] = {}
        own = float((vector.astype(np.float64) ** 2).sum())  # with components beyond the tree's
        self.as_floats = own * tree.longest < 2.0**104  # then no sum of products leaves the whole numbers that a float holds
        # a query as long as the rows has the same order of them, and distances that tell most
        square, scale = 2 * tree.longest, (tree.longest / own) ** 0.5 if own and tree.longest else 1.0
        vantage = np.array(tree.first, np.int64)
        away = np.sqrt(np.maximum(square - 2 * scale * (tree.comps[vantage] @ self.vector), 0))
        ranges, slack = np.reshape(tree.ranges, (-1, 4)), 1e-7 * square + 1e-6
        nearest = np.maximum(np.maximum(away[:, None] - ranges[:, 1::2], ranges[:, ::2] - away[:, None]), 0)
        farthest = away[:, None] + ranges[:, 1::2]
        #: Of both children of each node, scores that none of its rows is above, and below.
        self.high = (square - nearest**2 + slack) / (2 * scale)
        self.low = (square - farthest**2 - slack) / (2 * scale)

    def scores(self, node: int) -> np.ndarray:
        """Exact scores of a leaf's rows, or of a node's vantage point."""
        if node not in self.known:
            tree = self.tree
            stop = tree.stop[node] if tree.near[node] < 0 else tree.first[node] + 1
            rows = tree.comps[tree.first[node] : stop]
            self.known[node] = (rows @ self.vector if self.as_floats else rows.astype(np.int64) @ self.vector.astype(np.int64)).astype(np.int64)
        return self.known[node]

    def best(self, least: float, most: float, fits: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """(score, row) of the first k rows that fit with scores from least to most: nodes and rows nearest first, and nothing outside the annulus is opened."""
        tree = self.tree
        heap: list[tuple] = [(-np.inf, 0, 0, 0)] if len(tree.ids) else []
        while heap and k:
            key, kind, _, at = heapq.heappop(heap)
            if kind:
                yield -key, at
                k -= 1
                continue
            first, found = tree.first[at], self.scores(at)
            inside = np.flatnonzero((found >= least) & (found <= most) & fits[first : first + len(found)])
            if len(inside) > k:
                inside = inside[np.lexsort([tree.ids[first + inside], -found[inside]])[:k]]
            for r in inside.tolist():
                heapq.heappush(heap, (-int(found[r]), 1, int(tree.ids[first + r]), first + r))
            for side, child in enumerate((tree.near[at], tree.far[at])):
                if child >= 0 and self.high[at, side] >= least and self.low[at, side] <= most:
                    heapq.heappush(heap, (max(key, -float(self.high[at, side])), 0, child, child))


TREE_SCHEMA = "block long, ids binary, rows binary, labels binary, comps binary, added binary, nodes binary, ranges binary, longest double"


def trees(rows: DataFrame, tree_rows: int = TREE) -> DataFrame:
    """A vantage-point tree of each tree_rows of rows (vec_id, row, comps, label), dealt by hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks_of(batches, tree_rows):
            ids, hashes, labels = (part.column(k).to_numpy().copy() for k in (0, 1, 3))
            tree = Tree(ids, hashes, labels, matrix(part.column(2).combine_chunks()))
            held = {"block": int(hashes[0])} | tree.stored()
            names = [x.split(" ")[0] for x in TREE_SCHEMA.split(", ")]
            types = [pa.int64(), *[pa.binary()] * 7, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([held[n]], t) for n, t in zip(names, types, strict=True)], names)

    dealt = rows.select("vec_id", "row", "comps", "label").repartition("row").sortWithinPartitions("row")
    return dealt.mapInArrow(of, TREE_SCHEMA)


def _forest(blocks: pa.Table) -> list[Tree]:
    return [Tree.read({c: blocks[c][k].as_py() for c in blocks.column_names}) for k in range(blocks.num_rows)]


def _cut(found: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """The k first of (-score, vec_id, row)."""
    return sorted(found)[:k]


def _positives(anchors: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """(anchor_id, anchor_row, positive_id, positive_row, positive_score): of each anchor the k best other rows of its label in blocks."""
    forest, out = _forest(blocks), []
    comps = matrix(anchors["comps"].combine_chunks())
    for vector, id_, row, label in zip(comps, *(anchors[c].to_pylist() for c in ("vec_id", "row", "label")), strict=True):
        best: list[tuple[int, int, int]] = []
        for tree in forest:
            least = -best[-1][0] if len(best) == k else -np.inf
            fits = (tree.labels == label) & ((tree.rows != row) | (tree.ids != id_))
            best = _cut(best + [(-s, int(tree.ids[r]), int(tree.rows[r])) for s, r in Asked(tree, vector).best(least, np.inf, fits, k)], k)
        out += [(id_, row, x, r, -s) for s, x, r in best]
    return _table(out, ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score"])


def _negatives(anchors: pa.Table, blocks: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """Of each anchor's positives the k best rows of other labels in blocks, with 100 * score from low to high times the positive's."""
    forest, out = _forest(blocks), []
    comps = matrix(anchors["comps"].combine_chunks())
    for vector, id_, row, label, positives in zip(comps, *(anchors[c].to_pylist() for c in ("vec_id", "row", "label", "positives")), strict=True):
        asked = [(Asked(tree, vector), tree.labels != label) for tree in forest]
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for p in positives:
            score = p["positive_score"]
            if score not in windows:
                best: list[tuple[int, int, int]] = []
                least, most = -(-low * score // 100), high * score // 100
                for one, fits in asked if least <= most else []:
                    from_ = max(least, -best[-1][0]) if len(best) == k else least
                    best = _cut(best + [(-s, int(one.tree.ids[r]), int(one.tree.rows[r])) for s, r in one.best(from_, most, fits, k)], k)
                windows[score] = best
            out += [(id_, row, p["positive_id"], p["positive_row"], score, x, r, -s) for s, x, r in windows[score]]
    return _table(out, ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "negative_id", "negative_row", "negative_score"])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)


def hard_negatives(embeddings: DataFrame, label: Column, is_anchor: Column, n_positives: int = 5, k: int = 5, low: int = 80, high: int = 100, scale: int = 256, tree_rows: int = TREE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of embeddings (vec_id, embedding): for each anchor and positive the first k rows of another label whose scores are low to high hundredths of the positive's.

    Scores are integer inner products of floor(scale * x); higher ones come first, ties by smaller vec_id.
    An anchor's positives are its first n_positives other rows of the same label. Rows are dealt by hash into
    vantage-point trees of tree_rows rows; anchors meet all trees in groups of bounded size. In a
    tree a window of scores is an annulus of distances, searched nearest first until k rows are found;
    what earlier trees gave narrows it. A window is searched once for positives of equal score.

    Rows with a null label, and those that quantised leaves out, take no part. Vectors of different lengths
    are filled up with zeros. Rows that share a vec_id but not all else are rows of their own. A
    positive with a negative score has no window. Other columns are ignored; an empty table gives no rows.
    """
    rows = stored(quantised(embeddings.withColumn("label", label.cast("long")).filter("label is not null"), scale, "label"), "vectors")
    forest = stored(trees(rows, tree_rows), "trees")
    anchors = rows.filter(is_anchor)
    n, n_trees = anchors.count(), forest.count()
    names = "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long"
    found = met(anchors, forest, n, n_trees, lambda a, b: _positives(a, b, n_positives), names, ANCHORS, TREES)
    positives = ranked(found, ["anchor_id", "anchor_row"], n_positives, "positive_score", "positive_id", "positive_row")
    positives = positives.groupBy("anchor_id", "anchor_row").agg(F.collect_list(F.struct("positive_id", "positive_row", "positive_score")).alias("positives"))
    asked = anchors.join(positives, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row"))).select("vec_id", "row", "comps", "label", "positives")
    names += ", negative_id long, negative_row long, negative_score long"
    found = met(stored(asked, "anchors"), forest, n, n_trees, lambda a, b: _negatives(a, b, k, low, high), names, ANCHORS, TREES)
    keys = ["anchor_id", "anchor_row", "positive_id", "positive_row"]
    return ranked(found, keys, k, "negative_score", "negative_id", "negative_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
