"""Extremely randomised trees (ML-02): grown level by level on Spark, scored in Arrow batches.

Every node draws a few features and one cut for each, uniformly between the least and the largest value that the feature
takes in the node; the cut with the largest gain becomes the split. All rows are used for every tree. Draws are hashes
of (seed, tree, node, feature), and a node is judged by whole class counts, so the trees depend on neither the
partitioning nor the order of rows.

A level takes two aggregations of the rows: ranges, then class counts on the left of the cuts. Trees are taken in
batches, so that a task and the driver hold at most ``CELLS`` (node, feature) cells at once; the model itself is on the
driver and broadcast, and its size follows ``trees``, ``depth`` and ``leaf``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

CELLS = 1 << 20
_ROWS = 1 << 13  # rows of a batch that are looked at together


def draw(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, kind: int) -> np.ndarray:
    """A number in [0, 1) for each (tree, node, feature); ``kind`` 0 chooses features, 1 places cuts."""
    with np.errstate(over="ignore"):
        h = np.uint64(seed * 2 + kind) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(tree, np.uint64) + np.uint64(1))
        for part in (node, feature):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(part, np.uint64) * np.uint64(0x94D049BB133111EB) + np.uint64(1)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def candidates(seed: int, tree: np.ndarray, node: np.ndarray, features: int, count: int) -> np.ndarray:
    """Features that each node looks at, in the order drawn."""
    score = draw(seed, tree[:, None], node[:, None], np.arange(features)[None, :], 0)
    return np.argsort(score, axis=1, kind="stable")[:, :count]


def gain(left0, left1, all0, all1, weights: tuple[float, float]):
    """Decrease of the weighted Gini impurity, times the node's weight."""
    l0, l1, a0, a1 = left0 * weights[0], left1 * weights[1], all0 * weights[0], all1 * weights[1]
    r0, r1 = a0 - l0, a1 - l1
    half = lambda x, y: np.divide(x * y, x + y, out=np.zeros_like(x, dtype=float), where=(x + y) > 0)
    return 2.0 * (half(a0, a1) - half(l0, l1) - half(r0, r1))


@dataclass
class Tree:
    """Nodes by number: feature (-1 for a leaf), cut, number of the left child (the right one follows), class counts."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [0])
    counts: list = field(default_factory=list)


def place(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Node in which each row of ``x`` ends."""
    at = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while len(rows):
        f = feature[at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        at[rows] = left[at[rows]] + (x[rows, f] > cut[at[rows]])
    return at


def _rows(batch) -> np.ndarray:
    column = batch["features"]
    return np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))


def _ranges(trees, frontier, cand):
    """Least and largest value of each candidate feature in each node of the frontier."""

    def run(batches):
        import pyarrow as pa

        forest, shape = trees.value, cand.shape
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            whole = _rows(batch)
            for x in (whole[k : k + _ROWS] for k in range(0, len(whole), _ROWS)):
                for tree, nodes in frontier.items():
                    k = nodes[place(x, *forest[tree])]
                    own = np.flatnonzero(k >= 0)
                    k = k[own]
                    for j in range(shape[1]):
                        value = x[own, cand[k, j]]
                        np.minimum.at(low[:, j], k, value)
                        np.maximum.at(high[:, j], k, value)
        k, j = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(low[k, j]), pa.array(high[k, j])], ["k", "j", "low", "high"])

    return run


def _left_counts(trees, frontier, cand, cuts):
    """Rows of each class on the left of each cut."""

    def run(batches):
        import pyarrow as pa

        forest, shape = trees.value, cand.shape
        counts = np.zeros((2, *shape), dtype=np.int64)
        for batch in batches:
            whole, labels = _rows(batch), batch["label"].to_numpy()
            for low in range(0, len(whole), _ROWS):
                x, y = whole[low : low + _ROWS], labels[low : low + _ROWS]
                for tree, nodes in frontier.items():
                    k = nodes[place(x, *forest[tree])]
                    own = np.flatnonzero(k >= 0)
                    k = k[own]
                    for j in range(shape[1]):
                        left = x[own, cand[k, j]] <= cuts[k, j]
                        for c in (0, 1):
                            counts[c, :, j] += np.bincount(k[left & (y[own] == c)], minlength=shape[0])
        k, j = np.nonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(counts[0, k, j]), pa.array(counts[1, k, j])], ["k", "j", "c0", "c1"])

    return run


def _arrays(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(tree.feature), np.array(tree.cut), np.array(tree.left)


@dataclass
class ExtraTreesModel:
    """Fitted trees as one table of nodes: tree, node, feature, cut, left, share (of class 1, weighted)."""

    nodes: np.ndarray

    def _forest(self) -> list[tuple]:
        trees = [self.nodes[self.nodes["tree"] == t] for t in range(int(self.nodes["tree"].max()) + 1)]
        return [(t["feature"].astype(np.int64), t["cut"].copy(), t["left"].astype(np.int64), t["share"].copy()) for t in trees]

    def probability(self, features: Column) -> Column:
        """Mean share of class 1 in the leaves that a feature array falls into."""
        forest = SparkSession.getActiveSession().sparkContext.broadcast(self._forest())

        @F.arrow_udf("double")
        def run(column):
            import pyarrow as pa

            x = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64))
            total = np.zeros(len(x))
            for *split, share in forest.value:
                total += share[place(x, *split)]
            return pa.array(total / len(forest.value))

        return run(features)

    def save(self, spark: SparkSession, path: str) -> None:
        import pandas as pd

        spark.createDataFrame(pd.DataFrame(self.nodes)).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> "ExtraTreesModel":
        table = SparkSession.getActiveSession().read.parquet(path).orderBy("tree", "node").toPandas()
        return cls(table[[n for n, _ in NODE]].to_records(index=False).astype(NODE))


NODE = [("tree", "i4"), ("node", "i8"), ("feature", "i4"), ("cut", "f8"), ("left", "i8"), ("share", "f8")]


@dataclass(frozen=True)
class ExtraTrees:
    """Settings: trees, deepest level, fewest rows of a leaf, features a node looks at ('sqrt', 'log2' or a number)."""

    trees: int = 100
    depth: int = 18
    leaf: int = 1
    subset: str | int = "sqrt"
    seed: int = 42

    def _count(self, features: int) -> int:
        return max(1, {"sqrt": int(features**0.5), "log2": int(np.log2(features))}.get(self.subset, self.subset if isinstance(self.subset, int) else 1))

    def fit(self, data: DataFrame) -> ExtraTreesModel:
        """``data``: label (0 or 1) and features (vector or array, of one length). Classes weigh alike. Missing values count as
        zero. Rows without a label are left out; without rows of both classes a tree is one leaf."""
        spark = data.sparkSession
        features = vector_to_array("features") if isinstance(data.schema["features"].dataType, VectorUDT) else F.col("features").cast("array<double>")
        rows = materialise(data.filter("label IS NOT NULL").select(F.col("label").cast("int").alias("label"), features.alias("features")), "extra-trees")
        first = rows.agg(F.count(F.when(F.col("label") == 0, 1)).alias("n0"), F.count(F.when(F.col("label") == 1, 1)).alias("n1"), F.max(F.size("features")).alias("width")).first()
        totals = (first["n0"], first["n1"])
        weights = tuple(sum(totals) / (2.0 * n) if n else 0.0 for n in totals)
        trees = [Tree(counts=[totals]) for _ in range(self.trees)]
        open_ = {t: [0] for t in range(self.trees)} if min(totals) else {}
        count = self._count(first["width"] or 1)
        for _ in range(self.depth):
            if not open_:
                break
            grown: dict[int, list[int]] = {}
            for batch in self._batches(open_, count):
                self._grow(spark, rows, trees, batch, first["width"], count, weights, grown)
            open_ = grown
        return ExtraTreesModel(self._table(trees, weights))

    @staticmethod
    def _batches(open_: dict[int, list[int]], count: int):
        """The open nodes in batches of at most ``CELLS`` cells (one tree at least)."""
        batch, size = {}, 0
        for tree, nodes in open_.items():
            if batch and size + len(nodes) * count > CELLS:
                yield batch
                batch, size = {}, 0
            batch[tree], size = nodes, size + len(nodes) * count
        yield batch

    def _grow(self, spark, rows, trees, batch, width, count, weights, grown) -> None:
        """Split the nodes of ``batch`` where a cut gains something; children that may split again go to ``grown``."""
        tree = np.concatenate([np.full(len(n), t) for t, n in batch.items()])
        node = np.concatenate([np.array(n) for n in batch.values()])
        cand = candidates(self.seed, tree, node, width, count)
        frontier, k = {}, 0
        for t, nodes in batch.items():  # number of a node in the frontier, -1 for all others
            frontier[t] = np.full(len(trees[t].feature), -1)
            frontier[t][nodes] = np.arange(k, k + len(nodes))
            k += len(nodes)
        shared = spark.sparkContext.broadcast({t: _arrays(trees[t]) for t in batch})
        low, high = np.full(cand.shape, np.inf), np.full(cand.shape, -np.inf)
        found = rows.mapInArrow(_ranges(shared, frontier, cand), "k long, j long, low double, high double").groupBy("k", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        low[found["k"], found["j"]], high[found["k"], found["j"]] = found["low"], found["high"]
        spread = np.where(high > low, high - low, 0.0)
        cuts = np.where(high > low, low + draw(self.seed, tree[:, None], node[:, None], cand, 1) * spread, np.inf)
        left = np.zeros((2, *cand.shape), dtype=np.int64)
        found = rows.mapInArrow(_left_counts(shared, frontier, cand, cuts), "k long, j long, c0 long, c1 long").groupBy("k", "j").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()
        left[0][found["k"], found["j"]], left[1][found["k"], found["j"]] = found["c0"], found["c1"]
        shared.unpersist()
        counts = np.array([trees[t].counts[n] for t, n in zip(tree.tolist(), node.tolist())])
        best, pick = self.choose(left, counts, high > low, weights)
        for i in np.flatnonzero(best > 0).tolist():
            t, j, own = trees[int(tree[i])], int(pick[i]), (int(counts[i, 0]), int(counts[i, 1]))
            n, at = int(node[i]), len(t.feature)
            t.feature[n], t.cut[n], t.left[n] = int(cand[i, j]), float(cuts[i, j]), at
            sides = [(int(left[0, i, j]), int(left[1, i, j]))]
            sides.append((own[0] - sides[0][0], own[1] - sides[0][1]))
            for side, c in enumerate(sides):
                t.feature.append(-1)
                t.cut.append(0.0)
                t.left.append(0)
                t.counts.append(c)
                if min(c) and sum(c) >= 2 * self.leaf:
                    grown.setdefault(int(tree[i]), []).append(at + side)

    def choose(self, left, counts, valid, weights) -> tuple[np.ndarray, np.ndarray]:
        """Largest gain of each node and the candidate it belongs to (of equal ones the first drawn); 0 where none is allowed."""
        all0, all1 = counts[:, :1], counts[:, 1:]
        size = left.sum(axis=0)
        allowed = valid & (size >= self.leaf) & (all0 + all1 - size >= self.leaf)
        value = np.where(allowed, gain(left[0], left[1], np.broadcast_to(all0, size.shape), np.broadcast_to(all1, size.shape), weights), 0.0)
        pick = value.argmax(axis=1)
        return value[np.arange(len(pick)), pick], pick

    @staticmethod
    def _table(trees: list[Tree], weights) -> np.ndarray:
        rows = []
        for t, tree in enumerate(trees):
            for n, (f, c, left, (c0, c1)) in enumerate(zip(tree.feature, tree.cut, tree.left, tree.counts)):
                w0, w1 = c0 * weights[0], c1 * weights[1]
                # a class that is missing altogether has no weight: plain counts then
                rows.append((t, n, f, c, left, w1 / (w0 + w1) if w0 + w1 else (c1 / (c0 + c1) if c0 + c1 else 0.0)))
        return np.array(rows, dtype=NODE)
