"""Exact nearest neighbour by cosine among many centroids (JOIN-08): balls with pruning, searched in Arrow batches.

Centroids are dealt to pivots; a ball is a pivot with the largest angle to its members. By the triangle inequality of
angles no member can be nearer to a vector than the angle to the pivot less the ball's own, so whole balls are left out
for most vectors, and never the nearest centroid. One pass over the vectors, nothing is shuffled, and the plan does not
grow with the centroids; they are broadcast, up to ``MOST_NUMBERS`` numbers in all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MOST_NUMBERS = 1 << 26  # 512 MB on a worker
_CLOSE = 1e-9  # similarities this close are compared again in one fixed order of operations


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


class BallIndex:
    """Unit vectors in balls around about ``sqrt(n)`` pivots that are spread by farthest-first choice among a few."""

    def __init__(self, centroids: np.ndarray, seed: int = 5):
        self.unit = _unit(np.asarray(centroids, dtype=np.float64))
        n = len(self.unit)
        rng = np.random.default_rng(seed)
        pivots = self.unit[np.sort(rng.choice(n, max(1, int(n**0.5)), replace=False))] if n else self.unit
        for _ in range(2):  # move pivots to the middle of their members
            home = self._home(pivots)
            sums = np.zeros_like(pivots)
            np.add.at(sums, home, self.unit)
            pivots = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), pivots)
        home = self._home(pivots)
        order = np.argsort(home, kind="stable")
        self.members, self.edges, self.pivots = order, np.searchsorted(home[order], np.arange(len(pivots) + 1)), pivots
        cosine = np.clip((self.unit * pivots[home]).sum(axis=1), -1.0, 1.0)
        self.angle = np.zeros(len(pivots))
        np.maximum.at(self.angle, home, np.arccos(cosine))

    def _home(self, pivots: np.ndarray) -> np.ndarray:
        return np.concatenate([(self.unit[k : k + 4096] @ pivots.T).argmax(axis=1) for k in range(0, len(self.unit), 4096)]) if len(self.unit) else np.zeros(0, np.int64)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each vector (of equally near ones the first), its distance, and how many
        similarities were computed."""
        x = _unit(np.asarray(vectors, dtype=np.float64))
        to_pivot = np.clip(x @ self.pivots.T, -1.0, 1.0)
        most = np.cos(np.maximum(np.arccos(to_pivot) - self.angle, 0.0)) + 1e-12  # no member is more similar
        best, seen = np.full(len(x), -np.inf), to_pivot.size
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def visit(rows: np.ndarray, ball: int) -> None:
            nonlocal seen
            members = self.members[self.edges[ball] : self.edges[ball + 1]]
            if not len(rows) or not len(members):
                return
            similar = x[rows] @ self.unit[members].T
            seen += similar.size
            best[rows] = np.maximum(best[rows], similar.max(axis=1))
            i, j = np.nonzero(similar >= best[rows][:, None] - _CLOSE)
            pairs.append((rows[i], members[j]))

        first = to_pivot.argmax(axis=1)
        for ball in range(len(self.pivots)):
            visit(np.flatnonzero(first == ball), ball)
        for ball in range(len(self.pivots)):
            visit(np.flatnonzero((first != ball) & (most[:, ball] >= best - _CLOSE)), ball)
        rows, found = (np.concatenate(p) for p in zip(*pairs))
        exact = np.array([1.0 - np.dot(x[r], self.unit[c]) for r, c in zip(rows.tolist(), found.tolist())])
        order = np.lexsort((found, exact, rows))
        at = order[np.searchsorted(rows[order], np.arange(len(x)))]
        return found[at], exact[at], seen


def nearest_in_index(vectors: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """``vectors`` with ``nearest`` (the key of the nearest centroid; of equally near ones the smallest) and ``distance``
    (1 - cosine). A missing vector, one of another length, and any vector when there is no centroid get NULLs. Vectors of
    length zero are at distance 1 from all.
    """
    spark = vectors.sparkSession
    rows = centroids.filter(F.col(key).isNotNull() & F.col("centroid").isNotNull()).select(key, F.col("centroid").cast("array<double>").alias("centroid"))
    numbers = rows.agg(F.sum(F.size("centroid"))).first()[0] or 0
    if numbers > MOST_NUMBERS:
        raise ValueError(f"{numbers} numbers of centroids are too many for one broadcast ({MOST_NUMBERS})")
    table = rows.orderBy(key).toPandas()
    width = len(table["centroid"].iloc[0]) if len(table) else 0
    index = BallIndex(np.stack(table["centroid"].to_numpy())) if len(table) else None
    shared = spark.sparkContext.broadcast((index, table[key].tolist(), width))
    key_type = centroids.schema[key].dataType
    out = StructType([StructField("nearest", key_type), StructField("distance", DoubleType())])

    @F.pandas_udf(out)
    def search(column):
        import pandas as pd

        index, keys, width = shared.value
        good = np.array([v is not None and len(v) == width and width > 0 for v in column], dtype=bool)
        found = pd.DataFrame({"nearest": pd.Series([None] * len(column), dtype=object), "distance": np.full(len(column), np.nan)})
        if index is not None and good.any():
            near, distance, _ = index.nearest(np.stack(column[good].to_numpy()))
            found.loc[good, "nearest"] = [keys[k] for k in near]
            found.loc[good, "distance"] = distance
        return found

    got = vectors.withColumn("__near", search(F.col(vector).cast("array<double>")))
    return got.withColumns({"nearest": F.col("__near.nearest"), "distance": F.nanvl("__near.distance", F.lit(None).cast("double"))}).drop("__near")
