"""Two-speaker clustering of call segments (ML-08) and margin assignment (JOIN-08)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, rnd
from ..functions.vectors import cosine_similarity
from ..session import materialise
from .metric_index import nearest_in_index


def average_linkage(sums: np.ndarray, size: np.ndarray, count: int) -> np.ndarray:
    """Labels of average-linkage clustering under cosine distance, cut at ``count`` clusters; an item stands for ``size`` unit
    vectors with the given sum.

    The mean cosine similarity of two clusters of unit vectors is the dot product of their sums over
    the product of their sizes, so only sums are kept: memory is linear in the number of items.
    Nearest-neighbour chains give the merges; the last ones in height order are undone.
    """
    n = len(sums)
    sums, size, alive = sums.astype(np.float64).copy(), size.astype(np.float64).copy(), np.ones(n, dtype=bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        tip = chain[-1]
        distance = 1.0 - (sums @ sums[tip]) / (size * size[tip])
        distance[~alive] = np.inf
        distance[tip] = np.inf
        near = int(np.argmin(distance))
        if len(chain) > 1 and distance[chain[-2]] <= distance[near]:
            near = chain[-2]
        if len(chain) > 1 and near == chain[-2]:
            merges.append((float(distance[near]), near, tip))
            chain = chain[:-2]
            sums[near] += sums[tip]
            size[near] += size[tip]
            alive[tip] = False
        else:
            chain.append(near)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(n - count, 0)]:
        parent[root(b)] = root(a)
    return np.array([root(i) for i in range(n)], dtype=np.int64)


def _units(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1.0)


def two_clusters(vectors: np.ndarray) -> np.ndarray:
    """0/1 labels of average-linkage clustering under cosine distance, cut at two clusters; the first item's is 0."""
    if len(vectors) < 2:
        return np.zeros(len(vectors), dtype=np.int64)
    roots = average_linkage(_units(vectors), np.ones(len(vectors)), 2)
    return (roots != roots[0]).astype(np.int64)


AT_ONCE = 2000  # segments, or features, that are clustered in one task


def cluster_segments(segments: DataFrame, call="call_id", index="seg_idx", vector="emb", most: int = AT_ONCE) -> DataFrame:
    """ML-08: ``cluster`` per segment; the first segment's cluster is 0 ("Speaker A", WIN-08).

    A call of up to ``most`` segments is one group. The segments of a longer one are dealt over groups of about that size, each
    group is merged to an eighth as many clustering features (sum and size), these are dealt and merged again until they
    fit one group, and that is cut in two. So no task holds more than about ``most`` items, and far ends of a long call
    meet as features and not segment by segment.
    """
    kind = segments.schema[call].dataType.simpleString()
    counts = segments.groupBy(call).agg(F.count("*").alias("__n"))
    slim = segments.select(call, index, vector).join(counts, call)
    fields = segments.select(call, index).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cluster long"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index, kind="stable")
        return pd.DataFrame({call: pdf[call], index: pdf[index], "cluster": two_clusters(np.stack(pdf[vector].to_numpy()).astype("float64"))})

    # dealt by number, as the rows of many calls are few bytes and would be one task
    dealt = slim.filter(F.col("__n").between(2, most)).drop("__n").repartition(2 * segments.sparkSession.sparkContext.defaultParallelism, call)
    single = slim.filter("__n = 1").select(call, index, F.lit(0).cast("bigint").alias("cluster"))
    labels = dealt.groupBy(call).applyInPandas(label, schema).unionByName(single)
    longest = counts.agg(F.max("__n")).first()[0] or 0
    if longest > most:
        labels = labels.unionByName(_cluster_long(slim.filter(F.col("__n") > most), call, index, vector, most, longest, kind))
    return segments.join(labels, [call, index])


def _cluster_long(long: DataFrame, call: str, index: str, vector: str, most: int, longest: int, kind: str) -> DataFrame:
    """Labels of calls of more than ``most`` segments, by levels of clustering features."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        roots = average_linkage(np.stack(pdf["total"].to_numpy()).astype("float64"), pdf["size"].to_numpy(), max(1, len(pdf) // 8))
        return pd.DataFrame({call: pdf[call], "item": pdf["item"], "into": pdf["item"].to_numpy()[roots]})

    def halve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        return pd.DataFrame({call: pdf[call], "item": pdf["item"], "into": average_linkage(np.stack(pdf["total"].to_numpy()).astype("float64"), pdf["size"].to_numpy(), 2)})

    @F.pandas_udf("array<double>")
    def unit(v: pd.Series) -> pd.Series:
        return v.map(lambda x: _units(np.asarray(x, dtype=np.float64)[None, :])[0])

    width = F.col("width")
    items = materialise(long.select(call, F.col(index).cast("bigint").alias("item"), unit(F.col(vector).cast("array<double>")).alias("total"), F.lit(1).cast("bigint").alias("size"), F.col("__n").alias("width")), "features")
    schema, maps = f"`{call}` {kind}, item bigint, into bigint", []
    while longest > most:
        part = F.pmod(F.xxhash64("item"), F.ceil(width / F.lit(most)))
        into = materialise(items.withColumn("part", part).select(call, "part", "item", "total", "size").groupBy(call, "part").applyInPandas(merge, schema), "merged")
        maps.append(into)
        joined = items.join(into, [call, "item"]).select(call, "into", "size", F.posexplode("total").alias("i", "x"))
        sums = joined.groupBy(call, "into", "i").agg(F.sum("x").alias("x"), F.sum("size").alias("size"))
        items = sums.groupBy(call, F.col("into").alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"), F.first("size").alias("size"))
        widths = items.groupBy(call).agg(F.count("*").alias("width"))
        items = materialise(items.join(widths, call), "features")
        longest = items.agg(F.max("width")).first()[0]
    found = items.groupBy(call).applyInPandas(halve, schema)
    for into in reversed(maps):  # from features back to segments
        found = into.withColumnRenamed("into", "__up").join(found.withColumnRenamed("item", "__up"), [call, "__up"]).select(call, "item", "into")
    found = materialise(found, "labels")
    first = found.groupBy(call).agg(F.min_by("into", "item").alias("first"))
    return found.join(first, call).select(call, F.col("item").cast(long.schema[index].dataType).alias(index), (F.col("into") != F.col("first")).cast("bigint").alias("cluster"))


def assign_by_margin(clustered: DataFrame, width: int, call="call_id", vector="emb", margin=0.007) -> DataFrame:
    """JOIN-08, batch rule: nearer cluster mean (tie to A); nearly equal similarities mean overlap.

    Adds sim_a, sim_b, speaker, is_overlap, confidence and the call's cluster confidence.
    """
    means = clustered.groupBy(call).agg(
        F.count("*").alias("n_segments"),
        *[F.array(*[F.avg(F.when(F.col("cluster") == k, F.col(vector)[i].cast("double"))) for i in range(width)]).alias(f"mean_{k}") for k in (0, 1)],
        F.max("cluster").alias("top"),
    )
    one = F.col("top") == 0
    conf = F.when(one, F.when(F.col("n_segments") == 1, 0.90).otherwise(0.75)).otherwise(
        clamp(F.lit(1.0) - (cosine_similarity("mean_0", "mean_1") + 1.0) / 2.0 + 0.35, 0.55, 0.98))
    means = means.withColumn("cluster_conf", conf).withColumn("mean_1", F.when(one, F.col("mean_0")).otherwise(F.col("mean_1")))
    df = clustered.join(means.drop("top"), call)
    df = df.withColumns({"sim_a": cosine_similarity(vector, "mean_0"), "sim_b": cosine_similarity(vector, "mean_1")})
    gap = F.abs(F.col("sim_a") - F.col("sim_b"))
    df = df.withColumn("is_overlap", (gap < margin) & (F.col("n_segments") >= 3))
    return df.withColumns(
        {
            "speaker": F.when(F.col("is_overlap"), "Overlap (A+B)").when(F.col("sim_a") >= F.col("sim_b"), "Speaker A").otherwise("Speaker B"),
            "confidence": F.when(F.col("is_overlap"), F.greatest(F.lit(0.70), rnd(F.lit(1.0) - gap / 0.010, 3))).otherwise(rnd("cluster_conf", 3)),
        }
    ).drop("mean_0", "mean_1")


CENTROIDS_AT_ONCE = 2000


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """JOIN-08, general form: nearest centroid by cosine, of equal ones that with the smallest key.

    Up to ``CENTROIDS_AT_ONCE`` are one scalar array that rows scan in place; more are an index of balls with exact pruning
    (``metric_index``), which is broadcast. Nothing is paired or shuffled.
    """
    if centroids.count() > CENTROIDS_AT_ONCE:
        return nearest_in_index(vectors, centroids, key, vector)
    packed = centroids.select(F.struct(key, "centroid").alias("c")).agg(F.array_sort(F.collect_list("c")).alias("cs")).scalar()
    distances = F.transform("__cs", lambda c: F.struct((F.lit(1.0) - cosine_similarity(vector, c["centroid"])).alias("d"), c[key].alias("k")))
    out = vectors.withColumn("__cs", packed).withColumn("__best", F.array_min(distances)).drop("__cs")
    return out.withColumns({"nearest": F.col("__best.k"), "distance": F.col("__best.d")}).drop("__best")
