"""Near-duplicate groups by exact similarity of shingle sets: SimHash and MinHash propose, the sets themselves decide.

Two texts are linked if the Jaccard similarity of their sets of word shingles reaches the limit. Candidates are the links of
the trie join (``simhash``) over the SimHash fingerprints of the sets. No budget that the join can walk reaches all pairs at
0.8, so texts that share a band (the smallest images of their shingles under ``ROWS`` hash functions) are candidates too; with
40 bands of six, a pair of similarity 0.8 shares none with a chance of 5 in a million, a pair above it more rarely. Candidate
components are then searched breadth first with the sets of shingles, so no pair below the limit is ever linked; large ones
are split over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, is_listed, own_path, write_id_lists
from .simhash import _LOWER, Rule, components, linked, majority
from .words import mix

BANDS, ROWS = 40, 6
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_CHUNK = 1 << 10


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 digests of the shingles of ``size`` words (of all words, if there are fewer)."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # ASCII white space
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    digest, view = xxhash.xxh64_intdigest, memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array(sorted({digest(view[s:e]) for s, e in zip(starts, ends[min(size, len(tokens)) - 1 :].tolist())}), dtype=np.uint64)


def bands(digests: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set of shingles; an empty set has keys of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(digests), _CHUNK):
        least = np.minimum(least, (digests[low : low + _CHUNK] * _FACTORS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


def sketch_column(text: Column, size: int = 5) -> Column:
    """``digest`` (128 bits of the set of shingles), ``bands`` and ``print`` (SimHash of the set) of a text; a null text is empty."""

    @F.arrow_udf("struct<digest:binary,bands:array<long>,print:long>")
    def run(texts):
        import pyarrow as pa
        import xxhash

        sets = [shingles(t.as_py() or "", size) for t in texts]
        digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
        keys = pa.array([bands(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
        prints = pa.array(np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([digests, keys, prints], ["digest", "bands", "print"])

    return run(text)


def groups_of(sets: list[np.ndarray], limit: float) -> np.ndarray:
    """For each set the first one of its component: sets are linked if their Jaccard similarity is ``limit`` or more.

    A set is compared only with those that no other has reached yet, so a dense group costs about one comparison each.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0), np.zeros(0, np.int64))
    label, mine = np.full(len(sets), -1), np.zeros(len(vocabulary), dtype=bool)
    own, rest, kept, free = np.repeat(np.arange(len(sets)), sizes), flat, len(sets), len(sets)
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], free, queue = first, free - 1, [first]
        while queue:
            at = queue.pop()
            if not free:
                break
            if 2 * free < kept:
                still = label[own] < 0
                own, rest, kept = own[still], rest[still], free
            members = flat[edges[at] : edges[at + 1]]
            mine[members] = True
            common = np.bincount(own[mine[rest]], minlength=len(sets))
            mine[members] = False
            near = np.flatnonzero((label < 0) & (common >= limit * (sizes + sizes[at] - common) - 1e-9))
            label[near], free = first, free - len(near)
            queue += near.tolist()
    return label


def _group_task(limit: float, size: int):
    def run(table):
        import pyarrow as pa

        table = table.sort_by("node")
        nodes = table["node"].to_numpy()
        label = groups_of([shingles(t.as_py() or "", size) for t in table["text"]], limit)
        return pa.table({"node": nodes, "first": nodes[label]})

    return run


# ---- large candidate components, split ----------------------------------------------------------------------------------

MOST = 1000  # distinct sets of a candidate component that meet in one task, and of a chunk of a larger one


def _similar(one: np.ndarray, sets: list[np.ndarray], limit: float) -> np.ndarray:
    """Whether ``one`` is similar to each of ``sets``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(one, flat), max(len(one) - 1, 0))
    common = np.bincount(np.repeat(np.arange(len(sets)), sizes)[one[at] == flat] if len(one) else [], minlength=len(sets))
    return common >= limit * (sizes + len(one) - common) - 1e-9


def _star_task(limit: float, size: int):
    """Which texts of a group are similar to the one they are all compared with (``b`` = ``a``)."""

    def run(table):
        import pyarrow as pa

        own = table["a"].to_numpy() == table["b"].to_numpy()
        sets = [shingles(t.as_py() or "", size) for t in table["text"]]
        centre = sets[int(np.flatnonzero(own)[0])]
        near = _similar(centre, sets, limit) & ~own
        return table.select(["a", "b"]).filter(pa.array(near))

    return run


def _pair_task(limit: float, size: int):
    """Links between two chunks of sets (or inside one) whose parts ``v`` are not yet connected: one for each two parts."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("node")
        node, part, left, right = (table[c].to_numpy() for c in ("node", "v", "c1", "c2"))
        side = table["c"].to_numpy()
        sets = [shingles(t.as_py() or "", size) for t in table["text"]]
        parent = {v: v for v in np.unique(part).tolist()}

        def root(v):
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        edges = []
        here, there = np.flatnonzero(side == left[0]), np.flatnonzero(side == right[0])
        for k in here.tolist():
            mine = root(int(part[k]))
            others = [j for j in there.tolist() if root(int(part[j])) != mine]
            if not others:
                continue
            for j in np.array(others)[_similar(sets[k], [sets[j] for j in others], limit)].tolist():
                if root(int(part[j])) != root(int(part[k])):
                    parent[root(int(part[j]))] = root(int(part[k]))
                    edges.append((int(node[k]), int(node[j])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def split_groups(texts: DataFrame, stars: DataFrame, limit: float, size: int, most: int = MOST) -> DataFrame:
    """(node, root) of the linked sets in large candidate components; ``texts``: node, root (of the component), text; frozen.

    First each set is compared with the centres of its bands and its trie links (``stars``: a, b), which connects most of a dense group; a
    centre with many partners is met in several tasks. What is connected then is a part. Sets of small parts of a
    component are dealt over mixed chunks, those of a large part over chunks of its own, and only chunks that hold
    different parts are compared, two at a time. So a task never holds more than about two chunks, and every pair of
    candidates of a component is either connected or compared.
    """
    inside = stars.join(texts.select(F.col("node").alias("b")), "b", "left_semi").distinct()
    partners = inside.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    slots = F.ceil(F.col("n") / F.lit(most)).cast("int")
    rays = inside.join(partners, "a").select("a", "b", F.pmod(F.xxhash64("b"), slots).cast("int").alias("slot"))
    centres = partners.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    met = rays.unionByName(centres).join(texts.select(F.col("node").alias("b"), "text"), "b")
    links = frozen(met.groupBy("a", "slot").applyInArrow(_star_task(limit, size), "a long, b long"), "star-links")
    parts = components(links).withColumnRenamed("root", "v")
    sets = frozen(texts.select("node", "root").join(parts, "node", "left").select("node", "root", F.coalesce("v", "node").alias("v")), "parts")

    sizes = sets.groupBy("root", "v").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < most).groupBy("root").agg(F.sum("n").alias("small"))
    named = sizes.join(small, "root", "left").withColumn("big", F.col("n") >= most)
    chunks = F.when(F.col("big"), F.ceil(F.col("n") / F.lit(most))).otherwise(F.ceil(F.col("small") / F.lit(most)))
    named = frozen(named.select("root", "v", "big", chunks.cast("int").alias("chunks")), "part-sizes")
    # the number of a chunk: a hash of what it is dealt by
    group = F.when(F.col("big"), F.col("v")).otherwise(F.lit(-1))
    chunk = lambda part, k: F.xxhash64("root", part, k)
    dealt = sets.join(named, ["root", "v"]).withColumn("group", group)
    dealt = dealt.select("node", "root", "v", chunk(F.col("group"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).alias("c"))
    listed = named.withColumn("group", group).select("root", "group", "big", "chunks").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    listed = listed.select("root", "group", "big", chunk(F.col("group"), F.col("k")).alias("c"))
    left, right = listed.select("root", F.col("group").alias("g1"), F.col("c").alias("c1")), listed.select("root", F.col("group").alias("g2"), F.col("c").alias("c2"))
    # chunks of different parts once, mixed chunks also with themselves; each stands for up to MOST sets
    pairs = left.join(right, "root").filter("g1 < g2 OR (g1 = g2 AND g1 = -1 AND c1 <= c2)").select("root", "c1", "c2")
    wanted = pairs.select("root", "c1", "c2", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("c"))
    work = wanted.join(dealt, ["root", "c"]).join(texts.select("node", "text"), "node")
    more = work.select("node", "v", "c", "c1", "c2", "text").groupBy("c1", "c2").applyInArrow(_pair_task(limit, size), "a long, b long")
    return components(links.unionByName(more))


def _trie_links(distinct: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b), a < b, that connect all sets whose fingerprints are equal or linked by the trie join; ``distinct``: node,
    print; frozen."""
    prints = frozen(distinct.groupBy("print").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("times")), "prints")
    equal = distinct.join(prints.filter("times > 1").select("print", F.col("node").alias("a")), "print").filter("node > a").select("a", F.col("node").alias("b"))
    near = linked(prints.select("node", F.array("print").alias("fp")), rule)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(equal)


def repeated_rows(rows: DataFrame, limit: float = 0.8, size: int = 5, most: int = MOST, rule: Rule = Rule()) -> DataFrame:
    """``row_id`` of all ``rows`` (row_id, doc_id, text, sketch; frozen) but one of each group of linked texts.

    The row with the smallest doc_id stays (of equal ids, the first row; null ids come last). Equal sets of shingles are
    one node, those of blank texts too. The texts of one candidate component meet in one task, each distinct set once, or
    in several if there are more than ``MOST`` (``split_groups``); only candidates' texts move, and of all rows nothing but
    ids and digests.
    """
    # hot sets are combined before the exchange
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    distinct = rows.groupBy("sketch.digest").agg(F.min(F.struct("row_id", "sketch.bands", "sketch.print")).alias("m"), F.min(order).alias("first"), F.count(F.lit(1)).alias("times"))
    distinct = frozen(distinct.select("digest", F.col("m.row_id").alias("node"), F.col("m.bands").alias("bands"), F.col("m.print").alias("print"), "first", "times"), "shingle-sets")
    keys = distinct.select("node", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("band", "a")
    banded = keys.join(shared, "band").filter("node > a").select("a", F.col("node").alias("b"))
    stars = frozen(banded.unionByName(_trie_links(distinct.select("node", "print"), rule)).distinct(), "stars")
    candidates = components(stars)
    wanted = own_path(rows.sparkSession, "candidates")
    write_id_lists(candidates.select(F.col("node").alias("row_id")), wanted)
    counts = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("sets"))
    texts = rows.select(F.col("row_id").alias("node"), "text").filter(is_listed(F.col("node"), wanted)).join(candidates.join(counts, "root"), "node")
    texts = frozen(texts, "candidate-texts", "zstd")
    small = texts.filter(F.col("sets") <= most).groupBy("root").applyInArrow(_group_task(limit, size), "node long, first long").select("node", F.col("first").alias("root"))
    large = texts.filter(F.col("sets") > most).drop("sets")
    found = small if large.isEmpty() else small.unionByName(split_groups(large, stars, limit, size, most))
    named = frozen(distinct.drop("bands", "print").join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), "first", "times"), "shingle-groups")
    groups = named.groupBy("root").agg(F.min("first").alias("kept"), F.sum("times").alias("rows")).filter("rows > 1")
    several = named.join(groups, "root").select("digest", F.col("kept.row_id").alias("kept"))
    # both sides come from an exchange of this join alone, so a hot digest is split at run time
    return rows.select("row_id", F.col("sketch.digest").alias("digest")).join(several, "digest").filter("row_id <> kept").select("row_id")
