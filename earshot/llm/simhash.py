"""SimHash near-dedup: fingerprints of word shingles, linked by a self-join of binary tries.

The join walks pairs of trie nodes from the root, one bit per step, adds up the bits in which the two nodes differ and
drops a pair as soon as its budget of errors is spent. Two words within ``budget`` bits differ in at most
``budget // blocks`` bits of some block; the join therefore runs over the rotations that bring each block to the front,
with that smaller budget for the leading block. The upper levels of a trie are walked by the exchange: a fingerprint
goes to the node pairs it can take part in, and one task walks on below each pair. Fingerprints may have further words
of 64 bits, which count for the budget of the whole but not for the walk.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen
from .words import mix

NODE_ROWS = 100_000  # distinct fingerprints below one node of the level at which tasks start
LEAST_LEVEL = 4
_LEAF = 4096  # compare all of two nodes once they hold this many pairs
_CHUNK = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ---- fingerprints ------------------------------------------------------------------------------------------------------


def fingerprint(text: str, size: int = 4, seed: int = 42, words: int = 1) -> list[int]:
    """SimHash words of the shingles of ``size`` words, repeats included; zeros without words.

    A bit of the first word is set if over half of the XXH64 digests have it; further words use the digests mixed anew.
    """
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # ASCII white space
    if not tokens:
        return [0] * words
    digest, view = xxhash.xxh64_intdigest, memoryview(b" ".join(tokens))
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(size, len(tokens))
    ones, count = np.zeros((words, 64), dtype=np.int64), len(tokens) - size + 1
    for low in range(0, count, _CHUNK):
        high = min(count, low + _CHUNK)
        pairs = zip(starts[low:high].tolist(), ends[low + size - 1 : high + size - 1].tolist())
        hashes = np.array([digest(view[s:e], seed) for s, e in pairs], dtype=np.uint64)
        for k in range(words):
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
            hashes = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    return [int.from_bytes(np.packbits(2 * row > count).tobytes(), "big") for row in ones]


def majority(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes: the bits that are set in over half of them; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[low : low + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, size: int = 4, seed: int = 42, words: int = 1) -> Column:
    """Fingerprint of a text as an array of ``words`` signed longs; null and blank texts give zeros."""

    @F.arrow_udf("array<long>")
    def run(texts):
        import pyarrow as pa

        values = np.array([fingerprint(t.as_py() or "", size, seed, words) for t in texts], dtype=np.uint64).reshape(len(texts), words)
        return pa.array(list(values.view(np.int64)), pa.list_(pa.int64()))

    return run(text)


# ---- the trie join -----------------------------------------------------------------------------------------------------


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the ones of ``bit`` begin in each sorted range whose members agree in all bits above."""
    base = (keys[low] >> np.uint64(bit) >> np.uint64(1)) << np.uint64(1) << np.uint64(bit)
    at = np.searchsorted(keys, base | np.uint64(1 << bit))
    return np.clip(at, low, high)


def _leaf_pairs(a, b, al, ah, bl, bh, same, rule):
    """Pairs of indices inside node pairs that are small, compared in vector blocks."""
    na, nb = ah - al, bh - bl
    sizes = na * nb
    left, right = [], []
    for first in _blocks(sizes):
        s = sizes[first]
        own = np.repeat(np.arange(first.start, first.stop), s)
        k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        i, j = al[own] + k // nb[own], bl[own] + k % nb[own]
        if same:
            i, j = i[i < j], j[i < j]
        d = a[0][i] ^ b[0][j]
        total = np.bitwise_count(d)
        ok = (total <= rule.budget) & (np.bitwise_count(d >> np.uint64(64 - rule.width)) <= rule.lead)
        i, j, d, total = i[ok], j[ok], d[ok], total[ok].astype(np.int64)
        ok = np.ones(len(i), dtype=bool)
        for block in range(rule.blocks - rule.turn, rule.blocks):  # pairs that an earlier rotation finds
            part = d >> np.uint64(64 - rule.width * (block + 1)) & np.uint64((1 << rule.width) - 1)
            ok &= np.bitwise_count(part) > rule.lead
        for x, y in zip(a[1:], b[1:]):
            total += np.bitwise_count(x[i] ^ y[j])
        ok &= total <= rule.whole
        left.append(i[ok])
        right.append(j[ok])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _blocks(sizes: np.ndarray, most: int = 1 << 21):
    edges, total = [0], 0
    cumulative = np.cumsum(sizes)
    while edges[-1] < len(sizes):
        stop = max(edges[-1] + 1, int(np.searchsorted(cumulative, total + most, side="right")))
        total = int(cumulative[stop - 1])
        edges.append(stop)
    return [slice(x, y) for x, y in zip(edges, edges[1:])]


class Rule(NamedTuple):
    """What links two fingerprints: errors allowed in the first word and in all words, and the rotation at work."""

    budget: int = 4
    whole: int = 4
    blocks: int = 2
    turn: int = 0

    @property
    def width(self) -> int:
        return 64 // self.blocks

    @property
    def lead(self) -> int:
        return self.budget // self.blocks


def trie_join(a: list[np.ndarray], b: list[np.ndarray] | None, rule: Rule, bit: int = 63):
    """Yield arrays (i, j) of the linked pairs; over all rotations each pair comes once.

    ``a`` and ``b``: the words of the fingerprints, sorted by the first, rotated word. Without ``b`` the trie of ``a``
    joins itself. All keys of a side agree above ``bit``. Node pairs wait on a stack in chunks, so memory does not
    follow their number.
    """
    same = b is None
    b = a if same else b
    x, y = a[0], b[0]
    if not len(x) or not len(y):
        return
    differ = bin(int(x[0] ^ y[0]) >> (bit + 1)).count("1")
    stack = [(np.array([0]), np.array([len(x)]), np.array([0]), np.array([len(y)]), np.array([differ]), bit)]
    while stack:
        al, ah, bl, bh, d, bit = stack.pop()
        if len(al) > _CHUNK:
            stack += [(al[s], ah[s], bl[s], bh[s], d[s], bit) for s in (slice(k, k + _CHUNK) for k in range(0, len(al), _CHUNK))]
            continue
        small = (ah - al) * (bh - bl) <= _LEAF
        if bit < 0:  # equal first words
            small[:] = True
        if small.any():
            i, j = _leaf_pairs(a, b, al[small], ah[small], bl[small], bh[small], same, rule)
            if len(i):
                yield i, j
            al, ah, bl, bh, d = (v[~small] for v in (al, ah, bl, bh, d))
        if not len(al):
            continue
        am, bm = _split(x, al, ah, bit), _split(y, bl, bh, bit)
        kids = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1), (am, ah, bl, bm, d + 1)]
        kids[3] = tuple(v[(al != bl) | (ah != bh)] for v in kids[3]) if same else kids[3]  # of a node with itself, the mirror
        al, ah, bl, bh, d = (np.concatenate([k[n] for k in kids]) for n in range(5))
        allowed = rule.lead if bit >= 64 - rule.width else rule.budget
        keep = (ah > al) & (bh > bl) & (d <= allowed)
        stack.append((al[keep], ah[keep], bl[keep], bh[keep], d[keep], bit - 1))


def forest(count: int, pairs) -> np.ndarray:
    """Edges (i, j) that connect what all ``pairs`` connect: at most one per node of each component."""
    label = np.arange(count)
    tree = []
    for i, j in pairs:
        while len(i):
            li, lj = label[i], label[j]
            apart = li != lj
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            if not len(i):
                break
            low, high = np.minimum(li, lj), np.maximum(li, lj)
            # hang each higher root below the lowest root that it meets, then shorten all paths
            order = np.lexsort((low, high))
            roots, at = np.unique(high[order], return_index=True)
            pick = order[at]
            tree.append(np.stack([i[pick], j[pick]], axis=1))
            label[roots] = low[pick]
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return np.concatenate(tree) if tree else np.zeros((0, 2), dtype=np.int64)


def _near(level: int, lead: int) -> list[int]:
    """All masks of ``level`` bits with at most ``lead`` ones."""
    return [m for m in range(1 << level) if bin(m).count("1") <= lead]


def _join_task(level: int, words: int, rule: Rule):
    def run(key, table):
        import pyarrow as pa

        turn, low, high = (k.as_py() for k in key)
        table = table.sort_by([("key", "ascending"), ("node", "ascending")])
        prefix, node = table["prefix"].to_numpy(), table["node"].to_numpy()
        columns = [table[c].to_numpy().view(np.uint64) for c in ("key", *(f"w{k}" for k in range(1, words)))]
        order = np.argsort(columns[0], kind="stable")  # as unsigned numbers
        prefix, node, columns = prefix[order], node[order], [c[order] for c in columns]
        sides = [prefix == p for p in ((low,) if low == high else (low, high))]
        a, b = [c[sides[0]] for c in columns], None if low == high else [c[sides[1]] for c in columns]
        names = np.concatenate([node[s] for s in sides])
        shift = 0 if b is None else len(a[0])
        edges = names[forest(len(names), ((i, j + shift) for i, j in trie_join(a, b, rule._replace(turn=turn), 63 - level)))]
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return run


def linked(prints: DataFrame, rule: Rule = Rule(), node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) between nodes that connect all pairs of fingerprints that ``rule`` links.

    ``prints``: node and fp (array of longs) of distinct fingerprints, frozen. Each task returns a spanning forest of the
    links it finds, so a dense group of n fingerprints gives about n rows and not all its pairs; no link between groups
    is lost.
    """
    count, words = prints.count(), len((prints.select("fp").first() or [[0]])[0])
    level = min(rule.width, 20, max(LEAST_LEVEL, (count // node_rows).bit_length()))
    first = F.get("fp", F.lit(0))
    turns = [first] + [F.shiftleft(first, k).bitwiseOR(F.shiftrightunsigned(first, 64 - k)) for k in range(rule.width, 64, rule.width)]
    keys = prints.select("node", *[F.get("fp", F.lit(k)).alias(f"w{k}") for k in range(1, words)], F.explode(F.array(*[F.struct(F.lit(o).alias("turn"), k.alias("key")) for o, k in enumerate(turns)])).alias("x"))
    keys = keys.select("*", "x.*").drop("x").withColumn("prefix", F.shiftrightunsigned("key", 64 - level).cast("int"))
    masks = F.array(*[F.lit(m) for m in _near(level, rule.lead)])
    pairs = keys.withColumn("mask", F.explode(masks)).withColumn("other", F.col("prefix").bitwiseXOR(F.col("mask")))
    pairs = pairs.withColumns({"low": F.least("prefix", "other"), "high": F.greatest("prefix", "other")}).drop("mask", "other")
    return pairs.groupBy("turn", "low", "high").applyInArrow(_join_task(level, words, rule), "a long, b long")


# ---- components --------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Alternates large-star and small-star steps; both only ever move edges to smaller ends, so hubs do not grow beyond
    their neighbours, and the number of rounds follows the logarithm of the longest path. Each round is a written table.
    """
    edges = frozen(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v > u").distinct(), "edges")
    for _ in range(rounds):
        if edges.isEmpty():
            break
        # large star: each node links its larger neighbours to the smallest of all, itself included
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: each node links itself and its smaller neighbours to the smallest of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).filter("v > u")
        small = small.unionByName(low.select("v", F.col("m").alias("u")).filter("v > u"))
        after = frozen(small.distinct(), "edges")
        # settled when every edge of either table is in the other: compare order-free sums
        same = [t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first() for t in (edges, after)]
        edges = after
        if same[0] == same[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_groups(prints: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``prints`` (doc_id, fp and more; frozen) with ``root`` (one value per component) and ``component_id``: the
    smallest doc_id reachable over links.

    Equal fingerprints are linked, the zeros of blank texts like any other. A null doc_id never names a component
    unless all of it are null; repeated rows fall into one component. An empty table gives no rows.
    """
    # hot fingerprints are combined before the exchange
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    distinct = frozen(distinct, "fingerprints")
    roots = components(linked(distinct.select("node", "fp"), rule))
    named = frozen(distinct.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = frozen(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    # both sides come from an exchange of this join alone, so a hot fingerprint is split at run time
    return prints.join(final, "fp")


def rule_for(similarity: float, words: int = 4, slack: float = 1.5) -> Rule:
    """Budgets for pairs of a Jaccard similarity: the bits expected to differ and ``slack`` standard deviations more.

    Fingerprints estimate the angle between the shingle sets, so pairs close to the limit fall on either side of it.
    The first word alone gets two deviations, as pairs that it turns away are lost.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most = lambda bits, k: int(bits * p + k * math.sqrt(bits * p * (1 - p)))
    first = most(64, 2.0)
    return Rule(budget=first, whole=most(64 * words, slack), blocks=4)
