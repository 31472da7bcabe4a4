"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

For every length of a benchmark item, windows of that many words are fingerprinted over their five-word shingles. The
64 bits are cut into blocks; two fingerprints within the radius differ by at most ``radius // blocks`` bits in some
block, so looking for near values block by block returns every item within the radius. Candidates are verified by the weighted Jaccard
similarity of the shingles. Windows that cannot reach the similarity are left out before fingerprinting: at least the
wanted share of their shingles must be shingles of one item of that length.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import batch_words, hash_text, shingle_hashes

SIZE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 24, 4
BLOCK_ITEMS = 2000  # items per pass over the documents: bounds what goes to the workers
HITS = "array<struct<item_id:bigint,first_word:int,words:int,similarity:double>>"


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles; fewer words are one shingle of all of them."""
    return shingle_hashes(words, min(SIZE, max(1, len(words))))


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash in which a shingle weighs as often as it occurs."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared over joint weight, a shingle's weight being its count."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    joint = sum(a.values()) + sum(b.values()) - shared
    return shared / joint if joint else 0.0


class BlockIndex:
    """Fingerprints of the items of one length; ``near`` returns all within the radius."""

    def __init__(self, prints: list[int], radius: int, blocks: int = BLOCKS):
        self.prints, self.radius, self.blocks = np.array(prints, dtype=np.uint64), radius, blocks
        self.width, self.each = 64 // blocks, radius // blocks
        self.parts = [(self.prints >> np.uint64(self.width * k) & np.uint64((1 << self.width) - 1)).astype(np.uint64) for k in range(blocks)]

    def near(self, fingerprint: int) -> np.ndarray:
        value = np.uint64(fingerprint)
        candidate = np.zeros(len(self.prints), dtype=bool)
        for k, part in enumerate(self.parts):
            own = value >> np.uint64(self.width * k) & np.uint64((1 << self.width) - 1)
            candidate |= np.bitwise_count(part ^ own) <= self.each
        some = np.flatnonzero(candidate)
        return some[np.bitwise_count(self.prints[some] ^ value) <= self.radius]


class Benchmark:
    """Items grouped by length, with their shingles and fingerprints. ``items``: (item_id, text)."""

    def __init__(self, items, radius: int = RADIUS):
        lengths: dict[int, list] = {}
        for item, text in items:
            words = hash_text(text or "")
            if len(words):
                lengths.setdefault(len(words), []).append((item, shingles(words)))
        self.groups = []
        for length, own in sorted(lengths.items()):
            known = np.unique(np.concatenate([h for _, h in own]))
            self.groups.append((length, known, [(i, h, Counter(h.tolist())) for i, h in own], BlockIndex([simhash(h) for _, h in own], radius)))
        self.sizes = sorted({min(SIZE, g[0]) for g in self.groups})
        self.all = {size: np.unique(np.concatenate([g[1] for g in self.groups if min(SIZE, g[0]) == size])) for size in self.sizes}

    def search(self, words: np.ndarray, found: dict[int, np.ndarray], least: float) -> list[tuple]:
        """(item, first word, words, similarity) of the best window of each item that reaches ``least``.

        ``found``: for each shingle size, which places of the text hold a shingle of some item.
        """
        best: dict = {}
        hashes_of = {size: shingle_hashes(words, size) for size, places in found.items() if len(places)}
        for length, known, items, index in self.groups:
            size = min(SIZE, length)
            per_window = length - size + 1
            places = found[size]
            need = math.ceil(least * per_window - 1e-9)
            if len(words) < length or len(places) < max(1, need):
                continue
            all_hashes = hashes_of[size]
            own = places[np.isin(all_hashes[places], known)]
            if len(own) < need:
                continue
            mark = np.zeros(len(all_hashes) + 1, dtype=np.int64)
            mark[own + 1] = 1
            upto = np.cumsum(mark)
            windows = np.flatnonzero(upto[per_window:] - upto[: len(upto) - per_window] >= need)
            for start in windows.tolist():
                hashes = all_hashes[start : start + per_window]
                near = index.near(simhash(hashes))
                if not len(near):
                    continue
                counts = Counter(hashes.tolist())
                for k in near.tolist():
                    item, _, other = items[k]
                    score = similarity(counts, other)
                    if score >= least - 1e-12 and (item not in best or score > best[item][2]):
                        best[item] = (start, length, score)
        return [(item, *best[item]) for item in sorted(best, key=lambda i: (i is None, i))]


@lru_cache(maxsize=2)
def _benchmark(items: tuple, radius: int) -> Benchmark:
    return Benchmark(items, radius)


def leak_column(text: Column, items: list[tuple[int, str]], least: float = SIMILARITY, radius: int = RADIUS) -> Column:
    """Benchmark items in a text; ``items`` is one block of the benchmark."""
    key = tuple((i, t) for i, t in items)

    @F.arrow_udf(HITS)
    def run(texts):
        import pyarrow as pa

        bench = _benchmark(key, radius)
        _, _, words, first, _ = batch_words(texts)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        # places of item shingles in all texts of the batch; a shingle across two texts is sorted out below
        places = {size: np.flatnonzero(_member(shingle_hashes(words, size), bench.all[size])) for size in bench.sizes}
        texts_hit = np.unique(np.concatenate([np.searchsorted(first, p, side="right") - 1 for p in places.values()])) if places else []
        for k in np.asarray(texts_hit, dtype=np.int64).tolist():
            low, high = int(first[k]), int(first[k + 1])
            inside = {}
            for size, p in places.items():
                some = p[np.searchsorted(p, low) : np.searchsorted(p, high)] - low
                inside[size] = some[some + size <= high - low]
            out[k] = [dict(zip(("item_id", "first_word", "words", "similarity"), h)) for h in bench.search(words[low:high], inside, least)]
        kind = pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())])
        return pa.array(out, pa.list_(kind))

    return run(text)


def _member(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are in the sorted ``known``; a bit table turns away nearly all others first."""
    if not len(known):
        return np.zeros(len(hashes), dtype=bool)
    table = np.zeros(1 << 20, dtype=bool)
    table[(known >> np.uint64(44)).astype(np.int64)] = True
    out = table[(hashes >> np.uint64(44)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
    out[some] = known[at] == hashes[some]
    return out


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", per_block: int = BLOCK_ITEMS):
    """The benchmark in blocks of at most ``per_block`` items; the driver holds one block at a time."""
    rows, block = benchmark.select(F.col(f"`{item}`").cast("long"), F.col(f"`{text}`")).toLocalIterator(), []
    for row in rows:
        block.append((row[0], row[1]))
        if len(block) == per_block:
            yield block
            block = []
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per document and benchmark item in it: key, item_id, first_word, words, similarity (of the best window).

    Words are compared without case and punctuation. An item of fewer than five words is one shingle of all its words;
    items without words, and null or blank texts, match nothing. Repeated rows give repeated results; an empty table
    on either side gives no rows; extra columns are not read. Long benchmarks are taken in blocks, one pass each.
    """
    schema = f"doc_id {docs.select(F.col(f'`{key}`')).schema[0].dataType.simpleString()}, item_id bigint, first_word int, words int, similarity double"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        hits = docs.select(F.col(f"`{key}`").alias("doc_id"), F.explode(leak_column(F.col(f"`{text}`"), block, **options)).alias("h"))
        found = found.unionByName(hits.select("doc_id", "h.*"))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns as they were."""
    for block in item_blocks(benchmark):
        docs = docs.filter(F.size(leak_column(F.col(f"`{text}`"), block, **options)) == 0)
    return docs
