"""Best-fit packing of token sequences, certified by dual feasible functions.

Documents are tokenised once and cut into pieces. Pieces are dealt at random over partitions; each runs best-fit
decreasing and compares its number of bins with lower bounds from dual feasible functions. A partition that meets its
bound is proven optimal and stays. The others exchange the documents of their bins with room: these are dealt anew over
fewer, larger partitions that run best-fit decreasing again, as long as that saves bins.
"""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids binary"
_FLUSH = 16 << 20
_CACHED = 400_000  # words, some 150 bytes each


# ---- tokens ------------------------------------------------------------------------------------------------------------


class ByteBpe:
    """Token ids of a text as little-endian 32-bit numbers, with a bounded memory of words.

    Pre-tokens of this vocabulary's pattern never go across a single blank or line break between two other characters,
    so such texts are encoded word by word; all others in one piece. Texts are first split at the ``added`` tokens, which
    have ids of their own and match before all else, the leftmost and of these the longest.
    """

    def __init__(self, tiktoken_file: str, pattern: str, added: dict[str, int] | None = None):
        import base64
        import re

        import tiktoken

        with open(tiktoken_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoder = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # None: not seen yet; False: the words of this text do not stand alone
        self.words: dict[str, bytes | bool] = {"": False, "\n": False}
        self.added = {mark: np.array([number], "<u4").tobytes() for mark, number in (added or {}).items()}
        self.marks = re.compile("(" + "|".join(re.escape(m) for m in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def whole(self, text: str) -> bytes:
        ids = array("I", self.encoder.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, word: str) -> bytes | bool:
        rest = word[1:] if word[:1] == "\n" else word
        alone = rest.split() == [rest]
        ids = self.whole(word if word[:1] == "\n" else " " + word) if alone else False
        if len(self.words) < _CACHED and len(word) < 40:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        return b"".join(self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(self.marks.split(text)) if part)

    def _plain(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        if any(c.isspace() for c in first):
            return self.whole(text)
        start, found = self.whole(first), list(map(self.words.get, rest))
        try:
            return start + b"".join(found)
        except TypeError:  # a word is new, or does not stand alone
            found = [self._learn(word) if ids is None else ids for word, ids in zip(rest, found)]
        try:
            return start + b"".join(found)
        except TypeError:
            return self.whole(text)


@lru_cache(maxsize=2)
def _bpe(vocabulary: str, pattern: str, added: tuple) -> ByteBpe:
    """One per worker process: tasks that a process runs one after another share what it has learnt."""
    return ByteBpe(vocabulary, pattern, dict(added))


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """Added tokens of a ``tokenizers`` file: content and id. Those that take more than their own characters are refused."""
    import json

    with open(tokenizer_file, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError("added tokens with single_word, lstrip, rstrip or normalized are not supported")
    return {t["content"]: t["id"] for t in tokens}


def _cut(max_tokens: int, end_id: int, vocabulary: str, pattern: str, added: dict[str, int]):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        bpe, end, held, size = _bpe(vocabulary, pattern, tuple(sorted(added.items()))), np.array([end_id], "<u4").tobytes(), [], 0
        for batch in batches:
            for row, doc, text in zip(batch["row_id"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                ids = bpe.encode(text.as_py() or "") + end
                tokens = len(ids) // 4
                # only the first piece of a long document may be shorter than the others
                start, stop = 0, (tokens - 1) % max_tokens + 1
                piece = 0
                while start < tokens:
                    held.append((row, doc, piece, start, stop - start, ids[4 * start : 4 * stop]))
                    piece, start, stop = piece + 1, stop, stop + max_tokens
                size += len(ids)
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return run


def tokenise(docs: DataFrame, max_tokens: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents, written once: ``row_id`` (of the document), doc_id, piece, start, length, ids.

    ``vocabulary``: a file of ranks as tiktoken reads them, by default ``byte_bpe_50k.tiktoken``, which holds the
    vocabulary of ``byte_bpe_50k.json`` (a test compares the ids). Its added token ``<|endoftext|>`` in a text is one id, as
    ``tokenizers`` reads it by default; with a ``vocabulary`` of one's own, ``added`` names such tokens. A null or empty text is one piece with the end id alone.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        added = added_tokens(public_tokenizers.path("byte_bpe_50k.json")) if added is None else added
    docs = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return frozen(docs.mapInArrow(_cut(max_tokens, end_id, vocabulary, pattern, added or {}), PIECES), "pieces", "zstd")


# ---- bins --------------------------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every item, items taken from the longest down, each into the fullest bin that still has room for it."""
    bins, opened = np.empty(len(lengths), dtype=np.int64), 0
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some open bin has r tokens left
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, at, opened = capacity, opened, opened + 1
        bins[item] = at
        if room > need:
            free[room - need].append(at)
            rooms |= 1 << room - need
    return bins


def lower_bound(counts: np.ndarray, capacity: int, orders: int = 24) -> int:
    """Bins that any packing needs, from ``counts[length]``: the best of three families of dual feasible functions."""
    counts = counts.astype(object)  # Python integers: sums are exact at any size
    size = np.arange(capacity + 1)
    total = int((counts * size).sum())
    best = -(-total // capacity)
    # lengths above capacity - a count as whole bins, below a as nothing
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    for a in range(0, capacity // 2 + 1):
        large = n[capacity + 1] - n[capacity - a + 1]
        best = max(best, large - (-(s[capacity - a + 1] - s[a]) // capacity))
    # the larger half rounded up against the rest: at most floor(capacity / a) pieces of a or more fit a bin
    for a in range(1, capacity // 2 + 1):
        if capacity // a < 1:
            break
        value = np.where(size > capacity // 2, 2 * (capacity // a - (capacity - size) // a), np.where(size == capacity / 2, capacity // a, 2 * (size // a)))
        best = max(best, -(-int((counts * value).sum()) // (2 * (capacity // a))))
    # x stays where (k + 1) x is whole, otherwise floor((k + 1) x) / k
    for k in range(1, orders + 1):
        whole = (size * (k + 1)) % capacity == 0
        value = np.where(whole, k * size, capacity * ((size * (k + 1)) // capacity))
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return int(best)


PLACED = "row_id long, piece int, length long, part long, bin long, offset long, load long, bins long, bound long"


def _pack_group(capacity: int):
    def run(group):
        import pandas as pd

        group = group.sort_values(["length", "row_id", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = group["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        loads = np.bincount(bins, weights=lengths).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(order), dtype=np.int64)
        offset[order] = before - np.repeat(before[firsts], np.diff(np.append(firsts, len(order))))
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return pd.DataFrame({"row_id": group["row_id"], "piece": group["piece"].astype("int32"), "length": lengths, "part": group["part"], "bin": bins, "offset": offset, "load": loads[bins], "bins": int(bins.max()) + 1, "bound": bound})

    return run


def _deal(items: DataFrame, round_: int, per_part: int, count: int) -> DataFrame:
    """Deal items at random over parts of about ``per_part``; part numbers of different rounds differ."""
    parts = max(1, -(-count // per_part))
    part = F.pmod(F.xxhash64(F.lit(round_), "row_id", "piece"), F.lit(parts)) + F.lit(round_ << 28)
    return items.select("row_id", "piece", "length", part.alias("part"))


def place(pieces: DataFrame, capacity: int = 1024, per_part: int = 25_000, rounds: int = 3) -> DataFrame:
    """A row per piece: row_id, piece, ``sequence_id``, ``offset``, and whether its bin is ``certified``: it is full, or
    its part needs all its bins.

    Memory of a task: ``per_part * 2 ** rounds`` short rows. An exchange takes every piece of the bins with room in the
    parts with a gap (full bins cannot be bettered) and is kept only if it saves bins, so no round makes things worse.
    """
    items = pieces.select("row_id", "piece", "length")
    packed = frozen(_deal(items, 0, per_part, items.count()).groupBy("part").applyInPandas(_pack_group(capacity), PLACED), "packed")
    open_ = (F.col("bins") > F.col("bound")) & (F.col("load") < capacity)
    settled = []
    for round_ in range(1, rounds + 1):
        gap = packed.filter(open_)
        each = gap.groupBy("part").agg(F.count(F.lit(1)).alias("items"), F.sum((F.col("offset") == 0).cast("long")).alias("bins"))
        open_parts, count, bins = each.agg(F.count(F.lit(1)), F.sum("items"), F.sum("bins")).first()
        if open_parts < 2:
            break
        again = frozen(_deal(gap, round_, per_part << round_, count).groupBy("part").applyInPandas(_pack_group(capacity), PLACED), "packed")
        if again.filter("offset = 0").count() >= bins:
            break
        settled.append(packed.filter(~open_))
        packed = again
    for done in settled:
        packed = packed.unionByName(done)
    return packed.select("row_id", "piece", (F.shiftleft(F.col("part"), 32) + F.col("bin")).alias("sequence_id"), "offset", (~open_).alias("certified"))


def pack(docs: DataFrame, max_tokens: int = 1024, **options) -> tuple[DataFrame, DataFrame]:
    """Pieces with their token ids (``tokenise``) and their places (``place``), joined on row_id and piece.

    Repeated rows and equal or missing doc ids are separate documents. Ties between pieces of one length are broken by
    row and piece. An empty table gives no pieces. Extra columns of ``docs`` are not read.
    """
    pieces = tokenise(docs, max_tokens, **options)
    return pieces, place(pieces, max_tokens)
