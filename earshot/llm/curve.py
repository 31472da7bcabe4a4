"""Packing along a space-filling curve: documents that are alike become neighbours in the training sequences.

A document's token counts are hashed into a short signed vector. The vectors' second moments over all documents give the
few directions in which they differ most; places in these directions are spread evenly and numbered along a Hilbert
curve. Documents are range-sorted by that number and laid end to end, and the line is cut every ``capacity`` tokens.
Only the last cut can be short; it is made of powers of two, which need no padding.
"""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache
from unicodedata import normalize

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen

WIDTH, DIMENSIONS, BITS = 64, 4, 15
_UNIT = 4096  # vectors are whole numbers of this length: sums over all documents are exact in any order
_CACHED = 400_000
_FLUSH = 16 << 20  # bytes of text or ids that a task works on at once, and at least one document
PIECES = "row_id long, doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


# ---- tokens ------------------------------------------------------------------------------------------------------------


def _little(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _parts(texts, most: int):
    """Slices of an Arrow string array of about ``most`` bytes, at least one text each."""
    import pyarrow.compute as pc

    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


class ChunkTokeniser:
    """Ids of a ``tokenizers`` file of BPE with word ends, for which blanks and line breaks only separate.

    A text is the sequence of its chunks between blanks or line breaks. The ids of frequent chunks are kept in a bounded
    memory. Rare ones of plain letters, digits and marks are merged by ``tiktoken`` with the file's vocabulary as ranks, where
    a blank stands for the word end; all others go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json
        import re

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {"": b""}
        probe = self.tokenizer.encode("a b\n c", add_special_tokens=False).ids
        if probe != [i for c in "abc" for i in self.tokenizer.encode(c, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer gives ids to white space")
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        suffix, split = about["model"]["end_of_word_suffix"], about["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        ranks = {}
        for token, rank in about["model"]["vocab"].items():
            end = token.endswith(suffix) and len(token) > len(suffix)
            ranks[bytes(_BYTE_OF[c] for c in (token[: -len(suffix)] if end else token)) + b" " * end] = rank
        self.word_end = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.word_end[[rank for token, rank in ranks.items() if token[-1:] == b" " and len(token) > 1]] = True
        self.merges = tiktoken.Encoding("word_ends", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(split).findall
        # printable ASCII, Latin, Greek and Cyrillic; without the letter whose lower case depends on its place
        self.plain = re.compile("[!-~\xa1-\u03a2\u03a4-\u052f]+").fullmatch
        self.added = re.compile("|".join(re.escape(t["content"]) for t in about["added_tokens"])).search

    def _whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are not in the memory; one call of ``tiktoken`` for all, parted at the word ends."""
        pieces, counts, whole = [], [], {}
        for k, chunk in enumerate(chunks):
            if chunk.isascii() and chunk.isalpha():
                own = (chunk.lower(),)
            elif self.plain(chunk) and not self.added(chunk):
                own = self.pieces((chunk if chunk.isascii() else normalize("NFC", chunk)).lower())
            else:
                own, whole[k] = (), _little(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
            pieces += own
            counts.append(len(own))
        ids = np.array(self.merges.encode_ordinary(" ".join(pieces) + " ") if pieces else [], "<u4")
        after = np.concatenate([[0], np.flatnonzero(self.word_end[ids]) + 1])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])].tolist()
        raw = ids.tobytes()
        return [whole[k] if k in whole else raw[4 * a : 4 * b] for k, (a, b) in enumerate(zip(after, after[1:]))]

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.known.get, chunks))
        fresh = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(fresh, self.ids_of([chunks[k] for k in fresh])):
            found[k] = ids
            if len(self.known) < _CACHED and len(chunks[k]) < 40:
                self.known[chunks[k]] = ids
        return found

    def encode_many(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string array one after another, and the ``len + 1`` places where texts begin.

        Chunks are split and numbered in Arrow; Python sees each distinct one once, and the ids are gathered by NumPy.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten().dictionary_encode()
        at, ids = chunks.indices.to_numpy(), self._look_up(chunks.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        blob, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        counts = sizes[at]
        ends = np.cumsum(counts)
        tokens = blob[np.repeat(starts[at] - (ends - counts), counts) + np.arange(counts.sum())]
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        return tokens, np.concatenate([[0], ends])[edges]

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian 32-bit numbers."""
        import pyarrow as pa

        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order
    from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE_OF = _bytes_of_characters()


@lru_cache(maxsize=2)
def _tokeniser(path: str) -> ChunkTokeniser:
    """One per worker process: tasks that a process runs one after another share what it has learnt."""
    return ChunkTokeniser(path)


@lru_cache(maxsize=2)
def _hashed(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of every token id in the vectors."""
    ids = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    ids = (ids ^ (ids >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    ids = (ids ^ (ids >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    ids ^= ids >> np.uint64(31)
    return (ids % np.uint64(WIDTH)).astype(np.int64), np.where(ids >> np.uint64(63), 1.0, -1.0)


def vector_of(ids: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashed vector of one document: root of each token's count, length ``_UNIT``, in whole numbers; zero without tokens."""
    counts = np.bincount(ids, minlength=size) if len(ids) > size // 8 else None
    if counts is None:
        tokens, counts = np.unique(ids, return_counts=True)
    else:
        tokens = np.flatnonzero(counts)
        counts = counts[tokens]
    place, sign = _hashed(size, seed)
    vector = np.bincount(place[tokens], weights=np.sqrt(counts) * sign[tokens], minlength=WIDTH)
    length = np.sqrt((vector * vector).sum())
    return np.rint(vector * (_UNIT / length if length else 0)).astype(np.int32)


def _tokenise(path: str, end_id: int, seed: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("tokens", pa.int64()), ("ids", pa.binary()), ("vector", pa.list_(pa.int32()))])
        tokeniser = _tokeniser(path)
        narrow = "<u2" if tokeniser.size <= 1 << 16 else "<u4"
        end = np.array([end_id], narrow).tobytes()
        for batch in batches:
            for low, high in _parts(batch["text"], _FLUSH):
                some = batch.slice(low, high - low)
                ids, edges = tokeniser.encode_many(some["text"])
                pairs = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
                vectors = np.array([vector_of(ids[a:b], tokeniser.size, seed) for a, b in pairs], np.int32)
                raw, width = memoryview(ids.astype(narrow).tobytes()), int(narrow[-1])
                held = pa.array([b"".join((raw[width * a : width * b], end)) for a, b in pairs], pa.binary())
                vectors = pa.ListArray.from_arrays(np.arange(0, vectors.size + 1, WIDTH, dtype=np.int32), vectors.ravel())
                yield pa.RecordBatch.from_arrays([some["row_id"], some["doc_id"], pa.array(np.diff(edges) + 1), held, vectors], schema=schema)

    return run


# ---- the curve ---------------------------------------------------------------------------------------------------------


def hilbert(places: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Number along the Hilbert curve of each row of ``places`` (whole numbers below ``2 ** bits``, a column a dimension).

    From the coarsest bit down, each cell's walk is reflected or turned so that it continues its neighbour's (Skilling's
    transform); the bits of all dimensions are then interleaved.
    """
    x = [places[:, k].astype(np.int64) for k in range(places.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(len(x)):
            high = (x[k] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = x[0] ^ np.where(high, low, swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros(len(places), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    number = np.zeros(len(places), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            number = (number << 1) | (((axis ^ turn) >> level) & 1)
    return number


_UPPER = np.triu_indices(WIDTH)


def _moments(batches):
    """Sums of the vectors of a task and of their products, by place: exact, as all numbers are whole and below 2**53."""
    import pyarrow as pa

    total = np.zeros(1 + WIDTH + len(_UPPER[0]), dtype=np.int64)
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            vectors = batch["vector"].slice(low, 4096).flatten().to_numpy().reshape(-1, WIDTH).astype(np.float64)
            total += np.concatenate([[len(vectors)], vectors.sum(axis=0), (vectors.T @ vectors)[_UPPER]]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "total"])


def directions(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean of all vectors, and the ``DIMENSIONS`` directions of largest variance, scaled to unit variance.

    The driver gets one number per pair of vector places (2 145), whatever the number of documents.
    """
    rows = tokens.select("vector").mapInArrow(_moments, "place long, total long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = np.zeros(1 + WIDTH + len(_UPPER[0]))
    for row in rows:
        total[row.place] = float(row.total)
    count = max(total[0], 1.0)
    mean = total[1 : WIDTH + 1] / count
    spread = np.zeros((WIDTH, WIDTH))
    spread[_UPPER] = total[WIDTH + 1 :] / count
    spread = spread + np.triu(spread, 1).T - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread)
    best = vectors[:, ::-1][:, :DIMENSIONS]
    best = best * np.sign(best[np.abs(best).argmax(axis=0), np.arange(DIMENSIONS)])
    return mean, best / np.sqrt(np.maximum(values[::-1][:DIMENSIONS], 1e-9))


def curve_number(vectors: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Hilbert number of each vector: places along ``axes``, spread evenly by the logistic curve."""
    along = np.clip((vectors - mean) @ axes, -30, 30)
    places = np.floor((1 << BITS) / (1 + np.exp(-1.702 * along))).astype(np.int64)
    return hilbert(np.clip(places, 0, (1 << BITS) - 1))


def _number(mean: np.ndarray, axes: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch["vector"].flatten().to_numpy().reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row_id", "doc_id", "tokens", "ids")), pa.array(curve_number(vectors, mean, axes))], ["row_id", "doc_id", "tokens", "ids", "curve"])

    return run


# ---- the line and its cuts ---------------------------------------------------------------------------------------------


def _line_up(batches):
    """The tokens before each document within its part, in the part's order."""
    import pyarrow as pa

    at = 0
    for batch in batches:
        tokens = batch["tokens"].to_numpy()
        ends = at + np.cumsum(tokens)
        yield batch.append_column("at", pa.array(ends - tokens))
        at = int(ends[-1]) if len(ends) else at


def tail_cuts(total: int, capacity: int) -> list[int]:
    """Ends of the sequences of the last, short cut: powers of two, the largest first."""
    at, ends = total - total % capacity, []
    for bit in range(capacity.bit_length() - 1, -1, -1):
        if (total % capacity) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def _cut(capacity: int, total: int):
    ends = np.array(tail_cuts(total, capacity), dtype=np.int64)
    full = total // capacity

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in PIECES.split(", "))])
        held, size = [], 0
        for batch in batches:
            for row, doc, tokens, ids, first in zip(*[batch[c].to_pylist() for c in ("row_id", "doc_id", "tokens", "ids", "first")]):
                numbers = np.frombuffer(ids, "<u2" if len(ids) == 2 * tokens else "<u4").astype("<u4")
                at = first
                while at < first + tokens:
                    if at < full * capacity:
                        sequence, begin, end = at // capacity, at - at % capacity, at - at % capacity + capacity
                    else:
                        k = int(np.searchsorted(ends, at, side="right"))
                        sequence, begin, end = full + k, int(ends[k - 1]) if k else full * capacity, int(ends[k])
                    stop = min(end, first + tokens)
                    held.append((row, doc, at - first, stop - at, numbers[at - first : stop - first].tobytes(), tokens, sequence, at - begin))
                    at = stop
                size += 4 * tokens
                if size > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return run


def pack_along_curve(docs: DataFrame, capacity: int = 4096, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, seed: int = 11, part_bytes: int = 64 << 20) -> DataFrame:
    """Pieces of all documents in the order of the curve: row_id, doc_id, ``start`` (tokens of the document before it),
    ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.

    ``tokenizer``: a file of ``tokenizers``, by default ``word_bpe_49k.json``; ``end_id`` follows each document. All
    sequences hold ``capacity`` tokens, but the last ones, which hold different powers of two, the largest first. Documents
    are cut only where a sequence ends.

    A null or empty text is its end id alone. Repeated rows and equal or missing ids are separate documents; equal texts
    have equal curve numbers, and their order is then by a hash of the row, so that a group of copies of any size spreads
    over parts. An empty table gives no pieces. Other columns of ``docs`` are not read. Ids move once, in parts of
    about ``part_bytes``; a task streams its part. The table of part sizes has one row per part.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    read = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    tokens = frozen(read.mapInArrow(_tokenise(tokenizer, end_id, seed), "row_id long, doc_id long, tokens long, ids binary, vector array<int>"), "tokens", "zstd")
    total = tokens.agg(F.sum("tokens")).first()[0] or 0
    mean, axes = directions(tokens)

    parts = max(tokens.sparkSession.sparkContext.defaultParallelism, -(-2 * total // part_bytes))
    numbered = tokens.mapInArrow(_number(mean, axes), "row_id long, doc_id long, tokens long, ids binary, curve long")
    order = ["curve", "tie", "row_id"]
    sorted_ = numbered.withColumn("tie", F.xxhash64("row_id")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_ = sorted_.select("row_id", "doc_id", "tokens", "ids", F.spark_partition_id().alias("part"))
    line = frozen(sorted_.mapInArrow(_line_up, "row_id long, doc_id long, tokens long, ids binary, part int, at long"), "line", "zstd")

    sizes = line.groupBy("part").agg(F.sum("tokens").alias("held"))
    begins = sizes.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("before"))
    placed = line.join(begins, "part").select("row_id", "doc_id", "tokens", "ids", (F.col("before") + F.col("at")).alias("first"))
    return placed.mapInArrow(_cut(capacity, total), PIECES)


def assemble(pieces: DataFrame, pad_id: int = 0, capacity: int = 4096) -> DataFrame:
    """Whole sequences: ``sequence_id``, ``ids`` (little-endian 32-bit), ``docs`` (row_id, doc_id, start, offset, length).

    A sequence that is neither full nor a power of two is padded with ``pad_id`` to ``capacity``. A group holds one
    sequence, so at most ``capacity`` tokens.
    """
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "row_id", "doc_id", "start", "ids"))).alias("docs"))
    size = F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["length"])
    joined = F.aggregate("docs", F.lit("").cast("binary"), lambda a, d: F.concat(a, d["ids"]))
    power = F.bit_count(size) == 1
    blank = F.when(power, F.lit("").cast("binary")).otherwise(F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(capacity) - size).cast("int"))))
    return held.select("sequence_id", F.concat(joined, blank).alias("ids"), F.transform("docs", lambda d: d.dropFields("ids")).alias("docs"))
