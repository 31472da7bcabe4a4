"""Words of many texts at once: NumPy hashes of whole Arrow batches, for scans that look for a fixed set of words.

A word is a run of ASCII letters and digits or of bytes of other scripts, with A-Z in lower case; all else separates.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_ODD, _BLOCK + 1)
_INVERSE = _powers(pow(_ODD, -1, 1 << 64), _BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_spans(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in ``data``; no word goes across one of the offsets ``firsts``."""
    is_word = _IS_WORD[data]
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    new_text = np.zeros(len(data) + 1, dtype=bool)
    new_text[firsts] = True
    starts = np.flatnonzero(is_word & (~before | new_text[:-1]))
    after = np.append(is_word[1:], False)
    ends = np.flatnonzero(is_word & (~after | new_text[1:])) + 1
    return starts, ends


def _hash_block(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power = _POWER if len(folded) < len(_POWER) else _powers(_ODD, len(folded) + 1)
    inverse = _INVERSE if len(folded) < len(_INVERSE) else _powers(pow(_ODD, -1, 1 << 64), len(folded) + 1)
    sums = np.zeros(len(folded) + 1, dtype=np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * power[: len(folded)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def hash_words(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of ``data``, in blocks so that memory stays a few times the words."""
    starts, ends = word_spans(data, firsts)
    hashes, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        hashes[at:stop] = _hash_block(_FOLD[data[low:high]], starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return starts, ends, hashes


def batch_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the ``len + 1`` offsets of an Arrow string array; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def batch_words(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of an Arrow string array, the first word of each text, and the bytes."""
    raw, offsets = batch_bytes(texts)
    starts, ends, hashes = hash_words(raw, offsets)
    return starts, ends, hashes, np.searchsorted(starts, offsets), raw


def hash_text(text: str) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return hash_words(data, np.array([0, len(data)]))[2]


def words_of(text: str) -> list[str]:
    """The same words as strings."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, ends = word_spans(data, np.array([0, len(data)]))
    folded = _FOLD[data].tobytes()
    return [folded[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, factor = np.zeros(count, dtype=np.uint64), 1
    for k in range(size):
        factor = factor * 0xC2B2AE3D27D4EB4F & _MASK
        total += words[k : k + count] * np.uint64(factor)
    return mix(total)
