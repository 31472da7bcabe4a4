"""Fill-in-the-middle over seekable compressed texts.

A text is stored once as independent zstandard frames, each with the number of units and code points before it. A cut is
found by these counts: only the frame it lies in is decompressed and split. All other frames go into the output as they
are, in the new order, so an output is a valid zstandard stream that was never held as one text. Digests and the
restored text stream over the frames in order.

A unit is a run of ASCII letters or any other code point. A run that goes across frames counts in the frame it starts in.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import frozen
from .words import batch_bytes

MARKS = ("<P>", "<S>", "<M>")
FRAMES = "array<struct<data: binary, unit_start: bigint, char_start: bigint, joined: boolean>>"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


# ---- frames of one text ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _compressor(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


@lru_cache(maxsize=1)
def _decompressor():
    import zstandard

    return zstandard.ZstdDecompressor()


def inflate(frame: bytes) -> bytes:
    return _decompressor().decompress(frame)


def _starts(raw: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the bytes that start a unit and of those that start a code point; ``joined``: a letter stands before."""
    letter, first = _LETTER[raw], (raw & 0xC0) != 0x80
    after = np.empty_like(letter)
    after[:1], after[1:] = joined, letter[:-1]
    return first & ~(letter & after), first


def make_frames(raw: np.ndarray, frame_bytes: int, level: int) -> tuple[list[dict], int, int]:
    """Frames of the UTF-8 bytes of a text, its units and its code points; frames end between code points."""
    frames, units, chars, at, joined = [], 0, 0, 0, False
    while at < len(raw):
        stop = min(at + frame_bytes, len(raw))
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop += 1
        unit, char = _starts(raw[at:stop], joined)
        frames.append({"data": _compressor(level).compress(raw[at:stop].tobytes()), "unit_start": units, "char_start": chars, "joined": joined})
        units, chars, joined, at = units + int(unit.sum()), chars + int(char.sum()), bool(_LETTER[raw[stop - 1]]), stop
    return frames, units, chars


def cut_frames(frames: list[dict], cuts: list[int], units: int, chars: int, level: int) -> tuple[list[list[bytes]], list[int]]:
    """The frames between the unit numbers ``cuts`` (ascending), and the code points before each cut.

    Decompresses the frames that a cut lies in, and no others.
    """
    before = [f["unit_start"] for f in frames]
    places = []
    for cut in cuts:
        if cut >= units:
            places.append((len(frames), 0, chars))
            continue
        # of frames with equal counts the last one holds the unit: those before it hold no start of a unit
        k = bisect_right(before, cut) - 1
        raw = np.frombuffer(inflate(frames[k]["data"]), np.uint8)
        unit, char = _starts(raw, frames[k]["joined"])
        at = int(np.flatnonzero(unit)[cut - before[k]])
        places.append((k, at, frames[k]["char_start"] + int(char[:at].sum())))
    edges, sections = [(0, 0), *[p[:2] for p in places], (len(frames), 0)], []
    for (k, low), (end, high) in zip(edges, edges[1:]):
        section = []
        for j in range(k, end + (high > 0)):
            a, b = low if j == k else 0, high if j == end else None
            if a == 0 and b is None:
                section.append(frames[j]["data"])
            else:
                part = inflate(frames[j]["data"])[a:b]
                if part:
                    section.append(_compressor(level).compress(part))
        sections.append(section)
    return sections, [p[2] for p in places]


def _find(frames: list[bytes], mark: bytes, past: tuple[int, int] = (0, 0)) -> tuple[tuple[int, int], tuple[int, int]]:
    """Frame and byte where ``mark`` begins and where it ends, at or after ``past``; it may go across frames."""
    held, origin = b"", []  # the last bytes of earlier frames and where each came from
    for k in range(past[0], len(frames)):
        low = past[1] if k == past[0] else 0
        data = inflate(frames[k])[low:]
        joined = held + data
        at = joined.find(mark)
        if at >= 0:
            place = lambda i: origin[i] if i < len(held) else (k, low + i - len(held))
            last = place(at + len(mark) - 1)
            return place(at), (last[0], last[1] + 1)
        keep = max(0, len(joined) - len(mark) + 1)
        origin = [origin[i] if i < len(held) else (k, low + i - len(held)) for i in range(keep, len(joined))]
        held = joined[keep:]
    raise ValueError(f"no {mark!r} in the output")


def _between(frames: list[bytes], low: tuple[int, int], high: tuple[int, int]) -> Iterator[bytes]:
    for k in range(low[0], min(high[0] + (high[1] > 0), len(frames))):
        yield inflate(frames[k])[low[1] if k == low[0] else 0 : high[1] if k == high[0] else None]


def restore(frames: list[bytes], form: str, marks: tuple[str, str, str] = MARKS) -> Iterator[bytes]:
    """The text that an output was made of, in parts, from the output and its form alone."""
    start, end = (0, 0), (len(frames), 0)
    if form == "plain":
        yield from _between(frames, start, end)
        return
    prefix, suffix, middle = (m.encode() for m in marks)
    first, second = (prefix, suffix) if form == "psm" else (suffix, prefix)
    _, a = _find(frames, first)
    b, c = _find(frames, second, a)
    d, e = _find(frames, middle, c)
    head, tail = ((a, b), (c, d)) if form == "psm" else ((c, d), (a, b))
    for part in (head, (e, end), tail):
        yield from _between(frames, *part)


def digest(parts: Iterable[bytes]) -> str:
    total = hashlib.sha256()
    for part in parts:
        total.update(part)
    return total.hexdigest()


# ---- tables ------------------------------------------------------------------------------------------------------------


def archive_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", frame_bytes: int = 64 << 10, level: int = 3, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Store every text as frames: ``key``, ``units``, ``chars``, ``marked`` (a mark occurs in the text), ``frames``.

    Written once below the shared folder and read back; one row per row of ``docs``, so equal rows and equal or missing
    keys stay separate. A null text is an empty one: no frames, zero units. Other columns of ``docs`` are not read, so
    their names cannot clash. Memory of a task: one batch of texts; a text of any length is one row.
    """
    wanted = [m.encode() for m in marks]

    def run(batches):
        import pyarrow as pa

        struct = pa.struct([("data", pa.binary()), ("unit_start", pa.int64()), ("char_start", pa.int64()), ("joined", pa.bool_())])
        for batch in batches:
            raw, offsets = batch_bytes(batch["text"])
            columns = ([], [], [], [])
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = raw[low:high]
                frames, units, chars = make_frames(own, frame_bytes, level)
                whole = own.tobytes()
                for column, value in zip(columns, (units, chars, any(m in whole for m in wanted), frames)):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(struct))
            yield pa.RecordBatch.from_arrays([batch["key"], *[pa.array(c, t) for c, t in zip(columns, types)]], ["key", "units", "chars", "marked", "frames"])

    docs = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    tail = DataType.fromDDL(f"units long, chars long, marked boolean, frames {FRAMES}")
    schema = StructType([StructField("key", docs.schema["key"].dataType)] + tail.fields)
    # the frames are compressed already
    return frozen(docs.mapInArrow(run, schema), "frames", "uncompressed").withColumnRenamed("key", key)


def _draw(key: str, seed: int, k: int) -> Column:
    """The k-th group of eight hex digits of the digest of ``seed:key`` as a number."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hexed, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(archive: DataFrame, key: str = "doc_id", seed: int = 1, kept_plain: int = 10, suffix_first: int = 20, level: int = 3, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Outputs of all texts of ``archive_texts``: ``key``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``frames``.

    Two cuts between units are drawn by hashes of the key, so a text is cut alike in every run. ``form``: ``psm``
    (prefix, suffix, middle, each after its mark), ``spm`` (suffix first) for ``suffix_first`` of 100 others, or
    ``plain`` (unchanged) for ``kept_plain`` of 100, for empty texts and for those in which a mark occurs. Lengths are
    null for plain ones. ``frames`` is the output as an array of zstandard frames. A null key draws as an empty one.
    """

    def run(batches):
        import pyarrow as pa

        names = dict(zip(("P", "S", "M"), (_compressor(level).compress(m.encode()) for m in marks)))
        for batch in batches:
            prefix_chars, middle_chars, outputs = [], [], []
            for form, units, chars, first, second, frames in zip(*[batch[c].to_pylist() for c in ("form", "n", "chars", "first", "second", "frames")]):
                if form == "plain":
                    prefix_chars.append(None)
                    middle_chars.append(None)
                    outputs.append([f["data"] for f in frames])
                    continue
                (prefix, middle, suffix), (a, b) = cut_frames(frames, [first, second], units, chars, level)
                prefix_chars.append(a)
                middle_chars.append(b - a)
                head = [names["P"], *prefix, names["S"], *suffix] if form == "psm" else [names["S"], *suffix, names["P"], *prefix]
                outputs.append([*head, names["M"], *middle])
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["n"], batch["form"], pa.array(prefix_chars, pa.int64()), pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.list_(pa.binary()))],
                ["key", "n", "form", "prefix_chars", "middle_chars", "frames"],
            )

    n, h = F.col("units"), [_draw(key, seed, k) for k in (1, 2, 3, 4)]
    plain = (n == 0) | F.col("marked") | (h[2] % 100 >= 100 - kept_plain)
    planned = archive.select(
        F.col(f"`{key}`").alias("key"), n.alias("n"), "chars", "frames",
        F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
        F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("first"),
        F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("second"),
    )
    tail = DataType.fromDDL("n long, form string, prefix_chars long, middle_chars long, frames array<binary>")
    schema = StructType([StructField("key", planned.schema["key"].dataType)] + tail.fields)
    return planned.mapInArrow(run, schema).withColumnRenamed("key", key)


def output_text(frames: Column) -> Column:
    """The output as one string, for texts that fit a row."""

    @F.arrow_udf("string")
    def run(outputs):
        import pyarrow as pa

        return pa.array([b"".join(map(inflate, some)).decode() for some in outputs.to_pylist()], pa.string())

    return run(frames)


def digests(frames: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """SHA-256 of the output and of the text restored from it, as a struct of two hex strings; streams over the frames."""

    @F.arrow_udf("struct<output_sha256: string, restored_sha256: string>")
    def run(outputs, forms):
        import pyarrow as pa

        rows = [(digest(map(inflate, some)), digest(restore(some, f, marks))) for some, f in zip(outputs.to_pylist(), forms.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["output_sha256", "restored_sha256"])

    return run(frames, form)
