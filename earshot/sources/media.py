"""Audio files and raw chunks (SRC-01, SRC-14 .. SRC-17, SRC-20, HSH-01)."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.corpus import file_name
from ..operators.features import change_clips


def audio_listing(spark: SparkSession, root: str, pattern: str = "*.{wav,flac}") -> DataFrame:
    """SRC-01 / SET-01: path, length and modification time of audio files below ``root``; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(root).select("path", "length", "modificationTime")


def file_hashes(spark: SparkSession, root: str, pattern: str = "*.{wav,flac}") -> DataFrame:
    """HSH-01: SHA-256 of each file under its base name only."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(root).select(file_name("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def parse_riff(head: bytes) -> tuple[int, int, int, int, int, int] | None:
    """(format, channels, rate, bits, data bytes, place of the data) of a RIFF/WAVE header, None when it is not one."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt " and at + 24 <= len(head):
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            fmt = (kind, channels, rate, bits)
        elif name == b"data":
            return (*fmt, size, at + 8) if fmt else None
        at += 8 + size + size % 2
    return None


_HEAD_BYTES = 4096
_HEADER = "struct<format:int,channels:int,rate:int,bits:int,size:bigint,at:bigint>"


def riff_header(content) -> Column:
    """Header fields of a WAVE file's bytes, NULL when it has none.

    Most headers lie in the first 4 KiB, which is all that goes to Python for them; where chunks before the data are
    longer, the whole file goes. The result does not depend on which way was taken.
    """

    @F.arrow_udf(_HEADER)
    def read(heads):
        import pyarrow as pa

        kind = pa.struct([(n, pa.int64() if n in ("size", "at") else pa.int32()) for n in ("format", "channels", "rate", "bits", "size", "at")])
        names = [f.name for f in kind]
        found = (parse_riff(h.as_py()) if h.is_valid else None for h in heads)
        return pa.array([dict(zip(names, f)) if f else None for f in found], kind)

    c = F.col(content) if isinstance(content, str) else content
    first = read(F.substring(c, 1, _HEAD_BYTES))
    longer = F.when(first.isNull() & (F.octet_length(c) > _HEAD_BYTES), c)
    return F.coalesce(first, read(longer))


def header_audit(files: DataFrame) -> DataFrame:
    """SRC-17: duration, rate, channels and sample type from RIFF headers; NULLs for unreadable files."""
    h = files.select("path", riff_header("content").alias("h"))
    frame = F.col("h.channels") * F.col("h.rate").cast("double") * F.col("h.bits")
    ok = frame > 0
    return h.select(
        "path",
        F.when(ok, F.col("h.size") / (frame / 8.0)).alias("duration"),
        F.when(ok, F.col("h.rate")).alias("rate"),
        F.when(ok, F.col("h.channels")).alias("channels"),
        F.when(ok, F.when(F.col("h.format") == 1, F.concat(F.lit("PCM_"), F.col("h.bits").cast("string"))).otherwise("OTHER")).alias("subtype"),
    )


def wav_samples(files: DataFrame, rate: int = 16000) -> tuple[DataFrame, DataFrame]:
    """SRC-16: (path, ``pcm``) of mono 16-bit WAV files at ``rate``, and (path, ``reason``) of all others.

    Reasons: NOT_WAV, NOT_PCM16, NOT_MONO, WRONG_RATE, TRUNCATED (fewer bytes than the header states), NO_SAMPLES.
    ``pcm`` holds raw little-endian samples, which ``kernels.decode_pcm`` and ``live_chunks`` take.
    """
    read = files.select("path", "content", riff_header("content").alias("h"))
    whole = F.col("h.at") + F.col("h.size") <= F.octet_length("content")
    reason = (
        F.when(F.col("h").isNull(), "NOT_WAV")
        .when((F.col("h.format") != 1) | (F.col("h.bits") != 16), "NOT_PCM16")
        .when(F.col("h.channels") != 1, "NOT_MONO")
        .when(F.col("h.rate") != rate, "WRONG_RATE")
        .when(~whole, "TRUNCATED")
        .when(F.col("h.size") < 2, "NO_SAMPLES")
    )
    read = read.withColumn("reason", reason)
    pcm = whole_samples(F.substring("content", F.col("h.at").cast("int") + 1, F.col("h.size").cast("int")))
    return read.filter("reason IS NULL").select("path", pcm.alias("pcm")), read.filter("reason IS NOT NULL").select("path", "reason")


def wav_bytes(pcm_int16, rate: int = 16000) -> Column:
    """A mono 16-bit WAV file around raw PCM bytes."""
    size = F.octet_length(pcm_int16)
    fixed = F.unhex(F.lit((struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16) + b"data").hex()))
    le32 = lambda n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(4)])
    return F.concat(F.encode(F.lit("RIFF"), "utf-8"), le32(size + 36), F.encode(F.lit("WAVE"), "utf-8"), fixed, le32(size), pcm_int16)


def whole_samples(pcm) -> Column:
    """SRC-14: drop an odd trailing byte."""
    c = F.col(pcm) if isinstance(pcm, str) else pcm
    n = F.octet_length(c)
    return F.substring(c, F.lit(1), n - F.pmod(n, F.lit(2)))


def live_chunks(frames: DataFrame, pcm: str = "pcm") -> DataFrame:
    """SRC-14: binary chunks of a stream or table, odd byte dropped, empty ones skipped."""
    return frames.withColumn(pcm, whole_samples(pcm)).filter(F.octet_length(pcm) > 0)


MESSAGE_SCHEMA = "audio_chunk string, action string, claimed_contact_role string, is_financial_transaction boolean, language string"


def json_messages(messages: DataFrame, text: str = "message") -> tuple[DataFrame, DataFrame]:
    """SRC-15 / STM-07: (audio chunks, configuration messages) out of JSON text frames."""
    parsed = messages.withColumn("__m", F.from_json(text, MESSAGE_SCHEMA))
    audio = live_chunks(parsed.filter("__m.audio_chunk IS NOT NULL").withColumn("pcm", F.unbase64(F.col("__m.audio_chunk"))).drop("__m", text))
    config = parsed.filter("__m.audio_chunk IS NULL AND __m.action = 'configure'").select(
        *[c for c in messages.columns if c != text], "__m.claimed_contact_role", "__m.is_financial_transaction", "__m.language")
    return audio, config


def standardise(clips: DataFrame, pcm: str = "pcm", top_db: float = 30.0, shortest: int = 8000) -> DataFrame:
    """SRC-20: silence cut, clips of at least half a second kept, peak normalised; adds ``duration_sec``.

    Missing and silent clips are too short; clips of any length take one NumPy pass, a few clips at a time, no array lambdas.
    """
    cut = change_clips(clips, lambda y: K.normalise_peak(K.voiced(y, top_db), 0.95, 0.03), pcm).filter(F.size(pcm) >= shortest)
    return cut.withColumn("duration_sec", F.size(pcm) / 16000.0)
