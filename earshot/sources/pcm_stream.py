"""A stream of PCM chunks from growing files (SRC-14, SRC-11): a Python data source with a byte offset per file.

A recorder appends raw int16 samples to ``<call>@<first microsecond>.pcm`` and puts a file ``<name>.done`` beside it when
the call is over. The offset of a trigger says how far each file has been read, and Spark's checkpoint keeps it, so a
restart goes on where the last batch ended; a batch that failed is read again from the same places.
"""

from __future__ import annotations

import datetime as dt
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .ranged import open_store

CHUNK = "call_id string, seq long, event_ts timestamp, pcm binary"
_PART_BYTES = 8 << 20


class _Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def chunk_rows(name: str, data: bytes, first: int, chunk: int, rate: int):
    """Rows of the bytes of a file from byte ``first`` on; ``seq`` is the place of a chunk in the file."""
    call, _, begin = name.rsplit("/", 1)[-1].removesuffix(".pcm").rpartition("@")
    for at in range(0, len(data), chunk):
        micros = int(begin) + (first + at) * 1_000_000 // (2 * rate)
        when = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=micros)
        yield call, (first + at) // chunk, when, data[at : at + chunk]


class PcmStreamReader(DataSourceStreamReader):
    """At most ``per_trigger`` chunks of each file a trigger; only whole chunks until a file is done.

    A file that shrinks or goes is left where it was read to. The offset has one entry per file of the folder.
    """

    def __init__(self, options):
        self.root, self.rate = options["path"], int(options.get("rate", "16000"))
        self.chunk, self.limit = int(options.get("chunk_bytes", "8000")), int(options.get("per_trigger", "240"))
        if self.chunk <= 0 or self.chunk % 2 or self.limit <= 0:
            raise ValueError("chunk_bytes must be even and positive, per_trigger positive")
        self.current: dict | None = None

    def initialOffset(self):
        return {}

    def latestOffset(self):
        from pyarrow import fs

        if self.current is None:  # a new query: after a restart the engine has planned its last batch before
            self.current = self.initialOffset()
        store, root = open_store(self.root)
        listed = {f.base_name: f.size for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file}
        ahead = dict(self.current)
        for name, size in listed.items():
            if not fnmatch(name, "*@*.pcm"):
                continue
            start = ahead.get(name, 0)
            end = min(size, start + self.limit * self.chunk)
            # the last, short chunk of a file comes once the file is done
            if end == size and f"{name}.done" not in listed:
                end = start + (end - start) // self.chunk * self.chunk
            if end > start:
                ahead[name] = end
        self.current = ahead
        return ahead

    def partitions(self, start, end):
        if self.current is None:
            self.current = dict(end)
        parts, held, size = [], [], 0
        for name in sorted(end):
            first, last = start.get(name, 0), end[name]
            if last <= first:
                continue
            if held and size + last - first > _PART_BYTES:
                parts.append(_Ranges(held))
                held, size = [], 0
            held.append((f"{self.root}/{name}", first, last))
            size += last - first
        return parts + [_Ranges(held)] if held else parts

    def read(self, partition):
        for path, first, last in partition.ranges:
            store, name = open_store(path)
            with store.open_input_file(name) as file:
                yield from chunk_rows(path, file.read_at(last - first, first), first, self.chunk, self.rate)

    def commit(self, end):
        if self.current is None:
            self.current = dict(end)


class PcmChunks(DataSource):
    """``spark.readStream.format("pcm_chunks").option("path", folder)``; options chunk_bytes, per_trigger, rate."""

    @classmethod
    def name(cls):
        return "pcm_chunks"

    def schema(self):
        return CHUNK

    def streamReader(self, schema):
        return PcmStreamReader(self.options)


def pcm_stream(spark: SparkSession, root: str, chunk_bytes: int = 8000, per_trigger: int = 240, rate: int = 16000) -> DataFrame:
    """SRC-14 as a stream: call_id, seq, event_ts, pcm."""
    spark.dataSource.register(PcmChunks)
    return spark.readStream.format("pcm_chunks").option("path", root).option("chunk_bytes", chunk_bytes).option("per_trigger", per_trigger).option("rate", rate).load()
