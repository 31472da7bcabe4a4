"""WARC archives: write records of pages, normalise monolithic gzip files, read records back by their offsets.

``write_monolithic`` packs the records of a partition into files that are one gzip stream each, which can only be read
from their start. ``normalise`` inflates such a stream once, writes every record as a gzip member of its own and puts
a sidecar index of offsets beside it. ``read_records`` seeks by that index. Files lie in the shared folder and appear
under their names only when whole; names and contents follow from the partition alone, so a task can run again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import filesystem, frozen, write_file

DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
_LEVEL = 4
FEW_REPEATS = 200_000  # payloads with copies, beyond which their table is joined by a shuffle


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns page_id, url, html, ``refers_to``: the smallest page id with an equal payload, null for responses.

    Payloads under ``least_bytes`` are all responses. A null html is an empty payload. Rows that share the smallest
    page id are all responses; a row without page id refers to the smallest id among its equals, if there is one.
    """
    pages = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    digest = F.sha2("html", 256)
    # one short row per page, combined before the exchange: hot payloads arrive as one row per task
    first = pages.filter(F.octet_length("html") >= least_bytes).select(digest.alias("digest"), "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    repeats = frozen(first.filter((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", "first"), "warc-repeats")
    if repeats.count() <= FEW_REPEATS:  # some 100 bytes each
        repeats = F.broadcast(repeats)
    pages = pages.withColumn("digest", digest).join(repeats, "digest", "left")
    return pages.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _record(page_id, url, payload: bytes, refers_to) -> tuple[bytes, bytes]:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + payload_digest(payload))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode(), block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _monolithic_writer(folder: str, archive_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        rows = ((i, u, (h or "").encode(), r) for b in batches for i, u, h, r in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))))
        row = next(rows, None)
        while row is not None:
            path, count, size = f"{folder}/{part:06d}-{number:04d}.warc.gz", 0, 0

            def fill(stream):
                nonlocal row, count, size
                packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                while row is not None and (count == 0 or size < archive_bytes):
                    head, block = _record(*row)
                    stream.write(packer.compress(head) + packer.compress(block))
                    count, size, row = count + 1, size + len(head) + len(block), next(rows, None)
                stream.write(packer.flush())

            write_file(path, fill)
            number += 1
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": [count]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return run


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Archive name and number of records of every file written; ``pages`` comes from ``mark_revisits``."""
    return frozen(pages.mapInArrow(_monolithic_writer(folder, archive_bytes), "archive string, records long"), "warc-files")


class _Inflated:
    """The bytes of a gzip stream of one or many members, read once and in pieces."""

    def __init__(self, stream):
        self.stream, self.gzip, self.left = stream, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        raw = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
        raw = raw or self.stream.read(_CHUNK)
        if not raw:
            rest = b"" if self.gzip.eof else self.gzip.flush()
            if not self.gzip.eof:
                raise ValueError("the gzip stream is cut off")
            self.left += rest
            return bool(rest)
        if self.gzip.eof:
            self.gzip = zlib.decompressobj(31)
        self.left += self.gzip.decompress(raw, _CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the stream."""
        seen = 0
        while (at := self.left.find(mark, seen)) < 0:
            seen = max(0, len(self.left) - len(mark))
            if not self.more():
                if self.left.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a record's head")
                return None
        out = bytes(self.left[: at + len(mark)])
        del self.left[: at + len(mark)]
        return out

    def pieces(self, count: int):
        """The next ``count`` bytes."""
        while count:
            if not self.left and not self.more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.left[:count])
            del self.left[:count]
            count -= len(piece)
            if piece:
                yield piece


def normalise_stream(source, target) -> list[dict]:
    """Rewrite the records of a gzip stream as members of their own; returns the index. Memory: a few chunks."""
    inflated, index, offset = _Inflated(source), [], 0
    while (head := inflated.until(b"\r\n\r\n")) is not None:
        fields = _fields(head.lstrip(b"\r\n"))
        packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
        size = target.write(out) if (out := packer.compress(head)) else 0
        for piece in inflated.pieces(int(fields["content-length"]) + 4):
            if out := packer.compress(piece):
                size += target.write(out)
        size += target.write(packer.flush())
        index.append({"offset": offset, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id")})
        offset += size
    return index


def _normaliser(folder: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for archive in batch["archive"].to_pylist():
                store, name = filesystem(archive)
                path, index = f"{folder}/{archive.rsplit('/', 1)[1]}", []

                def fill(stream):
                    with store.open_input_stream(name, compression=None) as source:
                        index.extend(normalise_stream(source, stream))

                write_file(path, fill)
                write_file(path + ".idx", lambda stream: [stream.write(json.dumps(x).encode() + b"\n") for x in index])
                yield pa.RecordBatch.from_pydict({"archive": [path], "records": [len(index)]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return run


def normalise(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """One task per archive, as a single gzip stream cannot be split; the result lists the archives written."""
    count = archives.count()
    named = archives.repartition(max(1, count), "archive")
    return frozen(named.mapInArrow(_normaliser(folder), "archive string, records long"), "warc-normal")


def _page(urn: str | None) -> str | None:
    return urn[len("<urn:page:") : -1] if urn and urn.startswith("<urn:page:") else None


def _reader(batches):
    import pyarrow as pa

    names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
    held, size = [], 0
    for batch in batches:
        for archive in batch["archive"].to_pylist():
            store, name = filesystem(archive)
            with store.open_input_stream(name + ".idx", compression=None) as stream:
                index = [json.loads(line) for line in stream.read().splitlines()]
            with store.open_input_file(name) as source:
                for entry in index:
                    source.seek(entry["offset"])
                    record = zlib.decompress(source.read(entry["length"]), 31)
                    head, _, rest = record.partition(b"\r\n\r\n")
                    fields = _fields(head)
                    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{archive}: the payload at {entry['offset']} does not fit its digest")
                    # a revisit keeps the head of the answer, and so the length of the payload it leaves out
                    length = len(payload) if kind == "response" else int(_fields(http)["content-length"])
                    held.append((_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), payload if kind == "response" else None, length, digest, kind, _page(fields.get("warc-refers-to"))))
                    size += len(payload) + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def read_records(archives: DataFrame) -> DataFrame:
    """A row per record of the normalised archives, found by the sidecar index. Page ids come as text."""
    return archives.mapInArrow(_reader, "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")


def archive_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = 256 << 20, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC, normalise the archives and read them back: a row per page (see ``read_records``).

    A null html is an empty payload, a null url gives a record without target, a null page id one without record id;
    blanks and control characters of urls are percent-encoded. Repeated rows give repeated records. An empty table
    gives no archives and no rows. Extra columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    plain = write_monolithic(mark_revisits(pages, least_bytes), folder + "/monolithic", archive_bytes)
    return read_records(normalise(spark, plain, folder + "/normal"))
