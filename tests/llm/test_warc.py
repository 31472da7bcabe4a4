import base64
import gzip
import hashlib
import io
import json
from collections import Counter

from earshot.llm.common import filesystem
from earshot.llm.warc import archive_pages, normalise_stream, write_monolithic, mark_revisits
from earshot.session import scratch

PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/ x\n", None), (4, "http://c/", ""), (5, "http://d", "é" * 50_000), (5, "http://d", "é" * 50_000),
    (None, "http://e", "<p>one</p>"), (7, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n"), (0, "http://g", "<b>"), (None, "http://h", "alone"),
]


def expected():
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in PAGES:
        body = (h or "").encode()
        refers = first.get(h or "")
        refers = None if refers == i else refers
        yield i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, refers_to string").repartition(3)
    for size in (1, 100, 1 << 20):
        rows = archive_pages(pages, archive_bytes=size).collect()
        got = Counter((int(r.page_id) if r.page_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in rows)
        assert got == Counter(expected())
        assert {bytes(r.payload) for r in rows if r.payload is not None} == {(h or "").encode() for _, _, h in PAGES}


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = archive_pages(pages, least_bytes=20).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 20} == {"response"}


def test_no_pages(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_members_and_index(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    folder = scratch(spark, "warc-test")
    path = write_monolithic(mark_revisits(pages), folder).first().archive
    store, name = filesystem(path)
    whole = store.open_input_stream(name, compression=None).read()
    target = io.BytesIO()
    index = normalise_stream(io.BytesIO(whole), target)
    out = target.getvalue()
    # every member opens alone, and all together are the old stream
    parts = [gzip.decompress(out[x["offset"] : x["offset"] + x["length"]]) for x in index]
    assert b"".join(parts) == gzip.decompress(whole) == gzip.decompress(out)
    assert len(parts) == len(PAGES) and all(p.startswith(b"WARC/1.1\r\n") for p in parts)
    # a normalised archive normalises to itself, members and all
    again = io.BytesIO()
    assert normalise_stream(io.BytesIO(out), again) == index and again.getvalue() == out
    json.dumps(index)


def test_cut_stream_is_an_error():
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n")
    for bad in (whole[:-9], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabcd")):
        try:
            normalise_stream(io.BytesIO(bad), io.BytesIO())
        except ValueError:
            continue
        raise AssertionError("not noticed")
