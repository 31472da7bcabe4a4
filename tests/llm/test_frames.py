import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from check import compare, connect
from conftest import SCHEMA, prose, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from earshot.llm import frames
from earshot.llm.frames import archive_texts, cut_frames, digests, fill_in_middle, inflate, make_frames, output_text, restore

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in frames.MARKS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def hashed(rows):
    return sorted((tuple(hashlib.sha256(x.encode()).hexdigest() if k > 4 else x for k, x in enumerate(r)) for r in rows), key=str)


@pytest.mark.parametrize("frame_bytes", [64 << 10, 7])
def test_outputs_equal_brute_force(spark, odd, odd_rows, frame_bytes):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in range(1, 60)] + ["<P", "<", "<S><", "a<M>b", "<<P>>", "<S", "P>", "a" * 300, "é" * 50, "<P<S<M", "漢字" * 20]
    made = rows_of(texts, ids=range(100, 100 + len(texts)))
    docs = odd.unionByName(spark.createDataFrame(made, SCHEMA))
    outputs = fill_in_middle(archive_texts(docs, frame_bytes=frame_bytes))
    rows = outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output_text(F.col("frames")).alias("out"), digests(F.col("frames"), F.col("form")).alias("d")).collect()
    want = [brute(r[0], r[1]) for r in odd_rows + made]
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted((w[:6] for w in want), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, *r.d) for r in rows), key=str) == hashed(want)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


ALPHABET = st.sampled_from(["a", "B", "z", " ", "<", ">", "P", "S", "M", "é", "漢", "🙂", "1", "\n", "\x00"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=40).map("".join), st.integers(1, 9), st.data())
def test_cut_and_restore(text, frame_bytes, data):
    raw = np.frombuffer(text.encode(), np.uint8)
    held, units, chars = make_frames(raw, frame_bytes, 3)
    want = UNIT.findall(text)
    assert (units, chars) == (len(want), len(text)) and b"".join(inflate(f["data"]) for f in held) == text.encode()
    a, b = sorted((data.draw(st.integers(0, units)), data.draw(st.integers(0, units))))
    sections, at = cut_frames(held, [a, b], units, chars, 3)
    parts = ["".join(want[:a]), "".join(want[a:b]), "".join(want[b:])]
    assert [b"".join(map(inflate, s)).decode() for s in sections] == parts
    assert at == [len(parts[0]), len(parts[0]) + len(parts[1])]
    if not any(m in text for m in frames.MARKS):
        import zstandard

        one = zstandard.ZstdCompressor()
        for form in ("psm", "spm"):
            p, m, s = parts
            whole = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
            body = whole.encode()  # frames of an output may end anywhere
            output = [one.compress(body[k : k + frame_bytes]) for k in range(0, len(body), frame_bytes)]
            assert b"".join(restore(output, form)).decode() == text


def test_only_cut_frames_are_decompressed(monkeypatch):
    text = "word and " * 5000
    held, units, chars = make_frames(np.frombuffer(text.encode(), np.uint8), 1000, 3)
    seen = []
    monkeypatch.setattr(frames, "inflate", lambda f: seen.append(f) or inflate(f))
    cut_frames(held, [units // 3, units // 2], units, chars, 3)
    assert len(held) > 40 and len(set(seen)) <= 2


def test_empty_table_and_names(spark, none, odd):
    assert fill_in_middle(archive_texts(none)).collect() == []
    other = odd.select(F.col("doc_id").alias("form"), F.col("text").alias("marked"), *[F.lit(1).alias(c) for c in ("frames", "units", "chars", "n")])
    got = fill_in_middle(archive_texts(other, key="form", text="marked").withColumnRenamed("form", "id"), key="id")
    assert got.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "frames"] and got.count() == odd.count()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert duckdb and compare(connect(sf), entry_module.queries()["op12_fill_in_middle"](spark, sf), entry_module.oracle_sql()["op12_fill_in_middle"]) is None
