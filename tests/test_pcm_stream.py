import os

import duckdb
import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from earshot.session import scratch
from earshot.sources.pcm_stream import PcmStreamReader, pcm_stream


def grow(folder, calls, upto, done=()):
    for name, data in calls.items():
        with open(f"{folder}/{name}@1700000000000000.pcm", "wb") as out:
            out.write(data[: upto(name, data)])
        if name in done:
            open(f"{folder}/{name}@1700000000000000.pcm.done", "wb").close()


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    rng = np.random.default_rng(3)
    calls = {name: rng.integers(-9000, 9000, n).astype("<i2").tobytes() for name, n in (("a", 1000), ("b@x", 333), ("c", 20), ("empty", 0))}
    folder, out, checkpoint = str(tmp_path / "in"), scratch(spark, "pcm-out"), scratch(spark, "pcm-checkpoint")
    os.makedirs(folder)
    open(f"{folder}/notes.txt", "wb").close()
    batches = []

    def step():
        query = pcm_stream(spark, folder, 100, 4).writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
        try:
            query.processAllAvailable()
            batches.extend(p["numInputRows"] for p in query.recentProgress if p["numInputRows"])
        finally:
            query.stop()
        return spark.read.schema("call_id string, seq long, event_ts timestamp, pcm binary").parquet(out)

    got = {}
    for share, done in ((0.3, ()), (0.3, ()), (0.71, ("c",)), (1.0, ("a", "b@x", "c", "empty"))):
        grow(folder, calls, lambda name, data, s=share: len(data) if name in done else int(len(data) * s), done)
        rows = step().orderBy("call_id", "seq").collect()
        keys = [(r.call_id, r.seq) for r in rows]
        assert len(set(keys)) == len(keys)  # nothing twice
        got = {name: b"".join(bytes(r.pcm) for r in rows if r.call_id == name) for name in calls}
        for name, data in calls.items():
            assert data.startswith(got[name]) and [r.seq for r in rows if r.call_id == name] == list(range(-(-len(got[name]) // 100)))
    assert got == calls  # nothing lost
    assert max(batches) <= 4 * 3 and len(batches) >= 5
    first = step().filter("call_id = 'a' AND seq = 3").select(F.unix_micros("event_ts")).first()[0]
    assert first == 1_700_000_000_000_000 + 3 * 50 * 1_000_000 // 16000


def test_limit_follows_the_offset_that_the_engine_knows(tmp_path):
    grow(tmp_path, {"a": bytes(1000)}, lambda n, d: len(d))
    reader = PcmStreamReader({"path": str(tmp_path), "chunk_bytes": "100", "per_trigger": "2"})
    name = "a@1700000000000000.pcm"
    assert reader.latestOffset() == {name: 200} and reader.latestOffset() == {name: 400}
    again = PcmStreamReader({"path": str(tmp_path), "chunk_bytes": "100", "per_trigger": "2"})
    assert again.partitions({name: 200}, {name: 400})[0].ranges == [(f"{tmp_path}/{name}", 200, 400)]
    assert again.latestOffset() == {name: 600}
    for bad in ({"chunk_bytes": "3"}, {"chunk_bytes": "0"}, {"per_trigger": "0"}):
        with pytest.raises(ValueError):
            PcmStreamReader({"path": "x", **bad})


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert duckdb and compare(connect(sf), entry_module.queries()["pcm_file_stream"](spark, sf), entry_module.oracle_sql()["pcm_file_stream"]) is None
