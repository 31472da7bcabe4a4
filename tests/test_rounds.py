"""Work done once: rows behind ordered operators, parts of a queue, and chunks of a call."""

import numpy as np
from pyspark.sql import functions as F

from earshot.catalog import models, streams
from earshot.operators import blocks as B
from earshot.operators import calls as C
from earshot.operators import features as X


def test_call_events_read_their_telemetry_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(c, i, f"0:{i}", True, "AB"[(i // 3) % 2], "father", 10.0, 80.0) for c in (1, 2) for i in range(40)]
    tel = spark.createDataFrame(rows, "call_id long, seq long, timestamp string, is_speech boolean, speaker string, role string, risk_a double, risk_b double")
    got = C.call_events(tel.mapInPandas(counted, tel.schema), B.int_block("seq", 4), most=5).collect()
    assert seen.value == len(rows)
    assert sorted((r.call_id, r.seq, r.type) for r in got) == [(c, i, "ALERT" if (i // 3) % 2 else "INFO") for c in (1, 2) for i in (27, 30, 33, 36, 39)]


def test_numbered_is_row_index_and_lagged(spark):
    rows = [(k, i, None if i % 7 == 3 else f"v{k}{i}") for k in (1, 2, None) for i in range(0, 60, 1 if k == 1 else 11)]
    df, block = spark.createDataFrame(rows, "k long, i long, v string").repartition(5), B.int_block("i", 8)
    once = B.numbered(df, ["k"], ["i"], block, "n", before="v")
    twice = B.lagged(B.row_index(df, ["k"], ["i"], block, "n"), ["k"], ["i"], block, before="v")
    assert sorted(map(str, once.select("k", "i", "v", "n", "before").collect())) == sorted(map(str, twice.select("k", "i", "v", "n", "before").collect()))


def test_parts_of_a_queue_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000)
    e = spark.range(90).select(F.col("id").alias("event_id"), ts.alias("ts"), F.pmod("id", F.lit(8)).alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    e.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    tasks, enqueue = [], streams.stores.enqueue
    monkeypatch.setattr(streams.stores, "enqueue", lambda df, path: (tasks.append(df.rdd.getNumPartitions()), enqueue(df, path)))
    got = {r.ledger_id: tuple(r)[1:] for r in streams.queue_drain_rejects(spark, str(tmp_path)).collect()}
    want = {}
    for i in range(90):
        bad, late = i % 10 < 2, i % 8 % 7 == 0 and i % 3 > 0
        blocks, invalid, refused, _ = want.get(f"s{i % 8}", (1, 0, 0, True))
        want[f"s{i % 8}"] = (blocks + (not bad and not late), invalid + bad, refused + (late and not bad), True)
    assert tasks == [3, 3, 3] and got == want


def test_chunks_are_spread_and_described_in_one_pass(spark, tmp_path):
    from earshot.plans import live

    class Plain:
        threshold = 0.5

        def score(self, df):
            return df.withColumn("model_prob", F.lit(0.5))

    rng = np.random.default_rng(4)
    rows = [(c, t, "user", "".join(map(chr, rng.integers(32, 1500, 40 * (t + 1))))) for c in range(3) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    audio = models._call_audio(spark, str(tmp_path))
    assert audio.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    for kind, voice in (("monitor", X.timbre_monitor()), ("session", X.timbre_session())):
        scored = live.score_chunks(audio, Plain(), kind)
        assert scored._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1 and "ArrowEvalPython" not in scored._jdf.queryExecution().executedPlan().toString()
        y = live.live_chunks(audio).select("call_id", "seq", X.pcm_to_samples("pcm").alias("pcm"))
        facts = X.describe_clips(y.withColumn("facts", X.sound_facts("pcm"))).select("call_id", "seq", "facts.*", voice.alias("emb"))
        want = {(r.call_id, r.seq): r for r in facts.collect()}
        got = {(r.call_id, r.seq): r for r in scored.collect()}
        assert got.keys() == want.keys() and len(got) == 12
        for key, r in got.items():
            np.testing.assert_allclose([r.dur * 16000, r.rms, r.peak, *r.emb], [want[key].n, want[key].rms, want[key].peak, *want[key].emb], atol=1e-12, rtol=1e-9)
