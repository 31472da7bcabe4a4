import datetime as dt
import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earshot.session import scratch
from earshot.streaming import jobs as J
from earshot.streaming import state as S

T0 = dt.datetime(2024, 1, 1)
# 60 degrees apart, so the vector between them is close to both
A, B = [1.0, 0.0, 0.0], [0.5, 0.8660254, 0.0]
MIX = [0.8660254, 0.5, 0.0]
SCHEMA = "call_id string, seq long, event_ts timestamp, dur double, rms double, peak double, clipped double, emb array<double>, prob double, risk double"


def chunk(call, seq, emb, risk, rms=0.02, dur=0.25):
    return (call, seq, T0 + dt.timedelta(seconds=0.25 * seq), dur, rms, rms * 3, 0.0, emb, risk / 100, float(risk))


def conversation(call):
    rows = [chunk(call, i, A, 5) for i in range(4)] + [chunk(call, 4 + i, B, 90) for i in range(8)]
    rows += [chunk(call, 12, None, 5, rms=0.0001), chunk(call, 13, MIX, 90)] + [chunk(call, 14 + i, B, 10) for i in range(6)]
    return rows


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([r for c in ("x", "y") for r in conversation(c)], SCHEMA)


def test_monitor_story(chunks):
    rows = J.monitor_telemetry(J.replay_calls(chunks, "monitor")).filter("call_id = 'x'").orderBy("seq").collect()
    assert [r.speaker for r in rows[:5]] == ["A"] * 4 + ["B"] and rows[12].speaker == "SILENCE"
    assert rows[3].seconds_a == 1.0 and rows[11].seconds_b == 2.0 and rows[4].turns_b == 1
    assert rows[3].risk_a == pytest.approx(5.0) and rows[11].risk_b == 90.0
    assert rows[11].alert and rows[11].peak_risk == 90.0 and rows[11].risk_level == "HIGH"
    assert rows[11].call_risk == pytest.approx(61.7)  # the stage publishes the mean of all evaluations
    peaks = [r.peak_risk for r in rows]
    assert peaks == sorted(peaks)
    assert rows[0].stage == "CALIBRATING" and rows[-1].stage in ("PRELIMINARY_AVERAGE", "CONSOLIDATED_FINAL")


def test_session_story(chunks):
    rows = J.session_telemetry(J.replay_calls(chunks, "session")).filter("call_id = 'x'").orderBy("seq").collect()
    assert rows[11].remote_prob > 0.7 and rows[11].warning_banner and rows[11].live_level == "CRITICAL"
    assert rows[12].audio_quality == "SILENT" and rows[12].remote_prob == rows[11].remote_prob
    assert rows[13].speaker == "OVERLAP" and rows[13].remote_prob == rows[11].remote_prob and rows[13].recommendation.startswith("OVERLAP")
    assert all(0.01 <= r.local_prob <= 0.35 for r in rows)


@pytest.mark.parametrize("kind", ["monitor", "session"])
def test_stream_equals_replay(spark, chunks, kind):
    streamed = J.run_once(J.track_calls(J.closed_stream(chunks, "chunks"), kind, idle_ms=3_600_000), kind)
    replayed = J.replay_calls(chunks, kind)
    assert streamed.count() == replayed.count() > 0
    assert streamed.exceptAll(replayed.select(streamed.columns)).count() == 0


def test_triggers_in_any_order_lose_nothing(spark):
    """Forty chunks within the delay, dealt over four files in shuffled order, one file per trigger."""
    rows = conversation("x") + [chunk("x", s, A if s % 2 else B, 50) for s in range(20, 40)]
    path = scratch(spark, "shuffled")
    for part in (2, 0, 3, 1):
        J._with_all_columns(spark.createDataFrame([r for k, r in enumerate(rows) if k % 4 == part], SCHEMA)).coalesce(1).write.mode("append").parquet(path)
    end = J._with_all_columns(spark.createDataFrame([("end", 0, T0 + dt.timedelta(hours=1), 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0)], SCHEMA)).withColumn("action", F.lit("configure"))
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(path)
    streamed = J.run_once(J.track_calls(stream, "monitor", idle_ms=3_600_000), "monitor")
    replayed = J.replay_calls(spark.createDataFrame(rows, SCHEMA), "monitor")
    assert streamed.count() == replayed.count() == 40
    assert streamed.exceptAll(replayed.select(streamed.columns)).count() == 0


def test_late_and_repeated_chunks_are_counted(spark):
    rows = [chunk("z", s, A, 5) for s in (1, 2, 2, 1, 3)]
    state = S.monitor_start()
    out = [S.monitor_step(state, dict(seq=r[1], us=r[1] * 250_000, dur=r[3], rms=r[4], peak=r[5], emb=r[7], risk=r[9])) for r in rows]
    assert [o["seq"] for o in out if o] == [1, 2, 3] and state["dropped"] == 2


def test_control_rows_change_settings():
    state = S.monitor_start()
    assert S.monitor_step(state, {"action": "configure", "role": "bank_agent", "financial": True, "language": None}) is None
    assert (state["role"], state["financial"], state["language"]) == ("bank_agent", True, None)


def test_state_stays_small_and_survives_json():
    state, rng = S.monitor_start(), np.random.default_rng(0)
    for i in range(3000):
        e = rng.standard_normal(40)
        S.monitor_step(state, dict(seq=i, us=i * 250_000, dur=0.25, rms=0.02, peak=0.1, emb=e / np.linalg.norm(e), risk=float(rng.uniform(0, 100))))
    text = S.dump(state)
    assert len(text) < 8000 and S.load(text) == json.loads(text)
    assert len(state["history"]) <= 60 and sum(p[0] for p in state["recent"]["A"]) <= 4.0 + 1e-9


def test_first_evaluation_when_a_stage_starts():
    state = S.monitor_start()
    quiet = dict(dur=0.5, rms=0.0001, peak=0.0, emb=None, risk=70.0)
    for i in range(11):
        out = S.monitor_step(state, dict(seq=i, us=i * 500_000, **quiet))
    assert state["history"] == [70.0] and out["risk_b"] == 70.0


def test_rounding_of_last_seconds():
    assert S._last_seconds([[3.0, 1.0], [2.0, 2.0], [1.0, 3.0]], 4.0) == [[1.0, 1.0], [2.0, 2.0], [1.0, 3.0]]


def test_rolling_windows(spark):
    rows = [chunk("w", i, A, 90) for i in range(40)]
    path = scratch(spark, "roll")
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(path)
    got = J.run_once(J.rolling_risk(spark.readStream.schema(df.schema).parquet(path), delay="0 seconds"), "roll").orderBy("start").collect()
    full = [r for r in got if r.chunks == 12]
    assert full and all(r.risk_score == pytest.approx(90.4) and r.alert for r in full)


def test_alert_filters(spark):
    df = spark.createDataFrame([(True, 70.0, 0.7), (True, 69.9, 0.69), (False, 90.0, 0.1)], "alert boolean, risk_b double, remote_prob double")
    assert J.stream_alerts(df).count() == 1 and J.session_alerts(df).count() == 1


def test_repeated_batch_leaves_the_same_ledger(spark):
    path, ticks = scratch(spark, "idem"), iter([50, 40, 30])
    write = J.ledger_writer(path, 10, ["ts_us"], lambda: next(ticks))
    batch = spark.createDataFrame([("a", 1_700_000_000_000_000 + i, "E", "{}") for i in range(5)], "ledger_id string, ts_us long, event_type string, payload string")
    write(batch, 0)
    write(batch, 0)
    write(batch.withColumn("ts_us", F.col("ts_us") - 1_000_000), 1)
    blocks = spark.read.parquet(path)
    assert blocks.count() == 11
    times = [r.ts_us for r in blocks.orderBy("pos").collect()]
    assert times == sorted(times) and times[-1] == 40  # the clock went back, the ledger did not
    from earshot.operators.ledger import verify
    assert verify(blocks).first().status == "CHAIN_INTEGRITY_OK"


def test_broken_ledgers_refuse_events(spark):
    path = scratch(spark, "broken")
    batch = spark.createDataFrame([(n, i, "E", "{}") for n in "ab" for i in range(3)], "ledger_id string, ts_us long, event_type string, payload string")
    J.ledger_writer(path, 10, ["ts_us"])(batch, 0)
    from earshot.session import materialise
    bad = F.when((F.col("ledger_id") == "a") & (F.col("pos") == 2), '{"x":1}').otherwise(F.col("payload"))
    materialise(spark.read.parquet(f"{path}/batch=0").withColumn("payload", bad), "bad").write.mode("overwrite").parquet(f"{path}/batch=0")
    J.ledger_writer(path, 10, ["ts_us"])(batch.withColumn("reason", F.when(F.col("ts_us") == 2, "INVALID_PAYLOAD")), 1)
    got = {r.ledger_id: r["count"] for r in spark.read.parquet(path).groupBy("ledger_id").count().collect()}
    assert got == {"a": 4, "b": 6}
    reasons = sorted((r.ledger_id, r.reason) for r in J.rejected_events(spark, path).collect())
    assert reasons == [("a", "INVALID_PAYLOAD"), ("a", "LEDGER_BROKEN"), ("a", "LEDGER_BROKEN"), ("b", "INVALID_PAYLOAD")]


def test_queued_payloads(spark):
    cases = ['{"k":1}', '{"edge_synced":false,"a":[1,{"b":null}]}', None, "", "[1]", "{cut", '{"k":1,"k":2}', '{"original_queued_at":5}']
    df = spark.createDataFrame([(c,) for c in cases], "payload string").withColumn("queued_at", F.lit(1.5))
    got = [r.p and json.loads(r.p) for r in df.select(J.synced_payload(F.col("payload"), F.col("queued_at")).alias("p")).collect()]
    new = {"edge_synced": True, "original_queued_at": 1.5}
    assert got == [{"k": 1, **new}, {"a": [1, {"b": None}], **new}, new, None, None, None, None, new]


def test_rolling_window_of_chunks_without_length(spark, tmp_path):
    """The mean over no seconds is NaN, as in the SQL, and does not end the stream."""
    from earshot import catalog

    catalog.load_all()
    rows = [(1, dt.datetime(2024, 1, 5, 1), 7, "x", 0.0, ""), (2, dt.datetime(2024, 1, 5, 1), 8, "x", 300.0, "")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in catalog.QUERIES["rolling_window_risk"](spark, f"{tmp_path}").collect()]
    with duckdb.connect() as db:
        db.sql("SET TimeZone = 'UTC'")
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = db.sql(catalog.SQL["rolling_window_risk"]).fetchall()
    plain = lambda rows: sorted([(*r[:3], *("none" if isinstance(v, float) and np.isnan(v) else v for v in r[3:])) for r in rows], key=lambda r: r[:2])
    assert plain(got) == plain(want) and len(got) == 6 and plain(got)[0][3] == "none"


class Handle:
    """State of one call in memory; ``requests`` counts writes, reads and removals of map entries."""

    def __init__(self):
        self.held, self.value, self.timers, self.requests = {}, None, [], 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        handle = self

        class Value:
            exists = lambda _: handle.value is not None
            get = lambda _: handle.value

            def update(self, value):
                handle.value = value

        return Value()

    def keys(self):
        return list(self.held)

    def _count(self, key):
        self.requests += 1
        return key

    def updateValue(self, key, value):
        self.held[self._count(key)] = value

    def getValue(self, key):
        return self.held[self._count(key)]

    def removeKey(self, key):
        del self.held[self._count(key)]

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, at):
        self.timers.append(at)


def test_waiting_chunks_take_few_requests():
    handle, rng = Handle(), np.random.default_rng(1)
    waiting = J.Waiting(handle, ["seq", "emb", "role"])
    order = rng.permutation(3000)
    for part in np.array_split(order, 3):
        waiting.add(iter([pd.DataFrame({"event_ts": [T0 + dt.timedelta(seconds=int(s)) for s in part], "seq": part, "emb": [np.array([s, 1.0]) for s in part], "role": None})]))
    start = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert handle.timers == [start]
    first, later = waiting.take(start + 999_999)
    assert [r["seq"] for r in first] == list(range(1000)) and later == (start + 1_000_000) * 1000 and first[5]["emb"].tolist() == [5.0, 1.0] and first[5]["role"] is None
    rest, later = waiting.take(start + 10_000_000)
    assert [r["seq"] for r in rest] == list(range(1000, 3000)) and later is None and not handle.held
    assert handle.requests < 100  # one entry per chunk took 9 000
