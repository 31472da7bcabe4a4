import datetime as dt

import duckdb
import numpy as np
import pytest
from check import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from earshot.functions import kernels as K
from earshot.operators import features as X
from earshot.plans import live
from earshot.streaming import joined as J
from earshot.streaming import state as S

T0 = dt.datetime(2024, 1, 1)
RULES = J.JoinRules(least=400, every=800, recent=3000, kept=7000, heard=1500, mixed=2000, mixed_first=2600, mixed_least=500, first_after=1.5, first_speech=0.1)
SCHEMA = "call_id string, seq long, event_ts timestamp, pcm binary, speaker string"


def pcm(rng, n, level):
    return np.clip(rng.normal(0, level * 32768, n), -32768, 32767).astype("<i2").tobytes()


@pytest.mark.parametrize("most", [1, 7, 100])
def test_ring_holds_the_newest_samples(most):
    rng = np.random.default_rng(most)
    store, facts, whole = J.DictStore(), {}, b""
    for _ in range(200):
        part = rng.integers(-9, 9, rng.integers(1, 40)).astype("<i2").tobytes()
        ring = J.Ring("x", facts, store, most)  # facts travel, the ring itself does not
        ring.add(part)
        whole += part
        n = len(whole) // 2
        for want in (1, most // 2, most, 10 * most):
            got, first, last = ring.last(want)
            held = min(want, most, n)
            assert (first, last) == (n - held, n) and got == (whole[-2 * held :] if held else b"")
        assert sum(facts["x"]["sizes"]) < most + 40 and len(store.held) == len(facts["x"]["sizes"])


def call_rows(rng, call="x", chunks=120, speakers="AB"):
    """Loud, quiet and silent chunks, and clicks: speech by their peak, but not voiced."""
    rows = []
    for seq in range(chunks):
        kind = rng.choice(["loud", "loud", "click", "silent"])
        n = int(rng.integers(50, 700))
        sound = pcm(rng, n, 0.05 if kind == "loud" else 0.00001)
        if kind == "click":
            sound = np.where(np.arange(n) == n // 2, 900, 0).astype("<i2").tobytes()
        rows.append((call, seq, T0 + dt.timedelta(seconds=0.25 * seq), sound, str(rng.choice(list(speakers)))))
    return rows


def brute_cuts(rows, rules):
    """Every cut from the whole signals."""
    voiced, heard, mixed, judged, any_cut, spoken, out = {"A": b"", "B": b""}, {"A": b"", "B": b""}, b"", {"A": 0, "B": 0}, False, 0.0, []
    size = lambda s: len(s) // 2
    for _, seq, at, sound, who in rows:
        y = np.frombuffer(sound, "<i2") / 32768
        rms, peak = np.sqrt((y * y).mean()), np.abs(y).max()
        mixed += sound
        cut = None
        if rms > 0.0035 or peak > 0.018:
            spoken += len(y) / rules.rate
            if rms > 0.003:
                voiced[who] += sound
            heard[who] += sound
            if size(voiced[who][-10**9:]) - judged[who] >= rules.every:
                judged[who] = size(voiced[who])
                cut = (who, voiced[who][-2 * rules.recent :])
        if cut is None and not any_cut and ((at - T0).total_seconds() >= rules.first_after or spoken >= rules.first_speech):
            for s in (voiced["B"], heard["B"], voiced["A"], heard["A"]):
                if size(s) >= rules.least:
                    cut = ("FIRST", s[-2 * rules.kept :])
                    break
            else:
                if size(mixed) >= rules.mixed_least:
                    cut = ("FIRST", mixed[-2 * rules.mixed_first :])
        any_cut = any_cut or cut is not None
        out.append((seq, *(cut or (None, None))))
    return out


@pytest.mark.parametrize("speakers", ["AB", "A", "B"])
def test_cuts_are_those_of_the_whole_signals(speakers):
    firsts = set()
    for seed in range(12):
        rows = call_rows(np.random.default_rng(seed), speakers=speakers)
        state, store, got = J.collector_start(), J.DictStore(), []
        for _, seq, at, sound, who in rows:
            row = {"seq": seq, "us": int(at.timestamp() * 1e6), "pcm": sound, "speaker": who, "action": None}
            out = J.collect(state, store, row, "monitor", RULES)
            got.append((seq, out["cut_for"], out["cut"]))
            assert J.collect(state, store, row, "monitor", RULES) is None  # a repeated chunk
        want = brute_cuts(rows, RULES)
        assert got == want
        assert state["dropped"] == len(rows)
        firsts.update(len(c) for _, f, c in want if f == "FIRST")
    assert firsts


def test_session_cut_begins_with_silence():
    state, store = J.collector_start(), J.DictStore()
    rng = np.random.default_rng(1)
    whole = b""
    for seq in range(20):
        sound = pcm(rng, 300, 0.05 if seq % 3 else 0.00001)
        whole += sound
        out = J.collect(state, store, {"seq": seq, "us": seq, "pcm": sound + b"x", "speaker": "B", "action": None}, "session", RULES)
        assert out["cut_for"] == ("MIXED" if seq % 3 else None)
        if seq % 3:
            assert out["cut"] == (bytes(2 * RULES.mixed) + whole)[-2 * RULES.mixed :]


def test_joined_scores(spark):
    """Quiet and short cuts have fixed scores; others are scored like a clip of the same samples."""
    rng = np.random.default_rng(4)
    loud, quiet = pcm(rng, 3000, 0.1), pcm(rng, 3000, 0.0001)
    rows = [(0, "A", loud), (1, "A", quiet), (2, "B", loud[:600]), (3, None, None)]
    cuts = spark.createDataFrame([(s, f, None, None, c) for s, f, c in rows], "seq long, cut_for string, language string, financial boolean, cut binary")

    class Model:
        threshold = 0.5

        def score(self, df):
            return df.withColumn("model_prob", F.col("f")["acoustic_zcr_mean"])

    got = {r.seq: r for r in live.score_cuts(Model(), "monitor", RULES)(cuts).collect()}
    y = K.normalise_peak(K.voiced_or_whole(K.decode_pcm(loud).astype(float), 26.0, RULES.least))
    want = X._summarise(X._describe(y, 1024, 512, 500.0))["mu"][0]
    assert got[0].prob == pytest.approx(want) and got[0].risk > 0
    assert [(got[k].prob, got[k].risk) for k in (1, 3)] == [(0.05, 5.0), (None, None)]
    assert got[2].risk is not None


def test_stream_of_several_triggers_equals_replay(spark):
    rng = np.random.default_rng(9)
    rows = [r for c in ("x", "y", "z") for r in call_rows(rng, c, 60)]
    rows += [("x", 7, rows[7][2], rows[7][3], "A"), ("w", 0, T0, b"", "A"), (None, 1, T0, rows[0][3], "A")]  # again, empty, no call
    order = rng.permutation(len(rows))
    chunks = spark.createDataFrame([rows[k] for k in order], SCHEMA)
    score = lambda cuts: cuts.withColumns({"prob": F.crc32("cut") % 1000 / 1000.0, "risk": F.crc32("cut") % 1000 / 10.0})
    for kind in ("monitor", "session"):
        replayed = J.replay_calls(chunks, score, kind, RULES)
        columns = [c for c in replayed.columns if c != "dropped"]
        want = sorted(map(str, replayed.select(columns).collect()))
        for triggers in (1, 5):
            stream = J.stream_calls(J.table_as_stream(chunks, "joined-test", triggers, "2 seconds"), score, kind, RULES, "2 seconds")
            got = live.J.run_once(stream, f"joined-{kind}").select(columns)
            assert sorted(map(str, got.collect())) == want
    assert len(want) == 180


def test_alert_events():
    state = J.follower_start("monitor")
    base = {"turned": False, "is_speech": True, "confidence": 0.9, "role": None, "cut_for": None, "risk": None}
    seen = []
    for row in ({"speaker": "B", "turned": True}, {"speaker": "B", "cut_for": "B", "risk": 90.0}, {"speaker": "B"}, {"speaker": "A", "turned": True}, {"speaker": "B", "turned": True}, {"speaker": "A", "turned": True, "cut_for": "A", "risk": 55.0}):
        seen.append([(e["type"], e["speaker"], e["cause"]) for e in J.follow(state, {**base, **row}, "monitor")["events"]])
    assert seen == [[("INFO", "B", "turn")], [("ALERT", "B", "evaluation")], [], [("INFO", "A", "turn")], [("ALERT", "B", "turn")], [("INFO", "A", "turn")]]
    assert S.VOICED_LIMIT == 0.003


@pytest.mark.parametrize("name", ["joined_audio_state", "joined_session_state"])
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert duckdb and compare(connect(sf), entry_module.queries()[name](spark, sf), entry_module.oracle_sql()[name]) is None
