"""Live evaluation of joined audio (STM-02 .. STM-05, STM-08, STM-09, STM-12 .. STM-14).

Three stages, the same for a stream and for a table. A collector follows each call chunk by chunk: it keeps the newest
audio of the call and of each speaker, names the speaker, and cuts the audio that is to be judged as one signal. A
stateless stage scores these cuts; they are dropped right after, so audio never goes through an exchange twice. A
follower turns the scores of a call into smoothed risks and events.

Rings are kept chunk by chunk: a chunk is written to state once, at the end of its trigger, read only when a cut needs it, and
removed when newer audio has pushed it out. What waits for the watermark is kept in blocks of chunks, so the work of a
trigger follows its new rows and not the length of the call.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import kernels as K
from ..session import scratch
from . import jobs as J
from . import state as S

CHUNK_TYPES = {"seq": "bigint", "event_ts": "timestamp", "pcm": "binary", "speaker": "string", "action": "string", "role": "string", "financial": "boolean", "language": "string"}
CUT = "seq bigint, dur double, elapsed double, rms double, peak double, clipped double, is_speech boolean, speaker string, confidence double, seconds_a double, seconds_b double, overlap_sec double, " \
    "turns_a bigint, turns_b bigint, turned boolean, dropped bigint, role string, financial boolean, language string, cut_for string, cut_from bigint, cut_to bigint, cut binary, closing boolean"
EVENT = "struct<type:string,speaker:string,cause:string,risk:double>"
FOLLOWED = {
    "monitor": f"risk_a double, risk_b double, history_mean double, history_max double, peak_a double, peak_b double, events array<{EVENT}>",
    "session": "audio_quality string, remote_prob double, local_prob double",
}


@dataclass(frozen=True)
class JoinRules:
    """Lengths in samples; the defaults are those of 16 kHz audio.

    ``least``: shortest audio that is judged or recognised; ``every``: new voiced audio between judgements of a speaker;
    ``recent``: voiced audio that a judgement takes; ``kept``: what is kept of a speaker; ``heard``: call audio in which a voice
    is recognised; ``mixed``: call audio that a session judges; ``mixed_first``: call audio for a first judgement, if
    ``mixed_least`` has come; ``first_after`` and ``first_speech``: seconds of call and of speech after which there must be one.
    """

    rate: int = 16000
    least: int = 4000
    every: int = 8000
    recent: int = 64000
    kept: int = 192000
    heard: int = 24000
    mixed: int = 32000
    mixed_first: int = 48000
    mixed_least: int = 8000
    first_after: float = 5.0
    first_speech: float = 1.5
    shortest_voice: int = 1024


# ---- rings -------------------------------------------------------------------------------------------------------------


class Ring:
    """STM-12: the newest audio of one signal, at least ``most`` samples of it, and at most one chunk more.

    ``facts`` (in the call's state) holds the number of the first kept chunk, the samples of each, and all samples so far;
    ``store`` holds the chunks themselves under (name, number).
    """

    def __init__(self, name: str, facts: dict, store, most: int):
        self.name, self.store, self.most = name, store, most
        self.facts = facts.setdefault(name, {"first": 0, "sizes": [], "total": 0})

    @property
    def total(self) -> int:
        return self.facts["total"]

    def add(self, pcm: bytes) -> None:
        f, n = self.facts, len(pcm) // 2
        self.store.put(self.name, f["first"] + len(f["sizes"]), pcm[-2 * self.most :])
        f["sizes"].append(min(n, self.most))
        f["total"] += n
        while sum(f["sizes"]) - f["sizes"][0] >= self.most:
            self.store.remove(self.name, f["first"])
            f["sizes"].pop(0)
            f["first"] += 1

    def last(self, samples: int) -> tuple[bytes, int, int]:
        """The newest ``samples`` (fewer if there are not as many), and their places in the whole signal."""
        f, want, parts = self.facts, min(samples, self.most, self.facts["total"]), []
        held, k = 0, len(f["sizes"])
        while held < want:
            k -= 1
            parts.append(self.store.get(self.name, f["first"] + k))
            held += f["sizes"][k]
        joined = b"".join(reversed(parts))
        return joined[2 * (held - want) :], f["total"] - want, f["total"]


class DictStore:
    """Chunks of one call in memory."""

    def __init__(self):
        self.held: dict = {}

    def put(self, name, number, pcm):
        self.held[name, number] = pcm

    def get(self, name, number):
        return self.held[name, number]

    def remove(self, name, number):
        del self.held[name, number]


class MapStore:
    """Chunks of one call in Spark's state. New ones are held until ``flush``, as most are pushed out in the same trigger."""

    def __init__(self, state):
        self.state, self.new = state, {}

    def put(self, name, number, pcm):
        self.new[name, number] = pcm

    def get(self, name, number):
        return self.new[name, number] if (name, number) in self.new else bytes(self.state.getValue((name, number))[0])

    def remove(self, name, number):
        if self.new.pop((name, number), None) is None:
            self.state.removeKey((name, number))

    def flush(self):
        for key, pcm in self.new.items():
            self.state.updateValue(key, (pcm,))
        self.new = {}


# ---- the collector -----------------------------------------------------------------------------------------------------


def collector_start() -> dict:
    return {
        "last_seq": None, "first_us": None, "last_us": None, "heard_sec": 0.0, "dropped": 0, "now": "SILENCE", "last": "SILENCE", "sec": {"A": 0.0, "B": 0.0, "OVERLAP": 0.0}, "turns": {"A": 0, "B": 0, "OVERLAP": 0},
        "judged": {"A": 0, "B": 0}, "any": False, "rings": {}, "voices": {}, "role": None, "financial": None, "language": None,
    }


def _voice(pcm: bytes, kind: str) -> list[float] | None:
    """SIG-17 of joined audio."""
    y = K.decode_pcm(pcm)
    if len(y) < 512:
        return None
    frames = K.spectral_frames(y, 1024, 512)
    m = frames["mfcc"][1:]
    mean, std = m.mean(axis=1), m.std(axis=1)
    v = np.concatenate([mean, std, [frames["centroid"].mean() / 4000.0, frames["rolloff"].mean() / 8000.0]]) if kind == "monitor" else mean / (std + 1e-6)
    return (v / (np.linalg.norm(v) + 1e-7)).tolist()


def collect(state: dict, store, row: dict, kind: str, rules: JoinRules) -> dict | None:
    """One chunk: who speaks, and the audio to judge (``cut_for``: A, B, FIRST or MIXED). None for settings and old chunks."""
    if row.get("action") == "configure":
        for key in ("role", "financial", "language"):
            if row.get(key) is not None:
                state[key] = row[key]
        return None
    pcm = row["pcm"] or b""
    pcm = pcm[: len(pcm) - len(pcm) % 2]
    if not pcm:
        return None
    if state["last_seq"] is not None and row["seq"] <= state["last_seq"]:
        state["dropped"] += 1
        return None
    state["last_seq"] = row["seq"]
    state["first_us"] = row["us"] if state["first_us"] is None else state["first_us"]
    state["last_us"] = max(row["us"], state["last_us"] or row["us"])
    y = K.decode_pcm(pcm).astype(np.float64)
    dur, rms, peak = len(y) / rules.rate, float(np.sqrt((y * y).mean())), float(np.abs(y).max())
    state["heard_sec"] += dur
    ring = lambda name, most: Ring(name, state["rings"], store, most)
    mixed = ring("call", max(rules.heard, rules.mixed, rules.mixed_first))
    mixed.add(pcm)
    step = _monitor_cut if kind == "monitor" else _session_cut
    clipped = float((np.abs(y) > 0.98).mean())
    out = step(state, row, pcm, {"dur": dur, "rms": rms, "peak": peak, "clipped": clipped}, mixed, ring, rules)
    cut, first, last = out.pop("cut") or (None, None, None)
    return {
        "seq": row["seq"], "dur": dur, "rms": rms, "peak": peak, "clipped": clipped, "elapsed": (state["last_us"] - state["first_us"]) / 1e6 if kind == "monitor" else state["heard_sec"],
        "seconds_a": state["sec"]["A"], "seconds_b": state["sec"]["B"], "overlap_sec": state["sec"]["OVERLAP"], "turns_a": state["turns"]["A"], "turns_b": state["turns"]["B"],
        "dropped": state["dropped"], "role": state["role"], "financial": state["financial"], "language": state["language"], "cut": cut, "cut_from": first, "cut_to": last, "closing": False, **out,
    }


def _named(state: dict, row: dict, emb, rules: S.SpeakerRules, alone: tuple[str, float]) -> tuple[str, float]:
    """The speaker that the row names (two-channel recordings), or that the voice is nearest to."""
    if row.get("speaker") is not None:
        return row["speaker"], 0.98
    return alone if emb is None else S.assign_speaker(state["voices"], emb, rules)


def _monitor_cut(state, row, pcm, facts, mixed, ring, rules) -> dict:
    """STM-13: the last voiced audio of a speaker after each ``every``; STM-08: a first judgement where there is none in time."""
    speech, turned, cut_for, cut = facts["rms"] > 0.0035 or facts["peak"] > 0.018, False, None, None
    rings = {s: (ring(f"voiced {s}", rules.kept), ring(f"all {s}", rules.kept)) for s in "AB"}
    confidence = None
    if not speech:
        state["now"] = "SILENCE"
    elif row.get("speaker") is not None or min(mixed.total, rules.heard) >= rules.least:
        emb = None if row.get("speaker") is not None else _voice(mixed.last(rules.heard)[0], "monitor")
        who, confidence = _named(state, row, emb, S.MONITOR_RULES, ("A", 0.70))
        state["now"] = who
        if who != state["last"]:
            state["last"], turned = who, True
            state["turns"][who] += 1
        state["sec"][who] += facts["dur"]
        if who != "OVERLAP":
            voiced, all_ = rings[who]
            if facts["rms"] > S.VOICED_LIMIT:
                voiced.add(pcm)
            all_.add(pcm)
            if voiced.total - state["judged"][who] >= rules.every:
                state["judged"][who] = voiced.total
                cut_for, cut = who, voiced.last(rules.recent)
    elapsed, spoken = (state["last_us"] - state["first_us"]) / 1e6, state["sec"]["A"] + state["sec"]["B"]
    if cut is None and not state["any"] and (elapsed >= rules.first_after or spoken >= rules.first_speech):
        found = next((r for s in "BA" for r in rings[s] if r.total >= rules.least), None)
        if found is not None:
            cut_for, cut = "FIRST", found.last(rules.kept)
        elif mixed.total >= rules.mixed_least:
            cut_for, cut = "FIRST", mixed.last(rules.mixed_first)
    state["any"] = state["any"] or cut is not None
    return {"is_speech": bool(speech), "speaker": state["now"], "confidence": confidence, "turned": turned, "cut_for": cut_for, "cut": cut}


def _session_cut(state, row, pcm, facts, mixed, ring, rules) -> dict:
    """STM-14: the last mixed audio, silence included, with silence before the start of the call."""
    silent = facts["rms"] < 0.003
    speech = (facts["rms"] > 0.015 or facts["peak"] > 0.06) and not silent
    who, confidence, cut_for, cut = "SILENCE", 0.88, None, None
    if speech:
        sound, first, last = mixed.last(rules.mixed)
        cut = (bytes(2 * rules.mixed - len(sound)) + sound, first, last)
        emb = None
        if row.get("speaker") is None:
            emb = _voice(pcm, "session") if len(pcm) // 2 >= rules.shortest_voice else _voice(cut[0], "session")
        who, confidence = _named(state, row, emb, S.SESSION_RULES, ("A", 0.70))
        state["sec"][who] += facts["dur"]
        cut_for, cut = ("MIXED", cut) if who != "OVERLAP" else (None, None)
    return {"is_speech": bool(speech), "speaker": who, "confidence": confidence, "turned": False, "cut_for": cut_for, "cut": cut}


# ---- the follower ------------------------------------------------------------------------------------------------------


def follower_start(kind: str) -> dict:
    if kind == "session":
        return {"ema_remote": 0.08, "ema_local": 0.05, "remote": 0.08, "local": 0.05}
    five = lambda: {s: 5.0 for s in "AB"}
    return {"deep": five(), "ema": five(), "risk": five(), "peak": five(), "history": [], "event": None}


def follow(state: dict, row: dict, kind: str) -> dict:
    """One collected row with the score of its cut (``prob``, ``risk``)."""
    return _follow_monitor(state, row) if kind == "monitor" else _follow_session(state, row)


def _follow_monitor(state: dict, row: dict) -> dict:
    """WIN-18 and STM-08 on scores of joined audio, and the events of STM-10."""
    events, who = [], row["speaker"]

    def event(type_, speaker, cause, risk):
        same = [type_, speaker, cause, row["role"], risk if cause == "evaluation" else None]
        if state["event"] != same:
            state["event"] = same
            events.append({"type": type_, "speaker": speaker, "cause": cause, "risk": risk})

    if row["turned"]:
        risk = 25.0 if who == "OVERLAP" else state["risk"][who]
        event("OVERLAP" if who == "OVERLAP" else "ALERT" if who == "B" and risk >= 70.0 else "INFO", who, "turn", risk)
    if row["cut_for"] in ("A", "B"):
        state["deep"][who] = row["risk"]
        state["history"] = [*state["history"], row["risk"]][-S.HISTORY :]
    if row["is_speech"] and who in ("A", "B") and row["confidence"] is not None:
        deep = state["deep"][who]
        state["ema"][who] = S._risk_average(state["ema"][who], deep)
        state["risk"][who] = S._half_up(state["ema"][who])
        state["peak"][who] = max(state["peak"][who], deep, state["risk"][who])
        if state["risk"][who] >= 50.0 and (state["event"] is None or state["event"][0] != "ALERT"):
            event("ALERT", who, "evaluation", state["risk"][who])
    if row["cut_for"] == "FIRST":
        state["deep"]["B"], state["risk"]["B"] = row["risk"], S._half_up(row["risk"])
        state["history"] = [*state["history"], row["risk"]]
    history = state["history"]
    return {
        "risk_a": state["risk"]["A"], "risk_b": state["risk"]["B"], "history_mean": float(np.mean(history)) if history else None, "history_max": float(max(history)) if history else None,
        "peak_a": state["peak"]["A"], "peak_b": state["peak"]["B"], "events": events,
    }


def _follow_session(state: dict, row: dict) -> dict:
    """WIN-19 on the score of the last mixed seconds; silence and overlap change nothing."""
    quality = "SILENT" if row["rms"] < 0.003 else "CLIPPED" if row["clipped"] > 0.05 else "FAIR" if row["rms"] < 0.012 else "GOOD"
    if row["cut_for"] == "MIXED":
        prob = row["prob"]
        if row["speaker"] == "B":
            rate = 0.70 if prob > state["ema_remote"] else 0.35
            state["ema_remote"] = rate * prob + (1.0 - rate) * state["ema_remote"]
            state["remote"] = float(np.clip(state["ema_remote"], 0.01, 0.99))
        else:
            state["ema_local"] = 0.30 * prob + 0.70 * state["ema_local"]
            state["local"] = float(np.clip(state["ema_local"], 0.01, 0.35))
    return {"audio_quality": quality, "remote_prob": state["remote"], "local_prob": state["local"]}


# ---- streams -----------------------------------------------------------------------------------------------------------


WAITING = ["seq", "pcm", "speaker", "action", "role", "financial", "language"]


class Collector(StatefulProcessor):
    """``collect`` per call. A call that is idle for ``idle_ms`` of event time is closed with a row that says so."""

    def __init__(self, kind: str, rules: JoinRules, idle_ms: int):
        self.kind, self.rules, self.idle_ms = kind, rules, idle_ms

    def init(self, handle) -> None:
        self.waiting = J.Waiting(handle, WAITING)
        self.value = handle.getValueState("call", StructType([StructField("json", StringType())]))
        self.chunks = handle.getMapState("chunks", "name string, number bigint", "pcm binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.add(rows)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due, later = self.waiting.take(watermark)
        if not due and later is None:
            self.value.clear()
            self.chunks.clear()
            yield _frame([{"seq": None, "closing": True}], key[0])
            return
        state, store = json.loads(self.value.get()[0]) if self.value.exists() else collector_start(), MapStore(self.chunks)
        out = [o for o in (collect(state, store, r, self.kind, self.rules) for r in due) if o is not None]
        store.flush()
        self.value.update((json.dumps(state),))
        if later is not None:
            self.waiting.wake(later // 1000)
        else:
            idle_from = max([state["last_us"] or 0, *(r["us"] for r in due)])
            self.waiting.wake(max(idle_from // 1000 + self.idle_ms, watermark + 1))
        for low in range(0, len(out), 64):  # cuts are long
            yield _frame(out[low : low + 64], key[0])

    def close(self) -> None:
        pass


class Follower(StatefulProcessor):
    """``follow`` per call. The collector sends a call's rows trigger by trigger in order, so none has to wait here."""

    def __init__(self, kind: str, columns: list[str]):
        self.kind, self.columns = kind, columns

    def init(self, handle) -> None:
        self.value = handle.getValueState("call", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        records = [r for pdf in rows for r in _plain(pdf)]
        state, out = json.loads(self.value.get()[0]) if self.value.exists() else follower_start(self.kind), []
        # the row that closes a call has no number: it comes alone or before the first rows of a new call
        for row in sorted(records, key=lambda r: (not r["closing"], r["seq"] or 0)):
            if row["closing"]:
                state = follower_start(self.kind)
            else:
                out.append({**row, **follow(state, row, self.kind)})
        self.value.clear() if all(r["closing"] for r in records) else self.value.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out)[self.columns]

    def close(self) -> None:
        pass


_CUT_NAMES = [c.strip().split(" ")[0] for c in CUT.split(",")]


def _frame(rows: list[dict], call) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_CUT_NAMES).astype(object).assign(call_id=call)


def _plain(pdf: pd.DataFrame) -> list[dict]:
    return pdf.astype(object).where(pdf.notna(), None).to_dict("records")


def _chunks(chunks: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in CHUNK_TYPES.items() if c not in chunks.columns}
    return chunks.withColumns(missing).select("call_id", *CHUNK_TYPES).filter(F.col("call_id").isNotNull())


def _cut_schema(chunks: DataFrame) -> StructType:
    return StructType([*chunks.sparkSession.createDataFrame([], CUT).schema.fields, StructField("call_id", chunks.schema["call_id"].dataType)])


def _followed_schema(cuts: DataFrame, kind: str) -> tuple[StructType, list[str]]:
    kept = [f for f in cuts.schema.fields if f.name not in ("cut", "closing", "prob", "risk")]
    more = cuts.sparkSession.createDataFrame([], FOLLOWED[kind]).schema.fields
    schema = StructType([*kept, StructField("prob", cuts.schema["prob"].dataType), StructField("risk", cuts.schema["risk"].dataType), *more])
    return schema, schema.names


def _for_follower(scored: DataFrame) -> DataFrame:
    return scored.drop("cut")


def stream_calls(chunks: DataFrame, score: Callable[[DataFrame], DataFrame], kind: str = "monitor", rules: JoinRules = JoinRules(), delay: str = "10 seconds", idle_ms: int = J.IDLE_MS) -> DataFrame:
    """Stream of PCM chunks (call_id, seq, event_ts, pcm, and where known speaker and settings) to a row per chunk.

    ``score`` adds ``prob`` and ``risk`` to rows with a ``cut``, without moving rows. Chunks are answered once the
    watermark has passed them; empty ones, and rows without a call id, give nothing.
    """
    J.use_rocksdb(chunks.sparkSession)
    rows = _chunks(chunks).withWatermark("event_ts", delay)
    cuts = rows.groupBy("call_id").transformWithStateInPandas(
        statefulProcessor=Collector(kind, rules, idle_ms), outputStructType=_cut_schema(chunks), outputMode="Append", timeMode="EventTime")
    scored = _for_follower(score(cuts))
    schema, columns = _followed_schema(scored, kind)
    return scored.groupBy("call_id").transformWithStateInPandas(statefulProcessor=Follower(kind, columns), outputStructType=schema, outputMode="Append", timeMode="None")


def replay_calls(chunks: DataFrame, score: Callable[[DataFrame], DataFrame], kind: str = "monitor", rules: JoinRules = JoinRules()) -> DataFrame:
    """The same rows from a table: calls stream through sorted partitions, one call's rings in memory at a time."""
    schema = _cut_schema(chunks)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, state, store, first = None, None, None, True
        for pdf in batches:
            out = []
            for cid, row in zip(pdf["call_id"].tolist(), J._records(pdf)):
                if first or cid != call:
                    call, state, store, first = cid, collector_start(), DictStore(), False
                result = collect(state, store, row, kind, rules)
                if result is not None:
                    out.append({**result, "call_id": cid})
                if len(out) >= 64:
                    yield pd.DataFrame(out, columns=schema.names).astype(object)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=schema.names).astype(object)

    cuts = _chunks(chunks).repartition("call_id").sortWithinPartitions("call_id", "seq").mapInPandas(gather, schema)
    scored = _for_follower(score(cuts))
    followed, columns = _followed_schema(scored, kind)

    def trail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, state, first = None, None, True
        for pdf in batches:
            out = []
            for row in _plain(pdf):
                if first or row["call_id"] != call:
                    call, state, first = row["call_id"], follower_start(kind), False
                out.append({**row, **follow(state, row, kind)})
            if out:
                yield pd.DataFrame(out)[columns]

    return scored.repartition("call_id").sortWithinPartitions("call_id", "seq").mapInPandas(trail, followed)


def table_as_stream(chunks: DataFrame, label: str, triggers: int = 3, delay: str = "10 seconds") -> DataFrame:
    """A bounded table of chunks as a stream of ``triggers`` triggers in order of time, and a last row in the future that
    lets the watermark pass them all. That row is a setting of a call of its own, so it gives no output.

    Chunks are dealt over triggers by their place in time, which no call's length limits.
    """
    spark, path = chunks.sparkSession, scratch(chunks.sparkSession, label)
    chunks = _chunks(chunks)
    span = chunks.agg(F.min(F.unix_micros("event_ts")).alias("a"), F.max(F.unix_micros("event_ts")).alias("b"), F.max("call_id").alias("c")).first()
    if span["a"] is None:
        chunks.limit(0).write.parquet(path)
        return spark.readStream.schema(chunks.schema).parquet(path)
    width = (span["b"] - span["a"]) // triggers + 1
    for k in range(triggers):
        low = span["a"] + k * width
        chunks.filter(F.unix_micros("event_ts").between(low, low + width - 1)).write.mode("append").parquet(f"{path}/trigger={k}")
    end = F.timestamp_micros(F.lit(span["b"])) + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")
    other = F.concat(F.lit(span["c"]), F.lit("~")) if chunks.schema["call_id"].dataType == StringType() else F.lit(span["c"]) + 1
    known = {"event_ts": end, "call_id": other, "action": F.lit("configure"), "seq": F.lit(-1)}
    spark.range(1).select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in chunks.schema.fields]).write.parquet(f"{path}/trigger={triggers}")
    return spark.readStream.schema(chunks.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(path)
