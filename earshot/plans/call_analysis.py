"""Call analysis (ML-12): gate, diarise, exclude overlap, score turns, policy, report."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import signal as S
from ..functions.kernels import energy_share, frame_levels, gate_measures
from ..functions.numeric import let, rnd
from ..operators import calls as C
from ..operators import clustering as L
from ..operators.features import feature_map, summarise_clips, timbre_segment
from ..operators.models import SpoofModel
from ..session import materialise

RATE = 16000


@dataclass(frozen=True)
class SegmentRules:
    """Lengths in samples; the defaults are 0.5 s, 2.5 s, 0.25 s and 0.12 s."""

    shortest: int = 8000
    longest: int = 40000
    silence: int = 4000
    margin: int = 1920
    frame: int = 1024
    hop: int = 256
    top_db: float = 36.0


def speech_spans(pcm, rules: SegmentRules, levels=None) -> Column:
    """WIN-03 and WIN-04 inside one row: padded, merged and cut speech intervals as (s, e) pairs.

    ``levels`` takes frame levels measured elsewhere.
    """
    c = F.col(pcm) if isinstance(pcm, str) else pcm
    total = F.size(c)
    measured = S.frame_rms(c, rules.frame, rules.hop) if levels is None else F.col(levels)
    pair = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    pairs = "array<struct<s:int,e:int>>"

    hops = F.array_compact(F.transform(S.loud_frames(measured, rules.top_db), lambda loud, i: F.when(loud, i)))

    def extend(acc, i):
        s = F.greatest(F.lit(0), i * rules.hop - rules.margin)
        e = F.least(total, (i + 1) * rules.hop + rules.margin)
        start, joins = acc["s"] < 0, s <= acc["e"] + rules.silence
        done = F.when(start | joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(pair(acc["s"], acc["e"]))))
        return F.struct(done.alias("done"), F.when(~start & joins, acc["s"]).otherwise(s).cast("int").alias("s"),
                        F.when(~start & joins, F.greatest(acc["e"], e)).otherwise(e).cast("int").alias("e"))

    zero = F.struct(F.array().cast(pairs).alias("done"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    merged = F.aggregate(hops, zero, extend, lambda a: F.when(a["s"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(pair(a["s"], a["e"])))))
    cut = lambda iv: F.transform(
        F.sequence(iv["s"], F.greatest(iv["e"] - 1, iv["s"]), F.lit(rules.longest)), lambda f: pair(f, F.least(iv["e"], f + rules.longest)))
    pieces = F.filter(F.flatten(F.transform(merged, cut)), lambda p: p["e"] - p["s"] >= rules.shortest)
    return let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(pair(F.lit(0), total))))


def spans_of(y: np.ndarray, rules: SegmentRules) -> list[tuple[int, int]]:
    """``speech_spans`` of one call's samples."""
    total = len(y)
    power = np.maximum(1e-10, frame_levels(y, rules.frame, rules.hop) ** 2)
    loud = np.flatnonzero(power > power.max() * 10 ** (-rules.top_db / 10.0))
    starts, ends = np.maximum(0, loud * rules.hop - rules.margin), np.minimum(total, (loud + 1) * rules.hop + rules.margin)
    parts = np.flatnonzero(starts[1:] > ends[:-1] + rules.silence) + 1  # ends never fall, so neighbours decide
    merged = zip(starts[np.r_[0, parts]].tolist(), ends[np.r_[parts - 1, -1]].tolist()) if len(loud) else ()
    cuts = [(f, min(e, f + rules.longest)) for s, e in merged for f in range(s, max(e - 1, s) + 1, rules.longest)]
    return [(s, e) for s, e in cuts if e - s >= rules.shortest] or [(0, total)]


MEASURES = "share double, usable_sec double, speech_ratio double, snr_db double, clipped double, n int"


def _turns(rules: SegmentRules, min_speech: float, frame: int, hop: int, min_snr: float):
    """The speech segments of a call that passes the gate (PRJ-06, SIG-03, SIG-05, SIG-06), numbered from 0, and its measures with
    the first; of any other call the measures alone, numbered -1. Samples that are not finite count as none (PRJ-15)."""

    def pieces(y: np.ndarray):
        if not len(y) or not np.isfinite(y).all():
            yield -1, -1, -1, 0.0, 0.0, 0.0, 0.0, 0.0, 0, None
            return
        speech, ratio, snr = gate_measures(frame_levels(y, frame, hop), hop)
        clipped = float((np.abs(y) >= 0.985).mean())
        measures = (energy_share(y[: 4 * RATE], 300.0, 3400.0, 1e-9), speech, ratio, snr, clipped, len(y))
        if any(Q.gate_faults(speech, snr, clipped * 100, min_speech, min_snr)):
            yield -1, -1, -1, *measures, None
            return
        for at, (s, e) in enumerate(spans_of(y, rules)):
            yield at, s, e, *(measures if at == 0 else [None] * len(measures)), y[s:e]

    return pieces


QUALITY = ["usable_sec", "total_sec", "speech_ratio", "snr_db", "clipping_percent", "telephony", "quality_level", "is_usable", "rejection_reason"]


def describe_calls(calls: DataFrame, model: SpoofModel, rules: SegmentRules = SegmentRules(), min_speech: float = Q.MIN_SPEECH_SEC, frame: int = 480, hop: int = 240, min_snr: float = Q.MIN_SNR_DB) -> DataFrame:
    """Gate, segments, voice vector, score and risk signals in one pass over the samples (or int16 bytes), no shuffle.

    A row per speech segment, each described once; a call that failed the gate is one row with seg_idx -1, of which nothing is
    described. The first row of a call has its ``quality`` and its other columns as ``facts``.
    """
    facts = [c for c in calls.columns if c not in ("call_id", "pcm")]
    df = summarise_clips(calls, pieces=_turns(rules, min_speech, frame, hop, min_snr), more=f"seg_idx int, s int, e int, {MEASURES}", finer=2)
    df = df.withColumns({"clipping_percent": F.col("clipped") * 100, "total_sec": F.col("n") / float(RATE), "telephony": F.col("share") > 0.88})
    df = df.withColumns(Q.quality_gate("usable_sec", "snr_db", "clipping_percent", "telephony", min_speech=min_speech, min_snr=min_snr, total_sec="total_sec"))
    first, spoken = F.col("seg_idx") <= 0, F.col("seg_idx") >= 0
    start, end = rnd(F.col("s") / float(RATE), 2), rnd(F.col("e") / float(RATE), 2)
    scored = model.score(df.select(
        "call_id", "seg_idx", F.when(first, F.struct(*facts)).alias("facts"), F.when(first, F.struct(*QUALITY)).alias("quality"), start.alias("start_sec"), end.alias("end_sec"),
        F.when(spoken, timbre_segment(True)).alias("emb"), F.when(spoken, feature_map()).alias("f")))
    f = lambda name: F.col("f")[name]
    return scored.select(
        "call_id", "seg_idx", "facts", "quality", "start_sec", "end_sec", rnd(F.col("end_sec") - F.col("start_sec"), 2).alias("dur"), "emb", F.col("model_prob").alias("prob"),
        f("acoustic_phase_derivative_var").alias("phase_var"), f("spectral_hf_energy_ratio").alias("hf_ratio"), f("prosody_jitter").alias("jitter"), f("spectral_contrast_std").alias("contrast_std"))


def analyse_calls(calls: DataFrame, model: SpoofModel, rules: SegmentRules = SegmentRules(), min_speech: float = Q.MIN_SPEECH_SEC, min_snr: float = Q.MIN_SNR_DB, turns: C.TurnRules = C.TurnRules()) -> tuple[DataFrame, DataFrame]:
    """``calls``: call_id, pcm (samples, or int16 bytes), language, role, financial. Returns (verdict per call, report pages).

    Audio is read once: gate, segmentation, voices and scores are one pass whose small result is written with the facts of
    the calls, because diarisation and the report read it several times.
    """
    described = materialise(describe_calls(calls, model, rules, min_speech, min_snr=min_snr), "segments")
    facts = described.filter("seg_idx <= 0").select("call_id", "facts.*", "quality.*")
    voices = described.filter("seg_idx >= 0").drop("facts", "quality")
    clustered = materialise(L.cluster_segments(voices), "clustered")
    segments = materialise(L.assign_by_margin(clustered, 28).drop("emb"), "diarised")
    durations = C.call_durations(segments, turns)
    conf = segments.groupBy("call_id").agg(rnd(F.max("cluster_conf"), 3).alias("diarization_confidence"))
    people = C.speaker_assessments(C.speaker_scores(segments, durations, turns), facts.join(conf, "call_id"), model.threshold)
    empty = {"n_segments": 0, "total_speech_seconds": 0.0, "overlap_seconds": 0.0, "overlap_percent": 0.0, "seconds_a": 0.0, "seconds_b": 0.0, "num_speakers": 0}
    all_durations = facts.select("call_id").join(durations, "call_id", "left").fillna(empty)
    remote = facts.select("call_id").join(C.remote_risk(people), "call_id", "left").fillna({"overall_call_risk": 0.0, "remote_level": "low"})
    verdicts = C.call_verdicts(all_durations, remote, facts, turns)
    return verdicts, C.call_report(segments, verdicts, people)
