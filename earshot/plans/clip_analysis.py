"""Clip analysis (ML-10, ML-11): silence rule, features, window blend, fusion, risk and event."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import risk as R
from ..functions.hashing import event_payload
from ..functions.quality import SILENCE_RULES
from ..operators import calls
from ..operators.features import clip_features, cut_spans, facts_of, sliding_spans
from ..operators.models import SpoofModel
from ..session import materialise

RESULT = ["audio_id", "model_prob", "spoof_prob", "risk_score", "risk_level", "alert", "signal_breakdown", "explanation"]
# Fixed value: the note of the published result format.
SILENT_NOTE = "Audio level is near silent / ambient room noise. No synthetic voice detected. Please speak closer to the microphone."


def _pieces(window: int, minimum: int, shortest: int):
    """The standardised clip (number -1) and up to five windows of it that are not silent (WIN-02), with the flag of a
    near-silent clip (PRJ-10), which hands on no samples. Nothing of unusable clips (PRJ-15)."""
    quiet_rms, quiet_peak, _ = SILENCE_RULES["batch"]

    def pieces(y: np.ndarray):
        n, finite, rms, peak = facts_of(y)
        if not n or not finite:
            return
        if rms < quiet_rms and peak < quiet_peak:
            yield -1, True, y[:0]
            return
        y = K.normalise_peak(K.voiced_or_whole(y, 28.0, shortest)).astype(np.float32).astype(np.float64)
        yield -1, False, y
        if len(y) >= minimum:
            starts = range(0, max(len(y) - window, 0) + 1, max(1, (len(y) - window) // 4))
            for win, start in enumerate(starts[:5]):
                part = y[start : start + window]
                if facts_of(part)[2] >= 0.003:
                    yield win, False, K.normalise_peak(np.pad(part, (0, window - len(part))))

    return pieces


def analyse_clips(clips: DataFrame, model: SpoofModel, window: int = 48000, minimum: int = 56000, shortest: int = 8000) -> DataFrame:
    """``clips``: audio_id, pcm (samples, or int16 bytes), language, unknown_number, high_value, prior_fraud, ext_prob.

    Audio is read once, and one clip at a time goes from its samples to the numbers of its pieces in one pass. Clips without
    samples or with samples that are not finite give no result: ``usable_clips`` lists them with the reason (PRJ-15). A
    near-silent clip keeps its row but hands no samples to the feature job. The only shuffle is one aggregation of at most
    six score rows per clip.
    """
    facts = [c for c in clips.columns if c != "pcm"]
    whole = F.col("win") < 0
    rows = clips.select("audio_id", F.to_json(F.struct(*facts)).alias("facts"), "pcm")
    features = clip_features(rows, pieces=_pieces(window, minimum, shortest), more="win int, silent boolean")
    scored = model.score(features).select("audio_id", "win", "silent", "model_prob", F.when(whole, F.col("facts")).alias("facts"), F.when(whole, F.col("f")).alias("f"))

    in_window = F.when(~whole, F.col("model_prob"))
    per_clip = scored.groupBy("audio_id").agg(
        F.max(F.when(whole, F.col("model_prob"))).alias("global_prob"), F.percentile(in_window, F.lit(0.75)).alias("p75"), F.median(in_window).alias("med"),
        F.first("f", ignorenulls=True).alias("f"), F.first("facts", ignorenulls=True).alias("facts"), F.max("silent").alias("silent"))
    fact_type = ", ".join(f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in facts if c != "audio_id")
    out = per_clip.withColumn("facts", F.from_json("facts", fact_type)).select("*", "facts.*")
    feat = lambda name: F.col("f")[name]
    out = out.withColumn("model_prob", F.when(F.col("silent"), 0.02).otherwise(calls.window_blend("global_prob", "p75", "med")))
    out = out.withColumn("spoof_prob", F.when(F.col("silent"), 0.02).otherwise(R.fuse_scores("model_prob", "ext_prob", feat("spectral_flatness"))))
    judged = R.assess_risk(
        out, prob="spoof_prob", tau=model.threshold, phase=feat("acoustic_phase_derivative_var"), hf=feat("spectral_hf_energy_ratio"), jitter=feat("prosody_jitter"),
        contrast=feat("spectral_contrast_std"), language="language", unknown_number="unknown_number", high_value="high_value", prior_fraud="prior_fraud")
    quiet = F.create_map(F.lit("ml_classifier_spoof_prob"), F.lit(0.02), *[F.lit(x) for k in ("acoustic_anomaly", "spectral_anomaly", "prosody_anomaly", "speaker_mismatch") for x in (k, 0.0)])
    fixed = {"risk_score": F.lit(2.0), "risk_level": F.lit("LOW"), "alert": F.lit(False), "signal_breakdown": quiet, "explanation": F.lit(SILENT_NOTE)}
    return judged.withColumns({c: F.when(F.col("silent"), v).otherwise(F.col(c)) for c, v in fixed.items()}).select(*RESULT)


def clip_events(results: DataFrame, clips: DataFrame) -> DataFrame:
    """PRJ-18: ledger events of scored clips: ids, hash, base name and risk only. Silent clips seal none."""
    facts = clips.select("audio_id", "audio_sha256", "file_name", "language")
    df = results.filter(F.col("explanation") != SILENT_NOTE).join(facts, "audio_id")
    payload = event_payload(audio_sha256="audio_sha256", filename="file_name", language="language", risk_score="risk_score", risk_level="risk_level", alert_triggered="alert", session_id="audio_id")
    return df.select("audio_id", F.lit("BATCH_ANALYSIS").alias("event_type"), payload.alias("payload"))


def feature_table(clips: DataFrame, label: str = "features") -> DataFrame:
    """Features written once to the shared folder, for jobs that read them several times."""
    return materialise(clip_features(clips), label)


def windowed_features(clips: DataFrame) -> DataFrame:
    """WIN-01 into SIG-16: features of every sliding window."""
    return clip_features(cut_spans(clips.withColumn("spans", sliding_spans("pcm"))))
