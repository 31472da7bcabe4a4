"""Live audio: PCM chunks to scores to per-call state (STM-01 .. STM-03, SRC-14), as a stream or a replay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk as R
from ..operators import features as X
from ..operators.models import SpoofModel
from ..sources.media import live_chunks
from ..streaming import jobs as J
from ..streaming import joined

RATE = 16000


def score_chunks(chunks: DataFrame, model: SpoofModel, kind: str = "monitor") -> DataFrame:
    """``chunks``: call_id, seq, event_ts, pcm (int16 bytes). Adds what the call state needs: length, level, clipping, voice
    vector, probability and risk. Stateless and without a shuffle; empty chunks are skipped (SRC-14)."""

    def facts(y):
        n, _, rms, peak = X.facts_of(y)
        yield n, rms, peak, float((np.abs(y) >= 0.99).mean()) if n else None, y

    # from bytes to numbers in one Python pass, a few chunks at a time
    described = X.summarise_clips(live_chunks(chunks).select("call_id", "seq", "event_ts", "pcm"), pieces=facts, more="n int, rms double, peak double, clipped double")
    voice = X.timbre_monitor(True) if kind == "monitor" else X.timbre_session(True)
    scored = model.score(described.select("call_id", "seq", "event_ts", F.struct("n", "rms", "peak").alias("facts"), "clipped", voice.alias("emb"), X.feature_map().alias("f")))
    f = lambda name: F.col("f")[name]
    judged = R.assess_risk(
        scored, prob="model_prob", tau=model.threshold, phase=f("acoustic_phase_derivative_var"), hf=f("spectral_hf_energy_ratio"), jitter=f("prosody_jitter"), contrast=f("spectral_contrast_std"))
    return judged.select(
        "call_id", "seq", "event_ts", (F.col("facts.n") / float(RATE)).alias("dur"), F.col("facts.rms").alias("rms"), F.col("facts.peak").alias("peak"), "clipped", "emb",
        F.col("model_prob").alias("prob"), F.col("risk_score").alias("risk"))


def rolling_chunk_risk(scored: DataFrame, span: float = 3.0) -> DataFrame:
    """STM-01 with a result per chunk: length-weighted probability of the chunks that began in the last ``span`` seconds."""
    from ..operators import blocks

    at = scored.withColumn("__at", F.unix_micros("event_ts")).withColumn("__weighted", F.col("prob") * F.col("dur"))
    out = blocks.last_span(at, ["call_id"], "__at", int(span * 1e6), __p=(F.sum, "__weighted"), __d=(F.sum, "dur"), chunks=(F.count, "seq"))
    return out.withColumn("rolling_prob", F.col("__p") / F.nullif(F.col("__d"), F.lit(0.0))).drop("__at", "__weighted", "__p", "__d")


def score_cuts(model: SpoofModel, kind: str = "monitor", rules: joined.JoinRules = joined.JoinRules()):
    """STM-13 / STM-14: what scores the cuts of ``joined``: one signal, cut at silence and normalised, then features, model
    and risk. Stateless and without a shuffle. Too little or silent audio gets 0.05 and 5.0 (monitor); rows without a cut
    get NULL."""

    def score(cuts: DataFrame) -> DataFrame:
        audio = cuts.withColumn("__samples", X.pcm_to_samples("cut")).withColumn("__facts", X.sound_facts("__samples"))
        quiet = (F.col("__facts.n") < rules.least) | ((F.col("__facts.rms") < 0.0035) & (F.col("__facts.peak") < 0.018))
        none = F.array().cast("array<double>")
        if kind == "monitor":
            audio = audio.withColumn("__quiet", quiet)
            audio = audio.withColumn("__samples", F.when(F.col("__quiet"), none).otherwise(X.voiced_and_normalised("__samples", 26.0, rules.least)))
        else:
            audio = audio.withColumn("__quiet", F.lit(False)).withColumn("__samples", X.scaled("__samples", 1.0, 1e-4))
        described = model.score(X.clip_features(audio, "__samples"))
        f = lambda name: F.col("f")[name]
        judged = R.assess_risk(
            described, prob="model_prob", tau=model.threshold, phase=f("acoustic_phase_derivative_var"), hf=f("spectral_hf_energy_ratio"), jitter=f("prosody_jitter"),
            contrast=f("spectral_contrast_std"), language="language", high_value=F.coalesce("financial", F.lit(False)))
        fixed = lambda c, low: F.when(F.col("cut").isNull(), F.lit(None)).when(F.col("__quiet"), low).otherwise(F.col(c)).cast("double")
        return judged.select(*cuts.columns, fixed("model_prob", 0.05).alias("prob"), fixed("risk_score", 5.0).alias("risk"))

    return score


def watch_joined(chunks: DataFrame, model: SpoofModel, kind: str = "monitor", rules: joined.JoinRules = joined.JoinRules(), **options) -> DataFrame:
    """The stream: PCM chunks to one row of call state per chunk, judged on joined audio."""
    return joined.stream_calls(chunks, score_cuts(model, kind, rules), kind, rules, **options)


def replay_joined(chunks: DataFrame, model: SpoofModel, kind: str = "monitor", rules: joined.JoinRules = joined.JoinRules()) -> DataFrame:
    """The same over a table."""
    return joined.replay_calls(chunks, score_cuts(model, kind, rules), kind, rules)


def watch_calls(chunks: DataFrame, model: SpoofModel, kind: str = "monitor", **options) -> DataFrame:
    """The stream: PCM chunks to one row of call state per chunk."""
    return J.track_calls(score_chunks(chunks, model, kind), kind, **options)


def replay_audio(chunks: DataFrame, model: SpoofModel, kind: str = "monitor") -> DataFrame:
    """The same over a table."""
    return J.replay_calls(score_chunks(chunks, model, kind), kind)
