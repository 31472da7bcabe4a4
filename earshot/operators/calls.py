"""Per-call aggregation and report (AGG-17 .. AGG-22, PRJ-11, PRJ-12, RSK-09 .. RSK-11).

Segments carry call_id, seg_idx, start_sec, end_sec, dur, speaker, is_overlap, and for scored turns
prob, phase_var, hf_ratio, jitter, contrast_std. Every step is a partial aggregation by call, so a
very long call combines before the shuffle; lists in reports come in pages of bounded length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk as R
from ..functions.numeric import as_col, rnd
from ..session import materialise
from . import ordered

SIGNALS = ["phase_var", "hf_ratio", "jitter", "contrast_std"]
PAGE = 512


@dataclass(frozen=True)
class TurnRules:
    """Seconds: ``shortest`` turn that is scored, ``least`` clean speech of a scored speaker (PRJ-11); speech over ``second`` makes a
    second speaker (AGG-19); with less than ``doubtful`` in all, much overlap rejects a call (PRJ-12)."""

    shortest: float = 0.7
    least: float = 1.0
    second: float = 0.5
    doubtful: float = 4.0


def weighted_mean(value, weight) -> Column:
    """AGG-17: sum(x * d) / max(sum(d), 1e-4)."""
    v, w = as_col(value), as_col(weight)
    return F.sum(v * w) / F.greatest(F.sum(w), F.lit(1e-4))


def window_blend(global_prob, p75, median) -> Column:
    """AGG-18: 0.60 * global + 0.25 * p75 + 0.15 * median; the global score alone without windows."""
    g = as_col(global_prob)
    return F.coalesce(g * 0.60 + as_col(p75) * 0.25 + as_col(median) * 0.15, g)


def blend_windows(clips: DataFrame, windows: DataFrame, clip="audio_id", prob="prob") -> DataFrame:
    """AGG-18 over at most five window scores per clip."""
    stats = windows.groupBy(clip).agg(F.percentile(prob, F.lit(0.75)).alias("p75"), F.median(prob).alias("med"))
    return clips.join(stats, clip, "left").withColumn("blended", window_blend("global_prob", "p75", "med")).drop("p75", "med")


def call_durations(segments: DataFrame, rules: TurnRules = TurnRules()) -> DataFrame:
    """AGG-19: seconds of A, B, overlap and in total, overlap share and number of speakers."""
    sec = lambda cond: F.sum(F.when(cond, F.col("dur")).otherwise(0.0))
    clean = ~F.col("is_overlap")
    out = segments.groupBy("call_id").agg(
        F.count("*").alias("n_segments"),
        F.sum("dur").alias("t"),
        sec(F.col("is_overlap")).alias("o"),
        sec(clean & (F.col("speaker") == "Speaker A")).alias("a"),
        sec(clean & (F.col("speaker") == "Speaker B")).alias("b"),
    )
    return out.select(
        "call_id", "n_segments", rnd("t", 2).alias("total_speech_seconds"), rnd("o", 2).alias("overlap_seconds"),
        rnd(F.col("o") / F.greatest(F.col("t"), F.lit(1e-4)) * 100, 1).alias("overlap_percent"),
        rnd("a", 2).alias("seconds_a"), rnd("b", 2).alias("seconds_b"), F.when(rnd("b", 2) > rules.second, 2).otherwise(1).alias("num_speakers"))


def excess_overlap(overlap_percent, total_speech, rules: TurnRules = TurnRules()) -> Column:
    """PRJ-12."""
    return (as_col(overlap_percent) >= 60.0) & (as_col(total_speech) < rules.doubtful)


def speaker_scores(segments: DataFrame, durations: DataFrame, rules: TurnRules = TurnRules()) -> DataFrame:
    """PRJ-11 + AGG-17: one row per (call, speaker) present, with weighted scores of eligible turns.

    A turn counts when it is the speaker's own, not overlapped and at least 0.7 s long; a speaker needs
    a turn like that and 1.0 s of clean speech (``rules``), otherwise ``eligible`` is false.
    """
    wanted = F.when(F.col("num_speakers") > 1, F.array(F.lit("Speaker A"), F.lit("Speaker B"))).otherwise(F.array(F.lit("Speaker A")))
    people = durations.select("call_id", "seconds_a", "seconds_b", "num_speakers", F.explode(wanted).alias("speaker"))
    people = people.withColumn("clean_seconds", F.when(F.col("speaker") == "Speaker A", F.col("seconds_a")).otherwise(F.col("seconds_b")))
    clean = segments.filter(~F.col("is_overlap") & (F.col("dur") >= rules.shortest) & F.col("speaker").isin("Speaker A", "Speaker B"))
    means = clean.groupBy("call_id", "speaker").agg(
        weighted_mean("prob", "dur").alias("spoof_prob"), *[weighted_mean(c, "dur").alias(c) for c in SIGNALS], F.count("*").alias("clean_turns"))
    out = people.join(means, ["call_id", "speaker"], "left")
    return out.withColumn("eligible", (F.coalesce(F.col("clean_turns"), F.lit(0)) > 0) & (F.col("clean_seconds") >= rules.least)).drop("seconds_a", "seconds_b")


def speaker_assessments(scores: DataFrame, calls: DataFrame, tau=0.51) -> DataFrame:
    """RSK-02 .. RSK-06 and RSK-09, RSK-11 per speaker. ``calls``: call_id, language, telephony, diarization_confidence."""
    df = scores.join(calls, "call_id")
    df = R.assess_risk(df, prob=F.coalesce("spoof_prob", F.lit(0.0)), tau=tau, phase="phase_var", hf="hf_ratio", jitter="jitter", contrast="contrast_std", language="language")
    name = F.when(F.col("eligible"), R.speaker_risk_name("risk_level")).otherwise("insufficient_data")
    df = df.withColumn("voice_risk", name)
    return df.select(
        "call_id", "speaker", "num_speakers", "clean_seconds", "eligible", "voice_risk",
        F.when(F.col("eligible"), rnd("spoof_prob", 3)).otherwise(0.0).alias("spoof_score"),
        F.when(F.col("eligible"), F.col("risk_score")).alias("risk_score"),
        F.when(F.col("eligible"), R.analysis_confidence("diarization_confidence", "clean_seconds")).otherwise(0.30).alias("analysis_confidence"),
        R.speaker_reasons("voice_risk", F.coalesce("hf_ratio", F.lit(0.0)), F.coalesce("phase_var", F.lit(0.0)), "telephony").alias("reasons"),
        F.when(F.col("speaker") == "Speaker A", 0.94).when(F.col("num_speakers") > 1, 0.78).otherwise(0.50).alias("role_confidence"),
    )


def remote_risk(assessments: DataFrame) -> DataFrame:
    """AGG-20: highest risk of the remote party (B, or A when alone) and the name of its level."""
    remote = assessments.filter("eligible").filter((F.col("speaker") == "Speaker B") | (F.col("num_speakers") == 1))
    best = remote.groupBy("call_id").agg(F.max("risk_score").alias("s"), F.max_by("voice_risk", "risk_score").alias("n"))
    calls = assessments.select("call_id").distinct().join(best, "call_id", "left")
    hit = F.coalesce(F.col("s") > 0, F.lit(False))
    return calls.select("call_id", F.when(hit, F.col("s")).otherwise(0.0).alias("overall_call_risk"), F.when(hit, F.col("n")).otherwise("low").alias("remote_level"))


def call_verdicts(durations: DataFrame, remote: DataFrame, calls: DataFrame, rules: TurnRules = TurnRules()) -> DataFrame:
    """RSK-10 with both rejections (PRJ-06 unusable audio, PRJ-12 overlap). ``calls`` adds is_usable, role, financial."""
    df = durations.join(remote, "call_id").join(calls, "call_id")
    decision = R.call_decision("remote_level", "overall_call_risk")
    reject = ~F.col("is_usable") | excess_overlap("overlap_percent", "total_speech_seconds", rules)
    df = df.withColumn("call_assessment", F.when(reject, "insufficient_evidence").otherwise(decision))
    guidance = F.when(~F.col("is_usable"), F.format_string(R.GUIDANCE["unusable"], F.col("rejection_reason"))).when(
        reject, R.GUIDANCE["overlap"]
    ).otherwise(R.call_guidance("call_assessment", "role", "financial"))
    return df.withColumn("guidance", guidance).withColumn("overall_call_risk", F.when(reject, 0.0).otherwise(rnd("overall_call_risk", 1)))


def timeline_pages(segments: DataFrame, page: int = PAGE) -> DataFrame:
    """AGG-21: the ordered timeline of a call as pages of at most ``page`` entries."""
    entry = F.struct("seg_idx", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.col("dur").alias("duration"), "speaker", "is_overlap")
    return segments.groupBy("call_id", F.floor(F.col("seg_idx") / page).alias("page")).agg(F.array_sort(F.collect_list(entry)).alias("timeline"))


def call_report(segments: DataFrame, verdicts: DataFrame, assessments: DataFrame, page: int = PAGE) -> DataFrame:
    """AGG-21: verdict, the one or two speakers and a page of the timeline per row."""
    person = F.struct("speaker", "role_confidence", "clean_seconds", "voice_risk", "spoof_score", "risk_score", "analysis_confidence", "reasons")
    people = assessments.groupBy("call_id").agg(F.array_sort(F.collect_list(person)).alias("speakers"))  # at most two
    rejected = F.col("call_assessment") == "insufficient_evidence"
    out = verdicts.join(people, "call_id", "left").join(timeline_pages(segments, page), "call_id", "left")
    return out.withColumn("speakers", F.when(rejected, F.slice("speakers", 1, 0)).otherwise(F.col("speakers")))


def session_summary(telemetry: DataFrame) -> DataFrame:
    """AGG-22: peak, final, seconds and verdict per call from its telemetry rows (seq, risk, peak, alert, seconds_a/b)."""
    last = lambda c: F.max_by(c, "seq")
    out = telemetry.groupBy("call_id").agg(
        F.max("peak_risk").alias("p"), last("call_risk").alias("f"), F.max(F.col("alert").cast("int")).alias("a"),
        last("seconds_a").alias("sa"), last("seconds_b").alias("sb"))
    alert = F.col("a") == 1
    clone = (F.col("p") >= 50.0) | alert
    return out.select(
        "call_id", R.session_verdict("p").alias("verdict"), F.when(clone, "AI-Cloned Voice Detected").otherwise("Call Verified Authentic").alias("verdict_title"),
        rnd("p", 1).alias("peak_risk"), rnd("f", 1).alias("final_risk"), alert.alias("alert_triggered"), rnd("sb", 1).alias("remote_speech_sec"), rnd("sa", 1).alias("local_speech_sec"))


def call_events(telemetry: DataFrame, block: Column, most: int = 30, alert_at: float = 70.0) -> DataFrame:
    """STM-10: the last ``most`` events per call from monitor telemetry: call_id, seq, timestamp, speaker, type, text, risk.

    A change of speaker is an event: OVERLAP (risk 25), INFO, or ALERT when the remote party's risk is at ``alert_at`` or
    more. An event with the text of the one before it is left out.
    """
    # ordered operators read their rows more than once, so the recursion behind these is not run for each reading
    told = materialise(telemetry.filter("is_speech").select("call_id", "seq", "timestamp", "speaker", "role", "risk_a", "risk_b"), "telemetry")
    spoken = ordered.suppress_repeats(told, ["call_id"], ["seq"], block, "speaker")  # the first row of every turn
    remote = F.concat(F.lit("Remote party ("), F.initcap(F.replace("role", F.lit("_"), F.lit(" "))), F.lit(")"))
    overlap, local, hot = F.col("speaker") == "OVERLAP", F.col("speaker") == "A", F.col("risk_b") >= alert_at
    events = spoken.select(
        "call_id", "seq", "timestamp", "speaker",
        F.when(overlap, "OVERLAP").when(~local & hot, "ALERT").otherwise("INFO").alias("type"),
        F.when(overlap, "Both parties speak; not scored").when(local, "Local party speaks").otherwise(F.concat(remote, F.when(hot, " speaks: high risk of a cloned voice").otherwise(" speaks"))).alias("text"),
        F.when(overlap, 25.0).when(local, F.col("risk_a")).otherwise(F.col("risk_b")).alias("risk"),
    )
    events = ordered.suppress_repeats(materialise(events, "call-events"), ["call_id"], ["seq"], block, "text")
    return ordered.last_events(events, ["call_id"], [F.desc("seq")], most)
