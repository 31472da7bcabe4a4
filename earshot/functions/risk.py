"""Score fusion and risk mapping (FUS-01, RSK-01 .. RSK-15), all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import as_col, clamp, rnd

# Language codes and names with the wider acoustic tolerances.
INDIC_CODES = ["hi", "ta", "te", "bn", "kn", "mr", "indic", "hindi", "tamil", "telugu"]

# Explanation tail per level.
LEVEL_NOTES = {
    "CRITICAL": "[ALERT: High-Confidence AI Voice Clone / Synthetic Speech Detected.]",
    "HIGH": "[ALERT: Synthetic Vocoder & Neural Speech Artifacts Detected.]",
    "MEDIUM": "[Ambiguous Audio - Degraded Acoustic Signal or Background Noise.]",
    "LOW": "[Verified Genuine Human Voice - Natural Vocal Tract Biomechanics Confirmed.]",
}

# Context weights.
UNKNOWN_NUMBER, HIGH_VALUE, PRIOR_FRAUD, TRUSTED = 8.0, 12.0, 15.0, -10.0


def fuse_scores(model, external, flatness=None) -> Column:
    """FUS-01: mean of both, the only one present, or a guess from spectral flatness."""
    m, x = as_col(model), as_col(external)
    guess = clamp(F.coalesce(as_col(flatness), F.lit(0.0)) * 1.5, 0.05, 0.95)
    both = m * 0.5 + x * 0.5
    return F.when(m.isNotNull() & x.isNotNull(), both).otherwise(F.coalesce(m, x, guess))


def risk_level(score) -> Column:
    """RSK-01."""
    s = as_col(score)
    return F.when(s >= 80, "CRITICAL").when(s >= 60, "HIGH").when(s >= 25, "MEDIUM").otherwise("LOW")


def is_alert(level) -> Column:
    return as_col(level).isin("HIGH", "CRITICAL")


def is_indic(language, substring: bool = False) -> Column:
    """Exact match on the leading subtag; ``substring=True`` accepts the code anywhere in the text."""
    lang = F.lower(as_col(language))
    if substring:
        hit = F.lit(False)
        for code in INDIC_CODES:
            hit = hit | lang.contains(code)
    else:
        hit = F.regexp_extract(lang, "^([a-z]+)", 1).isin(*INDIC_CODES)
    return F.coalesce(hit, F.lit(False))


def _above(value: Column, upper: Column, width: float) -> Column:
    return F.least(F.lit(1.0), (value - upper) / width)


def _between_zero_and(value: Column, lower: float) -> Column:
    return F.least(F.lit(1.0), (F.lit(lower) - value) / lower)


def anomaly_columns(phase, hf, jitter, contrast, indic) -> dict[str, Column]:
    """RSK-02: four signals scaled to 0..1 against the limits for the language group."""
    phase, hf, jitter, contrast = as_col(phase), as_col(hf), as_col(jitter), as_col(contrast)
    indic = as_col(indic)
    phase_top = F.when(indic, 0.48).otherwise(0.45)
    jitter_top = F.when(indic, 0.14).otherwise(0.12)
    contrast_top = F.when(indic, 8.8).otherwise(8.6)
    zero = F.lit(0.0)
    return {
        "phase_anomaly": rnd(
            F.when(phase > phase_top, _above(phase, phase_top, 0.35))
            .when((phase > 0) & (phase < 0.015), _between_zero_and(phase, 0.015))
            .otherwise(zero),
            4,
        ),
        "hf_anomaly": rnd(F.when(hf > 0.014, _above(hf, F.lit(0.014), 0.020)).otherwise(zero), 4),
        "jitter_anomaly": rnd(
            F.when(jitter > jitter_top, _above(jitter, jitter_top, 0.20))
            .when((jitter > 0) & (jitter < 0.010), _between_zero_and(jitter, 0.010))
            .otherwise(zero),
            4,
        ),
        "contrast_anomaly": rnd(F.when(contrast > contrast_top, _above(contrast, contrast_top, 2.5)).otherwise(zero), 4),
    }


def weighted_anomaly(phase, hf, jitter, contrast) -> Column:
    """RSK-03, first half."""
    return as_col(contrast) * 0.40 + as_col(phase) * 0.30 + as_col(hf) * 0.20 + as_col(jitter) * 0.10


def lifted_probability(prob, contrast) -> Column:
    """RSK-03, second half: a strong contrast artefact raises a suspicious probability."""
    p, c = as_col(prob), as_col(contrast)
    return (
        F.when((c >= 0.35) & (p >= 0.38), F.greatest(p, c * 0.35 + 0.52))
        .when(c >= 0.65, F.greatest(p, c * 0.35 + 0.55))
        .otherwise(p)
    )


def banded_score(prob, anomaly, tau) -> Column:
    """RSK-04: five linear bands around the calibrated threshold."""
    p, a, t = as_col(prob), as_col(anomaly), as_col(tau)
    mid = F.greatest(F.lit(0.48), t * 0.88)
    low = F.greatest(F.lit(0.28), t * 0.58)

    def band(start, floor, height, width, cap, boost):
        return F.least(F.lit(cap), (p - start) / width * height + floor + a * boost)

    def wide(x):
        return F.greatest(F.lit(0.01), x)

    return (
        F.when(p >= 0.75, band(F.lit(0.75), 82.0, 14.0, F.lit(0.25), 99.0, 4.0))
        .when(p >= t, band(t, 60.0, 20.0, wide(F.lit(0.75) - t), 82.0, 6.0))
        .when(p >= mid, band(mid, 28.0, 28.0, wide(t - mid), 58.0, 12.0))
        .when(p >= low, band(low, 8.0, 16.0, wide(mid - low), 24.0, 3.0))
        .otherwise(band(F.lit(0.0), 2.0, 6.0, wide(low), 10.0, 2.0))
    )


def context_modifier(prob, unknown_number=False, high_value=False, prior_fraud=False, trusted=False) -> Column:
    """RSK-05, before clamping."""

    def add(flag, points, extra=None):
        cond = F.coalesce(as_col(flag).cast("boolean"), F.lit(False))
        return F.when(cond if extra is None else cond & extra, F.lit(points)).otherwise(F.lit(0.0))

    return (
        add(unknown_number, UNKNOWN_NUMBER)
        + add(high_value, HIGH_VALUE)
        + add(prior_fraud, PRIOR_FRAUD)
        + add(trusted, TRUSTED, as_col(prob) < 0.55)
    )


def explanation(score, level, prob) -> Column:
    """RSK-06 text."""
    note = F.lit(LEVEL_NOTES["LOW"])
    for name in ("MEDIUM", "HIGH", "CRITICAL"):
        note = F.when(as_col(level) == name, LEVEL_NOTES[name]).otherwise(note)
    return F.format_string(
        "Impersonation risk evaluated at %.1f/100 (%s). ML Spoof Probability: %.3f. %s",
        as_col(score), as_col(level), rnd(prob, 3), note,
    )


def assess_risk(
    df: DataFrame,
    prob="spoof_prob",
    tau=0.51,
    phase=0.0,
    hf=0.0,
    jitter=0.0,
    contrast=0.0,
    language=None,
    unknown_number=False,
    high_value=False,
    prior_fraud=False,
    trusted=False,
    speaker_mismatch=0.0,
    substring_language: bool = False,
) -> DataFrame:
    """RSK-02 .. RSK-06 as one row-wise projection; no shuffle, no Python.

    Adds phase_anomaly, hf_anomaly, jitter_anomaly, contrast_anomaly, weighted_anomaly, lifted_prob,
    raw_risk, safety_override, context_modifier, risk_score, risk_level, alert, signal_breakdown,
    explanation.
    """
    indic = is_indic(language, substring_language) if language is not None else F.lit(False)
    tau = F.when(as_col(tau).isNull() | (as_col(tau) == 0), F.lit(0.51)).otherwise(as_col(tau))
    zero = F.lit(0.0)
    staged = df.withColumn("__indic", indic)
    staged = staged.withColumns(anomaly_columns(*(F.coalesce(as_col(x), zero) for x in (phase, hf, jitter, contrast)), "__indic")).drop("__indic")
    staged = staged.withColumns(
        {
            "weighted_anomaly": weighted_anomaly("phase_anomaly", "hf_anomaly", "jitter_anomaly", "contrast_anomaly"),
            "lifted_prob": lifted_probability(clamp(prob, 0.0, 1.0), "contrast_anomaly"),
        }
    )
    staged = staged.withColumns(
        {
            "raw_risk": banded_score("lifted_prob", "weighted_anomaly", tau),
            "safety_override": F.col("lifted_prob") >= 0.75,
            "context_modifier": context_modifier("lifted_prob", unknown_number, high_value, prior_fraud, trusted),
        }
    )
    staged = staged.withColumn("risk_score", rnd(clamp(F.col("raw_risk") + F.col("context_modifier"), 0.0, 100.0), 1))
    staged = staged.withColumn("risk_level", risk_level("risk_score"))
    return staged.withColumns(
        {
            "alert": is_alert("risk_level"),
            "signal_breakdown": F.create_map(
                F.lit("ml_classifier_spoof_prob"), rnd("lifted_prob", 3),
                F.lit("acoustic_anomaly"), rnd("phase_anomaly", 3),
                F.lit("spectral_anomaly"), rnd("hf_anomaly", 3),
                F.lit("prosody_anomaly"), rnd("jitter_anomaly", 3),
                F.lit("vocoder_contrast_anomaly"), rnd("contrast_anomaly", 3),
                F.lit("speaker_mismatch"), rnd(as_col(speaker_mismatch).cast("double"), 3),
            ),
            "explanation": explanation("risk_score", "risk_level", "lifted_prob"),
        }
    )


# --- live mappings -------------------------------------------------------------------------------

# Live recommendations.
LIVE_OK = "Call audio appears authentic. Continue normal conversation."
LIVE_CAUTION = "Moderate vocal inconsistency detected. Exercise caution."
LIVE_VERIFY = "Verify your contact using another communication channel. Do not share OTP or transfer money."
LIVE_BANNER = "POSSIBLE AI CLONE DETECTED"
LIVE_OVERLAP = "OVERLAP DETECTED — INSUFFICIENT CONFIDENCE — WAITING FOR CLEAR SPEECH"


def live_risk(prob, tau=0.51) -> dict[str, Column]:
    """RSK-07: session score, level and recommendation from the smoothed probability."""
    p, t = as_col(prob), as_col(tau)
    score = (
        F.when(p < 0.25, p / 0.25 * 6.0 + 3.0)
        .when(p < t, (p - 0.25) / F.greatest(F.lit(0.01), t - 0.25) * 13.0 + 9.0)
        .when(p < 0.65, (p - t) / (F.lit(0.65) - t) * 20.0 + 55.0)
        .otherwise(F.least(F.lit(24.0), (p - 0.65) / 0.35 * 24.0) + 75.0)
    )
    low = (p < 0.25) | (p < t)
    return {
        "overall_risk": rnd(clamp(score, 1.0, 99.0), 1),
        "live_level": F.when(low, "LOW").when(p < 0.65, "HIGH").otherwise("CRITICAL"),
        "recommendation": F.when(low, LIVE_OK).when(p < 0.65, LIVE_CAUTION).otherwise(LIVE_VERIFY),
    }


def live_status(prob) -> Column:
    """RSK-08 label."""
    p = as_col(prob)
    return (
        F.when(p >= 0.70, "POSSIBLE AI CLONE")
        .when(p >= 0.45, "SUSPICIOUS SYNTHETIC")
        .when(p >= 0.30, "REVIEW RECOMMENDED")
        .otherwise("LOW RISK")
    )


def live_banner(prob) -> Column:
    """RSK-08 banner, NULL below the limit."""
    return F.when(as_col(prob) >= 0.70, F.lit(LIVE_BANNER))


# --- call report mappings ------------------------------------------------------------------------

# Speaker risk reasons.
REASON = {
    "critical": "Consistent high-confidence synthetic vocoder or cloned speech characteristics detected across clean speech turns.",
    "elevated": "Elevated synthetic voice indicators detected across separated speech turns.",
    "moderate": "Ambiguous acoustic characteristics; mild compression or acoustic reverberation present.",
    "low": "Verified natural human vocal tract biomechanics and normal micro-jitter dynamics.",
    "insufficient_data": "Less than 1.0 second of clean non-overlapping speech available.",
}
REASON_HF = "High-frequency unnatural harmonic leakage detected."
REASON_PHASE = "Waveform instantaneous phase discontinuity indicates neural synthesis."
REASON_TELEPHONY = "Telephone bandpass compression reduced high-frequency spectral resolution."


def speaker_risk_name(level) -> Column:
    """RSK-09 name."""
    lv = as_col(level)
    return F.when(lv == "CRITICAL", "critical").when(lv == "HIGH", "elevated").when(lv == "MEDIUM", "moderate").otherwise("low")


def speaker_reasons(name, hf, phase, telephony) -> Column:
    """RSK-09 reasons as an array of text."""
    n = as_col(name)
    base = F.lit(REASON["low"])
    for key in ("moderate", "elevated", "critical", "insufficient_data"):
        base = F.when(n == key, REASON[key]).otherwise(base)
    critical = n == "critical"
    scored = n != "insufficient_data"
    return F.array_compact(
        F.array(
            base,
            F.when(critical & (as_col(hf) > 0.015), F.lit(REASON_HF)),
            F.when(critical & (as_col(phase) > 0.55), F.lit(REASON_PHASE)),
            F.when(scored & as_col(telephony), F.lit(REASON_TELEPHONY)),
        )
    )


def call_decision(name, score) -> Column:
    """RSK-10 verdict of a call from the remote party's risk."""
    n, s = as_col(name), as_col(score)
    return (
        F.when(n.isin("critical", "elevated") | (s >= 60), "high_spoof_risk")
        .when((n == "moderate") | (s >= 25), "review_recommended")
        .otherwise("low_risk")
    )


# Guidance texts of the published call report.
GUIDANCE = {
    "high_spoof_risk": "Elevated synthetic voice risk detected for the remote participant (%s). Do not disclose money, passwords, OTPs, or sensitive financial data. Verify independently by calling the known official phone number.",
    "review_recommended": "The remote participant could not be verified with high confidence. Do not act on urgent or unusual financial requests; confirm via another trusted communication channel.",
    "low_risk": "Adequate clean speech analyzed with no strong synthetic evidence detected. Continue standard verification vigilance for sensitive operations.",
    "money": " [ALERT: High-value transaction requested during unverified call.]",
    "unusable": "Audio quality is insufficient for safe forensic evaluation (%s). Verify identity through an alternate trusted channel.",
    "overlap": "Severe overlapping speech detected. Audio collision prevents accurate speaker separation. Please ask the caller to repeat in turn.",
}


def call_guidance(decision, role, financial) -> Column:
    """RSK-10 guidance text with the money suffix."""
    d = as_col(decision)
    text = F.when(d == "high_spoof_risk", F.format_string(GUIDANCE["high_spoof_risk"], as_col(role))).when(d == "review_recommended", GUIDANCE["review_recommended"]).otherwise(GUIDANCE["low_risk"])
    return F.when(as_col(financial) & (d != "low_risk"), F.concat(text, F.lit(GUIDANCE["money"]))).otherwise(text)


def analysis_confidence(diarization_confidence, clean_seconds) -> Column:
    """RSK-11."""
    return rnd(as_col(diarization_confidence) * 0.5 + F.least(F.lit(1.0), as_col(clean_seconds) / 4.0) * 0.5, 2)


def stage(elapsed, speech) -> Column:
    """RSK-12."""
    e, s = as_col(elapsed), as_col(speech)
    return (
        F.when((e >= 10.0) | (s >= 4.5), "CONSOLIDATED_FINAL")
        .when((e >= 5.0) | (s >= 1.5), "PRELIMINARY_AVERAGE")
        .otherwise("CALIBRATING")
    )


def active_threat(risk_a, risk_b, speech_b) -> Column:
    """RSK-14, first half: the remote party, joined by the local one when it matters."""
    a, b = as_col(risk_a), as_col(risk_b)
    return F.when((as_col(speech_b) < 0.5) | (a >= 50.0), F.greatest(a, b)).otherwise(b)


def stage_risk(stage_name, active, history_mean, history_max) -> Column:
    """RSK-12 + RSK-14: the published call risk for each stage."""
    st, act = as_col(stage_name), as_col(active)
    final = F.when(act >= 50.0, F.greatest(act, F.coalesce(as_col(history_max), act))).otherwise(act)
    return (
        F.when(st == "CONSOLIDATED_FINAL", rnd(final, 1))
        .when(st == "PRELIMINARY_AVERAGE", rnd(F.coalesce(as_col(history_mean), act), 1))
        .otherwise(F.lit(5.0))
    )


def stage_level(stage_name, risk) -> Column:
    """RSK-13 level at 65 / 50 / 25."""
    r = as_col(risk)
    graded = F.when(r >= 65.0, "CRITICAL").when(r >= 50.0, "HIGH").when(r >= 25.0, "MEDIUM").otherwise("LOW")
    return F.when(as_col(stage_name) == "CALIBRATING", "CALIBRATING").otherwise(graded)


def stage_alert(level) -> Column:
    return as_col(level).isin("CRITICAL", "HIGH")


# Messages of the published live telemetry, by stage and level.
STAGE_TEXT = {
    "calibrating": "Calibrating acoustic baseline (%.0fs / 10s)... Preliminary score in %.0fs.",
    "preliminary": {
        "CRITICAL": "⚠️ PRELIMINARY WARNING: Potential AI clone (%.1f%% avg). Finalizing verification in %.0fs...",
        "HIGH": "⚠️ PRELIMINARY ALERT: Synthetic artifacts detected (%.1f%% avg). Stabilizing...",
        "MEDIUM": "Preliminary average risk: %.1f%% (Elevated ambient acoustics). Stabilizing...",
        "LOW": "Preliminary assessment: %.1f%% risk (Averaged over %.1fs speech). Finalizing in %.0fs...",
    },
    "final": {
        "CRITICAL": "🚨 CRITICAL ALERT: AI-Cloned Voice confirmed on %s! (Final Score: %.1f%%). DO NOT authorize wire transfers or payments.",
        "HIGH": "⚠️ HIGH SPOOF RISK: Confirmed synthetic vocal features on %s (Final Score: %.1f%%). Verify identity with a challenge question.",
        "MEDIUM": "Final assessment: %.1f%% risk. Ambient room acoustics or VoIP compression detected.",
        "LOW": "Call verified authentic (%.1f%% risk). Vocal biomechanics match natural human speech.",
    },
}


def stage_message(stage_name, level, risk, role, elapsed, speech) -> Column:
    """RSK-13 message."""
    st, lv, r, e = as_col(stage_name), as_col(level), as_col(risk), as_col(elapsed)
    left = F.greatest(F.lit(0.0), F.lit(10.0) - e)
    who = F.initcap(F.replace(as_col(role), F.lit("_"), F.lit(" ")))
    filled = {
        "preliminary": {"CRITICAL": (r, left), "HIGH": (r,), "MEDIUM": (r,), "LOW": (r, as_col(speech), left)},
        "final": {"CRITICAL": (who, r), "HIGH": (who, r), "MEDIUM": (r,), "LOW": (r,)},
    }

    def by_level(kind):
        text = {k: F.format_string(STAGE_TEXT[kind][k], *values) for k, values in filled[kind].items()}
        return F.when(lv == "CRITICAL", text["CRITICAL"]).when(lv == "HIGH", text["HIGH"]).when(lv == "MEDIUM", text["MEDIUM"]).otherwise(text["LOW"])

    calibrating = F.format_string(STAGE_TEXT["calibrating"], e, F.greatest(F.lit(0.0), F.lit(5.0) - e))
    return F.when(st == "CALIBRATING", calibrating).when(st == "PRELIMINARY_AVERAGE", by_level("preliminary")).otherwise(by_level("final"))


def session_verdict(peak) -> Column:
    """AGG-22 verdict at 65 / 50."""
    p = as_col(peak)
    return F.when(p >= 65.0, "CRITICAL_CLONE_DETECTED").when(p >= 50.0, "HIGH_SPOOF_RISK").otherwise("AUTHENTIC_CALL")


def prediction_record(prob, tau) -> Column:
    """RSK-15: prediction, both probabilities and the confidence, rounded to 4."""
    p, t = as_col(prob), as_col(tau)
    return F.struct(
        F.when(p >= t, "spoof").otherwise("genuine").alias("prediction"),
        rnd(p, 4).alias("spoof_probability"),
        rnd(F.lit(1.0) - p, 4).alias("genuine_probability"),
        rnd(F.greatest(p, F.lit(1.0) - p), 4).alias("confidence"),
        t.alias("calibrated_threshold"),
    )
