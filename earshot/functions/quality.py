"""Audio quality rules (PRJ-06 .. PRJ-10) over measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col

MIN_SPEECH_SEC, MIN_SNR_DB, MAX_CLIPPING_PCT = 1.5, 4.0, 8.0


def gate_faults(speech_sec, snr_db, clipping_pct, min_speech: float = MIN_SPEECH_SEC, min_snr: float = MIN_SNR_DB, max_clipping: float = MAX_CLIPPING_PCT):
    """PRJ-06 tests of columns or of numbers: too short, too much clipped, too noisy."""
    return speech_sec < min_speech, clipping_pct > max_clipping, snr_db < min_snr


def quality_gate(
    speech_sec,
    snr_db,
    clipping_pct,
    telephony,
    min_speech: float = MIN_SPEECH_SEC,
    min_snr: float = MIN_SNR_DB,
    max_clipping: float = MAX_CLIPPING_PCT,
    total_sec=None,
) -> dict[str, Column]:
    """PRJ-06: level, usability and the reason for a rejection."""
    s, n, c, t = as_col(speech_sec), as_col(snr_db), as_col(clipping_pct), as_col(telephony)
    empty = F.lit(False) if total_sec is None else as_col(total_sec) == 0
    short, clipped, noisy = gate_faults(s, n, c, min_speech, min_snr, max_clipping)
    return {
        "quality_level": F.when(empty | short, "unusable")
        .when(clipped | noisy, "poor")
        .when((n < 10.0) | t | (c > 3.0), "moderate")
        .otherwise("good"),
        "is_usable": ~(empty | short | clipped | noisy),
        "rejection_reason": F.when(empty, F.lit("Audio buffer is empty."))
        .when(short, F.format_string(f"Usable speech duration (%.1fs) is below required minimum ({min_speech}s).", s))
        .when(clipped, F.format_string("Severe microphone clipping detected (%.1f%% of samples distorted).", c))
        .when(noisy, F.format_string("Excessive background noise or low SNR (%.1f dB).", n))
        .otherwise(F.lit("")),
    }


def quality_tier(snr_db, clipping_ratio, rms) -> dict[str, Column]:
    """PRJ-07: EXCELLENT / ACCEPTABLE / DEGRADED and whether the clip can still be used."""
    n, c, r = as_col(snr_db), as_col(clipping_ratio), as_col(rms)
    degraded = (c > 0.05) | (n < 5.0) | (r < 0.005)
    return {
        "quality_rating": F.when(degraded, "DEGRADED").when((n < 15.0) | (c > 0.01), "ACCEPTABLE").otherwise("EXCELLENT"),
        "tier_usable": F.when(degraded, (n >= 0.0) & (r >= 0.002)).otherwise(F.lit(True)),
    }


def live_quality(rms, clipped_share) -> Column:
    """PRJ-08."""
    r, c = as_col(rms), as_col(clipped_share)
    return F.when(r < 0.003, "SILENT").when(c > 0.05, "CLIPPED").when(r < 0.012, "FAIR").otherwise("GOOD")


def monitor_voiced(rms, peak) -> Column:
    """PRJ-09, call monitor."""
    return (as_col(rms) > 0.0035) | (as_col(peak) > 0.018)


def session_voiced(rms, peak, quality) -> Column:
    """PRJ-09, live session."""
    return ((as_col(rms) > 0.015) | (as_col(peak) > 0.06)) & (as_col(quality) != "SILENT")


# Near-silence limits (rms, peak) and the result published instead of a score.
SILENCE_RULES = {
    "batch": (0.005, 0.025, 2.0),
    "stream": (0.006, 0.030, 2.5),
    "deep": (0.0035, 0.018, 5.0),
}


def near_silent(mode: str, rms, peak) -> Column:
    """PRJ-10 test."""
    rms_limit, peak_limit, _ = SILENCE_RULES[mode]
    return (as_col(rms) < rms_limit) & (as_col(peak) < peak_limit)


def silence_or(mode: str, rms, peak, score) -> Column:
    """PRJ-10: the fixed LOW result for near silence, the given score otherwise."""
    return F.when(near_silent(mode, rms, peak), F.lit(SILENCE_RULES[mode][2])).otherwise(as_col(score))
