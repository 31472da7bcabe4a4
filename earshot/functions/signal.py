"""Signal measures on ``ARRAY<FLOAT>`` columns with built-in array functions (SIG-01 .. 05, 07, 08, 15, 19, 20)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, clamp, let, rnd


def total(x, f=lambda v: v) -> Column:
    return F.aggregate(as_col(x), F.lit(0.0), lambda s, v: s + f(v.cast("double")))


def mean(x, f=lambda v: v) -> Column:
    c = as_col(x)
    return F.when(F.size(c) > 0, total(c, f) / F.size(c)).otherwise(F.lit(0.0))


def std(x) -> Column:
    """Population standard deviation of an array (AGG-25)."""
    return let(x, lambda c: let(mean(c), lambda m: F.sqrt(mean(c, lambda v: (v - m) * (v - m)))))


def rms(x) -> Column:
    """SIG-02."""
    return F.sqrt(mean(x, lambda v: v * v))


def peak(x) -> Column:
    """SIG-02."""
    return F.coalesce(F.array_max(F.transform(as_col(x), lambda v: F.abs(v))).cast("double"), F.lit(0.0))


def normalise_peak(x, target: float = 0.95, minimum: float = 0.03) -> Column:
    """SIG-01: scale to the target peak unless the clip is only room noise."""
    scaled = lambda c, m: F.when(m < minimum, c).otherwise(F.transform(c, lambda v: v / m * target))
    return let(as_col(x).cast("array<double>"), lambda c: let(peak(c), lambda m: scaled(c, m)))


def clipping_ratio(x, threshold: float = 0.99, strict: bool = False) -> Column:
    """SIG-03: share of samples at or above (``strict``: above) the limit."""
    c = as_col(x)
    hit = F.filter(c, lambda v: F.abs(v) > threshold if strict else F.abs(v) >= threshold)
    return F.when(F.size(c) > 0, F.size(hit) / F.size(c)).otherwise(F.lit(0.0))


def frames(x, length: int, hop: int, centred: bool = False) -> Column:
    """WIN-17: array of frames; ``centred`` pads half a frame of zeros on both sides."""
    samples = as_col(x).cast("array<double>")
    if centred:
        zeros = F.array_repeat(F.lit(0.0), length // 2)
        samples = F.concat(zeros, samples, zeros)

    def cut(c):
        count = F.floor((F.size(c) - length) / F.lit(hop)) + 1
        starts = F.when(count >= 1, F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<bigint>"))
        # by index: ``slice`` would copy the whole clip for every frame
        offsets = F.sequence(F.lit(0), F.lit(length - 1))
        return F.transform(starts, lambda i: F.transform(offsets, lambda j: F.get(c, (i * hop).cast("int") + j)))

    return let(samples, cut)


def percentile_of(values, q: float) -> Column:
    """Linear-interpolation percentile of an array column."""

    def pick(s):
        pos = (F.size(s) - 1) * q
        lo = F.floor(pos).cast("int")
        a, b = F.get(s, lo), F.coalesce(F.get(s, lo + 1), F.get(s, lo))
        return a + (b - a) * (pos - lo)

    return let(F.sort_array(as_col(values)), pick)


def snr_tier_db(x, frame: int = 320) -> Column:
    """SIG-04: 10 log10 of p90/p10 frame energy, in [-10, 50]; 0 when too short, 40 without a noise floor."""

    def grade(energies):
        hi, lo = percentile_of(energies, 0.9), percentile_of(energies, 0.1)
        db = F.log10(F.greatest(hi / lo, F.lit(1e-3))) * 10.0
        return F.when(F.size(energies) < 2, 0.0).when(lo <= 1e-12, 40.0).otherwise(rnd(clamp(db, -10.0, 50.0), 2))

    return let(F.transform(frames(x, frame, frame), lambda f: mean(f, lambda v: v * v) + 1e-12), grade)


def frame_rms(x, frame: int, hop: int, centred: bool = True) -> Column:
    return F.transform(frames(x, frame, hop, centred), rms)


def gate_measures(frame_levels, hop: int = 240, rate: int = 16000, activity: float = 0.08) -> dict[str, Column]:
    """SIG-05 from an array of 30/15 ms frame levels: usable seconds, speech ratio, SNR. Frames at ``activity`` times the
    95th percentile are speech."""
    r = as_col(frame_levels)
    p95, p10 = percentile_of(r, 0.95), percentile_of(r, 0.10)
    active = let(F.greatest(F.lit(1e-4), p95 * activity), lambda limit: F.size(F.filter(r, lambda v: v >= limit)))
    some = (F.size(r) > 0) & (F.array_max(r) > 1e-5)
    return {
        "usable_sec": F.when(some, active * hop / F.lit(float(rate))).otherwise(0.0),
        "speech_ratio": F.when(some, active / F.size(r)).otherwise(0.0),
        "snr_db": F.when(some, F.log10((p95 + 1e-6) / (p10 + 1e-6)) * 20.0).otherwise(0.0),
    }


def loud_frames(levels, top_db: float) -> Column:
    """Per frame: within ``top_db`` of the loudest one."""
    power = F.transform(as_col(levels), lambda v: F.greatest(F.lit(1e-10), v * v))
    return let(power, lambda p: let(F.array_max(p) * 10 ** (-top_db / 10.0), lambda floor: F.transform(p, lambda v: v > floor)))


def cut_silence(x, top_db: float = 30.0, frame: int = 2048, hop: int = 512, levels=None) -> Column:
    """SIG-07: keep the hops whose frame is within ``top_db`` of the loudest; unchanged when none is.

    ``levels`` takes frame levels measured elsewhere (long clips: by the NumPy helper).
    """
    c = as_col(x)
    measured = frame_rms(c, frame, hop) if levels is None else as_col(levels)
    keep = lambda flags: F.filter(c, lambda v, i: F.coalesce(F.get(flags, F.floor(i / F.lit(hop)).cast("int")), F.lit(False)))
    return let(let(loud_frames(measured, top_db), keep), lambda v: F.when(F.coalesce(F.size(v), F.lit(0)) > 0, v).otherwise(c))


def voiced_or_whole(x, top_db: float = 28.0, shortest: int = 8000, levels=None) -> Column:
    """The silence-cut clip when at least half a second remains, the clip itself otherwise."""
    return let(cut_silence(x, top_db, levels=levels), lambda cut: F.when(F.size(cut) >= shortest, cut).otherwise(as_col(x)))


def sign_changes(frame) -> Column:
    """Share of neighbouring samples with different sign bits."""
    f = as_col(frame)
    n = F.size(f) - 1
    pairs = F.zip_with(F.slice(f, 1, n), F.slice(f, 2, n), lambda a, b: ((a < 0) != (b < 0)).cast("double"))
    return F.when(n > 0, mean(pairs)).otherwise(F.lit(0.0))


def zero_crossings(x, frame: int = 512, hop: int = 256) -> Column:
    """SIG-08: crossing rate per frame; one frame for a short clip."""
    c = as_col(x).cast("array<double>")
    return F.when(F.size(c) >= frame, F.transform(frames(c, frame, hop), sign_changes)).otherwise(F.array(sign_changes(c)))


def relative_step(values, eps: float = 1e-6) -> Column:
    """SIG-15 / WIN-07 on an array: mean |difference| over mean; 0 for fewer than three values."""

    def measure(v):
        n = F.size(v) - 1
        steps = F.zip_with(F.slice(v, 1, n), F.slice(v, 2, n), lambda a, b: F.abs(b - a))
        return F.when(n > 1, mean(steps) / (mean(v) + eps)).otherwise(F.lit(0.0))

    return let(values, measure)


def overlap_score(f0, flatness) -> dict[str, Column]:
    """SIG-19 from pitch and flatness per frame: share of jumps above 75 Hz with the spread of flatness."""
    voiced = F.filter(as_col(f0), lambda v: (v > 65.0) & (v < 1500.0))
    n = F.size(voiced) - 1
    jumps = F.zip_with(F.slice(voiced, 1, n), F.slice(voiced, 2, n), lambda a, b: (F.abs(b - a) > 75.0).cast("double"))
    share = F.when(n > 7, mean(jumps)).otherwise(F.lit(0.0))
    spread = std(flatness)
    hit = ((share >= 0.065) & (spread >= 0.040)) | (share >= 0.22)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.65), share * 3.0 + spread * 8.0))
    return {"jump_ratio": share, "flatness_std": spread, "is_overlap": hit, "overlap_conf": F.when(hit, rnd(score, 3)).otherwise(0.0)}


def _grid(v: Column) -> Column:
    """8-bit grid on [-1, 1]; halves go to the even step."""
    return F.rint((v + 1.0) * 127.5) / 127.5 - 1.0


def mu_law(v, mu: float = 255.0) -> Column:
    """SIG-20: compress, quantise to 8 bits, expand."""
    x = clamp(as_col(v).cast("double"), -1.0, 1.0)
    q = _grid(F.signum(x) * F.log1p(F.abs(x) * mu) / math.log(1.0 + mu))
    return F.signum(q) * (F.pow(F.lit(1.0 + mu), F.abs(q)) - 1.0) / mu


def a_law(v, a: float = 87.6) -> Column:
    """SIG-20: the piecewise A-law curve."""
    x = clamp(as_col(v).cast("double"), -1.0, 1.0)
    k = 1.0 + math.log(a)
    m = F.abs(x)
    # the logarithm is only reached where its argument is at least 1
    curve = F.when(m < 1.0 / a, m * a / k).otherwise((F.log(F.greatest(m * a, F.lit(1.0))) + 1.0) / k)
    q = _grid(F.signum(x) * curve)
    mq = F.abs(q)
    return F.signum(q) * F.when(mq < 1.0 / k, mq * k / a).otherwise(F.exp(mq * k - 1.0) / a)


def companding_error(x, codec: str) -> Column:
    """SIG-20: mean absolute error of a clip through a codec."""
    f = {"mu_law": mu_law, "a_law": a_law}[codec]
    return mean(F.transform(as_col(x), lambda v: F.abs(f(v) - v.cast("double"))))
