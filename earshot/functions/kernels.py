"""NumPy helpers for what array functions cannot express: FFT, mel bands, pitch (SIG-06, 09 .. 14).

They run inside Arrow batches and return per-frame values; averages, spreads and vectors are built by
Spark from those. Frames are handled in blocks, so memory does not grow with the length of a clip.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

RATE, FRAME_BLOCK = 16000, 2048


def decode_pcm(raw: bytes, channels: int = 1) -> np.ndarray:
    """SRC-14 / SRC-16: int16 little-endian to [-1, 1], odd trailing byte dropped, channels averaged."""
    whole = len(raw) - len(raw) % (2 * channels)
    x = np.frombuffer(raw[:whole], dtype="<i2").astype(np.float32) / np.float32(32768.0)
    return x if channels == 1 else x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def padded(y: np.ndarray, before: int, after: int) -> np.ndarray:
    """``np.pad`` with zeros, without its cost for short clips."""
    y = np.asarray(y)
    out = np.zeros(before + len(y) + after, dtype=y.dtype)
    out[before : before + len(y)] = y
    return out


def framed(y: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Views of ``size`` samples every ``hop``, the tail dropped."""
    y = np.ascontiguousarray(y)
    return np.ndarray(((len(y) - size) // hop + 1, size), y.dtype, y, 0, (hop * y.itemsize, y.itemsize))


def frame_blocks(y: np.ndarray, size: int, hop: int):
    """Zero-padded, centred frames, a block at a time."""
    view = framed(padded(y, size // 2, size // 2), size, hop)
    for i in range(0, len(view), FRAME_BLOCK):
        yield view[i : i + FRAME_BLOCK]


@lru_cache(maxsize=8)
def mel_bank(n_fft: int, rate: int = RATE, bands: int = 128) -> np.ndarray:
    """Triangular mel bands of equal area: linear below 1 kHz, logarithmic above (27 steps per factor 6.4)."""
    knee, linear, log_step = 1000.0, 200.0 / 3, np.log(6.4) / 27.0

    def to_mel(hz):
        hz = np.asarray(hz, dtype=float)
        return np.where(hz < knee, hz / linear, knee / linear + np.log(np.maximum(hz, knee) / knee) / log_step)

    def to_hz(mel):
        return np.where(mel < knee / linear, mel * linear, knee * np.exp(log_step * (mel - knee / linear)))

    edges = to_hz(np.linspace(to_mel(0.0), to_mel(rate / 2), bands + 2))
    freqs = np.fft.rfftfreq(n_fft, 1.0 / rate)
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    shape = np.minimum((freqs - left) / (centre - left), (right - freqs) / (right - centre))
    return np.maximum(0.0, shape) * (2.0 / (right - left))


@lru_cache(maxsize=8)
def cosine_basis(bands: int, keep: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    k = np.arange(keep)[:, None]
    basis = np.cos(np.pi * k * (np.arange(bands) + 0.5) / bands) * np.sqrt(2.0 / bands)
    basis[0] /= np.sqrt(2.0)
    return basis


def decibels(power: np.ndarray) -> np.ndarray:
    """10 log10 with a floor 80 dB below the largest value."""
    db = 10.0 * np.log10(np.maximum(1e-10, power))
    return np.maximum(db, db.max() - 80.0) if db.size else db


def spectral_frames(y: np.ndarray, n_fft: int = 1024, hop: int = 512, n_mfcc: int = 20, finer: int = 1) -> dict[str, np.ndarray]:
    """SIG-10, 11, 13: descriptors of the magnitude spectrum per frame.

    With ``finer`` (a power of two) the coefficients are also taken of frames every ``hop // finer``, as ``mfcc_fine``; these
    frames hold the others.
    """
    y = padded(y, 0, max(0, n_fft - len(y)))
    freqs = np.fft.rfftfreq(n_fft, 1.0 / RATE)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    bank = mel_bank(n_fft)
    cols = {k: [] for k in ("flatness", "centroid", "bandwidth", "rolloff", "mel", "fine", "top", "bottom")}
    for block in frame_blocks(y, n_fft, hop // finer):
        mag = np.abs(np.fft.rfft(block * window, axis=1))
        power = mag**2
        if finer > 1:
            cols["fine"].append(power @ bank.T)
            mag, power = mag[::finer], power[::finer]
        floor = np.maximum(1e-10, power)
        cols["flatness"].append(np.exp(np.log(floor).mean(axis=1)) / floor.mean(axis=1))
        weight = mag / np.maximum(mag.sum(axis=1, keepdims=True), 1e-30)
        centroid = weight @ freqs
        cols["centroid"].append(centroid)
        cols["bandwidth"].append(np.sqrt((weight * (freqs[None, :] - centroid[:, None]) ** 2).sum(axis=1)))
        cum = mag.cumsum(axis=1)
        cols["rolloff"].append(freqs[(cum >= 0.85 * cum[:, -1:]).argmax(axis=1)])
        cols["mel"].append(cols["fine"][-1][::finer] if finer > 1 else power @ bank.T)
        top, bottom = band_extremes(mag, freqs)
        cols["top"].append(top)
        cols["bottom"].append(bottom)
    out = {k: np.concatenate(v) for k, v in cols.items() if v}
    contrast = decibels(out.pop("top")) - decibels(out.pop("bottom"))
    basis = cosine_basis(bank.shape[0], n_mfcc).T
    fine = {"mfcc_fine": (decibels(out.pop("fine")) @ basis).T} if finer > 1 else {}
    mfcc = decibels(out.pop("mel")) @ basis
    return {**out, "contrast": contrast.ravel(), "mfcc": mfcc.T, **fine}


def band_extremes(mag: np.ndarray, freqs: np.ndarray, lowest: float = 200.0, octaves: int = 6, share: float = 0.02):
    """SIG-11: mean of the strongest and weakest 2 % of bins in [0, 200) and six octaves above."""
    edges = np.concatenate([[0.0], lowest * 2.0 ** np.arange(octaves + 1)])
    starts, ends = np.searchsorted(freqs, edges[:-1], "left").tolist(), np.searchsorted(freqs, edges[1:], "right").tolist()
    top, bottom = [], []
    for k in range(octaves + 1):
        first = starts[k] - (1 if k else 0)  # a band also takes the bin below its edge
        last = len(freqs) - 1 if k == octaves else ends[k] - 1
        n = max(1, round(share * (last - first + 1)))
        band = mag[:, first : last + (1 if k == octaves else 0)]  # and gives up its last, but for the highest
        if n == 1:
            bottom.append(band.min(axis=1))
            top.append(band.max(axis=1))
            continue
        band = np.sort(band, axis=1)
        bottom.append(band[:, :n].mean(axis=1))
        top.append(band[:, -n:].mean(axis=1))
    return np.stack(top, axis=1), np.stack(bottom, axis=1)


def pitch(y: np.ndarray, fmin: float = 65.0, fmax: float = 500.0, size: int = 1024, hop: int = 512, limit: float = 0.1) -> np.ndarray:
    """SIG-14: YIN f0 per frame, half the frame as integration window, parabolic refinement."""
    return np.concatenate([pitch_of_frames(b, fmin, fmax, limit) for b in frame_blocks(np.asarray(y, dtype=float), size, hop)])


def pitch_of_frames(frames: np.ndarray, fmin: float = 65.0, fmax: float = 500.0, limit: float = 0.1) -> np.ndarray:
    """``pitch`` of frames that are cut already, a row each."""
    size = frames.shape[1]
    half = size // 2
    shortest, longest = int(RATE // fmax), min(int(np.ceil(RATE / fmin)), size - half - 1)
    lags = np.arange(longest + 2)
    out = []
    for block in (frames[i : i + FRAME_BLOCK] for i in range(0, len(frames), FRAME_BLOCK)):
        n = 2 * size
        cross = np.fft.irfft(np.conj(np.fft.rfft(block[:, :half], n, axis=1)) * np.fft.rfft(block, n, axis=1), n, axis=1)
        energy = np.concatenate([np.zeros((len(block), 1)), (block**2).cumsum(axis=1)], axis=1)
        shifted = energy[:, lags + half] - energy[:, lags]
        diff = np.maximum(0.0, shifted[:, :1] + shifted - 2 * cross[:, lags])
        running = diff[:, 1:].cumsum(axis=1)
        norm = np.ones_like(diff)
        norm[:, 1:] = diff[:, 1:] * lags[1:] / np.maximum(running, 1e-12)
        d = norm[:, shortest : longest + 1]
        before, after = norm[:, shortest - 1 : longest], norm[:, shortest + 1 : longest + 2]
        trough = (d < before) & (d <= after) & (d < limit)
        best = np.where(trough.any(axis=1), trough.argmax(axis=1), d.argmin(axis=1))
        rows = np.arange(len(d))
        b, c, a = d[rows, best], before[rows, best], after[rows, best]
        bend = c + a - 2 * b
        shift = np.where(np.abs(bend) > 1e-12, 0.5 * (c - a) / np.where(np.abs(bend) > 1e-12, bend, 1.0), 0.0)
        period = best + shortest + np.where(np.abs(shift) < 1, shift, 0.0)
        out.append(RATE / period)
    return np.concatenate(out)


def frame_levels(y: np.ndarray, size: int = 1024, hop: int = 512) -> np.ndarray:
    return np.concatenate([np.sqrt((b**2).mean(axis=1)) for b in frame_blocks(y, size, hop)])


def phase_step_variance(y: np.ndarray) -> float:
    """SIG-09: variance of the steps of the unwrapped phase of the analytic signal."""
    n = len(y)
    if n < 128:
        return 0.0
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    return float(np.var(np.diff(np.unwrap(np.angle(np.fft.ifft(np.fft.fft(y) * gain))))))


def energy_shares(y: np.ndarray, *bands: tuple[float, float, float]) -> list[float]:
    """SIG-06 / SIG-12: share of spectral energy between two frequencies, both included, per (low, high, eps)."""
    power = np.abs(np.fft.rfft(y)) ** 2
    freqs, total = np.fft.rfftfreq(len(y), 1.0 / RATE), power.sum()
    return [float(power[np.searchsorted(freqs, low, "left") : np.searchsorted(freqs, high, "right")].sum() / (total + eps)) for low, high, eps in bands]


def energy_share(y: np.ndarray, low: float, high: float, eps: float) -> float:
    return energy_shares(y, (low, high, eps))[0]


def gate_measures(levels: np.ndarray, hop: int = 240, activity: float = 0.08) -> tuple[float, float, float]:
    """SIG-05, as ``signal.gate_measures``: usable seconds, speech ratio and SNR from frame levels."""
    if not len(levels) or levels.max() <= 1e-5:
        return 0.0, 0.0, 0.0
    ordered = np.sort(levels)

    def percentile(q: float) -> float:
        at = (len(ordered) - 1) * q
        low = int(at)
        a, b = float(ordered[low]), float(ordered[min(low + 1, len(ordered) - 1)])
        return a + (b - a) * (at - low)

    p95, p10 = percentile(0.95), percentile(0.10)
    active = int((levels >= max(1e-4, p95 * activity)).sum())
    return active * hop / float(RATE), active / len(levels), float(np.log10((p95 + 1e-6) / (p10 + 1e-6)) * 20.0)


def moments(y: np.ndarray) -> tuple[float, float]:
    """AGG-26: biased skewness and excess kurtosis, 0 for a constant clip."""
    if y.max() == y.min():  # the mean of equal values need not be that value
        return 0.0, 0.0
    c = y - y.mean()
    var = (c**2).mean()
    if var <= 0:
        return 0.0, 0.0
    return float((c**3).mean() / var**1.5), float((c**4).mean() / var**2 - 3.0)


def mean(x: np.ndarray) -> float:
    return float(np.mean(x)) if len(x) else 0.0


def std(x: np.ndarray) -> float:
    return float(np.std(x)) if len(x) else 0.0


def relative_step(x: np.ndarray, eps: float = 1e-6) -> float:
    """SIG-15: mean |difference| over mean; 0 for fewer than three values."""
    return float(np.abs(np.diff(x)).mean() / (np.mean(x) + eps)) if len(x) > 2 else 0.0


def normalise_peak(y: np.ndarray, target: float = 0.95, minimum: float = 0.03) -> np.ndarray:
    """SIG-01; one factor for all samples, so a clip read in chunks has the same bits."""
    top = np.abs(y).max() if len(y) else 0.0
    return y if top < minimum else y * (target / top)


def voiced(y: np.ndarray, top_db: float = 28.0, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """SIG-07: hops whose frame is within ``top_db`` of the loudest."""
    if not len(y):
        return y
    power = np.maximum(1e-10, frame_levels(y, frame, hop) ** 2)
    return y[np.repeat(power > power.max() * 10 ** (-top_db / 10.0), hop)[: len(y)]]


def voiced_or_whole(y: np.ndarray, top_db: float = 28.0, shortest: int = 8000) -> np.ndarray:
    """SIG-07: ``voiced``; the whole clip where too little is left."""
    cut = voiced(y, top_db)
    return cut if len(cut) >= max(shortest, 1) else y
