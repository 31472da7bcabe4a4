"""Feature jobs over clips (SIG-06, 09 .. 17, 19, AGG-25, SRT-01, PRJ-13, PRJ-15).

One Arrow pass per clip yields the statistics of its frames (``summarise_clips``), or the frames themselves as arrays
(``describe_clips``), of which built-in array functions make statistics and vectors. No feature job shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StructField, StructType

from ..functions import kernels as K
from ..functions import signal as S
from ..functions.numeric import finite_or_zero
from ..functions.vectors import direction

N_MFCC = 20
SAMPLES = ArrayType(FloatType())
SOUND_FACTS = StructType([StructField("n", IntegerType()), StructField("finite", BooleanType()), StructField("rms", DoubleType()), StructField("peak", DoubleType())])
DESCRIPTOR_TYPES = (
    "n_samples int, skewness double, kurtosis double, phase_var double, hf_ratio double, band_share double, "
    "zcr array<double>, rms array<double>, f0 array<double>, flatness array<double>, centroid array<double>, "
    "bandwidth array<double>, rolloff array<double>, contrast array<double>, mfcc array<array<double>>"
)


@F.pandas_udf(SAMPLES)
def pcm_to_samples(raw: pd.Series) -> pd.Series:
    """SRC-16: mono int16 bytes to samples."""
    return raw.map(lambda b: K.decode_pcm(b or b""))


@F.pandas_udf(SAMPLES)
def pcm_to_samples_n(raw: pd.Series, channels: pd.Series) -> pd.Series:
    """SRC-16 with a channel count per row."""
    return pd.Series([K.decode_pcm(b or b"", int(c)) for b, c in zip(raw, channels)])


@F.pandas_udf(SOUND_FACTS)
def sound_facts(pcm: pd.Series) -> pd.DataFrame:
    """SIG-02 and PRJ-15 in one pass over the samples; a missing clip is empty."""
    return pd.DataFrame([facts_of(np.asarray([] if y is None else y, dtype=np.float64)) for y in pcm], columns=["n", "finite", "rms", "peak"])


def facts_of(y: np.ndarray) -> tuple[int, bool, float, float]:
    """``sound_facts`` of one clip."""
    finite = bool(np.isfinite(y).all())
    heard = len(y) and finite
    return len(y), finite, float(np.sqrt((y * y).mean())) if heard else 0.0, float(np.abs(y).max()) if heard else 0.0


def heard(value) -> np.ndarray:
    """Samples of one clip, given as samples or as int16 bytes; a missing clip is empty."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        value = K.decode_pcm(value)
    return np.asarray([] if value is None else value, dtype=np.float64)


def reject_reason(facts: str) -> Column:
    """PRJ-15 from ``sound_facts``; NULL for a usable clip."""
    return F.when(F.col(f"{facts}.n") <= 0, "empty").when(~F.col(f"{facts}.finite"), "not finite")


def usable_clips(clips: DataFrame, pcm: str = "pcm") -> tuple[DataFrame, DataFrame]:
    """PRJ-15: clips with finite, non-empty samples, and the rejected rest with a reason."""
    tagged = clips.withColumn("__facts", sound_facts(pcm)).withColumn("reject_reason", reject_reason("__facts")).drop("__facts")
    return tagged.filter("reject_reason IS NULL").drop("reject_reason"), tagged.filter("reject_reason IS NOT NULL")


@F.pandas_udf(ArrayType(DoubleType()))
def normalised(pcm: pd.Series) -> pd.Series:
    """SIG-01 on long clips."""
    return pcm.map(lambda y: K.normalise_peak(np.asarray(y, dtype=np.float64)))


def scaled(pcm, target: float, minimum: float) -> Column:
    """Clips scaled to a peak of ``target``; those below ``minimum`` stay as they are."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def scale(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda y: K.normalise_peak(np.asarray([] if y is None else y, dtype=np.float64), target, minimum))

    return scale(pcm)


def voiced_and_normalised(pcm, top_db: float = 28.0, shortest: int = 8000) -> Column:
    """SIG-07 then SIG-01 on long clips: the silence-cut clip where enough remains, the clip itself otherwise."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def prepare(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda y: K.normalise_peak(K.voiced_or_whole(np.asarray([] if y is None else y, dtype=np.float64), top_db, shortest)))

    return prepare(pcm)


def cut_at_silence(pcm, top_db: float = 28.0) -> Column:
    """SIG-07 on long clips: the hops that are kept, however few; empty for a missing clip."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def cut(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda y: K.voiced(np.asarray([] if y is None else y, dtype=np.float64), top_db))

    return cut(pcm)


@F.pandas_udf(ArrayType(DoubleType()))
def silence_levels(pcm: pd.Series) -> pd.Series:
    """Frame levels for SIG-07 (2048 samples every 512), of clips of any length."""
    return pcm.map(lambda y: K.frame_levels(np.asarray(y, dtype=np.float64), 2048, 512) if len(y) else np.zeros(1))


SMALL = 1 << 20  # samples of the rows that are handed on together


def _slices(clips, most: int = SMALL) -> Iterator[slice]:
    """Neighbouring rows of about ``most`` samples (or bytes) in all, one row at least."""
    first, held = 0, 0
    sizes = [0 if y is None else len(y) for y in clips]
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(sizes):
        yield slice(first, len(sizes))


def change_clips(clips: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None = None, pcm: str = "pcm", kind: str = "double", where: str | None = None) -> DataFrame:
    """``clips`` with ``pcm`` (samples, or int16 bytes) replaced by ``change`` of each clip's samples, as array<``kind``>.

    For jobs over whole tables, in place of column functions: those hold a whole Arrow batch of clips at every step, each
    step wider than the one before, while this hands on a few clips at a time. A missing clip is empty. With ``where`` only
    rows with that flag are changed; the others are handed on as they are.
    """
    schema = ", ".join(f"`{f.name}` {f'array<{kind}>' if f.name == pcm else f.dataType.simpleString()}" for f in clips.schema.fields)
    width = np.float32 if kind == "float" else np.float64

    def run(batches):
        import pyarrow as pa

        def samples(value) -> np.ndarray:
            if not value.is_valid:
                return np.zeros(0, dtype=width)
            return K.decode_pcm(memoryview(value.as_buffer())) if hasattr(value, "as_buffer") else value.values.to_numpy(zero_copy_only=False)

        def packed(batch, first: int, ys: list[np.ndarray]):
            ends = np.cumsum([0, *map(len, ys)]).astype(np.int32)
            columns = batch.slice(first, len(ys)).columns
            columns[at] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ys).astype(width, copy=False)))
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        for batch in batches:
            at = batch.schema.get_field_index(pcm)
            flags = batch.column(batch.schema.get_field_index(where)).to_pylist() if where else None
            first, held, ys = 0, 0, []
            for i, value in enumerate(batch.column(at)):
                y = samples(value)
                if change is not None and (flags is None or flags[i]):
                    y = change(y.astype(np.float64))
                ys.append(y.astype(width, copy=False))
                held += len(y)
                if held >= SMALL:
                    yield packed(batch, first, ys)
                    first, held, ys = i + 1, 0, []
            if ys:
                yield packed(batch, first, ys)

    return clips.mapInArrow(run, schema)


def cut_spans(df: DataFrame, pcm: str = "pcm", spans: str = "spans", batch: int = 64) -> DataFrame:
    """One row per span: all other columns, ``pos``, ``s``, ``e`` and the samples, zero padded to e - s.

    ``spans`` is an array of (s, e). Array views in Arrow batches, so the cost is that of the samples
    cut, whatever the length of the clip.
    """
    kept = [c for c in df.columns if c not in (pcm, spans)]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", pos int, s int, e int, pcm array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, rows = [*kept, "pos", "s", "e", "pcm"], []
        for pdf in batches:
            for record in pdf[[*kept, pcm, spans]].itertuples(index=False, name=None):
                *head, y, cuts = record
                y = np.asarray(y, dtype=np.float32)
                for pos, cut in enumerate(cuts):
                    s, e = cut["s"], cut["e"]
                    part = y[max(s, 0) : max(e, 0)]
                    rows.append((*head, pos, s, e, np.pad(part, (0, max(0, e - s - len(part)))) if s >= 0 else part[:0]))
                    if len(rows) >= batch:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return df.mapInPandas(run, schema)


def sliding_spans(pcm: str = "pcm", window: int = 48000, hop: int = 16000) -> Column:
    """WIN-01 as spans of one clip: a short clip is one padded window, the tail is dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(pcm) - window, F.lit(0)), F.lit(hop))
    return F.transform(starts, lambda s: F.struct(s.alias("s"), (s + window).alias("e")))


def _describe(y: np.ndarray, n_fft: int, hop: int, fmax: float, finer: int = 1) -> dict:
    """Per-frame descriptors; with ``finer`` also pitch and coefficients every ``hop // finer``, from the same frames."""
    y = np.asarray(y, dtype=np.float64)
    if len(y) == 0:
        y = np.zeros(1)
    skew, kurt = K.moments(y) if len(y) >= 128 else (0.0, 0.0)
    above, speech = (4000.0, K.RATE, 1e-10), (300.0, 3400.0, 1e-9)
    if n_fft <= len(y) <= 4 * K.RATE:
        hf_ratio, band_share = K.energy_shares(y, above, speech)
    else:
        hf_ratio, band_share = K.energy_share(K.padded(y, 0, max(0, n_fft - len(y))), *above), K.energy_share(y[: 4 * K.RATE], *speech)
    signs = np.diff(np.signbit(K.framed(y, min(512, len(y)), 256)), axis=1)
    f0 = K.pitch(y, fmax=fmax, size=n_fft, hop=hop // finer)
    fine = {"f0_fine": f0} if finer > 1 else {}
    return {
        "n_samples": len(y), "skewness": skew, "kurtosis": kurt, "phase_var": K.phase_step_variance(y), "hf_ratio": hf_ratio, "band_share": band_share,
        "zcr": signs.mean(axis=1) if signs.shape[1] and len(y) >= 128 else np.zeros(1), "rms": K.frame_levels(y, n_fft, hop), "f0": f0[::finer], **fine,
        **{k: (list(v) if k == "mfcc" else v) for k, v in K.spectral_frames(y, n_fft, hop, N_MFCC, finer).items()},
    }


def describe_clips(clips: DataFrame, pcm: str = "pcm", n_fft: int = 1024, hop: int = 512, fmax: float = 500.0, keep_pcm: bool = False) -> DataFrame:
    """Per-frame descriptors of every clip (samples, or int16 bytes); all other columns pass through."""
    kept = [c for c in clips.columns if keep_pcm or c != pcm]
    schema = ", ".join(f"`{c}` {clips.schema[c].dataType.simpleString()}" for c in kept) + ", " + DESCRIPTOR_TYPES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in (pdf.iloc[s] for s in _slices(pdf[pcm])):
                rows = pd.DataFrame([_describe(heard(y), n_fft, hop, fmax) for y in part[pcm]], index=part.index)
                yield pd.concat([part[kept], rows], axis=1)

    return clips.mapInPandas(run, schema)


SERIES = ["zcr", "rms", "flatness", "centroid", "bandwidth", "rolloff", "contrast"]
SUMMARY_TYPES = (
    "n_samples int, skewness double, kurtosis double, phase_var double, hf_ratio double, band_share double, "
    "mu array<double>, sd array<double>, pitch array<double>, shimmer double, n_voiced int, n_pitch int"
)


def _summarise(described: dict) -> dict:
    """AGG-25 of one clip's frames: what ``with_statistics`` makes of the per-frame arrays."""
    series = [np.asarray(described[name])[None, :] for name in SERIES]
    rows = np.stack([*(described[name] for name in ("flatness", "centroid", "bandwidth", "rolloff")), *described["mfcc"]])  # as many frames each
    parts = [*series[:2], rows[:4], series[-1], rows[4:]]
    f0 = np.asarray(described["f0"])
    voiced = f0[(f0 > 65.0) & (f0 < 500.0)]
    spread = [K.mean(voiced), K.std(voiced), float(voiced.max() - voiced.min()) if len(voiced) else None, K.relative_step(1.0 / (voiced + 1e-6))]
    kept = {k: described[k] for k in ("n_samples", "skewness", "kurtosis", "phase_var", "hf_ratio", "band_share")}
    mu, sd = ([x for part in parts for x in f(part, axis=1).tolist()] for f in (np.mean, np.std))
    return {**kept, "mu": mu, "sd": sd, "pitch": spread, "shimmer": K.relative_step(described["rms"]), "n_voiced": len(voiced), "n_pitch": len(f0)}


def _timbre(described: dict) -> list[float]:
    """``timbre_segment`` of the finer frames, not yet of unit length."""
    m, f0 = described["mfcc_fine"][:13], described["f0_fine"]
    voiced = f0[(f0 > 70.0) & (f0 < 500.0)]
    tail = [K.mean(voiced) / 500.0, K.std(voiced) / 250.0] if len(voiced) > 2 else [0.0, 0.0]
    return [*m.mean(axis=1).tolist(), *m.std(axis=1).tolist(), *tail]


def _whole(y: np.ndarray) -> Iterator[tuple]:
    yield (y,)


def summarise_clips(clips: DataFrame, pcm: str = "pcm", n_fft: int = 1024, hop: int = 512, fmax: float = 500.0, pieces: Callable[[np.ndarray], Iterator[tuple]] = _whole, more: str = "", finer: int = 1) -> DataFrame:
    """``with_statistics(describe_clips(...))`` in one pass over the samples that returns numbers per clip, not per frame.

    Clips are samples or int16 bytes. ``pieces`` yields what is to be described of a clip: facts of the types ``more``, then
    samples, or None for a row of facts alone, whose numbers are NULL. A job that standardises and cuts its clips does so
    there, one clip at a time: as columns every step is a Python process that holds a whole Arrow batch of samples. With
    ``finer`` (a power of two) frames are taken every ``hop // finer`` for the voice vector ``timbre_segment(True)``.
    """
    kept = [c for c in clips.columns if c != pcm]
    names = [f.split()[0] for f in more.split(",")] if more else []
    schema = "".join(f"`{c}` {clips.schema[c].dataType.simpleString()}, " for c in kept) + (f"{more}, " if more else "") + SUMMARY_TYPES + (", timbre array<double>" if finer > 1 else "")
    columns = [*names, *(f.split()[0] for f in SUMMARY_TYPES.split(", ")), *(["timbre"] if finer > 1 else [])]
    nothing = dict.fromkeys(columns[len(names) :])

    def numbers(piece: np.ndarray | None) -> dict:
        if piece is None:
            return nothing
        described = _describe(piece, n_fft, hop, fmax, finer)
        return {**_summarise(described), **({"timbre": _timbre(described)} if finer > 1 else {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in (pdf.iloc[s] for s in _slices(pdf[pcm])):
                at, rows = [], []
                for i, y in enumerate(part[pcm]):
                    for *facts, piece in pieces(heard(y)):
                        at.append(i)
                        rows.append({**dict(zip(names, facts)), **numbers(piece)})
                yield pd.concat([part[kept].iloc[at].reset_index(drop=True), pd.DataFrame(rows, columns=columns)], axis=1)

    return clips.mapInPandas(run, schema)


def with_statistics(described: DataFrame) -> DataFrame:
    """AGG-25: means and spreads of all per-frame series, two short arrays per clip, and the voiced pitch."""
    everything = F.concat(F.array(*SERIES), F.col("mfcc"))
    voiced = F.filter("f0", lambda v: (v > 65.0) & (v < 500.0))
    df = described.withColumns({"all_series": everything, "voiced": voiced})
    return df.withColumns(
        {
            "mu": F.transform("all_series", lambda c: S.mean(c)),
            "sd": F.transform("all_series", lambda c: S.std(c)),
            "pitch": F.array(S.mean("voiced"), S.std("voiced"), F.array_max("voiced") - F.array_min("voiced"),
                             S.relative_step(F.transform("voiced", lambda v: F.lit(1.0) / (v + 1e-6)))),
            "shimmer": S.relative_step("rms"),
            "n_voiced": F.size("voiced"),
            "n_pitch": F.size("f0"),
        }
    )


def feature_map() -> Column:
    """SIG-16: the 63 named features after ``summarise_clips`` or ``with_statistics``, NaN and infinity set to 0."""
    at = {name: i for i, name in enumerate(SERIES)}
    mu = lambda name: F.col("mu")[at[name]]
    sd = lambda name: F.col("sd")[at[name]]
    level = lambda i: F.col("mu")[len(SERIES) + i]
    enough = F.col("n_voiced") > 2
    items: dict[str, Column] = {
        "acoustic_kurtosis": F.col("kurtosis"),
        "acoustic_skewness": F.col("skewness"),
        "acoustic_zcr_mean": mu("zcr"),
        "acoustic_zcr_std": sd("zcr"),
        "acoustic_phase_derivative_var": F.col("phase_var"),
        "spectral_flatness": mu("flatness"),
        "spectral_hf_energy_ratio": F.col("hf_ratio"),
        "prosody_voiced_ratio": F.col("n_voiced") / F.col("n_pitch"),
        "prosody_shimmer": F.when(mu("rms") > 1e-6, F.col("shimmer")),
        "prosody_rms_mean": mu("rms"),
        "prosody_rms_std": sd("rms"),
        "mfcc_0_mean": level(0) - (level(1) + level(2) + level(3) + level(4)) / 4.0,
    }
    for i, name in enumerate(("f0_mean", "f0_std", "f0_range", "jitter")):
        items[f"prosody_{name}"] = F.when(enough, F.col("pitch")[i])
    for name in ("centroid", "bandwidth", "rolloff", "contrast"):
        items[f"spectral_{name}_mean"], items[f"spectral_{name}_std"] = mu(name), sd(name)
    for i in range(N_MFCC):
        items.setdefault(f"mfcc_{i}_mean", level(i))
        items[f"mfcc_{i}_std"] = F.col("sd")[len(SERIES) + i]
    raw = F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("double"))])
    return F.transform_values(raw, lambda k, v: finite_or_zero(v))


def clip_features(clips: DataFrame, pcm: str = "pcm", **cut) -> DataFrame:
    """Clips (or their ``pieces``) to feature maps."""
    described = summarise_clips(clips, pcm, **cut)
    keep = [c for c in described.columns if c in clips.columns and c != pcm] + [f.split()[0] for f in cut.get("more", "").split(",") if f]
    return described.select(*keep, "n_samples", "band_share", feature_map().alias("f"))


# Feature names in vector order.
FEATURE_NAMES = sorted(
    ["acoustic_kurtosis", "acoustic_skewness", "acoustic_zcr_mean", "acoustic_zcr_std", "acoustic_phase_derivative_var", "spectral_flatness", "spectral_hf_energy_ratio",
     "prosody_voiced_ratio", "prosody_f0_mean", "prosody_f0_std", "prosody_f0_range", "prosody_jitter", "prosody_shimmer", "prosody_rms_mean", "prosody_rms_std"]
    + [f"spectral_{n}_{s}" for n in ("centroid", "bandwidth", "rolloff", "contrast") for s in ("mean", "std")]
    + [f"mfcc_{i}_{s}" for i in range(N_MFCC) for s in ("mean", "std")]
)


def feature_vector(features, names: list[str] | None = None) -> Column:
    """SRT-01 / MAP-01: values in name order, unknown names 0."""
    f = features if isinstance(features, Column) else F.col(features)
    if names is None:
        return F.transform(F.array_sort(F.map_keys(f)), lambda n: finite_or_zero(F.try_element_at(f, n)))
    return F.transform(F.array(*[F.try_element_at(f, F.lit(n)) for n in names]), lambda v: finite_or_zero(v))


def neutralise(features, shortcuts: list[str]) -> Column:
    """PRJ-13: set the listed features to 0."""
    f = features if isinstance(features, Column) else F.col(features)
    return F.transform_values(f, lambda k, v: F.when(k.isin(*shortcuts), F.lit(0.0)).otherwise(v))


def _bands(summary: bool) -> tuple[Column, Column]:
    """Means and spreads of coefficients 1..19, from arrays of frames or from their ``summarise_clips``."""
    if summary:
        return F.slice("mu", len(SERIES) + 2, N_MFCC - 1), F.slice("sd", len(SERIES) + 2, N_MFCC - 1)
    m = F.slice("mfcc", 2, N_MFCC - 1)
    return F.transform(m, lambda c: S.mean(c)), F.transform(m, lambda c: S.std(c))


def timbre_monitor(summary: bool = False) -> Column:
    """SIG-17, 40-D: means and spreads of coefficients 1..19, scaled centroid and rolloff, unit length, also of a clip
    without samples or of digital silence."""
    mean = lambda name: F.col("mu")[SERIES.index(name)] if summary else S.mean(name)
    return direction(F.concat(*_bands(summary), F.array(mean("centroid") / 4000.0), F.array(mean("rolloff") / 8000.0)))


def timbre_session(summary: bool = False) -> Column:
    """SIG-17, 19-D: mean over spread of coefficients 1..19, unit length as of ``timbre_monitor``."""
    return direction(F.zip_with(*_bands(summary), lambda m, s: m / (s + 1e-6)))


def timbre_segment(summary: bool = False) -> Column:
    """SIG-17, 28-D: 13 means, 13 spreads, scaled pitch mean and spread, unit length; from frames, or from ``summarise_clips``
    with ``finer``."""
    if summary:
        return direction("timbre")
    m = F.slice("mfcc", 1, 13)
    voiced = F.filter("f0", lambda v: (v > 70.0) & (v < 500.0))
    enough = F.size(voiced) > 2
    tail = F.array(F.when(enough, S.mean(voiced) / 500.0).otherwise(0.0), F.when(enough, S.std(voiced) / 250.0).otherwise(0.0))
    return direction(F.concat(F.transform(m, lambda c: S.mean(c)), F.transform(m, lambda c: S.std(c)), tail))


def add_noise(planned: DataFrame, ident: str, pcm: str = "pcm", seed: int = 42) -> DataFrame:
    """CUR-08, second half: Gaussian noise of ``noise_amp`` from a generator keyed by id and seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, amp, y in zip(pdf[ident], pdf["noise_amp"], pdf[pcm]):
                y = np.asarray(y, dtype=np.float32)
                if amp:
                    rng = np.random.default_rng([seed, *str(key).encode()])
                    y = y + (rng.standard_normal(len(y)) * amp).astype(np.float32)
                out.append(y)
            yield pdf.assign(**{pcm: out})

    return planned.mapInPandas(run, planned.schema)
