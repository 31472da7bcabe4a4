import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import kernels as K
from earshot.functions import signal as S
from earshot.operators import features as X
from earshot.sources import media

RATE = 16000


def sine(hz, seconds=1.0, amp=0.5):
    return (amp * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)).astype(np.float32)


@pytest.fixture(scope="module")
def clips(spark):
    rng = np.random.default_rng(1)
    mix = (0.5 * sine(220, 3.0, 1.0) + 0.3 * sine(440, 3.0, 1.0) + 0.05 * rng.standard_normal(48000)).astype(np.float32)
    sig = {"low": sine(220), "high": sine(5000), "silence": np.zeros(16000, np.float32), "square": np.sign(sine(100)).astype(np.float32), "mix": mix, "short": sine(300, 0.005), "none": np.zeros(0, np.float32)}
    return spark.createDataFrame([(k, v.tolist()) for k, v in sig.items()], "name string, pcm array<float>"), sig


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_levels(clips):
    df, sig = clips
    got = by_name(df.select("name", S.rms("pcm").alias("rms"), S.peak("pcm").alias("peak"), S.clipping_ratio("pcm").alias("clip")))
    assert got["low"].rms == pytest.approx(0.5 / np.sqrt(2), rel=1e-4) and got["low"].peak == pytest.approx(0.5, abs=1e-3)
    assert got["square"].clip == pytest.approx((np.abs(sig["square"]) >= 0.99).mean()) and got["none"].rms == 0.0


def test_normalise_guards_noise(spark):
    df = spark.createDataFrame([([0.01, -0.02],), ([0.1, -0.5],)], "pcm array<double>")
    quiet, loud = [r[0] for r in df.select(S.normalise_peak("pcm")).collect()]
    assert quiet == [0.01, -0.02] and loud == pytest.approx([0.19, -0.95])


def test_zero_crossings_and_snr(clips):
    df, sig = clips
    got = by_name(df.select("name", S.mean(S.zero_crossings("pcm")).alias("z"), S.snr_tier_db("pcm").alias("snr")))
    assert got["low"].z == pytest.approx(2 * 220 / RATE, rel=0.05) and got["high"].z == pytest.approx(2 * 5000 / RATE, rel=0.05)
    energy = (sig["mix"][:48000].reshape(-1, 320).astype(float) ** 2).mean(axis=1) + 1e-12
    assert got["mix"].snr == pytest.approx(10 * np.log10(np.percentile(energy, 90) / np.percentile(energy, 10)), abs=0.011)
    assert got["silence"].snr == 40.0 and got["short"].snr == 0.0


def test_silence_cut(spark):
    y = np.concatenate([np.zeros(8192), sine(300, 0.512), np.zeros(8192)])
    df = spark.createDataFrame([(y.tolist(),), ([0.0] * 4096,)], "pcm array<double>")
    n = [r[0] for r in df.select(F.size(S.cut_silence("pcm", 30.0))).collect()]
    assert 8192 <= n[0] <= 8192 + 2 * 2048 and n[1] == 4096


def test_features_of_a_mix(clips):
    df, _ = clips
    got = by_name(X.clip_features(df))
    f = got["mix"].f
    assert sorted(f) == X.FEATURE_NAMES and len(f) == 63
    for row in got.values():
        assert all(np.isfinite(v) for v in row.f.values())
    assert f["prosody_f0_mean"] == pytest.approx(220, rel=0.02) and f["prosody_voiced_ratio"] > 0.9
    assert got["low"].f["prosody_f0_mean"] == pytest.approx(220, rel=0.03)  # padded edge frames included
    assert got["high"].f["spectral_hf_energy_ratio"] > 0.99 and got["low"].f["spectral_hf_energy_ratio"] < 0.01
    assert got["high"].f["spectral_centroid_mean"] == pytest.approx(5000, rel=0.05)
    assert got["low"].f["prosody_rms_mean"] == pytest.approx(0.5 / np.sqrt(2), rel=0.05)
    assert got["silence"].f["prosody_rms_mean"] == 0.0
    assert got["low"].band_share < 0.1 and got["mix"].band_share < 0.5


def test_moments_match_definition():
    y = np.random.default_rng(0).gamma(2.0, size=5000)
    c = y - y.mean()
    assert K.moments(y) == pytest.approx(((c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3))


def test_phase_of_a_tone_is_steady():
    assert K.phase_step_variance(sine(400)) < 1e-3 < K.phase_step_variance(np.random.default_rng(0).standard_normal(16000))


def test_mel_and_cosine_tables():
    b = K.cosine_basis(128, 20)
    assert np.allclose(b @ b.T, np.eye(20), atol=1e-12)
    m = K.mel_bank(1024)
    assert m.shape == (128, 513) and (m >= 0).all() and (m.max(axis=1) > 0).all()


def test_long_clips_use_the_same_frames():
    y = np.random.default_rng(2).standard_normal(RATE * 80)
    whole = np.lib.stride_tricks.sliding_window_view(np.pad(y, 512), 1024)[::512]
    assert np.allclose(K.frame_levels(y), np.sqrt((whole**2).mean(axis=1)))


def test_embeddings_have_unit_length(clips):
    df, _ = clips
    d = X.describe_clips(df.filter("name IN ('low', 'mix', 'high')"))
    for width, c in ((40, X.timbre_monitor()), (19, X.timbre_session()), (28, X.timbre_segment())):
        for r in d.select(c.alias("e")).collect():
            assert len(r.e) == width and np.linalg.norm(r.e) == pytest.approx(1.0, abs=1e-6)


def test_clips_without_sound_have_unit_vectors(spark):
    """no text, less than a sample, one sample of silence, and silence."""
    df = spark.createDataFrame(list(enumerate([None, bytearray(b""), bytearray(b"A"), bytearray(2), bytearray(4000), bytearray(b"A.")])), "k int, pcm binary")
    d, s = X.describe_clips(df), X.summarise_clips(df, finer=2)
    voices = [(d, 40, X.timbre_monitor()), (d, 19, X.timbre_session()), (d, 28, X.timbre_segment()), (s, 40, X.timbre_monitor(True)), (s, 19, X.timbre_session(True)), (s, 28, X.timbre_segment(True))]
    for described, width, c in voices:
        got = [r.e for r in described.select(c.alias("e")).collect()]
        assert [len(e) for e in got] == [width] * 6 and [np.linalg.norm(e) for e in got] == pytest.approx([1.0] * 6, abs=1e-9)


def test_overlap_rule(spark):
    df = spark.createDataFrame([([100.0, 200.0] * 6, [0.0, 0.2] * 6), ([100.0] * 12, [0.1] * 12), ([100.0, 300.0], [0.0, 0.9])], "f0 array<double>, flatness array<double>")
    o = S.overlap_score("f0", "flatness")
    assert [r[0] for r in df.select(o["is_overlap"]).collect()] == [True, False, False]


def test_companding(spark):
    x = np.linspace(-1.2, 1.2, 401)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = df.select(S.mu_law("v").alias("m"), S.a_law("v").alias("a")).toPandas()
    c = np.clip(x, -1, 1)
    q = np.round((np.sign(c) * np.log1p(255 * np.abs(c)) / np.log(256) + 1) * 127.5) / 127.5 - 1
    assert np.allclose(got.m, np.sign(q) * (256 ** np.abs(q) - 1) / 255, atol=1e-9)
    assert np.abs(got.a - c).max() < 0.05


def test_decoding(spark):
    raw = struct.pack("<4h", 0, 16384, -32768, 32767) + b"\x01"
    df = spark.createDataFrame([(bytearray(raw), 1), (bytearray(raw), 2), (None, 1)], "pcm binary, n int")
    mono, stereo, none = [r[0] for r in df.select(X.pcm_to_samples_n("pcm", "n")).collect()]
    assert mono == pytest.approx([0, 0.5, -1.0, 32767 / 32768]) and stereo == pytest.approx([0.25, (-1.0 + 32767 / 32768) / 2], abs=1e-6) and none == []


def test_summaries_equal_statistics_of_frames(spark):
    rng = np.random.default_rng(3)
    clips = [np.sin(np.arange(n) / 9) * 0.4 + rng.standard_normal(n) * 0.02 for n in (16000, 5000, 400, 100, 3)] + [np.zeros(4000), np.zeros(0)]
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(clips)], "id int, pcm array<float>")
    one = {r.id: r.f for r in X.summarise_clips(df).select("id", X.feature_map().alias("f")).collect()}
    two = {r.id: r.f for r in X.with_statistics(X.describe_clips(df)).select("id", X.feature_map().alias("f")).collect()}
    assert one.keys() == two.keys() and len(one[0]) == 63
    for i in one:
        assert all(one[i][k] == pytest.approx(two[i][k], rel=1e-9, abs=1e-9) for k in one[i])


def test_preparation_of_long_clips_equals_the_array_form(spark):
    rng = np.random.default_rng(4)
    loud = np.concatenate([rng.standard_normal(6000) * 0.2, np.zeros(9000), rng.standard_normal(6000) * 0.1])
    clips = [loud, np.zeros(9000), np.zeros(0), rng.standard_normal(3000) * 0.001]
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(clips)], "id int, pcm array<double>")
    array_form = S.normalise_peak(S.voiced_or_whole("pcm", 28.0, 8000))
    rows = df.select("id", X.voiced_and_normalised("pcm", 28.0, 8000).alias("a"), array_form.alias("b"), X.sound_facts("pcm").alias("s"), S.rms("pcm").alias("rms"), S.peak("pcm").alias("peak")).collect()
    for r in rows:
        assert len(r.a) == len(r.b) and np.allclose(r.a, r.b)
        assert r.s.rms == pytest.approx(r.rms, abs=1e-12) and r.s.peak == r.peak
    assert len(rows[0].a) < len(loud)


def test_rejects(spark):
    df = spark.createDataFrame([(1, [0.1]), (2, []), (3, None), (4, [float("nan")]), (5, [float("inf")])], "id int, pcm array<float>")
    good, bad = X.usable_clips(df)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reject_reason for r in bad.collect()} == {2: "empty", 3: "empty", 4: "not finite", 5: "not finite"}


def test_wav_headers(spark):
    df = spark.createDataFrame([("a", bytearray(b"\0\0" * 16000)), ("b", bytearray(b"xx"))], "path string, pcm binary")
    files = df.select("path", F.when(F.col("path") == "a", media.wav_bytes(F.col("pcm"))).otherwise(F.col("pcm")).alias("content"))
    got = {r.path: r for r in media.header_audit(files).collect()}
    assert (got["a"].duration, got["a"].rate, got["a"].channels, got["a"].subtype) == (1.0, 16000, 1, "PCM_16") and got["b"].duration is None


def test_header_behind_a_long_chunk(spark):
    import struct

    plain = b"RIFF" + struct.pack("<I", 0) + b"WAVE"
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
    data = b"data" + struct.pack("<I", 8) + bytes(range(8))
    for size in (3, 4000, 5000, 70_001):
        chunk = b"LIST" + struct.pack("<I", size) + b"data" * (size // 4) + b"x" * (size % 4 + size % 2)
        files = spark.createDataFrame([("a", bytearray(plain + chunk + fmt + data)), ("b", bytearray(plain + chunk)), ("c", bytearray(b"z" * 9000)), ("d", None)], "path string, content binary")
        got = {r.path: r for r in media.header_audit(files).collect()}
        assert got["a"].duration == 8 / 32000 and all(got[p].rate is None for p in "bcd")
        good, bad = media.wav_samples(files)
        assert [(r.path, bytes(r.pcm)) for r in good.collect()] == [("a", bytes(range(8)))]
        assert {r.path: r.reason for r in bad.collect()} == dict.fromkeys("bcd", "NOT_WAV")


def test_noise_is_seeded(spark):
    df = spark.createDataFrame([(1, [0.0] * 100, 0.01), (2, [0.0] * 100, 0.0)], "id int, pcm array<float>, noise_amp double")
    a, b = (sorted((r.id, tuple(r.pcm)) for r in X.add_noise(x, "id").collect()) for x in (df, df.repartition(3)))
    assert a == b and np.std(a[0][1]) == pytest.approx(0.01, rel=0.3) and set(a[1][1]) == {0.0}


def test_changed_clips_leave_a_few_at_a_time():
    """A batch of any size is handed on in parts of bounded samples, with the values of a pass over whole columns."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    class Table:
        schema = StructType([StructField("k", IntegerType()), StructField("pcm", BinaryType())])

        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(5)
    raw = [None, b"", b"\x01", *(rng.integers(-20000, 20000, 200_001, dtype="<i2").tobytes() for _ in range(20))]
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(len(raw)), pa.int32()), "pcm": pa.array(raw, pa.binary())})
    run = X.change_clips(Table(), lambda y: K.normalise_peak(y, 0.95, 0.03))
    out = list(run(iter([batch])))
    assert max(len(b.column(1).flatten()) for b in out) <= X.SMALL + 200_001 and len(out) > 3
    got = pa.Table.from_batches(out)
    assert got["k"].to_pylist() == list(range(len(raw)))
    for y, b in zip(got["pcm"], raw):
        np.testing.assert_array_equal(np.array(y.values), K.normalise_peak(K.decode_pcm(b or b"").astype(np.float64), 0.95, 0.03))


def test_changed_clips_where_flagged(spark):
    df = spark.createDataFrame([(1, [0.5, -0.25], True), (2, [0.5], False), (3, None, True)], "k int, pcm array<float>, loud boolean")
    got = {r.k: list(r.pcm) for r in X.change_clips(df, lambda y: y * 2, where="loud").collect()}
    assert got == {1: [1.0, -0.5], 2: [0.5], 3: []}


def test_standardised_clips(spark):
    y = np.concatenate([np.zeros(8192), 0.5 * sine(300, 1.0), np.zeros(8192)])
    df = spark.createDataFrame([("a", y.tolist()), ("short", [0.5] * 100), ("none", None)], "name string, pcm array<float>")
    rows = media.standardise(df).collect()
    want = K.normalise_peak(K.voiced(np.array(y, dtype=np.float32).astype(float), 30.0), 0.95, 0.03)
    assert [r.name for r in rows] == ["a"] and rows[0].duration_sec == pytest.approx(len(want) / RATE)
    np.testing.assert_allclose(rows[0].pcm, want)


def test_clips_of_bytes_are_decoded_where_they_are_described(spark):
    rng = np.random.default_rng(5)
    raw = [(rng.standard_normal(n) * 9000).astype("<i2").tobytes() + odd for n, odd in ((16000, b""), (700, b"x"), (0, b"x"))] + [None]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(raw)], "id int, pcm binary")
    decoded = X.change_clips(df, kind="float")
    for job in (X.clip_features, lambda c: X.describe_clips(c).select("id", "n_samples", "f0", "mfcc")):
        assert sorted(map(str, job(df).collect())) == sorted(map(str, job(decoded).collect()))
