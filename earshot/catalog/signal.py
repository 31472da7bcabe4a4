"""Signal measures: vectors of `embeddings` as 64-sample clips, text bytes of `documents` as int16 audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions.numeric import finite_or_zero, rnd
from ..operators import curation as K
from ..operators import features as X
from ..session import balance_tasks, table
from . import query, r

X64 = "x AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
FR = "[x[i * {h} + 1 : i * {h} + {n}] FOR i IN range(0, (len(x) - {n}) // {h} + 1)]"


def tones(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("pcm"))


def spoken_bytes(spark, d):
    """Whole documents as raw audio bytes, for jobs that decode a clip where they describe it."""
    return balance_tasks(table(spark, d, "documents").select("doc_id", "lang", F.encode("text", "utf-8").alias("pcm")))


def spoken(spark, d):
    """Whole documents read as raw audio bytes."""
    return X.change_clips(spoken_bytes(spark, d), kind="float")


MEAN = "list_sum({x}) / len({x})"


@query("clip_levels", f"""
WITH {X64} SELECT vec_id, {r('sqrt(list_sum([v * v FOR v IN x]) / len(x))', 9)} AS rms, {r('list_max([abs(v) FOR v IN x])', 9)} AS peak,
 {r('len([v FOR v IN x IF abs(v) >= 0.2e0]) / len(x)', 9)} AS clipped FROM x""")
def clip_levels(spark, d):
    """SIG-02, SIG-03."""
    return tones(spark, d).select("vec_id", rnd(S.rms("pcm"), 9).alias("rms"), rnd(S.peak("pcm"), 9).alias("peak"), rnd(S.clipping_ratio("pcm", 0.2), 9).alias("clipped"))


@query("normalised_peak", f"""
WITH {X64}, m AS (SELECT *, list_max([abs(v) FOR v IN x]) AS m FROM x)
SELECT vec_id, {r('list_sum([CASE WHEN m < 0.3e0 THEN v ELSE v / m * 0.95e0 END FOR v IN x])', 8)} AS total, {r('CASE WHEN m < 0.3e0 THEN m ELSE 0.95e0 END', 8)} AS peak FROM m""")
def normalised_peak(spark, d):
    """SIG-01."""
    n = tones(spark, d).withColumn("y", S.normalise_peak("pcm", minimum=0.3))
    return n.select("vec_id", rnd(S.total("y"), 8).alias("total"), rnd(S.peak("y"), 8).alias("peak"))


def pct(arr: str, q: str) -> str:
    return f"(list_sort({arr})[CAST(floor((len({arr}) - 1) * {q}) AS BIGINT) + 1] + (coalesce(list_sort({arr})[CAST(floor((len({arr}) - 1) * {q}) AS BIGINT) + 2], list_sort({arr})[len({arr})]) - list_sort({arr})[CAST(floor((len({arr}) - 1) * {q}) AS BIGINT) + 1]) * ((len({arr}) - 1) * {q} - floor((len({arr}) - 1) * {q})))"


@query("snr_tier", f"""
WITH {X64}, e AS (SELECT vec_id, [list_sum([v * v FOR v IN f]) / 8e0 + 1e-12 FOR f IN {FR.format(h=8, n=8)}] AS e FROM x)
SELECT vec_id, {r(f"least(50e0, greatest(-10e0, 10e0 * log10(greatest({pct('e', '0.9e0')} / {pct('e', '0.1e0')}, 1e-3))))", 2)} AS snr_db FROM e""")
def snr_tier(spark, d):
    """SIG-04, WIN-17."""
    return tones(spark, d).select("vec_id", S.snr_tier_db("pcm", 8).alias("snr_db"))


@query("gate_measures", f"""
WITH {X64}, p AS (SELECT vec_id, list_concat([0e0 FOR i IN range(0, 6)], list_concat(x, [0e0 FOR i IN range(0, 6)])) AS x FROM x),
e AS (SELECT vec_id, [sqrt(list_sum([v * v FOR v IN f]) / 12e0) FOR f IN {FR.format(h=6, n=12)}] AS e FROM p),
q AS (SELECT vec_id, e, {pct('e', '0.95e0')} AS p95, {pct('e', '0.10e0')} AS p10 FROM e)
SELECT vec_id, {r('len([v FOR v IN e IF v >= greatest(1e-4, p95 * 0.8e0)]) * 6 / 16000e0', 9)} AS usable_sec, {r('len([v FOR v IN e IF v >= greatest(1e-4, p95 * 0.8e0)]) * 1e0 / len(e)', 9)} AS speech_ratio, {r('20e0 * log10((p95 + 1e-6) / (p10 + 1e-6))', 6)} AS snr_db FROM q""")
def gate_measures(spark, d):
    """SIG-05 (with a higher activity limit, so that short test clips have silent frames)."""
    df = tones(spark, d).withColumn("e", S.frame_rms("pcm", 12, 6))
    g = S.gate_measures("e", 6, activity=0.8)
    return df.select("vec_id", rnd(g["usable_sec"], 9).alias("usable_sec"), rnd(g["speech_ratio"], 9).alias("speech_ratio"), rnd(g["snr_db"], 6).alias("snr_db"))


@query("zero_crossings", f"""
WITH {X64}, z AS (SELECT vec_id, [list_sum([CASE WHEN (f[i] < 0) <> (f[i + 1] < 0) THEN 1e0 ELSE 0e0 END FOR i IN range(1, 16)]) / 15e0 FOR f IN {FR.format(h=8, n=16)}] AS z FROM x)
SELECT vec_id, {r('list_sum(z) / len(z)', 9)} AS zcr_mean, {r('sqrt(list_sum([(v - list_sum(z) / len(z)) * (v - list_sum(z) / len(z)) FOR v IN z]) / len(z))', 7)} AS zcr_std FROM z""")
def zero_crossings(spark, d):
    """SIG-08, AGG-25."""
    df = tones(spark, d).withColumn("z", S.zero_crossings("pcm", 16, 8))
    return df.select("vec_id", rnd(S.mean("z"), 9).alias("zcr_mean"), rnd(S.std("z"), 7).alias("zcr_std"))


@query("level_steps", f"""
WITH {X64}, e AS (SELECT vec_id, [sqrt(list_sum([v * v FOR v IN f]) / 8e0) FOR f IN {FR.format(h=4, n=8)}] AS e FROM x)
SELECT vec_id, {r('(list_sum([abs(e[i + 1] - e[i]) FOR i IN range(1, len(e))]) / (len(e) - 1)) / (list_sum(e) / len(e) + 1e-6)', 8)} AS shimmer FROM e""")
def level_steps(spark, d):
    """SIG-15 form of jitter and shimmer."""
    df = tones(spark, d).withColumn("e", S.frame_rms("pcm", 8, 4, centred=False))
    return df.select("vec_id", rnd(S.relative_step("e"), 8).alias("shimmer"))


@query("silence_cut", f"""
WITH {X64}, p AS (SELECT vec_id, x AS y, list_concat([0e0 FOR i IN range(0, 4)], list_concat(x, [0e0 FOR i IN range(0, 4)])) AS x FROM x),
e AS (SELECT vec_id, y, [greatest(1e-10, list_sum([v * v FOR v IN f]) / 8e0) FOR f IN {FR.format(h=4, n=8)}] AS e FROM p),
k AS (SELECT vec_id, y, [i FOR i IN range(1, len(e) + 1) IF e[i] > list_max(e) * pow(10e0, -0.4e0)] AS k FROM e)
SELECT vec_id, CAST(list_sum([len(y[(i - 1) * 4 + 1 : i * 4]) FOR i IN k]) AS INTEGER) AS kept, {r('list_sum([coalesce(list_sum(y[(i - 1) * 4 + 1 : i * 4]), 0e0) FOR i IN k])', 8)} AS total FROM k""")
def silence_cut(spark, d):
    """SIG-07: hops within 4 dB of the loudest."""
    df = tones(spark, d).withColumn("y", S.cut_silence("pcm", 4.0, 8, 4))
    return df.select("vec_id", F.size("y").alias("kept"), rnd(S.total("y"), 8).alias("total"))


GRID = "round_even(({v} + 1e0) * 127.5e0, 0) / 127.5e0 - 1e0"


@query("companding_error", f"""
WITH s AS (SELECT label, unnest(embedding)::DOUBLE * 3e0 AS v FROM embeddings), c AS (SELECT label, greatest(-1e0, least(1e0, v)) AS v FROM s),
m AS (SELECT label, v, {GRID.format(v='(sign(v) * ln(1e0 + abs(v) * 255e0) / ln(256e0))')} AS qm,
  {GRID.format(v='(sign(v) * (CASE WHEN abs(v) < 1e0 / 87.6e0 THEN abs(v) * 87.6e0 / (1e0 + ln(87.6e0)) ELSE (ln(greatest(abs(v) * 87.6e0, 1e0)) + 1e0) / (1e0 + ln(87.6e0)) END))')} AS qa FROM c),
e AS (SELECT label, v, sign(qm) * (pow(256e0, abs(qm)) - 1e0) / 255e0 AS em,
  sign(qa) * CASE WHEN abs(qa) < 1e0 / (1e0 + ln(87.6e0)) THEN abs(qa) * (1e0 + ln(87.6e0)) / 87.6e0 ELSE exp(abs(qa) * (1e0 + ln(87.6e0)) - 1e0) / 87.6e0 END AS ea FROM m)
SELECT label, {r('avg(abs(em - v))', 8)} AS mu_law_error, {r('avg(abs(ea - v))', 8)} AS a_law_error FROM e GROUP BY 1""")
def companding_error(spark, d):
    """SIG-20 per group."""
    loud = tones(spark, d).withColumn("pcm", F.transform("pcm", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double") * 3.0))))
    return loud.groupBy("label").agg(rnd(F.avg(S.companding_error("pcm", "mu_law")), 8).alias("mu_law_error"), rnd(F.avg(S.companding_error("pcm", "a_law")), 8).alias("a_law_error"))


@query("frame_statistics", f"""
WITH s AS (SELECT user_id, value FROM events), m AS (SELECT user_id, avg(value) AS mu FROM s GROUP BY 1),
c AS (SELECT user_id, avg(pow(value - mu, 2)) AS m2, avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 4)) AS m4, any_value(mu) AS mu FROM s JOIN m USING (user_id) GROUP BY 1)
SELECT user_id, {r('mu', 7)} AS mean, {r('sqrt(m2)', 7)} AS std, {r('m3 / pow(m2, 1.5e0)', 6)} AS skewness, {r('m4 / (m2 * m2) - 3e0', 6)} AS kurtosis FROM c""")
def frame_statistics(spark, d):
    """AGG-25, AGG-26 over frame rows."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(rnd(F.avg("value"), 7).alias("mean"), rnd(F.stddev_pop("value"), 7).alias("std"), rnd(F.skewness("value"), 6).alias("skewness"), rnd(F.kurtosis("value"), 6).alias("kurtosis"))


@query("finite_values", """
SELECT event_id, CASE WHEN event_id % 4 IN (1, 2, 3) THEN 0e0 ELSE value END AS clean FROM events""")
def finite_values(spark, d):
    """PRJ-14."""
    m = F.pmod("event_id", F.lit(4))
    bad = F.when(m == 1, float("nan")).when(m == 2, float("inf")).when(m == 3, float("-inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", finite_or_zero(bad).alias("clean"))


@query("feature_vectors", """
SELECT event_id, '0.0,' || CAST(event_id AS VARCHAR) || '.0,0.0,7.0' AS ordered, '0.0,7.0' AS chosen FROM events""")
def feature_vectors(spark, d):
    """SRT-01, MAP-01, PRJ-13: name order, defaults for unknown names, neutralised shortcut."""
    m = F.create_map(F.lit("zz"), F.lit(7.0), F.lit("loud"), F.lit(3.5), F.lit("bad"), F.lit(float("nan")), F.lit("id"), F.col("event_id").cast("double"))
    df = table(spark, d, "events").select("event_id", X.neutralise(m, ["loud"]).alias("f"))
    text = lambda v: F.array_join(F.transform(v, lambda x: F.format_string("%.1f", x)), ",")
    return df.select("event_id", text(X.feature_vector("f")).alias("ordered"), text(X.feature_vector("f", ["unknown", "zz"])).alias("chosen"))


@query("clip_features")
def clip_features(spark, d):
    """SIG-06, SIG-09 .. SIG-16 on whole documents."""
    f = X.clip_features(spoken_bytes(spark, d))
    names = ["acoustic_phase_derivative_var", "spectral_hf_energy_ratio", "prosody_jitter", "spectral_contrast_std", "mfcc_0_mean", "prosody_f0_mean"]
    return f.select("doc_id", "n_samples", (F.col("band_share") > 0.88).alias("telephony"), F.size("f").alias("n_features"), *[rnd(F.col("f")[n], 6).alias(n) for n in names])


@query("clip_features_3s")
def clip_features_3s(spark, d):
    """SIG-16 on clips of three seconds: benchmark texts as int16 samples, repeated to 96 000 bytes."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    whole = F.when(F.octet_length(raw) > 0, F.substring(F.encode(F.repeat("text", F.ceil(F.lit(96000) / F.octet_length(raw)).cast("int")), "utf-8"), F.lit(1), F.lit(96000)))
    clips = balance_tasks(table(spark, d, "benchmark").select("item_id", whole.alias("raw"))).select("item_id", X.pcm_to_samples("raw").alias("pcm"))
    f = X.clip_features(clips)
    return f.select("item_id", "n_samples", F.size("f").alias("n_features"), rnd(F.col("f")["spectral_flatness"], 6).alias("spectral_flatness"), rnd(F.col("f")["mfcc_0_mean"], 6).alias("mfcc_0_mean"))


@query("decoded_audio", """
SELECT doc_id, CAST(strlen(text) // 2 AS INTEGER) AS n_samples FROM documents""")
def decoded_audio(spark, d):
    """SRC-14, SRC-16: whole documents decoded, an odd trailing byte dropped."""
    return spoken(spark, d).select("doc_id", F.size("pcm").alias("n_samples"))


@query("timbre_embeddings", """
SELECT doc_id, 40 AS monitor_dim, 19 AS session_dim, 28 AS segment_dim, 1e0 AS monitor_norm, 1e0 AS session_norm, 1e0 AS segment_norm FROM documents""")
def timbre_embeddings(spark, d):
    """SIG-17: widths and unit length of the vectors."""
    described = X.describe_clips(spoken_bytes(spark, d))
    widths = {"monitor": X.timbre_monitor(), "session": X.timbre_session(), "segment": X.timbre_segment()}
    return described.select("doc_id", *[F.size(v).alias(f"{k}_dim") for k, v in widths.items()],
                            *[rnd(S.total(v, lambda x: x * x), 4).alias(f"{k}_norm") for k, v in widths.items()])


@query("overlap_scores")
def overlap_scores(spark, d):
    """SIG-19."""
    described = X.describe_clips(spoken_bytes(spark, d), hop=256, fmax=2093.0)
    o = S.overlap_score("f0", "flatness")
    return described.select("doc_id", rnd(o["jump_ratio"], 6).alias("jump_ratio"), rnd(o["flatness_std"], 6).alias("flatness_std"), o["is_overlap"].alias("is_overlap"), o["overlap_conf"].alias("overlap_conf"))


@query("noise_augmented_clips")
def noise_augmented_clips(spark, d):
    """CUR-08 with the noise added."""
    clips = tones(spark, d).withColumn("label", F.pmod("label", F.lit(2))).withColumn("peak", S.peak("pcm"))
    noisy = X.add_noise(K.noise_plan(clips, "vec_id"), "vec_id")
    return noisy.select("vec_id", "augmented", rnd(S.rms("pcm"), 6).alias("rms"))
