"""Call analysis over `conversations` read as diarised segments, speaker vectors over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.numeric import rnd
from ..operators import calls as C
from ..operators import clustering as L
from ..session import table
from . import query, r
from .risk import assess_sql

# one message = one segment; start = turn * 10
SEGMENTS = """
seg AS (SELECT conv_id AS call_id, turn AS seg_idx, turn * 10e0 AS start_sec, turn * 10e0 + (length(text) % 400) / 100e0 AS end_sec, (length(text) % 400) / 100e0 AS dur,
  CASE role WHEN 'user' THEN 'Speaker A' WHEN 'assistant' THEN 'Speaker B' ELSE 'Overlap (A+B)' END AS speaker, role = 'system' AS is_overlap,
  (length(text) % 101) / 100e0 AS prob, (length(text) % 70) / 100e0 AS phase_var, (length(text) % 40) / 1000e0 AS hf_ratio, (length(text) % 30) / 100e0 AS jitter, 5e0 + (length(text) % 60) / 10e0 AS contrast_std
  FROM conversations)"""


def segments(spark, d):
    c = table(spark, d, "conversations").withColumn("n", F.length("text"))
    mod = lambda m: F.pmod("n", F.lit(m))
    dur = mod(400) / 100.0
    return c.select(
        F.col("conv_id").alias("call_id"), F.col("turn").alias("seg_idx"), (F.col("turn") * 10.0).alias("start_sec"), (F.col("turn") * 10.0 + dur).alias("end_sec"), dur.alias("dur"),
        F.when(F.col("role") == "user", "Speaker A").when(F.col("role") == "assistant", "Speaker B").otherwise("Overlap (A+B)").alias("speaker"),
        (F.col("role") == "system").alias("is_overlap"), (mod(101) / 100.0).alias("prob"), (mod(70) / 100.0).alias("phase_var"), (mod(40) / 1000.0).alias("hf_ratio"),
        (mod(30) / 100.0).alias("jitter"), (mod(60) / 10.0 + 5.0).alias("contrast_std"))


DUR = f"""
d0 AS (SELECT call_id, count(*) AS n_segments, sum(dur) AS t, sum(CASE WHEN is_overlap THEN dur ELSE 0e0 END) AS o,
  sum(CASE WHEN speaker = 'Speaker A' THEN dur ELSE 0e0 END) AS a, sum(CASE WHEN speaker = 'Speaker B' THEN dur ELSE 0e0 END) AS b FROM seg GROUP BY 1),
dur AS (SELECT call_id, n_segments, {r('t', 2)} AS total_speech_seconds, {r('o', 2)} AS overlap_seconds, {r('o / greatest(t, 1e-4) * 100', 1)} AS overlap_percent,
  {r('a', 2)} AS seconds_a, {r('b', 2)} AS seconds_b, CASE WHEN {r('b', 2)} > 0.5e0 THEN 2 ELSE 1 END AS num_speakers FROM d0)"""


@query("call_durations", f"WITH {SEGMENTS}, {DUR} SELECT * FROM dur")
def call_durations(spark, d):
    """AGG-19."""
    return C.call_durations(segments(spark, d))


W = "sum({c} * dur) / greatest(sum(dur), 1e-4)"
SCORES = f"""
ppl AS (SELECT call_id, num_speakers, total_speech_seconds, overlap_percent, n_segments, 'Speaker A' AS speaker, seconds_a AS clean_seconds FROM dur
  UNION ALL SELECT call_id, num_speakers, total_speech_seconds, overlap_percent, n_segments, 'Speaker B', seconds_b FROM dur WHERE num_speakers = 2),
mean AS (SELECT call_id, speaker, {W.format(c='prob')} AS spoof_prob, {W.format(c='phase_var')} AS phase_var, {W.format(c='hf_ratio')} AS hf_ratio, {W.format(c='jitter')} AS jitter,
  {W.format(c='contrast_std')} AS contrast_std, count(*) AS clean_turns FROM seg WHERE NOT is_overlap AND dur >= 0.7e0 GROUP BY ALL),
sc AS (SELECT ppl.*, spoof_prob, phase_var, hf_ratio, jitter, contrast_std, coalesce(clean_turns, 0) > 0 AND clean_seconds >= 1.0e0 AS eligible FROM ppl LEFT JOIN mean USING (call_id, speaker))"""


@query("speaker_weighted_scores", f"""
WITH {SEGMENTS}, {DUR}, {SCORES} SELECT call_id, speaker, eligible, {r('spoof_prob', 8)} AS spoof_prob, {r('phase_var', 8)} AS phase_var, {r('contrast_std', 8)} AS contrast_std FROM sc""")
def speaker_weighted_scores(spark, d):
    """AGG-17, PRJ-11."""
    seg = segments(spark, d)
    return C.speaker_scores(seg, C.call_durations(seg)).select(
        "call_id", "speaker", "eligible", *[rnd(c, 8).alias(c) for c in ("spoof_prob", "phase_var", "contrast_std")])


def call_facts(seg):
    """What a real call table would carry: language, role, telephony flag, usability."""
    m = F.pmod("call_id", F.lit(7))
    return seg.groupBy("call_id").agg(F.sum("dur").alias("t")).select(
        "call_id", F.when(m < 3, "hi").otherwise("en").alias("language"), (m == 1).alias("telephony"), F.lit(0.8).alias("diarization_confidence"),
        (F.col("t") >= 1.5).alias("is_usable"), F.lit("Usable speech is too short.").alias("rejection_reason"), F.lit("father").alias("role"), (m == 2).alias("financial"))


ASSESSED = f"""
src AS (SELECT sc.* REPLACE (coalesce(spoof_prob, 0e0) AS spoof_prob, coalesce(jitter, 0e0) AS jitter), coalesce(phase_var, 0e0) AS phase, coalesce(hf_ratio, 0e0) AS hf, coalesce(contrast_std, 0e0) AS contrast, call_id % 7 < 3 AS indic, call_id % 7 AS m FROM sc),
{assess_sql('src', p='spoof_prob', context='0e0')},
named AS (SELECT *, CASE WHEN NOT eligible THEN 'insufficient_data' WHEN risk_level = 'CRITICAL' THEN 'critical' WHEN risk_level = 'HIGH' THEN 'elevated' WHEN risk_level = 'MEDIUM' THEN 'moderate' ELSE 'low' END AS voice_risk FROM risk_5)"""


def assessments(spark, d):
    seg = segments(spark, d)
    dur = C.call_durations(seg)
    return seg, dur, C.speaker_assessments(C.speaker_scores(seg, dur), call_facts(seg).select("call_id", "language", "telephony", "diarization_confidence"))


@query("speaker_assessments", f"""
WITH {SEGMENTS}, {DUR}, {SCORES}, {ASSESSED}
SELECT call_id, speaker, voice_risk, CASE WHEN eligible THEN {r('spoof_prob', 3)} ELSE 0e0 END AS spoof_score, CASE WHEN eligible THEN risk_score END AS risk_score,
  CASE WHEN eligible THEN {r('0.8e0 * 0.5e0 + least(1e0, clean_seconds / 4e0) * 0.5e0', 2)} ELSE 0.30e0 END AS analysis_confidence,
  1 + CAST(voice_risk = 'critical' AND hf > 0.015e0 AS INTEGER) + CAST(voice_risk = 'critical' AND phase > 0.55e0 AS INTEGER) + CAST(eligible AND m = 1 AS INTEGER) AS n_reasons FROM named""")
def speaker_assessments(spark, d):
    """RSK-09, RSK-11, PRJ-11."""
    return assessments(spark, d)[2].select("call_id", "speaker", "voice_risk", "spoof_score", "risk_score", "analysis_confidence", F.size("reasons").alias("n_reasons"))


REMOTE = """
rem0 AS (SELECT call_id, max(risk_score) AS s, arg_max(voice_risk, risk_score) AS n FROM named WHERE eligible AND (speaker = 'Speaker B' OR num_speakers = 1) GROUP BY 1),
rem AS (SELECT dur.*, CASE WHEN coalesce(s, 0) > 0 THEN s ELSE 0e0 END AS risk, CASE WHEN coalesce(s, 0) > 0 THEN n ELSE 'low' END AS remote_level FROM dur LEFT JOIN rem0 USING (call_id)),
verdict AS (SELECT *, CASE WHEN NOT total_speech_seconds >= 1.5e0 OR (overlap_percent >= 60 AND total_speech_seconds < 4) THEN 'insufficient_evidence'
  WHEN remote_level IN ('critical', 'elevated') OR risk >= 60 THEN 'high_spoof_risk' WHEN remote_level = 'moderate' OR risk >= 25 THEN 'review_recommended' ELSE 'low_risk' END AS call_assessment FROM rem)"""


@query("call_verdicts", f"""
WITH {SEGMENTS}, {DUR}, {SCORES}, {ASSESSED}, {REMOTE}
SELECT call_id, call_assessment, CASE WHEN call_assessment = 'insufficient_evidence' THEN 0e0 ELSE risk END AS overall_call_risk, remote_level, overlap_percent, num_speakers,
  call_id % 7 = 2 AND call_assessment IN ('high_spoof_risk', 'review_recommended') AS money_suffix FROM verdict""")
def call_verdicts(spark, d):
    """AGG-20, RSK-10, PRJ-12, ML-12 policy stage."""
    seg, dur, people = assessments(spark, d)
    v = C.call_verdicts(dur, C.remote_risk(people), call_facts(seg))
    return v.select("call_id", "call_assessment", "overall_call_risk", "remote_level", "overlap_percent", "num_speakers", F.col("guidance").contains("[ALERT").alias("money_suffix"))


@query("call_report", f"""
WITH {SEGMENTS}, {DUR}, {SCORES}, {ASSESSED}, {REMOTE}, pg AS (SELECT call_id, seg_idx // 4 AS page, count(*) AS entries, {r('sum(dur)', 4)} AS page_seconds, arg_min(speaker, seg_idx) AS first_speaker FROM seg GROUP BY ALL)
SELECT verdict.call_id, call_assessment, CASE WHEN call_assessment = 'insufficient_evidence' THEN 0 ELSE num_speakers END AS listed_speakers, page, CAST(entries AS INTEGER) AS entries, page_seconds, first_speaker FROM verdict JOIN pg USING (call_id)""")
def call_report(spark, d):
    """AGG-21: nested report, here in pages of four segments."""
    seg, dur, people = assessments(spark, d)
    rep = C.call_report(seg, C.call_verdicts(dur, C.remote_risk(people), call_facts(seg)), people, page=4)
    secs = F.aggregate("timeline", F.lit(0.0), lambda s, x: s + x["duration"])
    return rep.select("call_id", "call_assessment", F.size("speakers").alias("listed_speakers"), "page", F.size("timeline").alias("entries"), rnd(secs, 4).alias("page_seconds"),
                      F.col("timeline")[0]["speaker"].alias("first_speaker"))


@query("window_blend", f"""
WITH w AS (SELECT doc_id, unnest(range(1, 1 + CAST(n_chars % 6 AS BIGINT))) AS i, n_chars FROM documents),
s AS (SELECT doc_id, CAST(quantile_cont(p, 0.75) AS DOUBLE) AS p75, CAST(median(p) AS DOUBLE) AS med FROM (SELECT doc_id, ((n_chars * i * 7) % 1000) / 1000e0 AS p FROM w) GROUP BY 1)
SELECT doc_id, {r('coalesce((n_chars % 997) / 997e0 * 0.60e0 + p75 * 0.25e0 + med * 0.15e0, (n_chars % 997) / 997e0)', 8)} AS blended FROM documents LEFT JOIN s USING (doc_id)""")
def window_blend(spark, d):
    """AGG-18."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    n = F.pmod("n_chars", F.lit(6))
    w = docs.filter(n > 0).select("doc_id", "n_chars", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("i"))
    w = w.select("doc_id", (F.pmod(F.col("n_chars") * F.col("i") * 7, F.lit(1000)) / 1000.0).alias("prob"))
    g = docs.select("doc_id", (F.pmod("n_chars", F.lit(997)) / 997.0).alias("global_prob"))
    return C.blend_windows(g, w, "doc_id").select("doc_id", rnd("blended", 8).alias("blended"))


@query("session_summary", f"""
WITH g AS (SELECT user_id AS call_id, max(value / 5) AS p, arg_max(value / 6, (ts, event_id)) AS f, max(CAST(event_type = 'error' AND value > 300 AS INTEGER)) AS a, arg_max(value / 10, (ts, event_id)) AS s FROM events GROUP BY 1)
SELECT call_id, CASE WHEN p >= 65 THEN 'CRITICAL_CLONE_DETECTED' WHEN p >= 50 THEN 'HIGH_SPOOF_RISK' ELSE 'AUTHENTIC_CALL' END AS verdict,
  CASE WHEN p >= 50 OR a = 1 THEN 'AI-Cloned Voice Detected' ELSE 'Call Verified Authentic' END AS verdict_title, {r('p', 1)} AS peak_risk, {r('f', 1)} AS final_risk, a = 1 AS alert_triggered, {r('s', 1)} AS remote_speech_sec, {r('s', 1)} AS local_speech_sec FROM g""")
def session_summary(spark, d):
    """AGG-22."""
    e = table(spark, d, "events")
    tel = e.select(F.col("user_id").alias("call_id"), F.struct("ts", "event_id").alias("seq"), (F.col("value") / 5).alias("peak_risk"), (F.col("value") / 6).alias("call_risk"),
                   ((F.col("event_type") == "error") & (F.col("value") > 300)).alias("alert"), (F.col("value") / 10).alias("seconds_a"), (F.col("value") / 10).alias("seconds_b"))
    return C.session_summary(tel)


@query("cosine_to_centroid", f"""
WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY 1)
SELECT vec_id, {r('1e0 - list_cosine_similarity(embedding::DOUBLE[], centroid)', 6)} AS distance FROM embeddings JOIN c USING (label)""")
def cosine_to_centroid(spark, d):
    """SIG-18: distance of each vector to the mean of its own label."""
    e = table(spark, d, "embeddings")
    c = e.groupBy("label").agg(V.mean_vector("embedding", 64).alias("centroid"))
    return e.join(c, "label").select("vec_id", rnd(F.lit(1.0) - V.cosine_similarity("embedding", "centroid"), 6).alias("distance"))


@query("nearest_centroid", f"""
WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY 1),
p AS (SELECT vec_id, c.label AS k, 1e0 - list_cosine_similarity(embedding::DOUBLE[], centroid) AS dist FROM embeddings, c)
SELECT vec_id, arg_min(k, dist) AS nearest, {r('min(dist)', 6)} AS distance FROM p GROUP BY 1""")
def nearest_centroid(spark, d):
    """JOIN-08, general form."""
    e = table(spark, d, "embeddings")
    c = e.groupBy("label").agg(V.mean_vector("embedding", 64).alias("centroid"))
    return L.nearest_centroid(e, c, "label", "embedding", 64).select("vec_id", "nearest", rnd("distance", 6).alias("distance"))


def voice_segments(spark, d):
    """Embeddings as segments of calls of 25."""
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 25).alias("call_id"), F.pmod("vec_id", F.lit(25)).alias("seg_idx"), F.col("embedding").alias("emb"), "vec_id", (F.pmod("vec_id", F.lit(9)) / 3.0 + 0.5).alias("dur"))


@query("diarize_by_clusters")
def diarize_by_clusters(spark, d):
    """ML-08, JOIN-08 batch rule."""
    seg = L.assign_by_margin(L.cluster_segments(voice_segments(spark, d)), 64)
    return seg.select("call_id", "seg_idx", "cluster", "speaker", "is_overlap", rnd("sim_a", 6).alias("sim_a"), rnd("sim_b", 6).alias("sim_b"), "confidence")


@query("centroid_margin_assignment", f"""
WITH s AS (SELECT vec_id // 25 AS call_id, vec_id % 25 AS seg_idx, embedding::DOUBLE[] AS emb, vec_id % 2 AS cluster FROM embeddings),
m AS (SELECT call_id, cluster, i, avg(emb[i]) AS x FROM s, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT call_id, cluster, list(x ORDER BY i) AS v FROM m GROUP BY ALL),
n AS (SELECT call_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT s.call_id, seg_idx, n, list_cosine_similarity(emb, a.v) AS sa, list_cosine_similarity(emb, b.v) AS sb FROM s JOIN c a ON a.call_id = s.call_id AND a.cluster = 0 JOIN c b ON b.call_id = s.call_id AND b.cluster = 1 JOIN n ON n.call_id = s.call_id)
SELECT call_id, seg_idx, abs(sa - sb) < 0.007e0 AND n >= 3 AS is_overlap, CASE WHEN abs(sa - sb) < 0.007e0 AND n >= 3 THEN 'Overlap (A+B)' WHEN sa >= sb THEN 'Speaker A' ELSE 'Speaker B' END AS speaker FROM p""")
def centroid_margin_assignment(spark, d):
    """JOIN-08 batch rule with given clusters."""
    seg = voice_segments(spark, d).withColumn("cluster", F.pmod("vec_id", F.lit(2)))
    return L.assign_by_margin(seg, 64).select("call_id", "seg_idx", "is_overlap", "speaker")
