"""Risk, fusion and quality rules over `events` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import risk as R
from ..functions.numeric import rnd
from ..session import table
from . import query, r


def risk_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Events read as scored clips: probability from the value, signals from the `k` property."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    lang = F.pmod("user_id", F.lit(4))
    return e.select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("p"),
        k.alias("k"),
        (k / 100.0).alias("phase"),
        (k * 0.0004).alias("hf"),
        (k * 0.002).alias("jitter"),
        (k * 0.07 + 5.0).alias("contrast"),
        F.when(lang == 0, "hi").when(lang == 1, "ta-IN").when(lang == 2, "en").alias("language"),
        (F.col("event_type") == "signup").alias("unknown_number"),
        (F.col("event_type") == "purchase").alias("high_value"),
        (F.col("event_type") == "error").alias("prior_fraud"),
        (F.col("event_type") == "view").alias("trusted"),
        F.when(F.pmod("user_id", F.lit(5)) != 0, F.least(F.col("value") / 200.0, F.lit(1.0))).alias("model_prob"),
        F.when(F.pmod("user_id", F.lit(3)) != 0, F.least(k / 90.0, F.lit(1.0))).alias("ext_prob"),
    )


RISK_IN = """
risk_in AS (
  SELECT event_id, user_id, ts, event_type, value, k, p,
    k / 100e0 AS phase, k * 0.0004e0 AS hf, k * 0.002e0 AS jitter, k * 0.07e0 + 5e0 AS contrast,
    CASE user_id % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'ta-IN' WHEN 2 THEN 'en' END AS language,
    (user_id % 4) IN (0, 1) AS indic,
    event_type = 'signup' AS unknown_number, event_type = 'purchase' AS high_value,
    event_type = 'error' AS prior_fraud, event_type = 'view' AS trusted,
    CASE WHEN user_id % 5 <> 0 THEN p END AS model_prob,
    CASE WHEN user_id % 3 <> 0 THEN least(k / 90e0, 1e0) END AS ext_prob
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, least(value / 200e0, 1e0) AS p FROM events)
)"""


def assess_sql(src: str, p: str = "p", tau: str = "0.51e0", lang: str = "indic", context: str | None = None) -> str:
    """CTE chain risk_1 .. risk_5 that states RSK-02 .. RSK-06 over `src`."""
    ctx = context or (
        "(CASE WHEN unknown_number THEN 8e0 ELSE 0e0 END) + (CASE WHEN high_value THEN 12e0 ELSE 0e0 END)"
        " + (CASE WHEN prior_fraud THEN 15e0 ELSE 0e0 END) + (CASE WHEN trusted AND lifted_prob < 0.55e0 THEN -10e0 ELSE 0e0 END)"
    )
    pt, jt, ct = (f"(CASE WHEN {lang} THEN {a} ELSE {b} END)" for a, b in
                  (("0.48e0", "0.45e0"), ("0.14e0", "0.12e0"), ("8.8e0", "8.6e0")))
    return f"""
risk_1 AS (
  SELECT *,
    {r(f"CASE WHEN phase > {pt} THEN least(1e0, (phase - {pt}) / 0.35e0) WHEN phase > 0 AND phase < 0.015e0 THEN least(1e0, (0.015e0 - phase) / 0.015e0) ELSE 0e0 END", 4)} AS phase_anomaly,
    {r("CASE WHEN hf > 0.014e0 THEN least(1e0, (hf - 0.014e0) / 0.020e0) ELSE 0e0 END", 4)} AS hf_anomaly,
    {r(f"CASE WHEN jitter > {jt} THEN least(1e0, (jitter - {jt}) / 0.20e0) WHEN jitter > 0 AND jitter < 0.010e0 THEN least(1e0, (0.010e0 - jitter) / 0.010e0) ELSE 0e0 END", 4)} AS jitter_anomaly,
    {r(f"CASE WHEN contrast > {ct} THEN least(1e0, (contrast - {ct}) / 2.5e0) ELSE 0e0 END", 4)} AS contrast_anomaly
  FROM {src}),
risk_2 AS (
  SELECT *,
    contrast_anomaly * 0.40e0 + phase_anomaly * 0.30e0 + hf_anomaly * 0.20e0 + jitter_anomaly * 0.10e0 AS weighted_anomaly,
    CASE WHEN contrast_anomaly >= 0.35e0 AND {p} >= 0.38e0 THEN greatest({p}, contrast_anomaly * 0.35e0 + 0.52e0)
         WHEN contrast_anomaly >= 0.65e0 THEN greatest({p}, contrast_anomaly * 0.35e0 + 0.55e0) ELSE {p} END AS lifted_prob,
    {tau} AS tau, greatest(0.48e0, {tau} * 0.88e0) AS mid, greatest(0.28e0, {tau} * 0.58e0) AS low
  FROM risk_1),
risk_3 AS (
  SELECT *,
    CASE WHEN lifted_prob >= 0.75e0 THEN least(99e0, (lifted_prob - 0.75e0) / 0.25e0 * 14e0 + 82e0 + weighted_anomaly * 4e0)
         WHEN lifted_prob >= tau THEN least(82e0, (lifted_prob - tau) / greatest(0.01e0, 0.75e0 - tau) * 20e0 + 60e0 + weighted_anomaly * 6e0)
         WHEN lifted_prob >= mid THEN least(58e0, (lifted_prob - mid) / greatest(0.01e0, tau - mid) * 28e0 + 28e0 + weighted_anomaly * 12e0)
         WHEN lifted_prob >= low THEN least(24e0, (lifted_prob - low) / greatest(0.01e0, mid - low) * 16e0 + 8e0 + weighted_anomaly * 3e0)
         ELSE least(10e0, lifted_prob / greatest(0.01e0, low) * 6e0 + 2e0 + weighted_anomaly * 2e0) END AS raw_risk,
    lifted_prob >= 0.75e0 AS safety_override
  FROM risk_2),
risk_4 AS (SELECT *, {ctx} AS context_modifier FROM risk_3),
risk_5 AS (
  SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM (SELECT *, {r("greatest(0e0, least(100e0, raw_risk + context_modifier))", 1)} AS risk_score FROM risk_4))"""


def assessed(spark, d):
    return R.assess_risk(
        risk_inputs(spark, d), prob="p", tau=0.51, phase="phase", hf="hf", jitter="jitter", contrast="contrast", language="language",
        unknown_number="unknown_number", high_value="high_value", prior_fraud="prior_fraud", trusted="trusted",
    )


@query("fuse_scores", f"""
WITH {RISK_IN}
SELECT event_id, {r('''CASE WHEN model_prob IS NOT NULL AND ext_prob IS NOT NULL THEN model_prob * 0.5e0 + ext_prob * 0.5e0
  WHEN model_prob IS NOT NULL THEN model_prob WHEN ext_prob IS NOT NULL THEN ext_prob
  ELSE least(0.95e0, greatest(0.05e0, phase * 1.5e0)) END''', 6)} AS spoof_prob FROM risk_in""")
def fuse_scores(spark, d):
    """FUS-01."""
    return risk_inputs(spark, d).select("event_id", rnd(R.fuse_scores("model_prob", "ext_prob", "phase"), 6).alias("spoof_prob"))


@query("join_model_and_external_scores", f"""
WITH {RISK_IN}, m AS (SELECT event_id, model_prob FROM risk_in WHERE model_prob IS NOT NULL),
x AS (SELECT event_id, ext_prob FROM risk_in WHERE ext_prob IS NOT NULL)
SELECT event_id, {r('''CASE WHEN model_prob IS NOT NULL AND ext_prob IS NOT NULL THEN model_prob * 0.5e0 + ext_prob * 0.5e0
  WHEN model_prob IS NOT NULL THEN model_prob ELSE ext_prob END''', 6)} AS spoof_prob,
  model_prob IS NOT NULL AND ext_prob IS NOT NULL AS both_present
FROM m FULL JOIN x USING (event_id)""")
def join_scores(spark, d):
    """JOIN-10: two score tables, either side may lack a clip."""
    base = risk_inputs(spark, d)
    model = base.filter("model_prob IS NOT NULL").select("event_id", "model_prob")
    ext = base.filter("ext_prob IS NOT NULL").select("event_id", "ext_prob")
    return model.join(ext, "event_id", "full_outer").select(
        "event_id",
        rnd(R.fuse_scores("model_prob", "ext_prob"), 6).alias("spoof_prob"),
        (F.col("model_prob").isNotNull() & F.col("ext_prob").isNotNull()).alias("both_present"),
    )


@query("risk_levels", f"""
WITH {RISK_IN} SELECT event_id, CASE WHEN p * 100 >= 80 THEN 'CRITICAL' WHEN p * 100 >= 60 THEN 'HIGH' WHEN p * 100 >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  p * 100 >= 60 AS alert FROM risk_in""")
def risk_levels(spark, d):
    """RSK-01."""
    level = R.risk_level(F.col("p") * 100)
    return risk_inputs(spark, d).select("event_id", level.alias("risk_level"), R.is_alert(level).alias("alert"))


@query("risk_anomalies", f"WITH {RISK_IN}, {assess_sql('risk_in')} SELECT event_id, phase_anomaly, hf_anomaly, jitter_anomaly, contrast_anomaly FROM risk_1")
def risk_anomalies(spark, d):
    """RSK-02."""
    return risk_inputs(spark, d).select("event_id", *[c.alias(n) for n, c in R.anomaly_columns("phase", "hf", "jitter", "contrast", R.is_indic("language")).items()])


@query("risk_probability_lift", f"WITH {RISK_IN}, {assess_sql('risk_in')} SELECT event_id, {r('weighted_anomaly', 6)} AS weighted_anomaly, {r('lifted_prob', 6)} AS lifted_prob FROM risk_2")
def risk_lift(spark, d):
    """RSK-03."""
    return assessed(spark, d).select("event_id", rnd("weighted_anomaly", 6).alias("weighted_anomaly"), rnd("lifted_prob", 6).alias("lifted_prob"))


@query("risk_bands", f"WITH {RISK_IN}, {assess_sql('risk_in')} SELECT event_id, {r('raw_risk', 6)} AS raw_risk, safety_override FROM risk_3")
def risk_bands(spark, d):
    """RSK-04."""
    return assessed(spark, d).select("event_id", rnd("raw_risk", 6).alias("raw_risk"), "safety_override")


@query("risk_context", f"WITH {RISK_IN}, {assess_sql('risk_in')} SELECT event_id, context_modifier, risk_score FROM risk_5")
def risk_context(spark, d):
    """RSK-05."""
    return assessed(spark, d).select("event_id", "context_modifier", "risk_score")


@query("risk_assessment", f"""
WITH {RISK_IN}, {assess_sql('risk_in')}
SELECT event_id, risk_score, risk_level, risk_level IN ('HIGH', 'CRITICAL') AS alert,
  {r('lifted_prob', 3)} AS signal_prob, {r('contrast_anomaly', 3)} AS signal_contrast, {r('phase_anomaly', 3)} AS signal_phase,
  'Impersonation risk evaluated at ' || format('{{:.1f}}', risk_score) || '/100 (' || risk_level || '). ML Spoof Probability: ' || format('{{:.3f}}', {r('lifted_prob', 3)}) || '. ' ||
  CASE risk_level WHEN 'CRITICAL' THEN '[ALERT: High-Confidence AI Voice Clone / Synthetic Speech Detected.]'
    WHEN 'HIGH' THEN '[ALERT: Synthetic Vocoder & Neural Speech Artifacts Detected.]'
    WHEN 'MEDIUM' THEN '[Ambiguous Audio - Degraded Acoustic Signal or Background Noise.]'
    ELSE '[Verified Genuine Human Voice - Natural Vocal Tract Biomechanics Confirmed.]' END AS explanation
FROM risk_5""")
def risk_assessment(spark, d):
    """RSK-06 with everything before it."""
    s = F.col("signal_breakdown")
    return assessed(spark, d).select(
        "event_id", "risk_score", "risk_level", "alert",
        s["ml_classifier_spoof_prob"].alias("signal_prob"), s["vocoder_contrast_anomaly"].alias("signal_contrast"),
        s["acoustic_anomaly"].alias("signal_phase"), "explanation",
    )


@query("risk_by_type", f"""
WITH {RISK_IN}, {assess_sql('risk_in')}
SELECT event_type, risk_level, count(*) AS clips, {r('avg(risk_score)', 4)} AS mean_risk, max(risk_score) AS max_risk FROM risk_5 GROUP BY ALL""")
def risk_by_type(spark, d):
    """Assessment rolled up: the fleet view of RSK-01 .. RSK-05."""
    return assessed(spark, d).groupBy("event_type", "risk_level").agg(
        F.count("*").alias("clips"), rnd(F.avg("risk_score"), 4).alias("mean_risk"), F.max("risk_score").alias("max_risk"))


@query("live_risk", f"""
WITH {RISK_IN}
SELECT event_id, {r('''greatest(1e0, least(99e0, CASE WHEN p < 0.25e0 THEN p / 0.25e0 * 6e0 + 3e0
  WHEN p < 0.51e0 THEN (p - 0.25e0) / greatest(0.01e0, 0.51e0 - 0.25e0) * 13e0 + 9e0
  WHEN p < 0.65e0 THEN (p - 0.51e0) / (0.65e0 - 0.51e0) * 20e0 + 55e0
  ELSE least(24e0, (p - 0.65e0) / 0.35e0 * 24e0) + 75e0 END))''', 1)} AS overall_risk,
  CASE WHEN p < 0.51e0 THEN 'LOW' WHEN p < 0.65e0 THEN 'HIGH' ELSE 'CRITICAL' END AS live_level,
  CASE WHEN p >= 0.70e0 THEN 'POSSIBLE AI CLONE' WHEN p >= 0.45e0 THEN 'SUSPICIOUS SYNTHETIC' WHEN p >= 0.30e0 THEN 'REVIEW RECOMMENDED' ELSE 'LOW RISK' END AS status,
  CASE WHEN p >= 0.70e0 THEN 'POSSIBLE AI CLONE DETECTED' END AS banner
FROM risk_in""")
def live_risk(spark, d):
    """RSK-07, RSK-08."""
    m = R.live_risk("p", 0.51)
    return risk_inputs(spark, d).select("event_id", m["overall_risk"].alias("overall_risk"), m["live_level"].alias("live_level"),
                                        R.live_status("p").alias("status"), R.live_banner("p").alias("banner"))


@query("speaker_risk", f"""
WITH {RISK_IN}, {assess_sql('risk_in')},
n AS (SELECT *, CASE risk_level WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'elevated' WHEN 'MEDIUM' THEN 'moderate' ELSE 'low' END AS name FROM risk_5)
SELECT event_id, name AS speaker_risk,
  1 + CAST(name = 'critical' AND hf > 0.015e0 AS INTEGER) + CAST(name = 'critical' AND phase > 0.55e0 AS INTEGER) + CAST(k % 2 = 0 AS INTEGER) AS n_reasons,
  CASE WHEN name IN ('critical', 'elevated') OR risk_score >= 60 THEN 'high_spoof_risk' WHEN name = 'moderate' OR risk_score >= 25 THEN 'review_recommended' ELSE 'low_risk' END AS decision,
  CASE WHEN high_value AND NOT (name = 'low' AND risk_score < 25) THEN true ELSE false END AS money_suffix,
  {r('0.8e0 * 0.5e0 + least(1e0, value / 4e0) * 0.5e0', 2)} AS analysis_confidence
FROM n""")
def speaker_risk(spark, d):
    """RSK-09, RSK-10, RSK-11."""
    df = assessed(spark, d).withColumn("speaker_risk", R.speaker_risk_name("risk_level"))
    value = table(spark, d, "events").select("event_id", "value")
    df = df.join(value, "event_id")
    decision = R.call_decision("speaker_risk", "risk_score")
    text = R.call_guidance(decision, F.lit("father"), "high_value")
    return df.select(
        "event_id", "speaker_risk",
        F.size(R.speaker_reasons("speaker_risk", "hf", "phase", F.pmod("k", F.lit(2)) == 0)).alias("n_reasons"),
        decision.alias("decision"),
        text.contains("[ALERT: High-value").alias("money_suffix"),
        R.analysis_confidence(0.8, "value").alias("analysis_confidence"),
    )


@query("call_stage", f"""
WITH {RISK_IN},
s AS (SELECT event_id, k / 8e0 AS elapsed, value / 60e0 AS speech, p * 100 AS rb, phase * 100 AS ra, k / 40e0 AS speech_b, p * 90 AS hmean, p * 110 AS hmax FROM risk_in),
a AS (SELECT *, CASE WHEN elapsed >= 10 OR speech >= 4.5e0 THEN 'CONSOLIDATED_FINAL' WHEN elapsed >= 5 OR speech >= 1.5e0 THEN 'PRELIMINARY_AVERAGE' ELSE 'CALIBRATING' END AS stage,
  CASE WHEN speech_b < 0.5e0 OR ra >= 50 THEN greatest(ra, rb) ELSE rb END AS active FROM s),
b AS (SELECT *, CASE stage WHEN 'CONSOLIDATED_FINAL' THEN {r('CASE WHEN active >= 50 THEN greatest(active, hmax) ELSE active END', 1)}
  WHEN 'PRELIMINARY_AVERAGE' THEN {r('hmean', 1)} ELSE 5e0 END AS call_risk FROM a)
SELECT event_id, stage, call_risk,
  CASE WHEN stage = 'CALIBRATING' THEN 'CALIBRATING' WHEN call_risk >= 65 THEN 'CRITICAL' WHEN call_risk >= 50 THEN 'HIGH' WHEN call_risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level,
  stage <> 'CALIBRATING' AND call_risk >= 50 AS alert,
  CASE WHEN stage = 'CALIBRATING' THEN NULL WHEN stage = 'PRELIMINARY_AVERAGE' THEN
     CASE WHEN call_risk >= 65 THEN '⚠️ PRELIMINARY WARNING' WHEN call_risk >= 50 THEN '⚠️ PRELIMINARY ALERT' WHEN call_risk >= 25 THEN 'Preliminary average risk' ELSE 'Preliminary assessment' END
   ELSE CASE WHEN call_risk >= 65 THEN '🚨 CRITICAL ALERT' WHEN call_risk >= 50 THEN '⚠️ HIGH SPOOF RISK' WHEN call_risk >= 25 THEN 'Final assessment' ELSE 'Call verified authentic (' || format('{{:.1f}}', call_risk) || '% risk). Vocal biomechanics match natural human speech.' END END AS message_head
FROM b""")
def call_stage(spark, d):
    """RSK-12, RSK-13, RSK-14."""
    df = risk_inputs(spark, d).join(table(spark, d, "events").select("event_id", "value"), "event_id").select(
        "event_id", (F.col("k") / 8.0).alias("elapsed"), (F.col("value") / 60.0).alias("speech"), (F.col("p") * 100).alias("rb"),
        (F.col("phase") * 100).alias("ra"), (F.col("k") / 40.0).alias("speech_b"), (F.col("p") * 90).alias("hmean"), (F.col("p") * 110).alias("hmax"),
    )
    df = df.withColumn("stage", R.stage("elapsed", "speech")).withColumn("active", R.active_threat("ra", "rb", "speech_b"))
    df = df.withColumn("call_risk", R.stage_risk("stage", "active", "hmean", "hmax"))
    df = df.withColumn("level", R.stage_level("stage", "call_risk"))
    text = R.stage_message("stage", "level", "call_risk", F.lit("bank_agent"), "elapsed", "speech")
    head = F.when(F.col("stage") == "CALIBRATING", F.lit(None)).when(text.startswith("Call verified"), text).otherwise(F.split(text, ":")[0])
    return df.select("event_id", "stage", "call_risk", "level", R.stage_alert("level").alias("alert"), head.alias("message_head"))


@query("prediction_record", f"""
WITH {RISK_IN} SELECT event_id, CASE WHEN p >= 0.5102e0 THEN 'spoof' ELSE 'genuine' END AS prediction,
 {r('p', 4)} AS spoof_probability, {r('1e0 - p', 4)} AS genuine_probability, {r('greatest(p, 1e0 - p)', 4)} AS confidence, 0.5102e0 AS calibrated_threshold FROM risk_in""")
def prediction_record(spark, d):
    """RSK-15."""
    return risk_inputs(spark, d).select("event_id", R.prediction_record("p", 0.5102).alias("rec")).select("event_id", "rec.*")


LINE_Q = """
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10e0 AS speech, l_quantity * 0.6e0 - 2e0 AS snr, l_discount * 100e0 AS clip_pct,
  l_discount / 2e0 AS clip, l_tax / 4e0 AS rms, l_linestatus = 'O' AND l_returnflag = 'R' AS tel, l_tax / 2e0 AS peak FROM lineitem)"""


def line_quality(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10.0).alias("speech"), (F.col("l_quantity") * 0.6 - 2.0).alias("snr"),
        (F.col("l_discount") * 100.0).alias("clip_pct"), (F.col("l_discount") / 2.0).alias("clip"), (F.col("l_tax") / 4.0).alias("rms"),
        ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("tel"), (F.col("l_tax") / 2.0).alias("peak"),
    )


@query("quality_gate", f"""
WITH {LINE_Q} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN speech < 1.5e0 THEN 'unusable' WHEN clip_pct > 8e0 OR snr < 4e0 THEN 'poor' WHEN snr < 10e0 OR tel OR clip_pct > 3e0 THEN 'moderate' ELSE 'good' END AS quality_level,
  NOT (speech < 1.5e0 OR clip_pct > 8e0 OR snr < 4e0) AS is_usable,
  CASE WHEN speech < 1.5e0 THEN 'Usable speech duration (' || format('{{:.1f}}', speech) || 's) is below required minimum (1.5s).'
       WHEN clip_pct > 8e0 THEN 'Severe microphone clipping detected (' || format('{{:.1f}}', clip_pct) || '% of samples distorted).'
       WHEN snr < 4e0 THEN 'Excessive background noise or low SNR (' || format('{{:.1f}}', snr) || ' dB).' ELSE '' END AS rejection_reason
FROM q""")
def quality_gate(spark, d):
    """PRJ-06."""
    g = Q.quality_gate("speech", "snr", "clip_pct", "tel")
    return line_quality(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(n) for n, c in g.items()])


@query("quality_tier", f"""
WITH {LINE_Q} SELECT l_suppkey, CASE WHEN clip > 0.05e0 OR snr < 5e0 OR rms < 0.005e0 THEN 'DEGRADED' WHEN snr < 15e0 OR clip > 0.01e0 THEN 'ACCEPTABLE' ELSE 'EXCELLENT' END AS quality_rating,
  CASE WHEN clip > 0.05e0 OR snr < 5e0 OR rms < 0.005e0 THEN snr >= 0 AND rms >= 0.002e0 ELSE true END AS tier_usable, count(*) AS clips
FROM q GROUP BY ALL""")
def quality_tier(spark, d):
    """PRJ-07, counted per supplier."""
    t = Q.quality_tier("snr", "clip", "rms")
    return line_quality(spark, d).groupBy("l_suppkey", *[c.alias(n) for n, c in t.items()]).agg(F.count("*").alias("clips"))


@query("live_quality_and_vad", f"""
WITH {LINE_Q}, c AS (SELECT *, CASE WHEN rms < 0.003e0 THEN 'SILENT' WHEN clip > 0.05e0 THEN 'CLIPPED' WHEN rms < 0.012e0 THEN 'FAIR' ELSE 'GOOD' END AS quality FROM q)
SELECT quality, (rms > 0.0035e0 OR peak > 0.018e0) AS monitor_voiced, (rms > 0.015e0 OR peak > 0.06e0) AND quality <> 'SILENT' AS session_voiced, count(*) AS chunks FROM c GROUP BY ALL""")
def live_quality_and_vad(spark, d):
    """PRJ-08, PRJ-09."""
    df = line_quality(spark, d).withColumn("quality", Q.live_quality("rms", "clip"))
    return df.groupBy("quality", Q.monitor_voiced("rms", "peak").alias("monitor_voiced"), Q.session_voiced("rms", "peak", "quality").alias("session_voiced")).agg(
        F.count("*").alias("chunks"))


@query("silence_shortcut", f"""
WITH {LINE_Q} SELECT l_suppkey,
  {r("sum(CASE WHEN rms < 0.005e0 AND peak < 0.025e0 THEN 2.0e0 ELSE speech * 20 END)", 3)} AS batch_total,
  {r("sum(CASE WHEN rms < 0.006e0 AND peak < 0.030e0 THEN 2.5e0 ELSE speech * 20 END)", 3)} AS stream_total,
  {r("sum(CASE WHEN rms < 0.0035e0 AND peak < 0.018e0 THEN 5.0e0 ELSE speech * 20 END)", 3)} AS deep_total,
  count(CASE WHEN rms < 0.005e0 AND peak < 0.025e0 THEN 1 END) AS silent_clips FROM q GROUP BY 1""")
def silence_shortcut(spark, d):
    """PRJ-10."""
    df = line_quality(spark, d).withColumn("score", F.col("speech") * 20)
    return df.groupBy("l_suppkey").agg(
        *[rnd(F.sum(Q.silence_or(m, "rms", "peak", "score")), 3).alias(f"{m}_total") for m in ("batch", "stream", "deep")],
        F.count(F.when(Q.near_silent("batch", "rms", "peak"), 1)).alias("silent_clips"))
