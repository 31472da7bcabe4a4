import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.catalog import models as catalog_models
from earshot.functions import quality as Q
from earshot.functions import signal as S
from earshot.operators import features as X
from earshot.operators.features import FEATURE_NAMES, clip_features
from earshot.operators.models import SpoofModel
from earshot.plans import call_analysis, clip_analysis
from earshot.session import materialise

RATE = 16000


def voice(hz, seconds, seed, noise=0.02):
    rng = np.random.default_rng(seed)
    t = np.arange(int(RATE * seconds)) / RATE
    y = sum(np.sin(2 * np.pi * hz * k * t) / k for k in (1, 2, 3)) * 0.25 + noise * rng.standard_normal(len(t))
    return y.astype(np.float32)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, int(i % 2), voice(120 + 10 * i, 0.6, i, 0.02 if i % 2 else 0.15).tolist()) for i in range(16)]
    feats = materialise(clip_features(spark.createDataFrame(rows, "audio_id int, label int, pcm array<float>")), "feats")
    return SpoofModel.fit(feats, "logistic", FEATURE_NAMES, rounds=20)


def test_clip_analysis(spark, model):
    clips = {"long": voice(150, 5.0, 1), "short": voice(150, 1.0, 2), "silent": np.zeros(16000, np.float32) + 0.001}
    df = spark.createDataFrame([(k, v.tolist(), "hi", True, False, False, None) for k, v in clips.items()],
                               "audio_id string, pcm array<float>, language string, unknown_number boolean, high_value boolean, prior_fraud boolean, ext_prob double")
    results = materialise(clip_analysis.analyse_clips(df, model), "results")
    got = {r.audio_id: r for r in results.collect()}
    assert set(got) == set(clips)
    assert (got["silent"].risk_score, got["silent"].risk_level, got["silent"].model_prob) == (2.0, "LOW", 0.02) and got["silent"].explanation == clip_analysis.SILENT_NOTE
    assert 0 <= got["long"].model_prob <= 1 and got["long"].explanation.startswith("Impersonation risk")
    assert 0 <= got["short"].model_prob <= 1 and not got["silent"].alert
    facts = df.select("audio_id", F.lit("h").alias("audio_sha256"), F.lit("x.wav").alias("file_name"), "language")
    events = clip_analysis.clip_events(results, facts).collect()
    assert len(events) == 2 and all("pcm" not in e.payload for e in events)


def test_call_analysis(spark, model):
    gap = np.zeros(RATE, np.float32)
    two = np.concatenate([voice(110, 2.0, 1), gap, voice(320, 2.0, 2), gap, voice(110, 2.0, 3), gap, voice(320, 2.0, 4)])
    calls = {"two": two, "tiny": voice(110, 0.4, 5), "none": np.zeros(0, np.float32)}
    df = spark.createDataFrame([(k, v.tolist(), "en", "father", True) for k, v in calls.items()], "call_id string, pcm array<float>, language string, role string, financial boolean")
    verdicts, report = call_analysis.analyse_calls(df, model)
    got = {r.call_id: r for r in verdicts.collect()}
    assert set(got) == set(calls)
    assert got["tiny"].call_assessment == "insufficient_evidence" and got["none"].call_assessment == "insufficient_evidence"
    assert got["none"].rejection_reason == "Audio buffer is empty."
    assert got["two"].n_segments >= 4 and got["two"].call_assessment in ("low_risk", "review_recommended", "high_spoof_risk", "insufficient_evidence")
    pages = {r.call_id: r for r in report.collect()}
    spoken = [e.speaker for e in pages["two"].timeline]
    assert spoken[0] in ("Speaker A", "Overlap (A+B)") and len(spoken) == got["two"].n_segments


def test_clip_analysis_from_bytes_in_one_pass(spark, model):
    """Clips as int16 bytes give what their samples give, and one Python step takes a clip to the numbers of its pieces."""
    clips = {"long": voice(150, 5.0, 1), "short": voice(150, 1.0, 2), "silent": np.zeros(16000, np.float32) + 0.001, "none": np.zeros(0, np.float32)}
    pcm = {k: (v * 32767).astype("<i2") for k, v in clips.items()}
    facts = "language string, unknown_number boolean, high_value boolean, prior_fraud boolean, ext_prob double"
    raw = spark.createDataFrame([(k, bytearray(v.tobytes()), "hi", True, False, False, None) for k, v in pcm.items()], f"audio_id string, pcm binary, {facts}")
    samples = spark.createDataFrame([(k, (v / np.float32(32768)).tolist(), "hi", True, False, False, None) for k, v in pcm.items()], f"audio_id string, pcm array<float>, {facts}")
    one, two = (clip_analysis.analyse_clips(df, model) for df in (raw, samples))
    rows = lambda df: sorted((r.audio_id, r.model_prob, r.risk_score, r.explanation) for r in df.collect())
    assert rows(one) == rows(two) and [r[0] for r in rows(one)] == ["long", "short", "silent"]
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan  # one Python step


def bursts(seed, count=6):
    """A call of voiced stretches and near silence."""
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(count):
        parts += [voice(float(rng.integers(90, 350)), float(rng.uniform(0.2, 3.2)), seed + k), np.zeros(int(RATE * rng.uniform(0.05, 0.6)), np.float32)]
    return np.concatenate(parts)


def test_call_analysis_reads_audio_once(spark, model, monkeypatch):
    """one Python step takes a call to the numbers of its segments, and the verdicts do not read the audio again."""
    plans, write = [], call_analysis.materialise
    monkeypatch.setattr(call_analysis, "materialise", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, label))[1])
    calls = {"a": bursts(1), "b": bursts(2), "tiny": voice(110, 0.4, 5)}
    df = spark.createDataFrame([(k, v.tolist(), "en", "father", True) for k, v in calls.items()], "call_id string, pcm array<float>, language string, role string, financial boolean")
    verdicts, report = call_analysis.analyse_calls(X.change_clips(df, kind="float"), model)
    assert plans[0].count("MapInPandas") == 1 and "ArrowEvalPython" not in plans[0]
    for out in (verdicts, report):
        assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()
    raw = {k: (v * 32767).astype("<i2") for k, v in calls.items()}
    facts = "language string, role string, financial boolean"
    as_bytes = spark.createDataFrame([(k, bytearray(v.tobytes()), "en", "father", True) for k, v in raw.items()], f"call_id string, pcm binary, {facts}")
    as_samples = spark.createDataFrame([(k, (v / np.float32(32768)).tolist(), "en", "father", True) for k, v in raw.items()], f"call_id string, pcm array<float>, {facts}")
    one, two = (sorted(map(tuple, call_analysis.analyse_calls(c, model)[0].collect())) for c in (as_bytes, as_samples))
    assert one == two and len(one) == 3


def test_described_calls_against_columns(spark, model):
    """Gate, segments, voices and scores equal those of the column forms, step by step."""
    rules, bad = call_analysis.SegmentRules(), bursts(9)
    bad[500] = np.nan
    calls = {f"c{k}": bursts(20 + k) for k in range(6)} | {"loud": np.sign(bursts(3)), "flat": voice(200, 3.0, 4), "tiny": voice(110, 0.4, 5), "none": np.zeros(0, np.float32), "bad": bad, "still": np.zeros(40000, np.float32)}
    df = spark.createDataFrame([(k, v.tolist(), k[0]) for k, v in calls.items()] + [("null", None, None)], "call_id string, pcm array<float>, language string")
    got = materialise(call_analysis.describe_calls(df, model), "described")
    heads = {r.call_id: r for r in got.filter("seg_idx <= 0").collect()}
    assert set(heads) == set(calls) | {"null"} and heads["null"].facts.language is None and heads["c0"].facts.language == "c"

    usable = df.filter(~F.col("call_id").isin("none", "bad", "null"))
    gate = usable.select("call_id", S.frame_rms("pcm", 480, 240).alias("e"), (S.clipping_ratio("pcm", 0.985) * 100).alias("clipped"), F.size("pcm").alias("n"))
    gate = gate.select("*", *[c.alias(k) for k, c in S.gate_measures("e").items()]).withColumn("telephony", F.lit(False))
    for r in gate.select("*", *[c.alias(k) for k, c in Q.quality_gate("usable_sec", "snr_db", "clipped", "telephony", total_sec="n").items()]).collect():
        q = heads[r.call_id].quality
        assert (q.usable_sec, q.speech_ratio, q.is_usable) == (r.usable_sec, r.speech_ratio, r.is_usable) and q.snr_db == pytest.approx(r.snr_db, abs=1e-6)
        assert (heads[r.call_id].seg_idx == 0) == r.is_usable
    assert all(heads[k].quality.rejection_reason == "Audio buffer is empty." for k in ("none", "bad", "null"))

    spans = {r.call_id: [(p.s, p.e) for p in r.spans] for r in usable.select("call_id", call_analysis.speech_spans("pcm", rules).alias("spans")).collect() if heads[r.call_id].quality.is_usable}
    assert len(spans) >= 5 and max(map(len, spans.values())) > 3
    for k in spans:
        assert call_analysis.spans_of(np.asarray(calls[k], np.float64), rules) == spans[k]
    segments = spark.createDataFrame([(k, i, calls[k][s:e].tolist()) for k, cut in spans.items() for i, (s, e) in enumerate(cut)], "call_id string, seg_idx int, pcm array<float>")
    voices = X.describe_clips(segments, hop=256, keep_pcm=True).select("call_id", "seg_idx", "pcm", X.timbre_segment().alias("emb"))
    want = {(r.call_id, r.seg_idx): r for r in model.score(clip_features(voices)).collect()}
    rows = {(r.call_id, r.seg_idx): r for r in got.filter("seg_idx >= 0").collect()}
    assert set(rows) == set(want)
    for key, r in rows.items():
        assert r.emb == pytest.approx(want[key].emb, abs=1e-9) and r.prob == pytest.approx(want[key].model_prob, abs=1e-9)
        assert (r.phase_var, r.hf_ratio, r.jitter) == pytest.approx([want[key].f[n] for n in ("acoustic_phase_derivative_var", "spectral_hf_energy_ratio", "prosody_jitter")], abs=1e-9)


def test_model_describes_labelled_documents_only(spark, tmp_path, monkeypatch):
    """documents without a label train nothing, so they are not described; the model is that of all features."""
    rows = [(i, f"{i} some words of document {i * 7919} " * (3 + i % 5), "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i // 3 % 2, 0) for i in range(0, 60, 3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes, write = [], clip_analysis.materialise

    def noted(df, label):
        out = write(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(clip_analysis, "materialise", noted)
    model = catalog_models._document_model(spark, str(tmp_path))
    monkeypatch.setattr(catalog_models, "LABELS_AT_ONCE", 5)  # more labels than are broadcast
    joined = catalog_models._document_model(spark, str(tmp_path))
    assert sizes == [20, 20] and joined.voters[0].coefficients.toArray() == pytest.approx(model.voters[0].coefficients.toArray(), rel=1e-9, abs=1e-12)
    clips = spark.createDataFrame(rows, "audio_id bigint, text string, lang string").select("audio_id", F.encode("text", "utf-8").alias("pcm"))
    labels = spark.createDataFrame([(i, i // 3 % 2) for i in range(0, 60, 3)], "audio_id bigint, label int")
    whole = SpoofModel.fit(clip_features(clips).join(labels, "audio_id"), "logistic", rounds=20)
    assert model.voters[0].coefficients.toArray() == pytest.approx(whole.voters[0].coefficients.toArray(), rel=1e-9, abs=1e-12)


def test_scores_and_report_reach_the_verdicts(spark, tmp_path, monkeypatch):
    """calls made of documents pass the gate or do not, and those that pass are judged by the model's scores."""
    rng = np.random.default_rng(2)
    text = lambda n, low: "".join(map(chr, rng.integers(low, 122, n)))
    rows = [(i, text(700 + 150 * i, 33) if i % 3 else text(10, 33), "en") for i in range(12)] + [(12, None, "en"), (13, "", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for prob in (0.02, 0.97):
        class Fixed:
            threshold = 0.5

            def score(self, df, prob=prob):
                return df.withColumn("model_prob", F.lit(prob))

        monkeypatch.setattr(catalog_models, "_document_model", lambda spark, d: Fixed())
        found[prob] = {r.call_id: r for r in catalog_models.call_analysis_query(spark, str(tmp_path)).collect()}
    genuine, cloned = found[0.02], found[0.97]
    assert set(genuine) == set(cloned) == set(range(14))
    judged = {k for k, r in genuine.items() if (r.call_assessment, cloned[k].call_assessment) == ("low_risk", "high_spoof_risk")}
    assert len(judged) >= 3 and {r.quality_level for r in genuine.values()} > {"unusable"}
    for k in judged:
        assert cloned[k].spoof_score == 0.97 and cloned[k].overall_call_risk > genuine[k].overall_call_risk
        assert genuine[k].timeline_entries == genuine[k].n_segments > 0 and genuine[k].guidance != cloned[k].guidance
    assert all(genuine[k].call_assessment == "insufficient_evidence" and genuine[k].timeline_entries == 0 for k in (0, 12, 13))
