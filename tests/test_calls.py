import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import calls as C
from earshot.operators import clustering as L
from earshot.plans import call_analysis as P


def slow_clusters(v):
    """Average linkage under cosine distance, by definition."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = 1 - u @ u.T
    groups = [[i] for i in range(len(v))]
    while len(groups) > 2:
        best = min(((np.mean([dist[a, b] for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
        _, i, j = best
        groups[i] += groups.pop(j)
    labels = np.zeros(len(v), int)
    for g in groups:
        if 0 not in g:
            labels[g] = 1
    return labels


@pytest.mark.parametrize("seed", range(6))
def test_clusters_against_definition(seed):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((2 + 7 * seed, 8)) + np.where(rng.uniform(size=(2 + 7 * seed, 1)) < 0.5, 1.0, -0.5)
    assert (L.two_clusters(v) == slow_clusters(v)).all()


def test_margin_assignment(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0, a), (1, 1, b), (1, 2, a), (1, 3, [0.7071, 0.7071]), (2, 0, a)]
    got = {(r.call_id, r.seg_idx): r for r in L.assign_by_margin(L.cluster_segments(spark.createDataFrame(rows, "call_id int, seg_idx int, emb array<double>")), 2).collect()}
    assert got[(1, 0)].speaker == "Speaker A" and got[(2, 0)].speaker == "Speaker A" and got[(2, 0)].confidence == 0.90
    assert got[(1, 1)].speaker in ("Speaker B", "Overlap (A+B)")


SEG = "call_id int, seg_idx int, start_sec double, end_sec double, dur double, speaker string, is_overlap boolean, prob double, phase_var double, hf_ratio double, jitter double, contrast_std double"


def seg(call, i, dur, who, prob, overlap=False):
    return (call, i, i * 3.0, i * 3.0 + dur, dur, who, overlap, prob, 0.0, 0.0, 0.0, 0.0)


@pytest.fixture(scope="module")
def report(spark):
    rows = [
        seg(1, 0, 2.0, "Speaker A", 0.1), seg(1, 1, 2.0, "Speaker B", 0.9), seg(1, 2, 0.5, "Speaker B", 0.0), seg(1, 3, 1.0, "Speaker B", 0.6),
        seg(2, 0, 2.0, "Speaker A", 0.1),
        seg(3, 0, 1.0, "Speaker A", 0.1), seg(3, 1, 2.0, "Overlap (A+B)", 0.1, True),
        seg(4, 0, 2.0, "Speaker A", 0.1), seg(4, 1, 0.6, "Speaker B", 0.99),
    ]
    segments = spark.createDataFrame(rows, SEG)
    durations = C.call_durations(segments)
    facts = segments.select("call_id").distinct().select("call_id", F.lit("en").alias("language"), F.lit(False).alias("telephony"), F.lit(0.8).alias("diarization_confidence"), F.lit(True).alias("is_usable"),
                                                         F.lit("").alias("rejection_reason"), F.lit("father").alias("role"), F.lit(True).alias("financial"))
    people = C.speaker_assessments(C.speaker_scores(segments, durations), facts.select("call_id", "language", "telephony", "diarization_confidence"))
    verdicts = C.call_verdicts(durations, C.remote_risk(people), facts.drop("language", "telephony", "diarization_confidence"))
    return segments, people, verdicts


def test_weighted_scores_and_eligibility(report):
    people = {(r.call_id, r.speaker): r for r in report[1].collect()}
    assert people[(1, "Speaker B")].spoof_score == pytest.approx((0.9 * 2 + 0.6) / 3)
    assert people[(4, "Speaker B")].voice_risk == "insufficient_data" and people[(4, "Speaker B")].analysis_confidence == 0.30
    assert (2, "Speaker B") not in people and people[(2, "Speaker A")].voice_risk == "low"


def test_verdicts(report):
    v = {r.call_id: r for r in report[2].collect()}
    assert v[1].call_assessment == "high_spoof_risk" and "[ALERT: High-value" in v[1].guidance
    assert v[2].call_assessment == "low_risk" and "[ALERT" not in v[2].guidance
    assert v[3].call_assessment == "insufficient_evidence" and v[3].overlap_percent == pytest.approx(66.7)
    assert v[4].call_assessment == "low_risk" and v[4].overall_call_risk == 0.0


def test_report_pages(report):
    segments, people, verdicts = report
    pages = C.call_report(segments, verdicts, people, page=3).filter("call_id = 1").orderBy("page").collect()
    assert [len(p.timeline) for p in pages] == [3, 1] and [t.seg_idx for p in pages for t in p.timeline] == [0, 1, 2, 3]
    assert [s.speaker for s in pages[0].speakers] == ["Speaker A", "Speaker B"]


def test_spans_in_one_row(spark):
    y = np.zeros(64000)
    y[8000:24000] = np.sin(np.arange(16000) * 0.2)
    y[26000:34000] = np.sin(np.arange(8000) * 0.2)
    y[60000:60100] = 0.5
    got = spark.createDataFrame([(y.tolist(),), (np.zeros(0).tolist(),)], "pcm array<double>").select(P.speech_spans("pcm", P.SegmentRules()).alias("s")).collect()
    spans = [(p.s, p.e) for p in got[0].s]
    assert spans[0][0] < 8000 - 1500 and 34000 < spans[0][0] + 40000 and max(e - s for s, e in spans) <= 40000
    assert all(e - s >= 8000 for s, e in spans) and [(p.s, p.e) for p in got[1].s] == [(0, 0)]


def test_nearest_centroid_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cents, rows = rng.standard_normal((23, 5)), rng.standard_normal((60, 5))
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(cents)], "speaker int, centroid array<double>")
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id int, emb array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = (1 - unit(rows) @ unit(cents).T).argmin(axis=1).tolist()
    for most in (2000, 4):
        monkeypatch.setattr(L, "CENTROIDS_AT_ONCE", most)
        got = [r.nearest for r in L.nearest_centroid(v, c, "speaker", "emb", 5).orderBy("id").collect()]
        assert got == want


def test_call_events(spark):
    rows = [("a", s, "00:0%d" % s, who, speech, ra, rb, "bank_agent") for s, who, speech, ra, rb in [
        (0, "A", True, 5.0, 5.0), (1, "A", True, 6.0, 5.0), (2, "B", True, 6.0, 40.0), (3, "SILENCE", False, 6.0, 40.0), (4, "B", True, 6.0, 90.0), (5, "A", True, 7.0, 90.0), (6, "B", True, 7.0, 90.0), (7, "OVERLAP", True, 7.0, 90.0)]]
    tel = spark.createDataFrame(rows, "call_id string, seq long, timestamp string, speaker string, is_speech boolean, risk_a double, risk_b double, role string")
    got = [(r.seq, r.type, r.risk) for r in C.call_events(tel, F.lit(0)).orderBy("seq").collect()]
    assert got == [(0, "INFO", 5.0), (2, "INFO", 40.0), (5, "INFO", 7.0), (6, "ALERT", 90.0), (7, "OVERLAP", 25.0)]
    last = C.call_events(tel, F.lit(0), most=1).first()
    assert last.seq == 7 and "Bank Agent" in [r.text for r in C.call_events(tel, F.lit(0)).collect() if r.seq == 6][0]


def test_long_calls_are_clustered_in_parts(spark):
    rng = np.random.default_rng(11)
    voices = rng.normal(size=(2, 12))
    rows = []
    for name, n in (("short", 30), ("long", 700), ("one", 1), ("edge", 64)):
        who = (rng.random(n) < 0.4).astype(int)
        who[0] = 0
        rows += [(name, k, (voices[w] + 0.4 * rng.normal(size=12)).tolist(), int(w)) for k, w in enumerate(who)]
    df = spark.createDataFrame(rows, "call_id string, seg_idx int, emb array<double>, who int").repartition(5)
    whole = {(r.call_id, r.seg_idx): r.cluster for r in L.cluster_segments(df).collect()}
    split = L.cluster_segments(df, most=64)
    assert split.schema["seg_idx"].dataType.simpleString() == "int" and split.count() == len(rows)
    wrong = 0
    for r in split.collect():
        if r.call_id != "long":  # one group: equal labels
            assert r.cluster == whole[r.call_id, r.seg_idx]
        else:
            wrong += r.cluster != r.who
    assert wrong <= 7
    sums = np.stack([r[2] for r in rows if r[0] == "edge"])
    labels = L.average_linkage(L._units(sums), np.ones(len(sums)), 5)
    assert len(set(labels.tolist())) == 5
