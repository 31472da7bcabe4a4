import pytest
from pyspark.sql import functions as F

from earshot.functions import quality as Q
from earshot.functions import risk as R


def assess(spark, rows, **kw):
    df = spark.createDataFrame(rows, "p double, phase double, hf double, jitter double, contrast double, language string, trusted boolean, unknown boolean")
    return R.assess_risk(df, prob="p", tau=0.51, phase="phase", hf="hf", jitter="jitter", contrast="contrast", language="language", trusted="trusted", unknown_number="unknown", **kw).collect()


def plain(p, trusted=False, unknown=False):
    return (p, 0.0, 0.0, 0.0, 0.0, None, trusted, unknown)


def test_published_cases(spark):
    low, high, trusted = assess(spark, [plain(0.08), plain(0.98), plain(0.95, trusted=True)])
    assert low["risk_level"] == "LOW" and not low["alert"]
    assert high["risk_level"] == "CRITICAL" and high["alert"]
    assert trusted["safety_override"] and trusted["risk_score"] >= 85


def expected_band(p, tau=0.51, a=0.0):
    mid, low = max(0.48, 0.88 * tau), max(0.28, 0.58 * tau)
    if p >= 0.75:
        return min(99, 82 + 14 * (p - 0.75) / 0.25 + 4 * a)
    if p >= tau:
        return min(82, 60 + 20 * (p - tau) / max(0.01, 0.75 - tau) + 6 * a)
    if p >= mid:
        return min(58, 28 + 28 * (p - mid) / max(0.01, tau - mid) + 12 * a)
    if p >= low:
        return min(24, 8 + 16 * (p - low) / max(0.01, mid - low) + 3 * a)
    return min(10, 2 + 6 * p / max(0.01, low) + 2 * a)


def test_bands_against_formula(spark):
    ps = [i / 200 for i in range(201)] + [0.28, 0.2958, 0.48, 0.51, 0.75]
    for row in assess(spark, [plain(p) for p in ps]):
        assert row["raw_risk"] == pytest.approx(expected_band(row["p"]), abs=1e-9)


def test_contrast_lifts_probability(spark):
    rows = assess(spark, [(0.40, 0.0, 0.0, 0.0, 10.0, "en", False, False), (0.10, 0.0, 0.0, 0.0, 11.0, "en", False, False), (0.30, 0.0, 0.0, 0.0, 9.6, "en", False, False)])
    assert rows[0]["lifted_prob"] == pytest.approx(0.52 + 0.35 * 0.56)
    assert rows[1]["lifted_prob"] == pytest.approx(0.55 + 0.35 * 0.96)
    assert rows[2]["lifted_prob"] == 0.30


def test_language_rule(spark):
    df = spark.createDataFrame([("hi",), ("hi-IN",), ("en",), ("chi",), (None,)], "l string")
    got = [r[0] for r in df.select(R.is_indic("l")).collect()]
    assert got == [True, True, False, False, False]
    assert [r[0] for r in df.select(R.is_indic("l", substring=True)).collect()] == [True, True, False, True, False]


def test_fusion_and_context(spark):
    df = spark.createDataFrame([(0.2, 0.6, 0.9), (0.2, None, 0.9), (None, 0.6, 0.9), (None, None, 0.1), (None, None, 0.0), (None, None, 5.0)], "m double, x double, f double")
    assert [round(r[0], 6) for r in df.select(R.fuse_scores("m", "x", "f")).collect()] == [0.4, 0.2, 0.6, 0.15, 0.05, 0.95]
    a, b = assess(spark, [plain(0.5, trusted=True, unknown=True), plain(0.6, trusted=True)])
    assert a["context_modifier"] == -2.0 and b["context_modifier"] == 0.0


def test_quality_gate_order(spark):
    df = spark.createDataFrame([(1.0, 1.0, 9.0, False), (2.0, 1.0, 9.0, False), (2.0, 3.9, 1.0, False), (2.0, 9.0, 0.0, False), (2.0, 30.0, 0.0, True), (2.0, 30.0, 0.0, False)],
                               "s double, n double, c double, t boolean")
    got = df.select(*[c.alias(k) for k, c in Q.quality_gate("s", "n", "c", "t").items()]).collect()
    assert [g["quality_level"] for g in got] == ["unusable", "poor", "poor", "moderate", "moderate", "good"]
    assert [g["is_usable"] for g in got] == [False, False, False, True, True, True]
    assert got[0]["rejection_reason"].startswith("Usable speech duration (1.0s)")


def test_stage_thresholds(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (0.0, 1.5), (10.0, 0.0), (0.0, 4.5)], "e double, s double")
    assert [r[0] for r in df.select(R.stage("e", "s")).collect()] == ["CALIBRATING", "PRELIMINARY_AVERAGE", "PRELIMINARY_AVERAGE", "CONSOLIDATED_FINAL", "CONSOLIDATED_FINAL"]
    msg = df.select(R.stage_message(R.stage("e", "s"), F.lit("CRITICAL"), F.lit(80.0), F.lit("bank_agent"), "e", "s").alias("m")).collect()
    assert "Bank Agent" in msg[3]["m"] and msg[0]["m"].startswith("Calibrating")
