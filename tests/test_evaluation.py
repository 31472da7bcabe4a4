import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import blocks
from earshot.operators import evaluation as E


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    rows = [("mixed", int(y), float(s)) for y, s in zip(rng.integers(0, 2, 200), np.round(rng.uniform(0, 1, 200), 2))]
    rows += [("spoof_only", 1, 0.3), ("spoof_only", 1, 0.9), ("perfect", 0, 0.1), ("perfect", 0, 0.2), ("perfect", 1, 0.8), ("perfect", 1, 0.9)]
    return spark.createDataFrame(rows, "slice string, label int, score double"), rows


def brute(rows):
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    thresholds = np.unique(s)[::-1]
    tpr = np.array([((s >= t) & (y == 1)).sum() / (y == 1).sum() for t in thresholds])
    fpr = np.array([((s >= t) & (y == 0)).sum() / (y == 0).sum() for t in thresholds])
    i = int(np.argmin(np.abs((1 - tpr) - fpr)))
    pairs = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    return thresholds, tpr, fpr, (fpr[i] + 1 - tpr[i]) / 2, thresholds[i], pairs


def test_curve_auc_and_eer(scores):
    df, rows = scores
    points = E.roc_curve(df, ["slice"])
    mixed = points.filter("slice = 'mixed'").orderBy(F.desc("threshold")).collect()
    thresholds, tpr, fpr, eer, tau, auc = brute([r for r in rows if r[0] == "mixed"])
    assert [m.threshold for m in mixed] == list(thresholds)
    assert np.allclose([m.tpr for m in mixed], tpr) and np.allclose([m.fpr for m in mixed], fpr)
    by = {r["slice"]: r for r in E.roc_auc(points, ["slice"]).collect()}
    best = {r["slice"]: r for r in E.equal_error_rate(points, ["slice"]).collect()}
    assert by["mixed"].roc_auc == pytest.approx(auc, abs=1e-6)
    assert best["mixed"].eer == pytest.approx(eer, abs=1e-6) and best["mixed"].eer_threshold == tau
    assert by["perfect"].roc_auc == 1.0 and best["perfect"].eer == 0.0


def test_one_class_gives_null_with_flag(scores):
    points = E.roc_curve(scores[0], ["slice"])
    row = E.equal_error_rate(points, ["slice"]).filter("slice = 'spoof_only'").first()
    assert row.eer is None and row.both_classes is False
    assert E.roc_auc(points, ["slice"]).filter("slice = 'spoof_only'").first().roc_auc is None


def test_collinear_points_do_not_change_the_area(scores):
    df, rows = scores
    full, lean = E.roc_curve(df, ["slice"]), E.roc_curve(df, ["slice"], drop_intermediate=True)
    mixed = [r for r in rows if r[0] == "mixed"]
    thresholds, tpr, fpr, *_ = brute(mixed)
    kept = lean.filter("slice = 'mixed'").orderBy(F.desc("threshold")).collect()
    n_pos, n_neg = sum(r[1] for r in mixed), sum(1 - r[1] for r in mixed)
    t, f = np.round(tpr * n_pos), np.round(fpr * n_neg)
    keep = np.r_[True, np.logical_or(np.diff(t, 2), np.diff(f, 2)), True]
    assert [k.threshold for k in kept] == list(thresholds[keep])
    assert full.count() > lean.count()
    x, y = [0] + [k.fpr for k in kept], [0] + [k.tpr for k in kept]
    assert np.trapezoid(y, x) == pytest.approx(brute(mixed)[-1], abs=1e-9)


def test_rates_and_floor(scores):
    df, _ = scores
    m = {r["slice"]: r for r in E.sliced_metrics(df, ["slice"], 0.5, min_rows=4).collect()}
    assert set(m) == {"mixed", "perfect"}
    assert m["perfect"].accuracy == 1.0 and m["perfect"].false_alarm_rate == 0.0
    assert m["mixed"].tn + m["mixed"].fp + m["mixed"].fn + m["mixed"].tp == 200


def test_overlapping_slices(spark):
    df = spark.createDataFrame([("indicsynth_vits_hindi", 1, 0.9), ("bonafide", 0, 0.1)], "system_id string, label int, score double")
    rules = {"language": {"hindi": F.col("system_id").contains("hindi")}, "generator": {"vits": F.col("system_id").contains("vits")}, "region": {"other": ~F.col("system_id").contains("indic")}}
    got = {(r.kind, r.slice): r["count"] for r in E.slice_rows(df, rules).groupBy("kind", "slice").count().collect()}
    assert got == {("overall", "all"): 2, ("language", "hindi"): 1, ("generator", "vits"): 1, ("region", "other"): 1}


def test_benchmark_flips_for_humans(spark):
    df = spark.createDataFrame([("nat", 0, 0.1), ("nat", 0, 0.9), ("A07", 1, 0.9), ("A17", 1, 0.1), ("zzz", 1, 0.9)], "system_id string, label int, score double")
    got = {r.system_id: r for r in E.system_benchmark(df, 0.5).collect()}
    assert got["nat"].correct == 1 and got["A07"].correct == 1 and got["A17"].correct == 0 and got["zzz"].split_kind == "Unknown"
    gap = E.generalisation(E.system_benchmark(df, 0.5)).first()
    assert (gap.known_detected_pct, gap.unseen_detected_pct, gap.generalization_gap_pct) == (100.0, 50.0, 50.0)


def test_blocks_are_even_where_scores_pile_up(spark):
    rows = spark.range(40_000).selectExpr("CASE WHEN id < 39600 THEN 0.5 + id * 1e-9 ELSE id / 40000D END AS v").repartition(7)
    cut = blocks.with_depth_block(rows, "v", "b", 64)
    per = cut.groupBy("b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
    assert [r.b for r in per] == list(range(64)) and max(r.n for r in per) <= 2 * min(r.n for r in per)
    assert all(a.high < b.low for a, b in zip(per, per[1:]))
