"""Metrics over scored rows (AGG-07 .. AGG-16, AGG-24, WIN-13, ML-07).

Inputs carry ``label`` (1 = spoof) and ``score``; ``slices`` are the grouping columns, empty for the
whole table. Rows are first reduced to distinct scores, so everything ordered works on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_col, ratio, rnd
from . import blocks
from .joins import match

# Known generator systems (type, acoustic model, vocoder, split).
GENERATOR_PROFILES = [
    ("A07", "TTS", "Tacotron 2 (Neural)", "WaveRNN", "Known"),
    ("A08", "TTS", "Neural Auto-encoder", "Neural", "Known"),
    ("A09", "TTS", "Tacotron 2", "WORLD Vocoder", "Known"),
    ("A10", "TTS", "Transfer Learning", "WORLD Vocoder", "Known"),
    ("A11", "VC", "Spectral Mapping", "WORLD Vocoder", "Known"),
    ("A12", "VC", "Neural Mapping", "WORLD Vocoder", "Known"),
    ("A13", "VC", "Moment Matching", "WORLD Vocoder", "Known"),
    ("A14", "VC", "CycleGAN VC", "WORLD Vocoder", "Known"),
    ("A15", "VC", "StarGAN VC", "WORLD Vocoder", "Known"),
    ("A16", "TTS", "Waveform Concatenation", "Direct Concatenation", "Unseen"),
    ("A17", "TTS", "Waveform Filtering", "Linear Prediction", "Unseen"),
    ("A18", "TTS", "High-Res Vocoder", "MagPhase Vocoder", "Unseen"),
    ("A19", "VC", "Deep Neural VC", "Neural WaveNet", "Unseen"),
    ("nat", "Human", "Studio Natural Speech", "Organic Human Vocal Tract", "Genuine"),
    ("librispeech_human", "Human", "LibriSpeech Clean Speech", "Organic Human Vocal Tract", "Genuine"),
]


def confusion(df: DataFrame, slices: list[str], predicted, label="label") -> DataFrame:
    """AGG-07: tn, fp, fn, tp and n per slice; one partial aggregation."""
    p, y = as_col(predicted).cast("int"), as_col(label)

    def cell(want_y, want_p):
        return F.sum(F.when((y == want_y) & (p == want_p), 1).otherwise(0)).cast("bigint")

    return df.groupBy(*slices).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"), F.count("*").alias("n"))


def rates(matrix: DataFrame, digits: int = 6) -> DataFrame:
    """AGG-08: accuracy, precision, recall, F1, false alarm and miss rate (0 for an empty denominator)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    values = {
        "accuracy": ratio(tn + tp, F.col("n")),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(tp * 2, tp * 2 + fp + fn),
        "false_alarm_rate": ratio(fp, fp + tn),
        "miss_rate": ratio(fn, fn + tp),
    }
    return matrix.withColumns({k: rnd(v, digits) for k, v in values.items()})


def score_counts(df: DataFrame, slices: list[str], label="label", score="score", grid: float | None = None) -> DataFrame:
    """Positives and negatives per distinct score; ``grid`` first rounds scores down to a step."""
    s = as_col(score)
    if grid:
        s = F.floor(s / grid) * grid
    return df.groupBy(*slices, s.alias("threshold")).agg(
        F.sum(as_col(label)).cast("bigint").alias("pos"), F.sum(F.lit(1) - as_col(label)).cast("bigint").alias("neg"))


def roc_curve(df: DataFrame, slices: list[str] = (), label="label", score="score", drop_intermediate: bool = False,
              grid: float | None = None) -> DataFrame:
    """AGG-09 / WIN-13: cumulative tp and fp, tpr, fpr and fnr at every distinct score, highest first.

    The running counts are block scans over blocks of equally many scores, so no single task orders the whole table, however
    the scores are piled up.
    Rates are NULL for a slice with one class. ``drop_intermediate`` leaves out collinear points.
    """
    slices = list(slices)
    points = score_counts(df, slices, label, score, grid)
    down = -F.col("threshold")
    points = blocks.with_depth_block(points, down, "__down")
    points = blocks.running(points, slices, [down], F.col("__down"), tp=("sum", "pos"), fp=("sum", "neg"))
    totals = points.groupBy(*slices).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if slices:
        points = match(points, totals, slices)
    else:  # one row: a scalar subquery, not a join
        points = points.withColumn("__n", totals.select(F.struct("n_pos", "n_neg")).scalar()).select("*", "__n.*").drop("__n")
    if drop_intermediate:
        # the point below is the previous row when scores ascend
        points = blocks.lagged(points, slices, ["threshold"], -F.col("__down"), below_pos="pos", below_neg="neg")
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = (F.col("below_pos") != F.col("pos")) | (F.col("below_neg") != F.col("neg"))
        points = points.filter(F.col("below_pos").isNull() | first | bend).drop("below_pos", "below_neg")
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    tpr = F.when(both, F.col("tp") / F.nullif(F.col("n_pos"), F.lit(0)))
    fpr = F.when(both, F.col("fp") / F.nullif(F.col("n_neg"), F.lit(0)))
    return points.drop("__down").withColumns({"tpr": tpr, "fpr": fpr}).withColumn("fnr", F.lit(1.0) - F.col("tpr"))


def _area() -> Column:
    """Trapezoid area of all points. Each point knows its own step, so no look-back is needed."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    n = F.max(F.col("n_pos").cast("double")) * F.max(F.col("n_neg").cast("double"))
    return area / F.nullif(n, F.lit(0.0))


def _even_point() -> Column:
    """The highest threshold with the smallest |fnr - fpr|."""
    return F.min_by(
        F.struct("threshold", ((F.col("fpr") + F.col("fnr")) / 2.0).alias("eer")),
        F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), (-F.col("threshold")).alias("order")),
    )


def curve_metrics(points: DataFrame, slices: list[str] = (), digits: int = 6) -> DataFrame:
    """AGG-10 / AGG-11 / SRT-06 in one aggregation: roc_auc, eer, eer_threshold, both_classes; NULL for one class."""
    best = points.groupBy(*slices).agg(
        rnd(_area(), digits).alias("roc_auc"), _even_point().alias("best"), (F.max("n_pos") * F.max("n_neg") > 0).alias("both_classes"))
    return best.select(
        *slices,
        "roc_auc",
        F.when(F.col("both_classes"), rnd("best.eer", digits)).alias("eer"),
        F.when(F.col("both_classes"), F.col("best.threshold")).alias("eer_threshold"),
        "both_classes",
    )


def roc_auc(points: DataFrame, slices: list[str] = (), digits: int = 6) -> DataFrame:
    """AGG-10."""
    return points.groupBy(*slices).agg(rnd(_area(), digits).alias("roc_auc"))


def equal_error_rate(points: DataFrame, slices: list[str] = (), digits: int = 6) -> DataFrame:
    """AGG-11 / SRT-06; NULL for one class."""
    return curve_metrics(points, slices, digits).drop("roc_auc")


def slice_rows(df: DataFrame, rules: dict[str, dict[str, Column]]) -> DataFrame:
    """AGG-12: one row per slice a scored row belongs to, carrying only label and score.

    ``rules`` maps kind -> slice name -> condition; the overall slice is always present.
    """
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("slice"))
    keys = [pair("overall", "all")]
    for kind, named in rules.items():
        keys += [F.when(cond, pair(kind, name)) for name, cond in named.items()]
    return df.select("label", "score", F.explode(F.array_compact(F.array(*keys))).alias("_s")).select("label", "score", "_s.kind", "_s.slice")


def sliced_metrics(rows: DataFrame, slices: list[str], tau, min_rows: int = 5) -> DataFrame:
    """AGG-12 / AGG-16: all metrics per slice, only where a slice has at least ``min_rows`` rows."""
    base = rates(confusion(rows, slices, F.col("score") >= as_col(tau))).filter(F.col("n") >= min_rows)
    ranked = curve_metrics(roc_curve(rows, slices), slices)
    return match(base, ranked, slices)


def evaluation_report(df: DataFrame, tau) -> DataFrame:
    """Every metric of one scored table in one row."""
    tagged = df.withColumn("scope", F.lit("all"))
    return sliced_metrics(tagged, ["scope"], tau, min_rows=0).withColumns({"genuine_count": F.col("tn") + F.col("fp"), "spoof_count": F.col("fn") + F.col("tp")})


def generator_profiles(spark) -> DataFrame:
    """JOIN-05: the fifteen profile rows."""
    return spark.createDataFrame(GENERATOR_PROFILES, "system_id string, system_type string, acoustic string, vocoder string, split_kind string")


def with_profiles(df: DataFrame) -> DataFrame:
    """JOIN-05: left join with the fixed profile table, ``Unknown`` where there is none."""
    joined = df.join(F.broadcast(generator_profiles(df.sparkSession)), "system_id", "left")  # 15 fixed rows
    unknown = {"system_type": "Unknown", "split_kind": "Unknown", "acoustic": "N/A", "vocoder": "N/A"}
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in unknown.items()})


def system_benchmark(df: DataFrame, tau) -> DataFrame:
    """AGG-13: per system, correct means "not flagged" for humans and "flagged" for generators.

    Rows are aggregated before the profile join, so the join sees one row per system.
    """
    flagged = F.sum(F.when(F.col("score") >= as_col(tau), 1).otherwise(0)).cast("bigint")
    per_system = with_profiles(df.groupBy("system_id").agg(F.count("*").alias("samples"), F.avg("score").alias("mean_prob"), flagged.alias("flagged")))
    correct = F.when(F.col("system_type") == "Human", F.col("samples") - F.col("flagged")).otherwise(F.col("flagged"))
    return per_system.withColumn("correct", correct).withColumn("error_rate", (F.col("samples") - F.col("correct")) / F.col("samples"))


def generalisation(benchmark: DataFrame) -> DataFrame:
    """AGG-14: human accuracy, known and unseen detection in percent and the gap between the last two."""
    human, known = F.col("system_type") == "Human", F.col("split_kind") == "Known"

    def share(cond):
        total = F.sum(F.when(cond, F.col("samples")).otherwise(0))
        return ratio(F.sum(F.when(cond, F.col("correct")).otherwise(0)), total) * 100

    raw = benchmark.agg(share(human).alias("h"), share(~human & known).alias("k"), share(~human & ~known).alias("u"))
    return raw.select(
        rnd("h", 2).alias("genuine_accuracy"),
        rnd(F.lit(100.0) - F.col("h"), 2).alias("genuine_far"),
        rnd("k", 2).alias("known_detected_pct"),
        rnd("u", 2).alias("unseen_detected_pct"),
        rnd(F.abs(F.col("k") - F.col("u")), 2).alias("generalization_gap_pct"),
    )


def score_histogram(df: DataFrame, bins: int = 30, label="label", score="score") -> DataFrame:
    """AGG-24: counts per class and bin over [0, 1]; 1.0 belongs to the last bin."""
    b = F.least(F.floor(as_col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(as_col(label).alias("label"), b.alias("bin")).agg(F.count("*").alias("n"))


def calibrate_and_apply(dev: DataFrame, test: DataFrame) -> DataFrame:
    """ML-07: threshold from dev only, rates on test. The threshold is a scalar subquery."""
    tau = equal_error_rate(roc_curve(dev)).select(F.struct("eer_threshold", F.col("eer").alias("dev_eer")))
    flagged = test.withColumn("__tau", tau.scalar()).select("*", "__tau.*").drop("__tau")
    matrix = confusion(flagged, ["eer_threshold", "dev_eer"], F.col("score") >= F.col("eer_threshold"))
    return rates(matrix)
