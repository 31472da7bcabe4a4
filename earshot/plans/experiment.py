"""Training experiment (ML-09): split, balance, fit, calibrate, evaluate, record."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import curation, evaluation
from ..operators.features import add_noise, clip_features
from ..operators.models import SpoofModel
from ..session import materialise


def choose_universe(rows: DataFrame, recipe: str = "all", ident: str = "audio_id", size: int | None = None, source: Column | None = None, seed: int = 42) -> DataFrame:
    """The rows an experiment is about: ``all``; ``balanced`` (CUR-05: half of ``size`` per class, spoof even per system);
    ``priority`` (CUR-06: half per class, 80 % of it where ``source`` holds); ``two_source`` (CUR-07: all genuine rows and as
    many spoof rows, half of them where ``source`` holds)."""
    if recipe == "all":
        return rows
    if recipe == "balanced":
        return curation.balanced_universe(rows, size, ident, seed=seed)
    if recipe == "priority":
        return curation.priority_universe(rows, size, source, ident, seed=seed)
    if recipe == "two_source":
        return curation.two_source_mix(rows, source, ident, seed=seed)
    raise ValueError(f"unknown recipe {recipe}")


def noisy_features(clips: DataFrame, ident: str = "audio_id", seed: int = 42) -> DataFrame:
    """CUR-08 before SIG-16: noise on a third of the genuine clips, then features. ``clips`` has pcm, label and peak."""
    planned = curation.noise_plan(clips, ident, seed=seed)
    return clip_features(add_noise(planned, ident, seed=seed))


def run_experiment(
    features: DataFrame,
    kind: str = "random_forest",
    ident: str = "audio_id",
    names: list[str] | None = None,
    speaker_disjoint: bool = True,
    balance: bool = True,
    recipe: str = "all",
    size: int | None = None,
    source: Column | None = None,
    shortcuts: list[str] = (),
    slices: dict | None = None,
    seed: int = 42,
    **settings,
) -> tuple[SpoofModel, DataFrame, dict]:
    """``features``: id, label, system_id, speaker_id and the feature map ``f`` (see ``noisy_features`` for clips).

    ``recipe``, ``size`` and ``source`` choose the rows (``choose_universe``). Speakers do not cross splits unless
    ``speaker_disjoint=False``. Returns the calibrated model, metrics of the test rows (overall and per slice) and a record for
    ``write_experiment``. The split table and the test scores are written once.
    """
    started = time.time()
    features = choose_universe(features, recipe, ident, size, source, seed)
    split = curation.speaker_disjoint_split(features, seed=seed) if speaker_disjoint else curation.stratified_split(features, ident, seed=seed)
    split = materialise(split, "split")
    train = split.filter("split = 'train'")
    train = curation.balance_classes(train, ident, seed=seed) if balance else train
    model = SpoofModel.fit(train, kind, names, shortcuts, seed, **settings).calibrate(split.filter("split = 'dev'"))
    test = materialise(model.score(split.filter("split = 'test'"), "score").drop("f"), "test-scores")
    rows = evaluation.slice_rows(test, slices or {})
    metrics = evaluation.sliced_metrics(rows, ["kind", "slice"], model.threshold, min_rows=5)
    leakage = curation.speaker_leakage(split).first().asDict()
    record = {
        "recipe": recipe, "model": kind, "threshold": model.threshold, "feature_count": len(model.names), "features": list(model.names), "balanced": balance, "speaker_disjoint": speaker_disjoint,
        "train_test_shared_speakers": leakage["train_test"] or 0, "seconds": round(time.time() - started, 2),
    }
    return model, metrics, record


def importance(model: SpoofModel, spark) -> DataFrame:
    """Feature importances of tree voters, highest first."""
    trees = [v for v in model.voters if hasattr(v, "featureImportances")]
    values = [sum(float(v.featureImportances[i]) for v in trees) / len(trees) for i in range(len(model.names))]
    return spark.createDataFrame(list(zip(model.names, values)), "feature string, importance double").orderBy(F.desc("importance"))
