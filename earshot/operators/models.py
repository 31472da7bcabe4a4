"""Classifiers on feature tables (ML-01 .. ML-07, ML-10, SRC-18) with Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk as R
from ..session import materialise
from . import evaluation
from .extra_trees import ExtraTrees, ExtraTreesModel
from .features import FEATURE_NAMES, feature_vector, neutralise

# The published model settings.
SETTINGS = {
    "random_forest": {"trees": 200, "depth": 20, "leaf": 1},
    "random_forest_balanced": {"trees": 300, "depth": 18, "leaf": 2},
    "random_forest_merged": {"trees": 100, "depth": 16, "leaf": 2},
    "soft_voting": {"trees": 200, "depth": 18, "leaf": 2, "subset": "log2"},
    "gradient_boosting": {"rounds": 200, "depth": 6, "rate": 0.05},
    "logistic": {"rounds": 1000},
}
_LOADERS = {"RandomForestClassificationModel": RandomForestClassificationModel, "GBTClassificationModel": GBTClassificationModel, "LogisticRegressionModel": LogisticRegressionModel, "ExtraTreesModel": ExtraTreesModel}


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """ML-05: n / (2 * n_class), from two scalar subqueries rather than a shuffle of the rows."""
    counts = df.agg(F.struct(F.count("*").alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("spoof")).alias("c")).scalar()
    of_class = F.when(F.col(label) == 1, F.col("__c.spoof")).otherwise(F.col("__c.n") - F.col("__c.spoof"))
    return df.withColumn("__c", counts).withColumn(name, F.col("__c.n") / (F.lit(2.0) * of_class)).drop("__c")


def to_vectors(df: DataFrame, names: list[str], shortcuts: list[str] = (), features: str = "f") -> DataFrame:
    """Feature map (or an array column) to the ML vector, shortcut features set to 0."""
    if df.schema[features].dataType.typeName() == "map":
        f = neutralise(features, list(shortcuts)) if shortcuts else F.col(features)
        array: Column = feature_vector(f, names)
    else:
        array = F.col(features).cast("array<double>")
    return df.withColumn("features", array_to_vector(array))


def spread(df: DataFrame) -> int:
    """Partitions for training rows: as many as the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _estimators(kind: str, settings: dict, seed: int) -> list:
    common = {"featuresCol": "features", "labelCol": "label"}

    def forest(s):
        return RandomForestClassifier(**common, weightCol="weight", numTrees=settings["trees"], maxDepth=settings["depth"], minInstancesPerNode=settings["leaf"],
                                      featureSubsetStrategy=settings.get("subset", "sqrt"), seed=s)

    if kind == "gradient_boosting":
        return [GBTClassifier(**common, maxIter=settings["rounds"], maxDepth=settings["depth"], stepSize=settings["rate"], seed=seed)]
    if kind == "logistic":
        return [LogisticRegression(**common, weightCol="weight", maxIter=settings["rounds"])]
    if kind == "soft_voting":
        return [forest(seed), ExtraTrees(settings["trees"], settings["depth"], settings["leaf"], settings["subset"], seed)]
    return [forest(seed)]


@dataclass
class SpoofModel:
    """Fitted voters with the threshold and names that travel with them."""

    kind: str
    voters: list
    names: list[str]
    threshold: float = 0.5
    shortcuts: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, kind: str = "random_forest", names: list[str] | None = None, shortcuts: list[str] = (), seed: int = 42, **overrides) -> "SpoofModel":
        """ML-01 .. ML-04. ``train`` has ``label`` and the feature map ``f``."""
        names = FEATURE_NAMES if names is None else names
        # fitting reads its rows many times, so they are written once; samples are drawn by partition and place, so rows are
        # dealt and ordered by what they hold, and a model does not depend on the order of files
        data = balanced_weights(materialise(to_vectors(train, names, shortcuts).select("label", "features"), "train"))
        place = F.xxhash64(vector_to_array("features"), "label")
        data = data.repartition(spread(train), place).sortWithinPartitions(place)
        voters = [e.fit(data) for e in _estimators(kind, {**SETTINGS[kind], **overrides}, seed)]
        return cls(kind, voters, names, 0.5, list(shortcuts))

    def score(self, df: DataFrame, output: str = "model_prob") -> DataFrame:
        """ML-06: mean spoof probability of the voters; no shuffle."""
        out, parts = to_vectors(df, self.names, self.shortcuts), []
        for i, voter in enumerate(self.voters):
            raw, prob, pred = f"__raw{i}", f"__prob{i}", f"__pred{i}"
            if isinstance(voter, ExtraTreesModel):
                out = out.withColumn(prob, voter.probability(vector_to_array("features")))
                parts.append(F.col(prob))
                continue
            out = voter.copy().setRawPredictionCol(raw).setProbabilityCol(prob).setPredictionCol(pred).transform(out)
            parts.append(vector_to_array(prob)[1])
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        out = out.withColumn(output, total / len(parts))
        return out.drop("features", *[f"__{n}{i}" for i in range(len(self.voters)) for n in ("raw", "prob", "pred")])

    def calibrate(self, dev: DataFrame) -> "SpoofModel":
        """ML-07: the equal-error threshold of the development rows; one row reaches the driver."""
        scored = self.score(dev, "score")
        row = evaluation.equal_error_rate(evaluation.roc_curve(scored)).first()
        if row["eer_threshold"] is not None:
            self.threshold = float(row["eer_threshold"])
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """RSK-15 record next to the score."""
        return self.score(df).withColumn("prediction", R.prediction_record("model_prob", self.threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        """SRC-18: voters and a one-row description."""
        for i, voter in enumerate(self.voters):
            if isinstance(voter, ExtraTreesModel):
                voter.save(spark, f"{path}/voter{i}")
            else:
                voter.write().overwrite().save(f"{path}/voter{i}")
        row = {"kind": self.kind, "names": self.names, "threshold": self.threshold, "shortcuts": self.shortcuts, "voters": [type(v).__name__ for v in self.voters]}
        schema = "kind string, names array<string>, threshold double, shortcuts array<string>, voters array<string>"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SpoofModel":
        row = spark.read.schema("kind string, names array<string>, threshold double, shortcuts array<string>, voters array<string>").json(f"{path}/about").first()
        voters = [_LOADERS[name].load(f"{path}/voter{i}") for i, name in enumerate(row["voters"])]
        return cls(row["kind"], voters, list(row["names"]), row["threshold"], list(row["shortcuts"] or []))
