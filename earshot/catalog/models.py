"""Models on `embeddings`, clip and call jobs on `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import models as M
from ..operators.calls import TurnRules
from ..operators.evaluation import rates, confusion
from ..plans import call_analysis, clip_analysis, experiment, live
from ..session import balance_tasks, materialise, scratch, table
from ..streaming import jobs as J
from . import query, r
from .signal import spoken_bytes

NAMES = [f"e{i}" for i in range(64)]


def labelled(spark, d):
    """Vectors of two label groups, read as a feature table."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("audio_id"), (F.pmod("label", F.lit(2)) == 0).cast("int").alias("label"), F.concat(F.lit("sys"), F.col("label").cast("string")).alias("system_id"),
                    F.pmod("vec_id", F.lit(37)).alias("speaker_id"), F.col("embedding").cast("array<double>").alias("f"))


@query("class_weights", f"""
WITH t AS (SELECT vec_id, CAST(label % 2 = 0 AS INTEGER) AS y FROM embeddings), n AS (SELECT count(*) AS n, sum(y) AS s FROM t)
SELECT vec_id AS audio_id, y AS label, {r('n / (2e0 * CASE WHEN y = 1 THEN s ELSE n - s END)', 8)} AS weight FROM t, n""")
def class_weights(spark, d):
    """ML-05."""
    return M.balanced_weights(labelled(spark, d)).select("audio_id", "label", rnd("weight", 8).alias("weight"))


def _fit_query(name, kind, note, **settings):
    @query(name)
    def run(spark, d):
        rows = labelled(spark, d)
        dev = F.pmod("audio_id", F.lit(4))
        model = M.SpoofModel.fit(rows.filter(dev < 2), kind, NAMES, **settings).calibrate(rows.filter(dev == 2))
        test = model.score(rows.filter(dev == 3))
        return rates(confusion(test, [], F.col("model_prob") >= model.threshold)).withColumn("model", F.lit(kind))

    run.__doc__ = note


_fit_query("random_forest", "random_forest", "ML-01, ML-06, ML-07.", trees=20, depth=8)
_fit_query("soft_voting", "soft_voting", "ML-02.", trees=10, depth=6)
_fit_query("gradient_boosting", "gradient_boosting", "ML-03.", rounds=5, depth=3)
_fit_query("logistic_regression", "logistic", "ML-04.", rounds=50)


@query("saved_model_scores", """
SELECT vec_id AS audio_id, true AS same_score, true AS same_label, true AS fits_threshold FROM embeddings""")
def saved_model_scores(spark, d):
    """SRC-18, RSK-15: a model written and loaded again scores every row as it did before."""
    rows, path = labelled(spark, d), scratch(spark, "model")
    model = M.SpoofModel.fit(rows, "random_forest", NAMES, ["e3"], trees=5, depth=5).calibrate(rows)
    model.save(spark, path)
    columns = lambda m, tag: m.predict(rows).select("audio_id", F.col("model_prob").alias(f"prob_{tag}"), F.col("prediction").alias(f"record_{tag}"))
    both = columns(model, "old").join(columns(M.SpoofModel.load(spark, path), "new"), "audio_id")
    return both.select(
        "audio_id", (F.col("prob_old") == F.col("prob_new")).alias("same_score"), (F.col("record_old.prediction") == F.col("record_new.prediction")).alias("same_label"),
        ((F.col("prob_new") >= F.col("record_new.calibrated_threshold")) == (F.col("record_new.prediction") == "spoof")).alias("fits_threshold"))


@query("model_checks", """
WITH t AS (SELECT (label % 2 = 0) AS spoof FROM embeddings WHERE vec_id % 4 = 3), k(model) AS (VALUES ('random_forest'), ('soft_voting'), ('gradient_boosting'), ('logistic'))
SELECT model, count(*) AS n, count(*) FILTER (spoof) AS spoof, count(*) FILTER (NOT spoof) AS genuine, 0::BIGINT AS outside, true AS separates FROM t, k GROUP BY model""")
def model_checks(spark, d):
    """ML-01 .. ML-04: all rows scored within [0, 1], and spoofed training rows higher on average than genuine ones."""
    rows, out = labelled(spark, d), None
    dev = F.pmod("audio_id", F.lit(4))
    settings = {"random_forest": {"trees": 20, "depth": 8}, "soft_voting": {"trees": 10, "depth": 6}, "gradient_boosting": {"rounds": 5, "depth": 3}, "logistic": {"rounds": 50}}
    for kind, own in settings.items():
        scored = M.SpoofModel.fit(rows.filter(dev < 3), kind, NAMES, **own).score(rows).withColumn("held", F.pmod("audio_id", F.lit(4)) == 3)
        mean = lambda y: F.avg(F.when((F.col("label") == y) & ~F.col("held"), F.col("model_prob")))
        one = scored.agg(
            F.count(F.when(F.col("held"), 1)).alias("n"), F.count(F.when(F.col("held") & (F.col("label") == 1), 1)).alias("spoof"), F.count(F.when(F.col("held") & (F.col("label") == 0), 1)).alias("genuine"),
            F.count(F.when(~F.col("model_prob").between(0.0, 1.0), 1)).alias("outside"), (mean(1) > mean(0)).alias("separates")).withColumn("model", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("experiment_universes", """
WITH t AS (SELECT (label % 2 = 0) AS spoof, label < 4 AS first FROM embeddings),
c AS (SELECT count(*) FILTER (NOT spoof) AS g, count(*) FILTER (spoof) AS s, count(*) FILTER (spoof AND first) AS sf, count(*) FILTER (spoof AND NOT first) AS so FROM t)
SELECT 'all' AS recipe, g AS genuine, s AS spoof FROM c UNION ALL SELECT 'balanced', least(g, 60), least(s, 60) FROM c UNION ALL SELECT 'priority', least(g, 60), least(s, 60) FROM c
UNION ALL SELECT 'two_source', g, least(sf, g // 2) + least(so, g - least(sf, g // 2)) FROM c""")
def experiment_universes(spark, d):
    """ML-09, CUR-05 .. CUR-07: class sizes of the universe of each recipe."""
    rows, out = labelled(spark, d), None
    rows = rows.withColumn("first", F.substring("system_id", 4, 9).cast("int") < 4)
    for recipe in ("all", "balanced", "priority", "two_source"):
        one = experiment.choose_universe(rows, recipe, size=120, source=F.col("first"))
        one = one.agg(F.count(F.when(F.col("label") == 0, 1)).alias("genuine"), F.count(F.when(F.col("label") == 1, 1)).alias("spoof")).withColumn("recipe", F.lit(recipe))
        out = one if out is None else out.unionByName(one)
    return out


@query("training_experiment")
def training_experiment(spark, d):
    """ML-09: metrics per system slice."""
    slices = {"system": {f"sys{i}": F.col("system_id") == f"sys{i}" for i in range(10)}}
    _, metrics, _ = experiment.run_experiment(labelled(spark, d), "random_forest", names=NAMES, slices=slices, trees=10, depth=6)
    return metrics


LABELS_AT_ONCE = 1 << 21  # labels that are broadcast


def _document_model(spark, d):
    """A model of the quality label from the features of the labelled documents; documents without a label train nothing and
    are not described. Labels go to the texts; with more than ``LABELS_AT_ONCE`` Spark chooses the join, which may move texts."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("audio_id"), F.col("quality").cast("int").alias("label"))
    if labels.count() <= LABELS_AT_ONCE:
        labels = F.broadcast(labels)
    labelled_clips = spoken_bytes(spark, d).withColumnRenamed("doc_id", "audio_id").join(labels, "audio_id")
    return M.SpoofModel.fit(clip_analysis.feature_table(labelled_clips), "logistic", rounds=20)


@query("clip_analysis")
def clip_analysis_query(spark, d):
    """ML-10, ML-11 over whole documents; lengths are scaled down with the clips."""
    model = _document_model(spark, d)
    clips = spoken_bytes(spark, d).select(F.col("doc_id").alias("audio_id"), "pcm", F.col("lang").alias("language"), (F.pmod("doc_id", F.lit(3)) == 0).alias("unknown_number"),
                                    (F.pmod("doc_id", F.lit(5)) == 0).alias("high_value"), F.lit(False).alias("prior_fraud"), F.lit(None).cast("double").alias("ext_prob"))
    out = clip_analysis.analyse_clips(clips, model, window=1024, minimum=1200, shortest=256)
    return out.select("audio_id", rnd("model_prob", 6).alias("model_prob"), "risk_score", "risk_level", "alert")


@query("call_analysis")
def call_analysis_query(spark, d):
    """ML-12 over whole documents as calls, from the report's pages. Lengths are scaled down with the clips, those of turns like
    those of segments; the noise limit too, as levels of text bytes lie within 4 dB, so every call would end at the gate."""
    model = _document_model(spark, d)
    calls = spoken_bytes(spark, d).select(F.col("doc_id").alias("call_id"), "pcm", F.col("lang").alias("language"), F.lit("father").alias("role"), (F.pmod("doc_id", F.lit(2)) == 0).alias("financial"))
    rules = call_analysis.SegmentRules(shortest=200, longest=400, silence=64, margin=32, frame=128, hop=32, top_db=6.0)
    turns = TurnRules(shortest=0.7 / 40, least=1.0 / 40, second=0.5 / 40, doubtful=4.0 / 40)
    _, report = call_analysis.analyse_calls(calls, model, rules, min_speech=0.02, min_snr=2.0, turns=turns)
    verdict = ["call_assessment", "overall_call_risk", "n_segments", "num_speakers", "overlap_percent", "quality_level", "guidance"]
    spoof = F.array_max(F.transform("speakers", lambda p: p["spoof_score"]))
    entries = F.when(F.col("timeline").isNull(), 0).otherwise(F.size("timeline"))
    return report.groupBy("call_id").agg(*[F.first(c).alias(c) for c in verdict], F.first(spoof).alias("spoof_score"), F.sum(entries).alias("timeline_entries"))


def _call_audio(spark, d):
    """Turns of conversations as chunks of a call, half a second apart."""
    c = balance_tasks(table(spark, d, "conversations"))
    return c.select(F.col("conv_id").alias("call_id"), F.col("turn").cast("bigint").alias("seq"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("turn") * 500_000).alias("event_ts"), F.encode("text", "utf-8").alias("pcm"))


@query("live_audio_calls", """
WITH c AS (SELECT conv_id AS call_id, count(*) AS n FROM conversations WHERE octet_length(encode(text)) >= 2 GROUP BY 1)
SELECT call_id, n AS streamed, n AS replayed, 0::BIGINT AS differing FROM c""")
def live_audio_calls(spark, d):
    """STM-01 .. STM-03 from PCM: chunks scored by a model and followed per call, as a stream and as a replay."""
    model, audio = _document_model(spark, d), _call_audio(spark, d)
    scored = materialise(live.score_chunks(audio, model), "chunk-scores")
    streamed = J.run_once(J.track_calls(J.closed_stream(scored, "chunks"), "monitor"), "live-audio")
    replayed = J.replay_calls(scored, "monitor").select(streamed.columns)  # scores are stateless: both sides follow the same ones
    rounded = lambda df, side: df.select(*[rnd(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).withColumn("side", F.lit(side))
    per = rounded(streamed, 1).unionByName(rounded(replayed, -1)).groupBy(*streamed.columns).agg(F.sum("side").alias("net"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("s"), F.count("*").alias("n"))
    return per.groupBy("call_id").agg(F.sum("s").alias("streamed"), F.sum(F.col("n") - F.col("s")).alias("replayed"), F.sum(F.abs("net")).alias("differing"))


@query("live_audio_rolling", """
SELECT conv_id AS call_id, turn AS seq, count(*) OVER (PARTITION BY conv_id ORDER BY turn * 500000 RANGE BETWEEN 3000000 PRECEDING AND CURRENT ROW) AS chunks, true AS within
FROM conversations WHERE octet_length(encode(text)) >= 2""")
def live_audio_rolling(spark, d):
    """STM-01 with a result per chunk."""
    rolled = live.rolling_chunk_risk(live.score_chunks(_call_audio(spark, d), _document_model(spark, d)))
    return rolled.select("call_id", "seq", "chunks", F.col("rolling_prob").between(0.0, 1.0).alias("within"))
