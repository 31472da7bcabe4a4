"""Trial protocols, clip indexes, score lists and transcripts (SRC-02 .. SRC-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, at_least: int, glob: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.input_file_name().alias("file"))
    return lines.filter(F.size("p") >= at_least)


def _labelled(word) -> dict:
    label = F.when(F.lower(word) == "bonafide", 0).otherwise(1)
    return {"label": label, "label_str": F.when(label == 0, "genuine").otherwise("spoof")}


def read_protocol_2019(spark: SparkSession, path: str, glob: str | None = "ASVspoof2019.LA.cm.*.txt") -> DataFrame:
    """SRC-02: ``speaker audio_id - attack label``; a dash means genuine."""
    p = F.col("p")
    df = _fields(spark, path, 5, glob).select(
        p[0].alias("speaker_id"), p[1].alias("audio_id"), F.when(p[3] == "-", "bonafide").otherwise(p[3]).alias("system_id"), p[4].alias("__key"), p[3].alias("attack"), "file")
    return df.withColumns(_labelled(F.col("__key"))).drop("__key")


def read_trials_2021(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """SRC-03: ``speaker trial codec source attack label ...``."""
    p = F.col("p")
    df = _fields(spark, path, 6, glob).select(
        p[0].alias("speaker_id"), p[1].alias("audio_id"), p[2].alias("codec"), p[4].alias("attack"),
        F.concat_ws("_", F.lit("asv2021"), p[4], p[2]).alias("system_id"), p[5].alias("__key"))
    return df.withColumns(_labelled(F.col("__key"))).drop("__key")


def read_clip_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04: tab-separated index; file name in the second column, speaker in the sixth."""
    df = spark.read.option("sep", "\t").option("quote", "").schema("c0 string, c1 string, c2 string, c3 string, c4 string, c5 string").csv(path)
    return df.filter("c5 IS NOT NULL").select(F.col("c1").alias("file_name"), F.col("c5").alias("speaker_id"))


def read_system_means(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: ``system_ID,mean`` with a header."""
    return spark.read.option("header", "true").schema("system_ID string, mean double").csv(path).withColumnRenamed("system_ID", "system_id")


def read_transcripts(spark: SparkSession, path: str, glob: str | None = "*.trans.txt") -> DataFrame:
    """SRC-06: ``utterance-id TEXT``; the id's parts are reader, chapter and number."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    pattern = r"^(\S+)\s+(.*)$"
    df = reader.text(path).filter(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("utt_id"), F.regexp_extract("value", pattern, 2).alias("text"))
    part = F.split("utt_id", "-")
    return df.withColumns({"reader": F.get(part, F.lit(0)), "chapter": F.get(part, F.lit(1))})


def protocol_counts(protocol: DataFrame) -> DataFrame:
    """AGG-02: totals and attack histogram per protocol file."""
    return protocol.groupBy("split", "attack").agg(
        F.count("*").alias("total"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bonafide"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("spoof"))


def trial_counts(trials: DataFrame) -> DataFrame:
    """AGG-03: trials and class counts per codec."""
    return trials.groupBy("codec").agg(
        F.count("*").alias("trials"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("bonafide"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("spoof"))


def with_speaker_index(clips: DataFrame, index: DataFrame, default) -> DataFrame:
    """JOIN-03: speaker by file name, else the default."""
    one = index.groupBy("file_name").agg(F.max("speaker_id").alias("speaker_id"))
    return clips.join(one, "file_name", "left").withColumn("speaker_id", F.coalesce("speaker_id", default))
