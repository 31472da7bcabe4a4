"""Feature tables, ledgers, queues, reports and model folders (SRC-07 .. SRC-13, SRC-18, SRC-19, SRC-21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators.ledger import BLOCK_COLUMNS


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing has been committed there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cached_features(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """SRC-07: build and write the table once, partitioned by split when it has one; reuse unless forced."""
    found = None if force else read_if_written(spark, path)
    if found is None:
        df = build()
        writer = df.write.mode("overwrite")
        (writer.partitionBy("split") if "split" in df.columns else writer).parquet(path)
        found = spark.read.parquet(path)
    return found


LEDGER_ARRAY = "array<struct<index:bigint,timestamp:double,event_type:string,event_data:string,previous_hash:string,current_hash:string>>"


def parse_ledgers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-08: (blocks, status per file) from ``value`` (a JSON array of blocks) and ``file``.

    Unreadable, empty and non-array files become a status row and contribute no blocks; nothing is
    rewritten. ``event_data`` keeps its JSON text.
    """
    body = F.trim("value")
    readable = F.get_json_object("value", "$").isNotNull()
    tagged = files.withColumn("parsed", F.from_json("value", LEDGER_ARRAY)).withColumn(
        "status",
        F.when(body == "", "EMPTY_FILE").when(~readable, "INVALID_JSON").when(~body.startswith("["), "NOT_A_LIST")
        .when(F.size("parsed") == 0, "EMPTY_LEDGER").otherwise("LOADED"))
    blocks = tagged.filter("status = 'LOADED'").select(F.col("file").alias("ledger_id"), F.posexplode("parsed").alias("pos", "b")).select(
        "ledger_id", F.col("pos").cast("bigint").alias("pos"), "b.index", F.round(F.col("b.timestamp") * 1e6).cast("bigint").alias("ts_us"), "b.timestamp",
        "b.event_type", F.col("b.event_data").alias("payload"), "b.previous_hash", "b.current_hash")
    return blocks, tagged.select(F.col("file").alias("ledger_id"), "status")


def read_ledger_files(spark: SparkSession, path: str, expected: DataFrame | None = None, largest: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """SRC-08 over a folder of ledger files, one array per file.

    A file is one JSON value, so it is parsed as one row; files of more than ``largest`` bytes are not read and reported as
    TOO_LARGE.

    Spark plans no work for files of zero length; ``expected`` (ledger_id = path) names the files that
    should be there, and those without content are reported as EMPTY_FILE.
    """
    found = spark.read.format("binaryFile").load(path)
    files = found.filter(F.col("length") <= largest).select(F.decode("content", "utf-8").alias("value"), F.col("path").alias("file"))
    blocks, status = parse_ledgers(files)
    status = status.unionByName(found.filter(F.col("length") > largest).select(F.col("path").alias("ledger_id"), F.lit("TOO_LARGE").alias("status")))
    if expected is not None:
        status = expected.select("ledger_id").join(status, "ledger_id", "left").fillna({"status": "EMPTY_FILE"})
    return blocks, status


def append_ledger(blocks: DataFrame, path: str) -> None:
    """SRC-09."""
    blocks.select(*BLOCK_COLUMNS).write.mode("append").parquet(path)


def write_checkpoints(checkpoints: DataFrame, path: str) -> None:
    """SRC-10."""
    checkpoints.write.mode("overwrite").json(path)


def read_checkpoints(spark: SparkSession, path: str, ledger_type: str = "bigint") -> DataFrame:
    """SRC-10."""
    return spark.read.schema(f"ledger_id {ledger_type}, blocks_count bigint, last_block_index bigint, last_block_hash string, cumulative_hash string, version string").json(path)


QUEUE_SCHEMA = "event_type string, payload string, session_id string, queued_at double"


def enqueue(events: DataFrame, path: str) -> None:
    """SRC-11: append events as JSON lines."""
    events.select("event_type", "payload", "session_id", "queued_at").write.mode("append").json(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: pending events; blank lines carry nothing and are skipped."""
    return spark.read.schema(QUEUE_SCHEMA).json(path).filter("event_type IS NOT NULL")


def queue_status(pending: DataFrame, offline: bool) -> DataFrame:
    """AGG-29."""
    return pending.agg(F.count("*").alias("pending_sync_events")).select(
        F.lit("EDGE_OFFLINE" if offline else "ONLINE").alias("node_mode"), F.lit(offline).alias("offline_mode"), "pending_sync_events", F.lit("HEALTHY").alias("status"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """SRC-12: manifest rows as JSON lines, in parallel."""
    manifest.write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """SRC-13: a metrics table of a few rows as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def text_report(metrics: DataFrame) -> DataFrame:
    """SRC-13: one readable line per slice."""
    pct = lambda c: rnd(F.col(c) * 100, 2)
    line = F.format_string("%-12s %-12s %8d %7.2f%% %7.2f%%", "kind", "slice", "n", pct("accuracy"), pct("false_alarm_rate"))
    return metrics.select("kind", "slice", line.alias("line"))


def newest_path(listing: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """SRC-19: the most recently modified path, per group if asked."""
    return listing.groupBy(*groups).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def write_experiment(spark: SparkSession, record: dict, path: str) -> None:
    """SRC-21: one JSON record with id, model, counts, names and timings."""
    spark.createDataFrame([record]).coalesce(1).write.mode("overwrite").json(path)
