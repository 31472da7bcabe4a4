"""Streaming jobs (STM-01 .. STM-14) and their batch replay.

Everything stateless around the per-call recursion is column code shared by stream and batch.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..functions import quality as Q
from ..functions import risk as R
from ..functions.hashing import event_payload
from ..functions.numeric import rnd
from ..functions.text import clock
from ..operators import ledger as L
from ..session import materialise, scratch
from . import state as S

CHUNK_COLUMNS = ["call_id", "seq", "event_ts", "dur", "rms", "peak", "clipped", "emb", "prob", "risk", "action", "role", "financial", "language"]
IDLE_MS = 60_000


def use_rocksdb(spark) -> None:
    """Per-key state processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, commit it to a table, and read that table."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch(spark, label), checkpoint or scratch(spark, f"{label}-checkpoint")
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def closed_stream(chunks: DataFrame, label: str, delay: str = "10 seconds") -> DataFrame:
    """A bounded table as a stream that ends: its rows in one trigger, then a row far enough in the future to let the
    watermark pass them all. That row is a control row of a call of its own, so it gives no output."""
    spark, path = chunks.sparkSession, scratch(chunks.sparkSession, label)
    chunks = _with_all_columns(chunks)
    chunks.write.parquet(path)
    last = spark.read.schema(chunks.schema).parquet(path).agg(
        (F.max("event_ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")).alias("event_ts"), F.max("call_id").alias("call_id"))
    other = F.concat("call_id", F.lit("~")) if chunks.schema["call_id"].dataType == StringType() else F.col("call_id") + 1
    known = {"event_ts": F.col("event_ts"), "call_id": other, "action": F.lit("configure"), "seq": F.lit(-1)}
    last.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in chunks.schema.fields]).write.mode("append").parquet(path)
    return spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1000).parquet(path)


# --- windows (STM-01) ----------------------------------------------------------------------------

def rolling_risk(chunks: DataFrame, length: str = "3 seconds", hop: str = "1 second", delay: str = "5 seconds", tau=0.5102) -> DataFrame:
    """STM-01: level and risk of the last three seconds, once per second; near silence gets 2.5.

    A window whose chunks have no length has no mean: its probability and risk are NaN, as 0 / 0 is in doubles, and NaN is over
    every limit, as in the ordering of SQL engines.
    """
    none, seconds = F.lit(float("nan")), F.sum("dur")
    mean = lambda value: F.when(seconds == 0, none).otherwise(F.sum(value * F.col("dur")) / seconds)
    win = chunks.withWatermark("event_ts", delay).groupBy("call_id", F.window("event_ts", length, hop)).agg(
        F.count("*").alias("chunks"), F.sqrt(mean(F.col("rms") * F.col("rms"))).alias("rms"), F.max("peak").alias("peak"), mean(F.col("prob")).alias("prob"))
    judged, lost = R.assess_risk(win, prob="prob", tau=tau), F.isnan("prob")
    risk = Q.silence_or("stream", "rms", "peak", F.when(lost, none).otherwise(F.col("risk_score")))
    return judged.select("call_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "chunks", F.when(lost, none).otherwise(rnd("prob", 6)).alias("prob"),
                         risk.alias("risk_score"), ((F.col("alert") | lost) & ~Q.near_silent("stream", "rms", "peak")).alias("alert"))


def call_sessions(chunks: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Cuts a call at a silence gap: chunks, seconds and peak per session."""
    return chunks.withWatermark("event_ts", delay).groupBy("call_id", F.session_window("event_ts", gap).alias("w")).agg(
        F.count("*").alias("chunks"), rnd(F.sum("dur"), 6).alias("seconds"), F.max("risk").alias("peak_risk")).select(
        "call_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "chunks", "seconds", "peak_risk")


# --- stateful calls (STM-02, STM-03) -------------------------------------------------------------

def _records(pdf: pd.DataFrame) -> list[dict]:
    us = pdf["event_ts"].astype("int64") // (1 if str(pdf["event_ts"].dtype).startswith("datetime64[us") else 1000)
    columns = {c: [None if gone else v for v, gone in zip(pdf[c].tolist(), pdf[c].isna().tolist())] for c in pdf.columns if c != "event_ts"}
    columns["us"] = us.tolist()
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


class Waiting:
    """STM-09: chunks that the watermark has not passed; taken in order of ``seq`` and arrival.

    State holds blocks of chunks that arrived together, next to each other in time, as a request to the state store costs far
    more than a row. A block that the watermark cuts is read, and its later part written again, once per watermark that falls
    into it; all other chunks are written, read and removed once. So the work of a trigger follows its own rows. What waits is
    bounded by the delay; only rows behind the watermark are lost.
    """

    ROWS, BYTES = 256, 1 << 20  # of a block

    def __init__(self, handle, fields: list[str]):
        key = StructType([StructField(c, LongType()) for c in ("first", "last", "n")])
        self.handle, self.fields, self.entries = handle, fields, handle.getMapState("waiting", key, StructType([StructField("rows", BinaryType())]))
        self.count = handle.getValueState("arrived", StructType([StructField("n", LongType())]))

    def _put(self, rows: list[tuple]) -> None:
        """``rows`` (us, n, fields) in order of time."""
        low, held = 0, 0
        for i, row in enumerate(rows, 1):
            held += sum(len(v) for v in row if isinstance(v, (bytes, bytearray)))
            if i == len(rows) or i - low >= self.ROWS or held >= self.BYTES:
                self.entries.updateValue((rows[low][0], row[0], rows[low][1]), (pickle.dumps(rows[low:i], protocol=5),))
                low, held = i, 0

    def add(self, frames: Iterator[pd.DataFrame]) -> None:
        n, first = (self.count.get()[0] if self.count.exists() else 0), None
        for pdf in frames:
            rows = [(r["us"], n + i, *(bytes(v) if isinstance(v, bytearray) else v for v in (r[f] for f in self.fields))) for i, r in enumerate(_records(pdf))]
            if rows:
                rows.sort(key=lambda r: r[:2])
                self._put(rows)
                first, n = rows[0][0] if first is None else min(first, rows[0][0]), n + len(rows)
        self.count.update((n,))
        if first is not None:
            self.wake(first // 1000, earlier=True)

    def take(self, watermark_ms: int) -> tuple[list[dict], int | None]:
        """Rows whose time has come, in order of ``seq``, and the time of the first that still waits."""
        due, later = [], None
        for first, last, n in sorted(tuple(k) for k in self.entries.keys()):
            if first // 1000 > watermark_ms:
                later = first if later is None else min(later, first)
                continue
            rows = pickle.loads(bytes(self.entries.getValue((first, last, n))[0]))
            self.entries.removeKey((first, last, n))
            come = [r for r in rows if r[0] // 1000 <= watermark_ms]
            due += [{**dict(zip(self.fields, r[2:])), "us": r[0], "n": r[1]} for r in come]
            if len(come) < len(rows):
                self._put(rows[len(come) :])
                later = rows[len(come)][0] if later is None else min(later, rows[len(come)][0])
        return sorted(due, key=lambda r: (r["seq"], r["n"])), later

    def wake(self, at_ms: int, earlier: bool = False) -> None:
        """One timer at ``at_ms``; with ``earlier``, only if none is set before."""
        timers = list(self.handle.listTimers())
        if earlier and timers and min(timers) <= at_ms:
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at_ms)


class CallProcessor(StatefulProcessor):
    """STM-02 / STM-03: one state value per call; STM-09: an event-time timer clears idle calls.

    Chunks wait until the watermark has passed them (``Waiting``), so the result does not depend on how rows were dealt
    over triggers.
    """

    FIELDS = [c for c in CHUNK_COLUMNS if c not in ("call_id", "event_ts")]

    def __init__(self, kind: str, idle_ms: int = IDLE_MS):
        self.kind, self.idle_ms = kind, idle_ms

    def init(self, handle) -> None:
        self.waiting = Waiting(handle, self.FIELDS)
        self.value = handle.getValueState("call", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.add(rows)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, step = S.KINDS[self.kind]
        watermark = timerValues.getCurrentWatermarkInMs()
        due, later = self.waiting.take(watermark)
        if not due and later is None:
            self.value.clear()
            return
        state = S.load(self.value.get()[0]) if self.value.exists() else start()
        out = [o for o in (step(state, r) for r in due) if o is not None]
        self.value.update((S.dump(state),))
        idle_from = max([state["last_us"] or 0, *(r["us"] for r in due)])
        self.waiting.wake(later // 1000 if later is not None else max(idle_from // 1000 + self.idle_ms, watermark + 1))
        if out:
            yield pd.DataFrame(out).assign(call_id=key[0])

    def close(self) -> None:
        pass


def _with_all_columns(chunks: DataFrame) -> DataFrame:
    types = {"action": "string", "role": "string", "financial": "boolean", "language": "string", "clipped": "double"}
    missing = {c: F.lit(None).cast(t) if c != "clipped" else F.lit(0.0) for c, t in types.items() if c not in chunks.columns}
    return chunks.withColumns(missing).select(*CHUNK_COLUMNS)


def _schema(chunks: DataFrame, kind: str) -> StructType:
    spark = chunks.sparkSession
    out = spark.createDataFrame([], S.OUTPUTS[kind]).schema
    return StructType([*out.fields, StructField("call_id", chunks.schema["call_id"].dataType)])


def track_calls(chunks: DataFrame, kind: str, delay: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """Streaming form: each chunk is answered once the watermark has passed it. Rows behind the watermark are dropped;
    a bounded input needs a last row in the future (``closed_stream``). Rows without a call id belong to no call."""
    use_rocksdb(chunks.sparkSession)
    df = _with_all_columns(chunks).filter(F.col("call_id").isNotNull()).withWatermark("event_ts", delay)
    return df.groupBy("call_id").transformWithStateInPandas(
        statefulProcessor=CallProcessor(kind, idle_ms), outputStructType=_schema(chunks, kind), outputMode="Append", timeMode="EventTime")


def replay_calls(chunks: DataFrame, kind: str) -> DataFrame:
    """Batch form with the same result: calls stream through sorted partitions with one call's state in memory.

    The recursion is sequential inside a call; a call's chunks are bounded by real time.
    """
    schema = _schema(chunks, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, step = S.KINDS[kind]
        call, state, first = None, None, True
        for pdf in batches:
            out, ids = [], pdf["call_id"].tolist()
            for cid, row in zip(ids, _records(pdf)):
                if first or cid != call:
                    call, state, first = cid, start(), False
                result = step(state, row)
                if result is not None:
                    out.append({**result, "call_id": cid})
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return _with_all_columns(chunks).filter(F.col("call_id").isNotNull()).repartition("call_id").sortWithinPartitions("call_id", "seq").mapInPandas(run, schema)


def monitor_telemetry(tracked: DataFrame, role: str = "father") -> DataFrame:
    """RSK-12 .. RSK-14 on the tracked state: stage, call risk, level, alert, message."""
    speech = F.col("seconds_a") + F.col("seconds_b")
    df = tracked.withColumn("role", F.coalesce("role", F.lit(role))).withColumn("stage", R.stage("elapsed", speech))
    df = df.withColumn("call_risk", R.stage_risk("stage", R.active_threat("risk_a", "risk_b", "seconds_b"), "history_mean", "history_max"))
    df = df.withColumn("risk_level", R.stage_level("stage", "call_risk"))
    return df.withColumns(
        {
            "alert": R.stage_alert("risk_level"),
            "alert_message": R.stage_message("stage", "risk_level", "call_risk", "role", "elapsed", speech),
            "peak_risk": F.greatest(F.lit(5.0), "peak_b", F.when(F.col("peak_a") >= 50.0, F.col("peak_a")).otherwise(0.0)),
            "calibration_progress": rnd(F.greatest(F.least(F.lit(1.0), F.col("elapsed") / 10.0), F.least(F.lit(1.0), speech / 4.5)), 2),
            "timestamp": clock("elapsed"),
        }
    )


def session_telemetry(tracked: DataFrame, tau: float = 0.51) -> DataFrame:
    """RSK-07, RSK-08 on the tracked state."""
    m = R.live_risk("remote_prob", tau)
    overlap = F.when(F.col("speaker") == "OVERLAP", F.lit(R.LIVE_OVERLAP))
    return tracked.withColumns(
        {**m, "recommendation": F.coalesce(overlap, m["recommendation"]), "remote_status": R.live_status("remote_prob"), "warning_banner": R.live_banner("remote_prob"),
         "vu_meter": rnd(F.least(F.lit(1.0), F.col("rms") * 10.0), 3), "timestamp": clock("processed_sec")})


# --- sinks (STM-06, STM-11) ----------------------------------------------------------------------

def stream_alerts(telemetry: DataFrame) -> DataFrame:
    """STM-06: alerts whose remote party is at 70 or more."""
    return telemetry.filter(F.col("alert") & (F.col("risk_b") >= 70.0))


def session_alerts(telemetry: DataFrame) -> DataFrame:
    """STM-06: sessions at 0.70 or more."""
    return telemetry.filter(F.col("remote_prob") >= 0.70)


HEAD_COLUMNS = ["ledger_id", "index", "current_hash", "ts_us"]


HEAD_BUCKETS, BASE_EVERY = 256, 32


def _numbered(spark, path: str, label: str) -> list[int]:
    """Numbers of the ``label=N`` folders below ``path``."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(name):
        return []
    names = (f.getPath().getName() for f in store.listStatus(name))
    return sorted(int(n[len(label) + 1 :]) for n in names if n.startswith(label + "="))


def _files(spark, paths: list[str]) -> dict[str, tuple]:
    """Length and time of change of the files in ``paths``; contents are not read. One entry per file, as in any file index."""
    if not paths:
        return {}
    listed = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return {r["path"]: (r["length"], r["modificationTime"]) for r in listed.collect()}


class LedgerHeads:
    """Last blocks of ledgers at ``path/_heads``: each batch adds those of its own ledgers, and every ``BASE_EVERY`` batches
    all are written as a base in buckets, of which a batch reads those that its ledgers fall into."""

    def __init__(self, spark, path: str, kind: str):
        self.spark, self.path = spark, f"{path}/_heads"
        self.schema = f"ledger_id {kind}, index bigint, current_hash string, ts_us bigint"

    @staticmethod
    def bucket() -> Column:
        return F.pmod(F.xxhash64("ledger_id"), F.lit(HEAD_BUCKETS)).cast("int")

    def read(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """Heads before batch ``batch_id``; with ``buckets``, at least those of ledgers in them."""
        bases = [n for n in _numbered(self.spark, self.path, "base") if n < batch_id]
        parts = [n for n in _numbered(self.spark, self.path, "batch") if (bases[-1] if bases else -1) < n < batch_id]
        found = self.spark.createDataFrame([], self.schema)
        if parts:
            found = found.unionByName(self.spark.read.schema(self.schema).parquet(*[f"{self.path}/batch={n}" for n in parts]))
        if bases:
            base = self.spark.read.schema(self.schema + ", bucket int").parquet(f"{self.path}/base={bases[-1]}")
            found = found.unionByName((base if buckets is None else base.filter(F.col("bucket").isin(buckets))).drop("bucket"))
        if buckets is not None:
            found = found.filter(self.bucket().isin(buckets))
        return found.groupBy("ledger_id").agg(F.max_by(F.struct("index", "current_hash", "ts_us"), "index").alias("h")).select("ledger_id", "h.*")

    def add(self, batch_id: int, blocks: DataFrame) -> None:
        last = F.max_by(F.struct("index", "current_hash", "ts_us"), "pos")
        blocks.groupBy("ledger_id").agg(last.alias("h")).select("ledger_id", "h.*").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        bases = [n for n in _numbered(self.spark, self.path, "base") if n < batch_id]
        if batch_id - (bases[-1] if bases else -1) >= BASE_EVERY:
            self.read(batch_id + 1).withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base={batch_id}")


def ledger_writer(path: str, genesis_us: int, order: list[str], clock: Callable[[], int] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` target that chains events (ledger_id, ts_us, event_type, payload) onto ledgers at ``path``.

    Each batch owns one folder and overwrites it, so a repeated batch leaves a ledger of the same events. A block's time
    is when it is appended (``clock``, microseconds) and never before its predecessor's; ``ts_us`` only orders events.
    What a batch writes follows its events (``LedgerHeads``), and it reads no earlier blocks that are as they were.

    At its first batch a writer verifies all blocks. At each later one it lists the files: ledgers with blocks in files that
    are new or changed are verified, and all are if a file is gone. Events of broken ledgers (LDG-07), and events with a
    ``reason``, go to ``path/_rejects`` instead.
    """
    clock = clock or (lambda: time.time_ns() // 1000)
    broken: list[DataFrame] = []
    known_files: dict[str, tuple] = {}

    def refresh(spark, kind: str, written: list[int]) -> None:
        """Bring the list of broken ledgers up to date."""
        schema = f"ledger_id {kind}, pos bigint, index bigint, ts_us bigint, event_type string, payload string, previous_hash string, current_hash string"
        folders = [f"{path}/batch={b}" for b in written]
        now = _files(spark, folders)
        changed = [f for f, facts in now.items() if known_files.get(f) != facts]
        gone = [f for f in known_files if f not in now]
        first = not broken
        if first:
            broken.append(spark.createDataFrame([], f"ledger_id {kind}"))
        if changed or gone:
            blocks = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
            if not (first or gone):
                touched = spark.read.schema(schema).parquet(*changed).select("ledger_id").distinct()
                blocks = blocks.join(touched, "ledger_id", "left_semi")
            bad = L.verify(blocks).filter("NOT valid").select("ledger_id")
            if gone and not first:  # a ledger may have lost all of its blocks: its head is known all the same
                heads = LedgerHeads(spark, path, kind).read(written[-1] + 1 if written else 0)
                bad = bad.unionByName(heads.join(blocks.groupBy("ledger_id").agg(F.max("index").alias("top")), "ledger_id", "left").filter("top IS NULL OR top < index").select("ledger_id"))
            broken[0] = materialise(broken[0].unionByName(bad).distinct(), "broken-ledgers")
        known_files.clear()
        known_files.update(now)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, kind = batch.sparkSession, batch.schema["ledger_id"].dataType.simpleString()
        refresh(spark, kind, [b for b in _numbered(spark, path, "batch") if b < batch_id])
        store = LedgerHeads(spark, path, kind)
        batch = batch.persist()
        try:
            reason = F.col("reason") if "reason" in batch.columns else F.lit(None).cast("string")
            batch_ = batch.withColumn("reason", reason).join(broken[0].withColumn("__bad", F.lit(True)), "ledger_id", "left")
            batch_ = batch_.withColumn("reason", F.coalesce("reason", F.when(F.col("__bad"), F.lit("LEDGER_BROKEN")))).drop("__bad")
            batch_.filter("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/_rejects/batch={batch_id}")
            events = batch_.filter("reason IS NULL").drop("reason").withColumnRenamed("ts_us", "__event_us")
            buckets = [r[0] for r in events.select(store.bucket()).distinct().collect()]  # at most HEAD_BUCKETS numbers
            heads = store.read(batch_id, buckets)
            first = L.genesis(events.select("ledger_id").distinct().join(heads, "ledger_id", "left_anti"), F.lit(genesis_us)).select(*L.BLOCK_COLUMNS)
            known = heads.unionByName(first.select(*HEAD_COLUMNS))
            now = F.greatest(F.col("__head_us"), F.lit(clock()))
            events = events.join(known.select("ledger_id", F.col("ts_us").alias("__head_us")), "ledger_id").withColumn("ts_us", now)
            added = L.append_events(known, events, ["__event_us" if c == "ts_us" else c for c in order], F.floor(F.col("__event_us") / F.lit(3600e6)))
            first.unionByName(added).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            store.add(batch_id, spark.read.parquet(f"{path}/batch={batch_id}"))
            known_files.update(_files(spark, [f"{path}/batch={batch_id}"]))
        finally:
            batch.unpersist()

    return write


def rejected_events(spark, path: str, ledger_type: str = "string") -> DataFrame:
    """Events that a ledger writer at ``path`` turned away, with the reason."""
    return spark.read.schema(f"ledger_id {ledger_type}, ts_us bigint, event_type string, payload string, reason string, batch bigint").parquet(f"{path}/_rejects")


def synced_payload(payload, queued_at) -> Column:
    """Canonical payload of a queued event with ``edge_synced`` and ``original_queued_at`` set, over older values of
    these keys; NULL where the text is no JSON object or names a key twice."""
    fields = F.try_variant_get(F.try_parse_json(F.coalesce(payload, F.lit("{}"))), "$", "map<string,variant>")
    new = F.create_map(F.lit("edge_synced"), F.parse_json(F.lit("true")), F.lit("original_queued_at"), F.parse_json(F.format_string("%.6f", queued_at)))
    kept = F.map_filter(fields, lambda k, _: ~k.isin("edge_synced", "original_queued_at"))
    return F.to_json(F.to_variant_object(F.map_concat(kept, new)))


def drain_queue(spark, queue_path: str, ledger_path: str, checkpoint: str, genesis_us: int, schema: str, ledger_of: Column, clock: Callable[[], int] | None = None, max_files: int = 1000) -> None:
    """STM-11: chain every queued event once, in queue order. The checkpoint is what "cleared" means.

    Events with an unusable payload are rejected with it; they do not stop the others.
    """
    pending = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(queue_path).filter("event_type IS NOT NULL")
    synced = synced_payload(F.col("payload"), F.col("queued_at"))
    events = pending.select(ledger_of.alias("ledger_id"), (F.col("queued_at") * 1e6).cast("bigint").alias("ts_us"), "event_type", "payload", synced.alias("synced"))
    events = events.withColumn("reason", F.when(F.col("synced").isNull(), F.lit("INVALID_PAYLOAD"))).withColumn("payload", F.coalesce("synced", "payload")).drop("synced")
    query = events.writeStream.foreachBatch(ledger_writer(ledger_path, genesis_us, ["ts_us", "event_type", "payload"], clock)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def alerts_to_ledger(alerts: DataFrame, ledger_path: str, checkpoint: str, genesis_us: int, event_type: str = "LIVE_CALL_CLONE_DETECTED") -> None:
    """STM-06: a stream of alert rows into ledgers, one per call."""
    payload = event_payload(risk_level="risk_level", risk_score="risk_score", role="role", timestamp="timestamp")
    events = alerts.select(F.col("call_id").alias("ledger_id"), "ts_us", F.lit(event_type).alias("event_type"), payload.alias("payload"))
    query = events.writeStream.foreachBatch(ledger_writer(ledger_path, genesis_us, ["ts_us", "payload"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
