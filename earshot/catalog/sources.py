"""Readers and writers, on files that Spark derives from the tables and writes to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import corpus as C
from ..functions.hashing import foreign_hash_ok, seconds_text
from ..functions.numeric import rnd
from ..functions.text import clock, role_label
from ..functions.signal import total as signal_total
from ..operators import blocks as B
from ..operators import features
from ..operators import ledger as L
from ..sources import media, metadata, stores
from ..session import scratch, table
from . import query, r
from .curation import samples
from .evaluation import SLICED, sliced_metrics
from .ledger import CHAIN, chain, stored_chain
from .signal import spoken

ATTACK = "CASE o_orderpriority WHEN '1-URGENT' THEN '-' ELSE 'A' || lpad(substr(o_orderpriority, 1, 1) || '', 2, '0') END"


def attack():
    return F.when(F.col("o_orderpriority") == "1-URGENT", "-").otherwise(F.concat(F.lit("A"), F.lpad(F.substring("o_orderpriority", 1, 1), 2, "0")))


def protocol_files(spark, d):
    """Orders as protocol lines, one folder per status; short lines are noise to skip."""
    o = table(spark, d, "orders")
    line = F.concat_ws("  ", F.concat(F.lit("LA_"), F.col("o_custkey").cast("string")), F.concat(F.lit("LA_T_"), F.col("o_orderkey").cast("string")), F.lit("-"), attack(),
                       F.when(F.pmod("o_orderkey", F.lit(11)) != 0, F.when(attack() == "-", "bonafide").otherwise("spoof")))
    path = scratch(spark, "protocol")
    o.select(F.col("o_orderstatus").alias("part"), line.alias("value")).write.partitionBy("part").text(path)
    return path


@query("protocol_2019", f"""
SELECT 'LA_' || o_custkey AS speaker_id, 'LA_T_' || o_orderkey AS audio_id, CASE WHEN {ATTACK} = '-' THEN 'bonafide' ELSE {ATTACK} END AS system_id,
  CASE WHEN {ATTACK} = '-' THEN 0 ELSE 1 END AS label, CASE WHEN {ATTACK} = '-' THEN 'genuine' ELSE 'spoof' END AS label_str FROM orders WHERE o_orderkey % 11 <> 0""")
def protocol_2019(spark, d):
    """SRC-02."""
    return metadata.read_protocol_2019(spark, protocol_files(spark, d), None).select("speaker_id", "audio_id", "system_id", "label", "label_str")


@query("protocol_counts", f"""
SELECT o_orderstatus AS split, {ATTACK} AS attack, count(*) AS total, count(CASE WHEN {ATTACK} = '-' THEN 1 END) AS bonafide, count(CASE WHEN {ATTACK} <> '-' THEN 1 END) AS spoof
FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY ALL""")
def protocol_counts(spark, d):
    """AGG-02."""
    p = metadata.read_protocol_2019(spark, protocol_files(spark, d), None)
    return metadata.protocol_counts(p.withColumn("split", F.regexp_extract("file", "part=([A-Z])", 1)))


def trial_files(spark, d):
    o = table(spark, d, "orders")
    line = F.concat_ws(" ", F.concat(F.lit("S"), F.col("o_custkey").cast("string")), F.concat(F.lit("DF_E_"), F.col("o_orderkey").cast("string")),
                       F.concat(F.lit("codec"), F.pmod("o_custkey", F.lit(4)).cast("string")), F.lit("src"), attack(), F.when(attack() == "-", "Bonafide").otherwise("spoof"), F.lit("notrim"))
    path = scratch(spark, "trials")
    o.select(line.alias("value")).write.text(path)
    return path


@query("trials_2021", f"""
SELECT 'S' || o_custkey AS speaker_id, 'DF_E_' || o_orderkey AS audio_id, 'asv2021_' || {ATTACK} || '_codec' || (o_custkey % 4) AS system_id, CASE WHEN {ATTACK} = '-' THEN 0 ELSE 1 END AS label FROM orders""")
def trials_2021(spark, d):
    """SRC-03."""
    return metadata.read_trials_2021(spark, trial_files(spark, d)).select("speaker_id", "audio_id", "system_id", "label")


@query("trial_counts", f"""
SELECT 'codec' || (o_custkey % 4) AS codec, count(*) AS trials, count(CASE WHEN {ATTACK} = '-' THEN 1 END) AS bonafide, count(CASE WHEN {ATTACK} <> '-' THEN 1 END) AS spoof FROM orders GROUP BY 1""")
def trial_counts(spark, d):
    """AGG-03."""
    return metadata.trial_counts(metadata.read_trials_2021(spark, trial_files(spark, d)))


@query("clip_index_join", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'fleurs_unknown' ELSE CAST(o_custkey AS VARCHAR) END AS speaker_id FROM orders""")
def clip_index_join(spark, d):
    """SRC-04, JOIN-03: two thirds of the clips are in the tab-separated index."""
    o = table(spark, d, "orders").withColumn("file_name", F.concat(F.col("o_orderkey").cast("string"), F.lit(".wav")))
    path = scratch(spark, "index")
    o.filter(F.pmod("o_custkey", F.lit(3)) != 0).select(
        F.col("o_orderkey").alias("a"), "file_name", F.lit('say "x"').alias("c"), F.lit("x").alias("t"), F.lit("F").alias("g"), F.col("o_custkey").alias("s")).write.option("sep", "\t").option("quote", "\u0000").csv(path)
    return metadata.with_speaker_index(o.select("o_orderkey", "file_name"), metadata.read_clip_index(spark, path), F.lit("fleurs_unknown")).select("o_orderkey", "speaker_id")


@query("system_means_file", f"SELECT p_brand AS system_id, {r('avg(p_retailprice)', 4)} AS mean FROM part GROUP BY 1")
def system_means_file(spark, d):
    """SRC-05."""
    path = scratch(spark, "means")
    table(spark, d, "part").groupBy("p_brand").agg(rnd(F.avg("p_retailprice"), 4).alias("mean")).select(F.col("p_brand").alias("system_ID"), "mean").write.option("header", "true").csv(path)
    return metadata.read_system_means(spark, path)


@query("transcripts", """
SELECT conv_id || '-' || turn || '-0' AS utt_id, replace(text, chr(10), '\\n') AS text, CAST(conv_id AS VARCHAR) AS reader, CAST(turn AS VARCHAR) AS chapter FROM conversations""")
def transcripts(spark, d):
    """SRC-06: utterances one a line, line breaks inside them escaped."""
    path = scratch(spark, "transcripts")
    c = table(spark, d, "conversations")
    c.select(F.concat(F.concat_ws("-", "conv_id", "turn", F.lit("0")), F.lit(" "), F.replace("text", F.lit("\n"), F.lit("\\n")))).write.text(path)
    t = metadata.read_transcripts(spark, path, None)
    return t.select("utt_id", "text", "reader", "chapter")


@query("riff_headers", """
SELECT s_suppkey, CAST(length(s_name) * 1000 AS DOUBLE) / 32000e0 AS duration, 16000 AS rate, 1 AS channels, 'PCM_16' AS subtype, length(s_name) * 1000 / 32000e0 >= 0.5e0 AS is_valid FROM supplier""")
def riff_headers(spark, d):
    """SRC-17, PRJ-05: headers of WAV content held in a table."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("path"), media.wav_bytes(F.encode(F.repeat("s_name", 1000), "utf-8")).alias("content"))
    a = media.header_audit(s)
    return a.select(F.col("path").cast("bigint").alias("s_suppkey"), "duration", "rate", "channels", "subtype", C.valid_file("duration", "channels", "rate").alias("is_valid"))


@query("wav_files", """
WITH s AS (SELECT doc_id, doc_id % 7 AS kind, encode(coalesce(text, '')) AS raw FROM documents),
r AS (SELECT *, CASE kind WHEN 1 THEN 'WRONG_RATE' WHEN 2 THEN 'TRUNCATED' WHEN 3 THEN 'NOT_WAV' WHEN 4 THEN 'NOT_MONO' WHEN 5 THEN 'NO_SAMPLES' END AS reason FROM s)
SELECT doc_id, CASE WHEN reason IS NULL THEN octet_length(raw) // 2 END AS samples, CASE WHEN reason IS NULL AND octet_length(raw) % 2 = 0 THEN sha256(raw) END AS even_sha, reason FROM r""")
def wav_files(spark, d):
    """SRC-16: texts as the samples of WAV files, some of them unusable, one kind with a long chunk before the data."""
    kind, raw = F.pmod("doc_id", F.lit(7)), F.encode(F.coalesce("text", F.lit("")), "utf-8")
    good = media.wav_bytes(raw)
    long_list = F.concat(F.substring(good, 1, 12), F.encode(F.lit("LIST"), "utf-8"), F.unhex(F.lit("88130000")), F.encode(F.repeat(F.lit("data"), 1250), "utf-8"), F.substring(good, F.lit(13), F.octet_length(good)))
    stereo = F.concat(F.substring(good, 1, 22), F.unhex(F.lit("0200")), F.substring(good, F.lit(25), F.octet_length(good)))
    content = (
        F.when(kind == 1, media.wav_bytes(raw, 8000)).when(kind == 2, F.substring(good, F.lit(1), F.octet_length(good) - 1)).when(kind == 3, raw)
        .when(kind == 4, stereo).when(kind == 5, media.wav_bytes(F.unhex(F.lit("")))).when(kind == 6, long_list).otherwise(good)
    )
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("doc_id"), content.alias("content"), F.octet_length(raw).alias("size"))
    samples, rejects = media.wav_samples(files)
    read = samples.select(F.col("path").alias("doc_id"), F.floor(F.octet_length("pcm") / 2).alias("samples"), F.sha2("pcm", 256).alias("sha"), F.lit(None).cast("string").alias("reason"))
    sizes = files.select("doc_id", "size")
    read = read.join(sizes, "doc_id").select("doc_id", "samples", F.when(F.col("size") % 2 == 0, F.col("sha")).alias("even_sha"), "reason")
    return read.unionByName(rejects.select(F.col("path").alias("doc_id"), F.lit(None).cast("bigint").alias("samples"), F.lit(None).cast("string").alias("even_sha"), "reason"))


@query("audio_listing", "SELECT DISTINCT c_nationkey AS folder, true AS has_bytes FROM customer")
def audio_listing(spark, d):
    """SRC-01, SET-01: recursive listing by pattern of customers written into one folder per nation."""
    path = scratch(spark, "listing")
    table(spark, d, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    found = media.audio_listing(spark, path, "*.{parquet,flac}")
    return found.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("folder"), (F.col("length") > 0).alias("has_bytes"))


@query("newest_path", "SELECT l_suppkey, CAST(max((l_shipdate, l_orderkey)).l_orderkey AS BIGINT) AS newest FROM (SELECT l_suppkey, l_shipdate, l_orderkey FROM lineitem) GROUP BY 1".replace("max((l_shipdate, l_orderkey)).l_orderkey", "arg_max(l_orderkey, (l_shipdate, l_orderkey))"))
def newest_path(spark, d):
    """SRC-19: line items read as model files of a supplier, the newest of each."""
    listing = table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("path"), F.col("l_shipdate").alias("modificationTime"))
    return stores.newest_path(listing, ("l_suppkey",)).withColumnRenamed("path", "newest")


@query("rejected_clips", "SELECT vec_id, CASE vec_id % 10 WHEN 3 THEN 'empty' WHEN 7 THEN 'not finite' END AS reason FROM embeddings")
def rejected_clips(spark, d):
    """PRJ-15."""
    m = F.pmod("vec_id", F.lit(10))
    e = table(spark, d, "embeddings").select("vec_id", F.when(m == 3, F.slice("embedding", 1, 0)).when(m == 7, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding")).alias("pcm"))
    good, bad = features.usable_clips(e)
    return good.select("vec_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("vec_id", F.col("reject_reason").alias("reason")))


@query("cut_windows", f"""
WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x, unnest(range(0, 41, 8)) AS st FROM embeddings)
SELECT vec_id, CAST(st // 8 AS INTEGER) AS win_idx, {r('list_sum(x[st + 1 : st + 24])', 8)} AS total FROM s""")
def cut_windows(spark, d):
    """WIN-01, ARR-01: the samples of each window."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("pcm"))
    w = features.cut_spans(e.withColumn("spans", features.sliding_spans("pcm", 24, 8)))
    return w.select("vec_id", F.col("pos").alias("win_idx"), rnd(signal_total("pcm"), 8).alias("total"))


@query("report_lines", f"""
WITH m AS ({SLICED}) SELECT printf('%-12s %-12s %8d %7.2f%% %7.2f%%', kind, slice, n, {r('accuracy * 100', 2)}, {r('false_alarm_rate * 100', 2)}) AS line FROM m""")
def report_lines(spark, d):
    """SRC-13: the sliced metrics as text lines, written and read back."""
    path = scratch(spark, "report")
    stores.text_report(sliced_metrics(spark, d)).select("line").coalesce(1).write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("live_chunks", """
SELECT conv_id, turn, strlen(text) - strlen(text) % 2 AS n_bytes FROM conversations WHERE strlen(text) >= 2""")
def live_chunks(spark, d):
    """SRC-14."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.encode("text", "utf-8").alias("pcm"))
    return media.live_chunks(c).select("conv_id", "turn", F.octet_length("pcm").cast("bigint").alias("n_bytes"))


@query("json_messages", """
SELECT conv_id, turn, 'audio' AS kind, strlen(text) - strlen(text) % 2 AS n_bytes, CAST(NULL AS VARCHAR) AS role FROM conversations WHERE role <> 'system' AND strlen(text) >= 2
UNION ALL SELECT conv_id, turn, 'configure', NULL, 'bank_agent' FROM conversations WHERE role = 'system'""")
def json_messages(spark, d):
    """SRC-15, STM-07: base64 audio and configuration messages."""
    c = table(spark, d, "conversations")
    audio = F.to_json(F.struct(F.regexp_replace(F.base64(F.encode("text", "utf-8")), "\\s", "").alias("audio_chunk")))
    m = c.select("conv_id", "turn", F.when(F.col("role") == "system", F.lit('{"action":"configure","claimed_contact_role":"bank_agent"}')).otherwise(audio).alias("message"))
    a, conf = media.json_messages(m)
    return a.select("conv_id", "turn", F.lit("audio").alias("kind"), F.octet_length("pcm").cast("bigint").alias("n_bytes"), F.lit(None).cast("string").alias("role")).unionByName(
        conf.select("conv_id", "turn", F.lit("configure").alias("kind"), F.lit(None).cast("bigint").alias("n_bytes"), F.col("claimed_contact_role").alias("role")))


@query("feature_cache", "SELECT o_orderstatus AS split, count(*) AS n, true AS reused FROM orders GROUP BY 1")
def feature_cache(spark, d):
    """SRC-07: the second call does not build."""
    path, built = scratch(spark, "features"), []

    def build():
        built.append(1)
        return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split"))

    stores.cached_features(spark, path, build)
    return stores.cached_features(spark, path, build).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n")).withColumn("reused", F.lit(len(built) == 1))


@query("ledger_files", f"""
WITH RECURSIVE {CHAIN} SELECT ledger_id, count(*) AS blocks, true AS hashes_ok, true AS linked, 'LOADED' AS status FROM chain GROUP BY 1""")
def ledger_files(spark, d):
    """SRC-08: whole ledgers as JSON arrays, one a line behind its name, written, read back, re-hashed and re-linked."""
    b = stored_chain(spark, d)
    head = F.concat(F.lit('{"index":'), F.col("index").cast("string"), F.lit(',"timestamp":'), seconds_text("ts_us"), F.lit(',"event_type":"'), "event_type", F.lit('","event_data":'), "payload")
    one = F.concat(head, F.lit(',"previous_hash":"'), "previous_hash", F.lit('","current_hash":"'), "current_hash", F.lit('"}'))
    listed = F.array_sort(F.collect_list(F.struct("pos", one.alias("text"))))  # one row per ledger, as the format wants
    files = b.groupBy("ledger_id").agg(F.concat(F.lit("["), F.array_join(listed["text"], ","), F.lit("]")).alias("value"))
    path = scratch(spark, "ledger-files")
    files.select(F.concat_ws("\t", F.col("ledger_id").cast("string"), "value").alias("value")).write.text(path)
    lines = spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("bigint").alias("file"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("value"))
    blocks, status = stores.parse_ledgers(lines)
    ok = (F.col("pos") == 0) | foreign_hash_ok("index", "timestamp", "event_type", "payload", "previous_hash", "current_hash")
    checked = B.lagged(blocks.withColumn("ok", ok), ["ledger_id"], ["pos"], B.int_block("pos"), before="current_hash")
    link = F.col("before").isNull() & (F.col("pos") == 0) | F.coalesce(F.col("before") == F.col("previous_hash"), F.lit(False))
    per = checked.groupBy("ledger_id").agg(F.count("*").alias("blocks"), F.min("ok").alias("hashes_ok"), F.min(link).alias("linked"))
    return per.join(status, "ledger_id")


@query("checkpoint_file", f"""
WITH RECURSIVE {CHAIN} SELECT ledger_id, sha256(string_agg(current_hash, '' ORDER BY pos)) AS cumulative_hash, count(*) AS blocks_count FROM chain GROUP BY 1""")
def checkpoint_file(spark, d):
    """SRC-10."""
    path = scratch(spark, "checkpoints")
    stores.write_checkpoints(L.create_checkpoints(stored_chain(spark, d)), path)
    return stores.read_checkpoints(spark, path).select("ledger_id", "cumulative_hash", "blocks_count")


@query("ledger_table", f"WITH RECURSIVE {CHAIN} SELECT count(*) AS blocks, count(DISTINCT current_hash) AS hashes FROM chain")
def ledger_table(spark, d):
    """SRC-09: genesis blocks and events appended in two commits."""
    path = scratch(spark, "ledger")
    b = chain(spark, d)
    stores.append_ledger(b.filter("pos = 0"), path)
    stores.append_ledger(b.filter("pos > 0"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("blocks"), F.countDistinct("current_hash").alias("hashes"))


def queue_path(spark, d):
    path = scratch(spark, "queue")
    e = table(spark, d, "events")
    stores.enqueue(e.select("event_type", F.col("props").alias("payload"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), (F.unix_micros("ts") / 1e6).alias("queued_at")), path)
    return path


@query("queue_status", "SELECT 'EDGE_OFFLINE' AS node_mode, true AS offline_mode, count(*) AS pending_sync_events, 'HEALTHY' AS status FROM events")
def queue_status(spark, d):
    """SRC-11, AGG-29."""
    return stores.queue_status(stores.read_queue(spark, queue_path(spark, d)), True)


@query("queue_events", "SELECT event_type, 's' || user_id AS session_id, count(*) AS n FROM events GROUP BY ALL")
def queue_events(spark, d):
    """SRC-11."""
    return stores.read_queue(spark, queue_path(spark, d)).groupBy("event_type", "session_id").agg(F.count("*").alias("n"))


@query("manifest_file", f"SELECT o_orderkey AS audio_id, {r('o_totalprice / 50000e0', 4)} AS duration_sec FROM orders")
def manifest_file(spark, d):
    """SRC-12."""
    path = scratch(spark, "manifest")
    stores.write_manifest(samples(spark, d), path)
    return spark.read.schema("audio_id bigint, duration_sec double").json(path).select("audio_id", rnd("duration_sec", 4).alias("duration_sec"))


@query("experiment_record", "SELECT 'balanced' AS experiment, count(*) AS train_rows FROM orders")
def experiment_record(spark, d):
    """SRC-21."""
    path = scratch(spark, "experiment")
    n = table(spark, d, "orders").count()
    stores.write_experiment(spark, {"experiment": "balanced", "train_rows": n, "model": "random_forest"}, path)
    return spark.read.schema("experiment string, train_rows bigint").json(path)


PATHS = """
paths AS (SELECT o_orderkey, CASE o_orderkey % 13
  WHEN 0 THEN '/c/additional_genuine/slr65/train/tam_' || o_custkey || '_' || o_orderkey || '.wav'
  WHEN 1 THEN '/c/Additional_Genuine/slr65/x' || o_orderkey || '.flac'
  WHEN 2 THEN '/c/indic_tts/Hindi/f_m_spk' || o_custkey || '_' || o_orderkey || '.wav'
  WHEN 3 THEN '/c/IndicSynth/freevc24/gujarati/a_b_c_s' || o_custkey || '_' || o_orderkey || '.wav'
  WHEN 4 THEN '/c/la/LA_T_' || o_orderkey || '.flac'
  WHEN 5 THEN '/c/df/DF_E_' || o_orderkey || '.flac'
  WHEN 6 THEN '/c/asvspoof2021/genuine_' || o_orderkey || '.flac'
  WHEN 7 THEN '/c/LibriSpeech/test/' || o_custkey || '-12-' || o_orderkey || '.flac'
  WHEN 8 THEN '/c/chatterbox/u' || o_orderkey || '.wav'
  WHEN 9 THEN '/c/x/ASV2019_' || o_custkey || '-nat-' || o_orderkey || '.wav'
  WHEN 10 THEN '/c/x/ASV2019_' || o_orderkey || '.wav'
  WHEN 11 THEN '/c/x/my_nat_' || o_orderkey || '.wav' ELSE '/c/x/senate' || o_orderkey || '.wav' END AS path, o_custkey FROM orders)"""


def clip_paths(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    forms = ["/c/additional_genuine/slr65/train/tam_{c}_{k}.wav", "/c/Additional_Genuine/slr65/x{k}.flac", "/c/indic_tts/Hindi/f_m_spk{c}_{k}.wav", "/c/IndicSynth/freevc24/gujarati/a_b_c_s{c}_{k}.wav",
             "/c/la/LA_T_{k}.flac", "/c/df/DF_E_{k}.flac", "/c/asvspoof2021/genuine_{k}.flac", "/c/LibriSpeech/test/{c}-12-{k}.flac", "/c/chatterbox/u{k}.wav", "/c/x/ASV2019_{c}-nat-{k}.wav",
             "/c/x/ASV2019_{k}.wav", "/c/x/my_nat_{k}.wav", "/c/x/senate{k}.wav"]
    pick = F.get(F.array(*[F.lit(f) for f in forms]), F.pmod("o_orderkey", F.lit(13)).cast("int"))
    return o.select("o_orderkey", F.replace(F.replace(pick, F.lit("{c}"), c), F.lit("{k}"), k).alias("path"))


@query("corpus_classification", f"""
WITH {PATHS}, x AS (SELECT *, o_orderkey % 13 AS m, {ATTACK} AS attack FROM paths JOIN (SELECT o_orderkey, o_orderpriority FROM orders) USING (o_orderkey)),
y AS (SELECT *, m = 4 AND o_orderkey % 11 <> 0 AS in_proto FROM x)
SELECT o_orderkey,
  CASE WHEN m IN (0, 1) THEN 'additional_genuine' WHEN m = 2 THEN 'indic_tts' WHEN m = 3 THEN 'indic_synth' WHEN in_proto THEN 'asvspoof2019' WHEN m = 5 THEN 'asvspoof2021' WHEN m = 6 THEN 'asvspoof2021_unlisted'
       WHEN m = 7 THEN 'librispeech' WHEN m = 8 THEN 'chatterbox' WHEN m IN (9, 10) THEN 'asv2019_named' ELSE 'fallback' END AS corpus,
  CASE WHEN m = 0 THEN 'tam_' || o_custkey WHEN m = 1 THEN 'slr65_x' || o_orderkey WHEN m = 2 THEN 'spk' || o_custkey WHEN m = 3 THEN 's' || o_custkey WHEN in_proto THEN 'LA_' || o_custkey WHEN m = 5 THEN 'S' || o_custkey
       WHEN m = 7 THEN 'libri_' || o_custkey WHEN m = 8 THEN 'chatterbox_speaker' WHEN m = 9 THEN 'ASV2019_' || o_custkey ELSE 'speaker_unknown' END AS speaker_id,
  CASE WHEN m IN (0, 1) THEN 'indic_slr65_tamil' WHEN m = 2 THEN 'indictts_hindi' WHEN m = 3 THEN 'indicsynth_freevc24_gujarati' WHEN in_proto THEN CASE WHEN attack = '-' THEN 'bonafide' ELSE attack END
       WHEN m = 5 THEN 'asv2021_' || attack || '_codec' || (o_custkey % 4) WHEN m = 6 THEN 'asv2021_df' WHEN m = 7 THEN 'bonafide' WHEN m = 8 THEN 'chatterbox_tts' WHEN m = 9 THEN 'nat' WHEN m = 10 THEN 'spoof' WHEN m = 11 THEN 'bonafide' ELSE 'spoof' END AS system_id,
  CASE WHEN m IN (0, 1, 2, 6, 7, 9, 11) THEN 0 WHEN m = 3 THEN 1 WHEN in_proto OR m = 5 THEN CASE WHEN attack = '-' THEN 0 ELSE 1 END ELSE 1 END AS label FROM y""")
def corpus_classification(spark, d):
    """PRJ-01, PRJ-02, PRJ-03, JOIN-01, JOIN-02, STR-01."""
    proto = metadata.read_protocol_2019(spark, protocol_files(spark, d), None)
    trials = metadata.read_trials_2021(spark, trial_files(spark, d))
    return C.classify_paths(clip_paths(spark, d), protocol=proto, trials=trials).select("o_orderkey", "corpus", "speaker_id", "system_id", "label")


@query("pseudo_speakers", f"""
WITH {PATHS}, s AS (SELECT o_orderkey, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.wav|\\.flac', '', 'g') AS stem FROM paths)
SELECT o_orderkey, stem, CAST(CAST('0x' || substr(md5(stem), 1, 8) AS BIGINT) % 30 AS INTEGER) AS bucket FROM s""")
def pseudo_speakers(spark, d):
    """PRJ-04: a stable bucket of 30 per stem."""
    p = clip_paths(spark, d)
    return p.select("o_orderkey", C.stem("path").alias("stem"), C.pseudo_speaker(C.stem("path")).alias("bucket"))


@query("language_codes", """
WITH c AS (SELECT doc_id, ['hi', 'ta', 'te', 'bn', 'kn', 'mr', 'xx'][CAST(doc_id % 7 AS INTEGER) + 1] AS code FROM documents)
SELECT doc_id, CASE code WHEN 'hi' THEN 'hindi' WHEN 'ta' THEN 'tamil' WHEN 'te' THEN 'telugu' WHEN 'bn' THEN 'bengali' WHEN 'kn' THEN 'kannada' WHEN 'mr' THEN 'marathi' END AS name, CASE WHEN code = 'xx' THEN '?' ELSE code END AS back FROM c""")
def language_codes(spark, d):
    """PRJ-16."""
    codes = F.array(*[F.lit(x) for x in ("hi", "ta", "te", "bn", "kn", "mr", "xx")])
    df = table(spark, d, "documents").select("doc_id", F.get(codes, F.pmod("doc_id", F.lit(7)).cast("int")).alias("code"))
    return df.select("doc_id", C.language_name("code").alias("name"), C.language_code(C.language_name("code"), "?").alias("back"))


@query("generator_subset", """
WITH g AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i, n_chars FROM documents WHERE contains(lower(source), 'src1') AND n_chars > 0)
SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN lang ELSE CAST(i % 5 + 1 AS VARCHAR) END AS speaker FROM g""")
def generator_subset(spark, d):
    """PRJ-17: substring filter, rows without audio skipped, round-robin speaker where none is given."""
    docs = table(spark, d, "documents").filter(F.lower("source").contains("src1") & (F.col("n_chars") > 0))
    docs = B.row_index(docs.select("doc_id", "lang", "n_chars"), [], ["doc_id"], B.int_block("doc_id", 65536), "rn")
    given = F.when(F.pmod("n_chars", F.lit(2)) == 0, F.col("lang"))
    return docs.select("doc_id", C.default_speaker(given, F.col("rn") - 1, 5).alias("speaker"))


@query("role_labels_and_clock", """
SELECT event_id, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Agent' AS role_label, lpad(CAST(CAST(floor(value) AS INTEGER) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(value) AS INTEGER) % 60 AS VARCHAR), 2, '0') AS clock FROM events""")
def role_labels_and_clock(spark, d):
    """STR-02, STR-03, STR-04."""
    return table(spark, d, "events").select("event_id", role_label(F.concat("event_type", F.lit("_agent"))).alias("role_label"), clock("value").alias("clock"))


@query("standardised_clips", """
SELECT doc_id, floor(octet_length(encode(text)) // 2 / 16000e0 * 10000 + 0.5e0) / 10000 AS duration_sec, 0.95e0 AS peak FROM documents WHERE octet_length(encode(text)) // 2 >= 1000""")
def standardised_clips(spark, d):
    """SRC-20: whole documents as clips, silence cut, half a second kept, peak set to 0.95."""
    out = media.standardise(spoken(spark, d), shortest=1000)
    return out.select("doc_id", rnd("duration_sec", 4).alias("duration_sec"), rnd(F.array_max(F.transform("pcm", lambda v: F.abs(v))), 6).alias("peak"))
