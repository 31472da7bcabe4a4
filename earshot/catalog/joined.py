"""Live calls judged on joined audio: turns of `conversations` are chunks of PCM, their roles the two channels of a call.

Lengths are scaled down with the chunks. For the state queries a digest of the cut stands for the model's score, so SQL
can follow every cut and every smoothed value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..plans import live
from ..session import materialise, scratch, table
from ..sources.pcm_stream import pcm_stream
from ..sources.ranged import write_raw
from ..streaming import joined as J
from . import query, r
from .models import _document_model

RULES = J.JoinRules(least=100, every=300, recent=800, kept=2400, heard=600, mixed=700, mixed_first=900, mixed_least=10**9, first_after=1.0, first_speech=250 / 16000, shortest_voice=512)


def _channels(spark, d):
    """Chunks half a second apart; users are channel A, assistants channel B."""
    c = table(spark, d, "conversations").filter("role <> 'system'")
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("turn") * 500_000)
    return c.select(F.col("conv_id").alias("call_id"), F.col("turn").cast("bigint").alias("seq"), at.alias("event_ts"), F.encode("text", "utf-8").alias("pcm"), F.when(F.col("role") == "user", "A").otherwise("B").alias("speaker"))


def _digest_score(cuts):
    value = F.conv(F.substring(F.md5(F.hex("cut")), 1, 4), 16, 10).cast("int") % 1000
    return cuts.withColumns({"prob": value / F.lit(1000.0), "risk": value / F.lit(10.0)})


_CHUNKS = """
c AS (SELECT conv_id AS call_id, turn AS seq, CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS who, (octet_length(encode(text)) // 2)::BIGINT AS n,
    left(hex(encode(text)), (4 * (octet_length(encode(text)) // 2))::INTEGER) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn - min(turn) OVER (PARTITION BY conv_id) AS gone
  FROM conversations WHERE role <> 'system' AND octet_length(encode(text)) >= 2)"""


def _average(new, old):
    return f"CASE WHEN {new} >= 60 THEN greatest({old}, {new}) WHEN {new} < 30 THEN 0.45e0 * {new} + 0.55e0 * {old} ELSE 0.35e0 * {new} + 0.65e0 * {old} END"


@query("joined_audio_state", f"""
WITH RECURSIVE {_CHUNKS},
s AS (
  SELECT DISTINCT call_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS who, '' AS ha, '' AS hb, 0::BIGINT AS ta, 0::BIGINT AS tb, 0::BIGINT AS ja, 0::BIGINT AS jb, 5e0 AS da, 5e0 AS db, 5e0 AS ea, 5e0 AS eb,
    5e0 AS ra, 5e0 AS rb, 5e0 AS pa, 5e0 AS pb, []::DOUBLE[] AS hist, NULL::VARCHAR AS cut_for, NULL::BIGINT AS cut_from, NULL::BIGINT AS cut_to, NULL::DOUBLE AS risk, 0::BIGINT AS na, 0::BIGINT AS nb,
    '' AS last_type, '' AS last_key, '' AS events FROM c
  UNION ALL
  SELECT call_id, k, seq, who, ha, hb, ta, tb, ja, jb, da, CASE WHEN cut_for = 'FIRST' THEN risk ELSE db END, ea, eb,
    ra, CASE WHEN cut_for = 'FIRST' THEN floor(risk * 10 + 0.5e0) / 10 ELSE rb END, pa, pb, CASE WHEN cut_for IS NULL THEN hist ELSE list_append(hist, risk) END, cut_for, cut_from, cut_to, risk, na, nb,
    CASE WHEN hot THEN 'ALERT' ELSE type1 END, CASE WHEN hot THEN key2 ELSE key1 END, events1 || CASE WHEN hot AND key2 <> key1 THEN ' ALERT:' || who || ':evaluation' ELSE '' END
  FROM (SELECT *, 'ALERT|' || who || '|evaluation|' || CASE who WHEN 'A' THEN ra ELSE rb END AS key2, CASE who WHEN 'A' THEN ra ELSE rb END >= 50 AND type1 <> 'ALERT' AS hot
   FROM (SELECT * REPLACE (CASE who WHEN 'A' THEN greatest(pa, da, ra) ELSE pa END AS pa, CASE who WHEN 'B' THEN greatest(pb, db, rb) ELSE pb END AS pb)
   FROM (SELECT * REPLACE (CASE who WHEN 'A' THEN floor(ea * 10 + 0.5e0) / 10 ELSE ra END AS ra, CASE who WHEN 'B' THEN floor(eb * 10 + 0.5e0) / 10 ELSE rb END AS rb)
   FROM (SELECT * REPLACE (CASE who WHEN 'A' THEN {_average('da', 'ea')} ELSE ea END AS ea, CASE who WHEN 'B' THEN {_average('db', 'eb')} ELSE eb END AS eb)
   FROM (SELECT * REPLACE (CASE WHEN cut_for = 'A' THEN risk ELSE da END AS da, CASE WHEN cut_for = 'B' THEN risk ELSE db END AS db, CASE WHEN cut_for = 'A' THEN ta ELSE ja END AS ja, CASE WHEN cut_for = 'B' THEN tb ELSE jb END AS jb)
   FROM (SELECT *, ('0x' || substr(md5(cut), 1, 4))::INTEGER % 1000 / 10e0 AS risk, cut_to - length(cut) // 4 AS cut_from
   FROM (SELECT *, CASE cut_for WHEN 'A' THEN right(ha, 3200) WHEN 'B' THEN right(hb, 3200) WHEN 'FIRST' THEN CASE WHEN tb >= 100 THEN right(hb, 9600) ELSE right(ha, 9600) END END AS cut,
       CASE cut_for WHEN 'A' THEN ta WHEN 'B' THEN tb WHEN 'FIRST' THEN CASE WHEN tb >= 100 THEN tb ELSE ta END END AS cut_to
   FROM (SELECT *, CASE WHEN who = 'A' AND ta - ja >= 300 THEN 'A' WHEN who = 'B' AND tb - jb >= 300 THEN 'B' WHEN len(hist) = 0 AND (gone * 0.5e0 >= 1 OR ta + tb >= 250) AND greatest(ta, tb) >= 100 THEN 'FIRST' END AS cut_for,
       CASE WHEN turned AND key0 <> last_key THEN type0 ELSE last_type END AS type1, CASE WHEN turned AND key0 <> last_key THEN key0 ELSE last_key END AS key1, CASE WHEN turned AND key0 <> last_key THEN type0 || ':' || who || ':turn' ELSE '' END AS events1
   FROM (SELECT *, type0 || '|' || who || '|turn' AS key0
   FROM (SELECT s.call_id, c.k, c.seq, c.who, c.gone, s.who IS DISTINCT FROM c.who AS turned, CASE WHEN c.who = 'B' AND rb >= 70 THEN 'ALERT' ELSE 'INFO' END AS type0, last_type, last_key,
       CASE WHEN c.who = 'A' THEN ha || h ELSE ha END AS ha, CASE WHEN c.who = 'B' THEN hb || h ELSE hb END AS hb, CASE WHEN c.who = 'A' THEN ta + n ELSE ta END AS ta, CASE WHEN c.who = 'B' THEN tb + n ELSE tb END AS tb, ja, jb,
       da, db, ea, eb, ra, rb, pa, pb, hist, na + (c.who = 'A' AND s.who IS DISTINCT FROM 'A')::BIGINT AS na, nb + (c.who = 'B' AND s.who IS DISTINCT FROM 'B')::BIGINT AS nb
     FROM s JOIN c ON s.call_id = c.call_id AND c.k = s.k + 1)))))))))))
SELECT call_id, seq, who AS speaker, cut_for, cut_from, cut_to, risk, ra AS risk_a, rb AS risk_b, pa AS peak_a, pb AS peak_b, {r('list_avg(hist)', 6)} AS history_mean, list_max(hist) AS history_max,
  na AS turns_a, nb AS turns_b, trim(events) AS events FROM s WHERE k > 0""")
def joined_audio_state(spark, d):
    """STM-02, STM-08, STM-10, STM-12, STM-13: what is cut, and what the scores of the cuts do to a call."""
    followed = J.replay_calls(_channels(spark, d), _digest_score, "monitor", RULES)
    events = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["type"], e["speaker"], e["cause"])), " ")
    return followed.select("call_id", "seq", "speaker", "cut_for", "cut_from", "cut_to", "risk", "risk_a", "risk_b", "peak_a", "peak_b", rnd("history_mean", 6).alias("history_mean"), "history_max", "turns_a", "turns_b", events.alias("events"))


_SESSION = f"""
WITH RECURSIVE {_CHUNKS},
s AS (
  SELECT DISTINCT call_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS who, '' AS h, 0::BIGINT AS t, NULL::DOUBLE AS prob, 0.08e0 AS eb, 0.05e0 AS ea, 0.08e0 AS rb, 0.05e0 AS ra FROM c
  UNION ALL
  SELECT call_id, k, seq, who, h, t, prob, eb, ea, CASE who WHEN 'B' THEN least(greatest(eb, 0.01e0), 0.99e0) ELSE rb END, CASE who WHEN 'A' THEN least(greatest(ea, 0.01e0), 0.35e0) ELSE ra END
  FROM (SELECT * REPLACE (CASE who WHEN 'B' THEN CASE WHEN prob > eb THEN 0.7e0 * prob + (1e0 - 0.7e0) * eb ELSE 0.35e0 * prob + (1e0 - 0.35e0) * eb END ELSE eb END AS eb, CASE who WHEN 'A' THEN 0.3e0 * prob + 0.7e0 * ea ELSE ea END AS ea)
   FROM (SELECT s.call_id, c.k, c.seq, c.who, s.h || c.h AS h, t + n AS t, ('0x' || substr(md5(right(repeat('0', 2800) || s.h || c.h, 2800)), 1, 4))::INTEGER % 1000 / 1000e0 AS prob, eb, ea, rb, ra
     FROM s JOIN c ON s.call_id = c.call_id AND c.k = s.k + 1)))"""


@query("joined_session_state", f"""{_SESSION}
SELECT call_id, seq, who AS speaker, greatest(t - 700, 0) AS cut_from, t AS cut_to, prob, {r('rb', 9)} AS remote_prob, {r('ra', 9)} AS local_prob FROM s WHERE k > 0""")
def joined_session_state(spark, d):
    """STM-03, STM-12, STM-14: the last mixed seconds of a session, silence before its start included."""
    followed = J.replay_calls(_channels(spark, d), _digest_score, "session", RULES)
    return followed.select("call_id", "seq", "speaker", "cut_from", "cut_to", "prob", rnd("remote_prob", 9).alias("remote_prob"), rnd("local_prob", 9).alias("local_prob"))


@query("joined_session_alerts", f"""{_SESSION}
SELECT call_id, count(*) AS alerts, min(seq) AS first_alert FROM s WHERE k > 0 AND rb >= 0.7 GROUP BY call_id""")
def joined_session_alerts(spark, d):
    """STM-06: rows of sessions whose remote party is at 0.70 or more."""
    alerts = live.J.session_alerts(J.replay_calls(_channels(spark, d), _digest_score, "session", RULES))
    return alerts.groupBy("call_id").agg(F.count("*").alias("alerts"), F.min("seq").alias("first_alert"))


@query("joined_audio_streams", """
SELECT k AS kind, count(*) AS streamed, count(*) AS replayed, 0::BIGINT AS differing FROM conversations, (VALUES ('monitor'), ('session')) t(k) WHERE role <> 'system' AND octet_length(encode(text)) >= 2 GROUP BY k""")
def joined_audio_streams(spark, d):
    """STM-02 .. STM-05, STM-09, STM-13, STM-14: speakers by voice and scores by a model, as a stream of several triggers
    and as a replay; the same rows."""
    model, audio, out = _document_model(spark, d), materialise(_channels(spark, d).drop("speaker"), "audio"), None
    for kind in ("monitor", "session"):
        streamed = live.J.run_once(live.watch_joined(J.table_as_stream(audio, "joined", 4), model, kind, RULES), f"joined-{kind}")
        replayed = live.replay_joined(audio, model, kind, RULES).select(streamed.columns)
        plain = lambda df, side: df.select(*[F.to_json(c).alias(c) if t.startswith("array") else rnd(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).withColumn("side", F.lit(side))
        per = plain(streamed, 1).unionByName(plain(replayed, -1)).groupBy(*streamed.columns).agg(F.sum("side").alias("net"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("s"), F.count("*").alias("n"))
        one = per.agg(F.sum("s").alias("streamed"), F.sum(F.col("n") - F.col("s")).alias("replayed"), F.sum(F.abs("net")).alias("differing")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query("pcm_file_stream", """
WITH c AS (SELECT 'c' || conv_id AS call_id, encode(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS b, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT call_id, (octet_length(b) + 499) // 500 AS chunks, octet_length(b) AS bytes, md5(t) AS digest, true AS limited FROM c WHERE octet_length(b) > 0""")
def pcm_file_stream(spark, d):
    """SRC-14, SRC-11: growing files of PCM as a stream with a limit per trigger, stopped while files grow and started again."""
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("@1700000000000000.pcm"))
    calls = materialise(whole.select(name.alias("name"), F.encode(F.array_join(F.transform("t", lambda x: x["text"]), ""), "utf-8").alias("pcm")), "call-bytes")
    folder, out, checkpoint, most = scratch(spark, "pcm-files"), scratch(spark, "pcm-out"), scratch(spark, "pcm-checkpoint"), 0
    half = calls.withColumn("pcm", F.substring("pcm", F.lit(1), F.expr("octet_length(pcm) div 2")))
    for recorded, done in ((half, False), (calls, True)):
        write_raw(recorded, folder, done)
        query_ = pcm_stream(spark, folder, 500, 2).writeStream.format("parquet").option("checkpointLocation", checkpoint).start(out)
        query_.processAllAvailable()
        most = max([most, *(p["numInputRows"] for p in query_.recentProgress)])
        query_.stop()
    limited = most <= 2 * calls.count()
    read = spark.read.schema("call_id string, seq long, event_ts timestamp, pcm binary").parquet(out)
    per = read.groupBy("call_id").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("pcm")).alias("bytes"), F.array_sort(F.collect_list(F.struct("seq", "pcm"))).alias("c"))
    joined = F.aggregate("c", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["pcm"]))
    return per.select("call_id", "chunks", "bytes", F.md5(joined).alias("digest"), F.lit(limited).alias("limited"))
