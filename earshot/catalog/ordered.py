"""Windows over `documents` (length as samples), ordered operations over `events` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.tables import register_table_functions
from ..operators import blocks as B
from ..operators import ordered as O
from ..session import table
from . import query, r

CLIPS = "clips AS (SELECT doc_id, n_chars * 40 AS n_samples FROM documents)"


def clips(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 40).alias("n_samples"))


@query("sliding_windows", f"""
WITH {CLIPS}, s AS (SELECT doc_id, n_samples, unnest(CASE WHEN n_samples < 48000 THEN [0::BIGINT] ELSE range(0::BIGINT, n_samples - 48000 + 1, 16000::BIGINT) END) AS start_sample FROM clips)
SELECT doc_id, CAST(start_sample // 16000 AS INTEGER) AS win_idx, start_sample, n_samples < 48000 AS padded FROM s""")
def sliding_windows(spark, d):
    """WIN-01."""
    return O.sliding_windows(clips(spark, d)).select("doc_id", "win_idx", "start_sample", "padded")


@query("sliding_windows_sql", f"""
WITH {CLIPS}, k AS (SELECT doc_id % 10 AS shelf, doc_id, n_samples FROM clips),
s AS (SELECT shelf, doc_id, n_samples, unnest(CASE WHEN n_samples < 48000 THEN [0::BIGINT] ELSE range(0::BIGINT, n_samples - 48000 + 1, 16000::BIGINT) END) AS start_sample FROM k)
SELECT shelf, doc_id, CAST(row_number() OVER (PARTITION BY shelf ORDER BY doc_id, start_sample) - 1 AS INTEGER) AS win_idx, start_sample, n_samples < 48000 AS padded FROM s""")
def sliding_windows_sql(spark, d):
    """WIN-01 as a table function in SQL, windows numbered over the clips of a shelf."""
    register_table_functions(spark)
    clips(spark, d).selectExpr("doc_id % 10 AS shelf", "doc_id", "n_samples").createOrReplaceTempView("shelved_clips")
    return spark.sql("""
        SELECT shelf, doc_id, win_idx, start_sample, padded
        FROM sliding_windows(TABLE(shelved_clips) PARTITION BY (shelf) ORDER BY (doc_id), 'n_samples', 48000, 16000, true)""")


@query("strategic_windows", f"""
WITH {CLIPS}, c AS (SELECT *, n_samples - 48000 AS last, greatest(1, (n_samples - 48000) // 4) AS step FROM clips WHERE n_samples >= 56000),
s AS (SELECT doc_id, step, unnest(range(0::BIGINT, last + 1, step)[1:5]) AS start_sample FROM c)
SELECT doc_id, CAST(start_sample // step AS INTEGER) AS win_idx, start_sample FROM s""")
def strategic_windows(spark, d):
    """WIN-02."""
    return O.strategic_windows(clips(spark, d)).select("doc_id", "win_idx", "start_sample")


SPANS = """
spans AS (SELECT event_id, user_id, s, s + CAST(round(value * 240e0) AS BIGINT) * 1000000 AS e FROM (SELECT *, epoch_us(ts) AS s FROM events)),
padded AS (SELECT user_id, greatest(0, s - 120000000) AS s, e + 120000000 AS e FROM spans),
reach AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM padded),
isl AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 250000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach),
merged AS (SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS s, max(e) AS e, count(*) AS parts FROM isl GROUP BY ALL)"""


def spans(spark, d):
    """Events as activity intervals in microseconds."""
    e = table(spark, d, "events")
    start = F.unix_micros("ts")
    return e.select("event_id", "user_id", start.alias("s"), (start + F.round(F.col("value") * 240.0).cast("bigint") * 1000000).alias("e"))


def day_block(col):
    return F.floor(F.col(col) / F.lit(86400e6))


@query("interval_merge", f"WITH {SPANS} SELECT * FROM merged")
def interval_merge(spark, d):
    """WIN-03, SIG-07 islands."""
    return O.merge_intervals(spans(spark, d), ["user_id"], "s", "e", 120000000, 250000000, day_block("__s"))


@query("interval_split", f"""
WITH {SPANS}, p AS (SELECT user_id, island, e, unnest(range(s, greatest(e, s + 1), 9000000000::BIGINT)) AS f FROM merged)
SELECT user_id, island, f AS s, least(e, f + 9000000000) AS e FROM p WHERE least(e, f + 9000000000) - f >= 1800000000""")
def interval_split(spark, d):
    """WIN-04: pieces of at most 2.5 h, at least half an hour."""
    merged = O.merge_intervals(spans(spark, d), ["user_id"], "s", "e", 120000000, 250000000, day_block("__s"))
    return O.split_intervals(merged, "s", "e", 9000000000, 1800000000).select("user_id", "island", "s", "e")


@query("interval_split_or_whole", """
WITH c AS (SELECT doc_id, n_chars * 40 AS total, n_chars * 40 AS e FROM documents), p AS (SELECT doc_id, e, unnest(range(0::BIGINT, greatest(e, 1), 40000::BIGINT)) AS f FROM c),
k AS (SELECT doc_id, f AS s, least(e, f + 40000) AS e, CAST(f // 40000 AS INTEGER) AS piece FROM p WHERE least(e, f + 40000) - f >= 8000)
SELECT * FROM k UNION ALL SELECT doc_id, 0, total, 0 FROM c WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def interval_split_or_whole(spark, d):
    """WIN-04 with the whole-clip fallback."""
    base = clips(spark, d).select("doc_id", F.lit(0).cast("bigint").alias("s"), F.col("n_samples").alias("e"), F.col("n_samples").alias("total"))
    pieces = O.split_intervals(base, "s", "e", 40000, 8000)
    return O.with_whole_clip(pieces, base, ["doc_id"], "s", "e", "total")


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query("turn_changes", """
WITH t AS (SELECT *, coalesce(CAST(role <> lag(role) OVER w AS INTEGER), 1) AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, changed, CAST(sum(changed) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM t""")
def turn_changes(spark, d):
    """WIN-05."""
    return O.turn_changes(turns(spark, d), ["conv_id"], ["turn"], B.int_block("turn", 512), "role").drop("chars")


@query("turn_counts", """
WITH t AS (SELECT *, coalesce(CAST(role <> lag(role) OVER w AS INTEGER), 1) AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, role, CAST(sum(changed) AS BIGINT) AS turns FROM t GROUP BY ALL""")
def turn_counts(spark, d):
    """WIN-05 counts per speaker."""
    return O.turn_changes(turns(spark, d), ["conv_id"], ["turn"], B.int_block("turn", 512), "role").groupBy("conv_id", "role").agg(F.sum("changed").alias("turns"))


@query("mean_abs_step", f"""
WITH t AS (SELECT user_id, value, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events)
SELECT user_id, {r('avg(step)', 9)} AS mean_step, {r('avg(step) / (avg(value) + 1e-6)', 9)} AS relative_step, {r('avg(CASE WHEN step > 75 THEN 1e0 WHEN step IS NOT NULL THEN 0e0 END)', 9)} AS jump_ratio, count(*) AS n FROM t GROUP BY 1""")
def mean_abs_step(spark, d):
    """WIN-07: jitter, shimmer and pitch-jump form."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    m = O.mean_abs_step(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), "value")
    return m.select("user_id", rnd("mean_step", 9).alias("mean_step"), rnd(F.col("mean_step") / (F.col("mean_value") + 1e-6), 9).alias("relative_step"),
                    rnd("jump_ratio", 9).alias("jump_ratio"), "n")


@query("first_speaker_is_a", """
SELECT conv_id, turn, CASE WHEN role = first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'Speaker A' ELSE 'Speaker B' END AS speaker FROM conversations""")
def first_speaker_is_a(spark, d):
    """WIN-08."""
    return O.first_is_a(turns(spark, d), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "speaker")


@query("running_peak_and_seconds", f"""
SELECT event_id, max(value) OVER w AS peak, {r("sum(CASE WHEN event_type = 'click' THEN value / 100 ELSE 0e0 END) OVER w", 4)} AS seconds_a, {r("sum(CASE WHEN event_type = 'view' THEN value / 100 ELSE 0e0 END) OVER w", 4)} AS seconds_b
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_peak_and_seconds(spark, d):
    """WIN-09, WIN-10."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    sec = lambda kind: F.when(F.col("event_type") == kind, F.col("value") / 100).otherwise(0.0)
    out = B.running(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), peak=("max", "value"), seconds_a=("sum", sec("click")), seconds_b=("sum", sec("view")))
    return out.select("event_id", "peak", rnd("seconds_a", 4).alias("seconds_a"), rnd("seconds_b", 4).alias("seconds_b"))


@query("running_over_one_hot_call", f"""
SELECT event_id, row_number() OVER w AS rn, max(value) OVER w AS peak, lag(value) OVER w AS before
FROM events WINDOW w AS (PARTITION BY CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END ORDER BY ts, event_id)""")
def running_over_one_hot_call(spark, d):
    """Block scans when one call holds a third of all rows."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    e = e.withColumn("call", F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(-1)).otherwise(F.col("user_id")))
    order, block = ["ts", "event_id"], B.time_block("ts", 3600)
    out = B.running(e, ["call"], order, block, rn=("sum", F.lit(1)), peak=("max", "value"))
    return B.lagged(out, ["call"], order, block, before="value").select("event_id", "rn", "peak", "before")


@query("bounded_history", f"""
SELECT event_id, {r('avg(value) OVER w', 9)} AS mean_60, max(value) OVER w AS max_60 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def bounded_history(spark, d):
    """WIN-11."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    out = B.last_rows(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), 60, mean_60=(F.avg, "value"), max_60=(F.max, "value"))
    return out.select("event_id", rnd("mean_60", 9).alias("mean_60"), "max_60")


@query("reevaluation_points", f"""
WITH v AS (SELECT event_id, user_id, ts, CAST(value * 100 AS BIGINT) AS ms, value FROM events),
c AS (SELECT *, sum(ms) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM v)
SELECT event_id, CAST(cum AS BIGINT) AS voiced_ms, cum // 20000 > (cum - ms) // 20000 AS evaluate,
  {r('avg(value) OVER (PARTITION BY user_id ORDER BY cum RANGE BETWEEN 160000 PRECEDING AND CURRENT ROW)', 9)} AS recent_mean FROM c""")
def reevaluation_points(spark, d):
    """WIN-12: a new evaluation per 20 s of voiced time, over the last 160 s of it."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value", F.round(F.col("value") * 100).cast("bigint").alias("ms"))
    out = O.reevaluation_points(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), "ms", 20000.0)
    out = B.last_span(out, ["user_id"], "voiced_total", 160000, recent_mean=(F.avg, "value"))
    return out.select("event_id", F.col("voiced_total").alias("voiced_ms"), "evaluate", rnd("recent_mean", 9).alias("recent_mean"))


@query("suppress_repeats", """
WITH t AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, user_id, event_type FROM t WHERE p IS NULL OR p <> event_type""")
def suppress_repeats(spark, d):
    """WIN-14, STM-10."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    return O.suppress_repeats(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), "event_type").drop("ts")


@query("last_events", """
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 30""")
def last_events(spark, d):
    """WIN-15."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    return O.last_events(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 30).drop("ts")


def ema_sql(start: str, step: str, out: str) -> str:
    """Recursive SQL over rows numbered per user."""
    return f"""
WITH RECURSIVE s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT event_id, user_id, rn, (SELECT {step.replace('X', start)}) AS x FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.user_id, s.rn, {step.replace('X', 'f.x')} FROM s JOIN f ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT event_id, {out} FROM f"""


@query("risk_ema", ema_sql("5e0", "CASE WHEN value / 5 < 30 THEN 0.45e0 * (value / 5) + 0.55e0 * X WHEN value / 5 >= 60 THEN greatest(X, value / 5) ELSE 0.35e0 * (value / 5) + 0.65e0 * X END",
                           f"{r('x', 6)} AS ema_risk"))
def risk_ema(spark, d):
    """WIN-18."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    out = O.risk_ema(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), F.col("value") / 5)
    return out.select("event_id", rnd("ema_risk", 6).alias("ema_risk"))


@query("remote_prob_ema", ema_sql("0.08e0", "CASE WHEN value / 500 > X THEN 0.7e0 * (value / 500) + 0.3e0 * X ELSE 0.35e0 * (value / 500) + 0.65e0 * X END",
                                  f"{r('x', 6)} AS ema_prob, {r('least(0.99e0, greatest(0.01e0, x))', 6)} AS published"))
def remote_prob_ema(spark, d):
    """WIN-19, remote."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    out = O.remote_prob_ema(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), F.col("value") / 500)
    return out.select("event_id", rnd("ema_prob", 6).alias("ema_prob"), rnd("ema_prob_published", 6).alias("published"))


@query("local_prob_ema", ema_sql("0.05e0", "0.3e0 * (value / 500) + 0.7e0 * X", f"{r('least(0.35e0, greatest(0.01e0, x))', 6)} AS published"))
def local_prob_ema(spark, d):
    """WIN-19, local."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    out = O.local_prob_ema(e, ["user_id"], ["ts", "event_id"], B.time_block("ts", 86400), F.col("value") / 500)
    return out.select("event_id", rnd("ema_prob_published", 6).alias("published"))
