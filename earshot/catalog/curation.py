"""Curation over `orders` read as a clip manifest: speaker = customer, system = priority, label = status."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import corpus as C
from ..functions.numeric import rnd
from ..operators import curation as K
from ..session import table
from . import query, r

SAMPLES = """
samples AS (SELECT o_orderkey AS audio_id, o_custkey AS speaker_id, o_orderpriority AS system_id, CAST(o_orderstatus <> 'F' AS INTEGER) AS label,
  o_totalprice / 50000e0 AS duration_sec, CASE o_custkey % 4 WHEN 0 THEN 'hindi' WHEN 1 THEN 'tamil' WHEN 2 THEN 'telugu' ELSE 'marathi' END AS language,
  md5(o_orderkey || ':42') AS k FROM orders)"""


def samples(spark, d):
    lang = F.pmod("o_custkey", F.lit(4))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("audio_id"), F.col("o_custkey").alias("speaker_id"), F.col("o_orderpriority").alias("system_id"),
        (F.col("o_orderstatus") != "F").cast("int").alias("label"), (F.col("o_totalprice") / 50000.0).alias("duration_sec"),
        F.when(lang == 0, "hindi").when(lang == 1, "tamil").when(lang == 2, "telugu").otherwise("marathi").alias("language"))


@query("split_stratified", f"""
WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS rn, count(*) OVER (PARTITION BY label) AS n FROM samples)
SELECT audio_id, label, CASE WHEN rn <= floor(n * 0.70e0) THEN 'train' WHEN rn <= floor(n * (0.70e0 + 0.15e0)) THEN 'dev' ELSE 'test' END AS split FROM x""")
def split_stratified(spark, d):
    """CUR-01."""
    return K.stratified_split(samples(spark, d), "audio_id").select("audio_id", "label", "split")


@query("split_unstratified", f"""
WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (ORDER BY k) AS rn, count(*) OVER () AS n FROM samples)
SELECT audio_id, CASE WHEN rn <= floor(n * 0.70e0) THEN 'train' WHEN rn <= floor(n * (0.70e0 + 0.15e0)) THEN 'dev' ELSE 'test' END AS split FROM x""")
def split_unstratified(spark, d):
    """CUR-01 fallback."""
    return K.stratified_split(samples(spark, d), "audio_id", label=None).select("audio_id", "split")


DISJOINT = """
spk AS (SELECT speaker_id, row_number() OVER (ORDER BY md5(speaker_id || ':42')) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT speaker_id FROM samples)),
spl AS (SELECT speaker_id, CASE WHEN rn <= greatest(1, floor(n * 0.70e0)) THEN 'train' WHEN rn <= greatest(1, floor(n * 0.70e0)) + greatest(1, floor(n * 0.15e0)) THEN 'dev' ELSE 'test' END AS split FROM spk),
split_samples AS (SELECT samples.*, split FROM samples JOIN spl USING (speaker_id))"""


@query("split_speaker_disjoint", f"WITH {SAMPLES}, {DISJOINT} SELECT audio_id, speaker_id, split FROM split_samples")
def split_speaker_disjoint(spark, d):
    """CUR-02, JOIN-04."""
    return K.speaker_disjoint_split(samples(spark, d)).select("audio_id", "speaker_id", "split")


@query("split_fixed_counts", f"""
WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM samples)
SELECT audio_id, CASE WHEN rn <= 1400 THEN 'train' WHEN rn <= 1700 THEN 'dev' ELSE 'test' END AS split FROM x""")
def split_fixed_counts(spark, d):
    """CUR-03."""
    return K.fixed_split(samples(spark, d), "audio_id").select("audio_id", "split")


@query("split_stats", f"""
WITH {SAMPLES}, {DISJOINT}, s AS (SELECT split, count(*) AS total, count(CASE WHEN label = 0 THEN 1 END) AS genuine, count(CASE WHEN label = 1 THEN 1 END) AS spoof FROM split_samples GROUP BY 1)
SELECT *, {r('genuine / total * 100', 2)} AS genuine_pct, {r('spoof / total * 100', 2)} AS spoof_pct FROM s""")
def split_stats(spark, d):
    """AGG-01."""
    return K.split_stats(K.speaker_disjoint_split(samples(spark, d)))


LEAK = """
f AS (SELECT speaker_id, max(CAST(split = 'train' AS INTEGER)) AS a, max(CAST(split = 'dev' AS INTEGER)) AS b, max(CAST(split = 'test' AS INTEGER)) AS c FROM split_samples GROUP BY 1),
l AS (SELECT CAST(sum(a * c) AS BIGINT) AS train_test, CAST(sum(a * b) AS BIGINT) AS train_dev, CAST(sum(b * c) AS BIGINT) AS dev_test FROM f)"""
STRAT = """
x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS rn, count(*) OVER (PARTITION BY label) AS n FROM samples),
split_samples AS (SELECT *, CASE WHEN rn <= floor(n * 0.70e0) THEN 'train' WHEN rn <= floor(n * (0.70e0 + 0.15e0)) THEN 'dev' ELSE 'test' END AS split FROM x)"""


@query("leakage_of_stratified_split", f"WITH {SAMPLES}, {STRAT}, {LEAK} SELECT *, train_test + train_dev + dev_test = 0 AS leak_free FROM l")
def leakage_stratified(spark, d):
    """JOIN-06, CUR-09: the label-stratified split leaks speakers."""
    return K.speaker_leakage(K.stratified_split(samples(spark, d), "audio_id"))


@query("leakage_of_disjoint_split", f"WITH {SAMPLES}, {DISJOINT}, {LEAK} SELECT *, train_test + train_dev + dev_test = 0 AS leak_free FROM l")
def leakage_disjoint(spark, d):
    """JOIN-06, CUR-09: the speaker-disjoint split does not."""
    return K.speaker_leakage(K.speaker_disjoint_split(samples(spark, d)))


@query("shared_speakers", f"WITH {SAMPLES}, {STRAT} SELECT speaker_id FROM split_samples WHERE split = 'train' INTERSECT SELECT speaker_id FROM split_samples WHERE split = 'test'")
def shared_speakers(spark, d):
    """SET-04."""
    return K.shared_speakers(K.stratified_split(samples(spark, d), "audio_id"), "train", "test")


def quota_sql(src: str, target: str, remainder: bool = True) -> str:
    """CTEs q1 .. chosen: even quota per system with refill."""
    quota = (f"floor({target} / g) + CASE WHEN row_number() OVER (ORDER BY system_id) <= ({target}) % g THEN 1 ELSE 0 END" if remainder
             else f"greatest(1, floor({target} / g))")
    return f"""
q0 AS (SELECT system_id, count(*) AS n, count(*) OVER () AS g FROM {src} GROUP BY 1),
q1 AS (SELECT *, {quota} AS quota FROM q0),
q2 AS (SELECT s.*, q1.quota, row_number() OVER (PARTITION BY s.system_id ORDER BY k) AS rn FROM {src} s JOIN q1 USING (system_id)),
q3 AS (SELECT *, rn <= quota AS chosen, CASE WHEN rn > quota THEN row_number() OVER (PARTITION BY rn <= quota ORDER BY k) END AS pool_rn FROM q2),
chosen AS (SELECT * FROM q3 WHERE chosen OR pool_rn <= {target} - (SELECT count(*) FROM q2 WHERE rn <= quota))"""


@query("quota_sample", f"WITH {SAMPLES}, spoof AS (SELECT * FROM samples WHERE label = 1 AND (system_id <> '5-LOW' OR audio_id % 17 = 0)), {quota_sql('spoof', '2003')} SELECT audio_id, system_id FROM chosen")
def quota_sample(spark, d):
    """WIN-16, JOIN-07, SET-03: one system is short, so the rest refills it."""
    spoof = samples(spark, d).filter("label = 1 AND (system_id <> '5-LOW' OR audio_id % 17 = 0)")
    return K.quota_with_refill(spoof, "system_id", 2003, "audio_id").select("audio_id", "system_id")


@query("balance_classes", f"""
WITH {SAMPLES}, t AS (SELECT least(count(CASE WHEN label = 0 THEN 1 END), count(CASE WHEN label = 1 THEN 1 END)) AS t FROM samples),
spoof AS (SELECT * FROM samples WHERE label = 1), {quota_sql('spoof', '(SELECT t FROM t)')},
gen AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM samples WHERE label = 0)
SELECT audio_id, label, system_id FROM chosen UNION ALL SELECT audio_id, label, system_id FROM gen WHERE rn <= (SELECT t FROM t)""")
def balance_classes(spark, d):
    """CUR-04."""
    return K.balance_classes(samples(spark, d), "audio_id").select("audio_id", "label", "system_id")


@query("balanced_universe", f"""
WITH {SAMPLES}, spoof AS (SELECT * FROM samples WHERE label = 1), {quota_sql('spoof', '1001', False)},
gen AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM samples WHERE label = 0)
SELECT audio_id, label FROM chosen UNION ALL SELECT audio_id, label FROM gen WHERE rn <= 1000""")
def balanced_universe(spark, d):
    """CUR-05."""
    return K.balanced_universe(samples(spark, d), 2001, "audio_id").select("audio_id", "label")


@query("priority_universe", f"""
WITH {SAMPLES}, m AS (SELECT *, speaker_id % 40 = 0 AS prio FROM samples),
s AS (SELECT label, CASE WHEN label = 0 THEN 3000 ELSE 3001 END AS t, count(CASE WHEN prio THEN 1 END) AS p, count(CASE WHEN NOT prio THEN 1 END) AS o FROM m GROUP BY 1),
s0 AS (SELECT *, least(p, floor(t * 0.8e0)) AS p0 FROM s), s1 AS (SELECT *, least(o, t - p0) AS o0 FROM s0),
s2 AS (SELECT label, CASE WHEN p0 + o0 < t AND p > p0 THEN least(p, t - o0) ELSE p0 END AS pq, CASE WHEN p0 + o0 < t AND p <= p0 THEN least(o, t - p0) ELSE o0 END AS oq FROM s1),
x AS (SELECT m.*, pq, oq, row_number() OVER (PARTITION BY label, prio ORDER BY k) AS rn FROM m JOIN s2 USING (label))
SELECT audio_id, label FROM x WHERE rn <= CASE WHEN prio THEN pq ELSE oq END""")
def priority_universe(spark, d):
    """CUR-06: too few priority rows, so the other side fills up."""
    return K.priority_universe(samples(spark, d), 6001, F.pmod("speaker_id", F.lit(40)) == 0, "audio_id").select("audio_id", "label")


@query("two_source_mix", f"""
WITH {SAMPLES}, n AS (SELECT count(*) AS n FROM samples WHERE label = 0),
sp AS (SELECT *, system_id = '1-URGENT' AS f FROM samples WHERE label = 1),
c AS (SELECT least(count(CASE WHEN f THEN 1 END), (SELECT floor(n / 2) FROM n)) AS a FROM sp),
x AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY k) AS rn FROM sp)
SELECT audio_id, label FROM samples WHERE label = 0 UNION ALL
SELECT audio_id, label FROM x WHERE rn <= CASE WHEN f THEN (SELECT a FROM c) ELSE (SELECT n FROM n) - (SELECT a FROM c) END""")
def two_source_mix(spark, d):
    """CUR-07, SET-02."""
    return K.two_source_mix(samples(spark, d), F.col("system_id") == "1-URGENT", "audio_id").select("audio_id", "label")


@query("noise_plan", f"""
WITH {SAMPLES}, h AS (SELECT audio_id, label, duration_sec / 20e0 AS peak, CAST('0x' || substr(md5(audio_id || ':42:pick'), 1, 8) AS BIGINT) / 4294967296e0 AS a,
  CAST('0x' || substr(md5(audio_id || ':42:amp'), 1, 8) AS BIGINT) / 4294967296e0 AS b FROM samples)
SELECT audio_id, a < 0.35e0 AND label = 0 AS augmented, {r("CASE WHEN a < 0.35e0 AND label = 0 THEN (b * (0.015e0 - 0.003e0) + 0.003e0) * greatest(0.05e0, peak) ELSE 0e0 END", 8)} AS noise_amp FROM h""")
def noise_plan(spark, d):
    """CUR-08."""
    df = samples(spark, d).withColumn("peak", F.col("duration_sec") / 20.0)
    return K.noise_plan(df, "audio_id").select("audio_id", "augmented", rnd("noise_amp", 8).alias("noise_amp"))


@query("random_sample", f"WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM samples) SELECT audio_id FROM x WHERE rn <= 777")
def random_sample(spark, d):
    """SRT-04."""
    return K.take_random(samples(spark, d), 777, "audio_id").select("audio_id")


@query("seeded_shuffle", f"WITH {SAMPLES} SELECT audio_id, speaker_id FROM samples ORDER BY k")
def seeded_shuffle(spark, d):
    """SRT-05."""
    return K.shuffle_rows(samples(spark, d).select("audio_id", "speaker_id"), "audio_id")


@query("head_per_class", f"WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY audio_id) AS rn FROM samples) SELECT audio_id, label FROM x WHERE rn <= 250")
def head_per_class(spark, d):
    """SRT-03."""
    return K.head_per_group(samples(spark, d), ["label"], ["audio_id"], 250).select("audio_id", "label")


@query("clips_per_speaker_limit", f"WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (PARTITION BY language, speaker_id ORDER BY k) AS rn FROM samples) SELECT audio_id, language, speaker_id FROM x WHERE rn <= 3")
def clips_per_speaker_limit(spark, d):
    """SRT-07."""
    return K.head_per_group(samples(spark, d), ["language", "speaker_id"], [K.draw_key("audio_id")], 3).select("audio_id", "language", "speaker_id")


FILES = f"""
files AS (SELECT o_orderkey, o_custkey % 2 AS label, lower('/data/' || o_orderpriority || '/' || ['Hindi', 'TAMIL', 'bengali', 'english', 'kannada'][CAST(o_custkey % 5 AS INTEGER) + 1] || '/' ||
   ['vits', 'freevc24', 'freevc', 'xttsv2', 'other'][CAST(o_orderkey % 5 AS INTEGER) + 1] || '_' || o_orderkey || '.wav') AS low, o_totalprice / 50000e0 AS duration,
   o_totalprice / 50000e0 >= 0.5e0 AND o_orderkey % 50 <> 0 AND o_orderkey % 70 <> 0 AS is_valid FROM orders),
tagged AS (SELECT *, CASE WHEN contains(low, 'hindi') THEN 'hindi' WHEN contains(low, 'tamil') THEN 'tamil' WHEN contains(low, 'telugu') THEN 'telugu' WHEN contains(low, 'bengali') THEN 'bengali' WHEN contains(low, 'kannada') THEN 'kannada' WHEN contains(low, 'marathi') THEN 'marathi' ELSE 'unknown' END AS language,
  CASE WHEN contains(low, 'xttsv2') THEN 'xttsv2' WHEN contains(low, 'vits') THEN 'vits' WHEN contains(low, 'freevc24') THEN 'freevc24' WHEN contains(low, 'freevc') THEN 'freevc' WHEN contains(low, 'yourtts') THEN 'yourtts' ELSE 'unknown' END AS generator FROM files)"""
AUDIT = f"""
audit AS (SELECT label, count(*) AS total_files, count(CASE WHEN is_valid THEN 1 END) AS valid_files, count(CASE WHEN NOT is_valid THEN 1 END) AS corrupted_files,
 {r('coalesce(avg(CASE WHEN is_valid THEN duration END), 0e0)', 2)} AS avg_duration_sec, {r('coalesce(sum(CASE WHEN is_valid THEN duration END), 0e0) / 3600e0', 3)} AS total_duration_hours FROM tagged GROUP BY label)"""


def audio_files(spark, d):
    """Orders read as audio files with header fields."""
    o = table(spark, d, "orders")
    langs = F.array(*[F.lit(x) for x in ("Hindi", "TAMIL", "bengali", "english", "kannada")])
    gens = F.array(*[F.lit(x) for x in ("vits", "freevc24", "freevc", "xttsv2", "other")])
    path = F.concat(F.lit("/data/"), "o_orderpriority", F.lit("/"), F.get(langs, F.pmod("o_custkey", F.lit(5)).cast("int")), F.lit("/"),
                    F.get(gens, F.pmod("o_orderkey", F.lit(5)).cast("int")), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".wav"))
    rate = F.when(F.pmod("o_orderkey", F.lit(50)) == 0, 8000).otherwise(16000)
    channels = F.when(F.pmod("o_orderkey", F.lit(70)) == 0, 2).otherwise(1)
    files = o.select("o_orderkey", F.pmod("o_custkey", F.lit(2)).alias("label"), path.alias("path"), (F.col("o_totalprice") / 50000.0).alias("duration"), rate.alias("rate"), channels.alias("channels"))
    return files.select(
        "*", C.valid_file("duration", "channels", "rate").alias("is_valid"),
        C.first_match("path", C.SPEECH_LANGUAGES, "unknown").alias("language"), C.first_match("path", C.GENERATORS, "unknown").alias("generator"))


@query("corpus_audit", f"WITH {FILES}, {AUDIT} SELECT * FROM audit")
def corpus_audit(spark, d):
    """AGG-04, PRJ-05."""
    return K.corpus_audit(audio_files(spark, d))


@query("corpus_breakdown", f"""
WITH {FILES} SELECT label, 'language' AS kind, language AS name, count(*) AS n FROM tagged WHERE is_valid GROUP BY ALL
UNION ALL SELECT label, 'generator', generator, count(*) FROM tagged WHERE is_valid AND label = 1 GROUP BY ALL""")
def corpus_breakdown(spark, d):
    """AGG-04, PRJ-02."""
    return K.corpus_breakdown(audio_files(spark, d))


@query("corrupted_files", f"WITH {FILES} SELECT o_orderkey, label FROM tagged WHERE NOT is_valid")
def corrupted_files(spark, d):
    """AGG-04: the list of invalid files, as rows."""
    return audio_files(spark, d).filter("NOT is_valid").select("o_orderkey", "label")


@query("balance_verdict", f"""
WITH {FILES}, {AUDIT}, o AS (SELECT CAST(sum(CASE WHEN label = 0 THEN valid_files ELSE 0 END) AS BIGINT) AS genuine, CAST(sum(CASE WHEN label = 1 THEN valid_files ELSE 0 END) AS BIGINT) AS spoof, CAST(sum(corrupted_files) AS BIGINT) AS corrupted FROM audit),
p AS (SELECT *, {r('genuine / (genuine + spoof) * 100', 2)} AS genuine_percentage, {r('spoof / (genuine + spoof) * 100', 2)} AS spoof_percentage FROM o)
SELECT *, abs(genuine_percentage - spoof_percentage) <= 15e0 AS is_balanced, CASE WHEN abs(genuine_percentage - spoof_percentage) <= 15e0 AND corrupted = 0 THEN 'PASSED' ELSE 'WARNING' END AS status FROM p""")
def balance_verdict(spark, d):
    """AGG-05."""
    return K.balance_verdict(K.corpus_audit(audio_files(spark, d)))


for _group in ("language", "split"):
    @query(f"manifest_report_by_{_group}", f"""
    WITH {SAMPLES}, {DISJOINT}, g AS (SELECT {_group}, count(*) AS files, {r('sum(duration_sec) / 3600e0', 4)} AS hours, count(DISTINCT speaker_id) AS speakers FROM split_samples GROUP BY 1)
    SELECT *, {r('files / (SELECT sum(files) FROM g) * 100', 1)} AS pct FROM g""")
    def manifest_report(spark, d, group=_group):
        """AGG-06, SET-05."""
        return K.manifest_report(K.speaker_disjoint_split(samples(spark, d)), group)


@query("system_counts", f"WITH {SAMPLES} SELECT label, system_id, count(*) AS n FROM samples GROUP BY ALL")
def system_counts(spark, d):
    """AGG-23."""
    return samples(spark, d).groupBy("label", "system_id").agg(F.count("*").alias("n"))


@query("merged_corpora", """
WITH a AS (SELECT o_orderkey AS audio_id, 'orders' AS corpus, 0 AS label FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderkey AS audio_id, 'orders' AS corpus, 1 AS label FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT doc_id AS audio_id, source AS corpus, 1 AS label FROM documents)
SELECT corpus, label, count(*) AS clips, CAST(sum(audio_id) AS BIGINT) AS id_sum FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ALL""")
def merged_corpora(spark, d):
    """SET-02: genuine rows and two spoof sources stacked by column name."""
    o = table(spark, d, "orders")
    pick = lambda status, label: o.filter(F.col("o_orderstatus") == status).select(
        F.col("o_orderkey").alias("audio_id"), F.lit("orders").alias("corpus"), F.lit(label).alias("label"))
    docs = table(spark, d, "documents").select(F.lit(1).alias("label"), F.col("source").alias("corpus"), F.col("doc_id").alias("audio_id"))
    merged = pick("F", 0).unionByName(pick("O", 1)).unionByName(docs)
    return merged.groupBy("corpus", "label").agg(F.count("*").alias("clips"), F.sum("audio_id").alias("id_sum"))


@query("distinct_speakers_and_systems", f"WITH {SAMPLES} SELECT DISTINCT language, system_id FROM samples ORDER BY 1, 2")
def distinct_pairs(spark, d):
    """SET-05, SRT-02."""
    return samples(spark, d).select("language", "system_id").distinct().orderBy("language", "system_id")


@query("unchosen_pool", f"WITH {SAMPLES}, x AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM samples) SELECT audio_id FROM x WHERE rn > 777")
def unchosen_pool(spark, d):
    """JOIN-07, SET-03 as an anti join."""
    base = samples(spark, d).select("audio_id")
    return base.join(K.take_random(base, 777, "audio_id"), "audio_id", "left_anti")
