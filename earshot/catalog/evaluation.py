"""Metrics over `documents` joined with `labels`, and system benchmarks over `lineitem` and `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import evaluation as E
from ..session import table
from . import query, r

TAU = 0.51
SCORED = """
scored AS (SELECT doc_id, lang, source, quality AS label, (n_chars % 1000) / 1000e0 AS score, 'indic_' || lang || '_' || source AS system_id
  FROM documents JOIN labels USING (doc_id))"""


def scored(spark, d):
    """Documents as scored clips: label from quality, score from the length, slice from lang and source."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "doc_id").select(
        "doc_id", "lang", "source", "label", (F.pmod("n_chars", F.lit(1000)) / 1000.0).alias("score"),
        F.concat_ws("_", F.lit("indic"), "lang", "source").alias("system_id"))


def curve_sql(slices: str = "") -> str:
    """CTEs pts, curve: the ROC with plain windows."""
    part = f"PARTITION BY {slices}" if slices else ""
    sel = f"{slices}, " if slices else ""
    return f"""
pts AS (SELECT {sel}score AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM rows_in GROUP BY {sel}score),
cum AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
   CAST(sum(pos) OVER ({part}) AS BIGINT) AS n_pos, CAST(sum(neg) OVER ({part}) AS BIGINT) AS n_neg
   FROM pts WINDOW w AS ({part} ORDER BY threshold DESC)),
curve AS (SELECT *, CASE WHEN n_pos > 0 AND n_neg > 0 THEN tp / n_pos::DOUBLE END AS tpr, CASE WHEN n_pos > 0 AND n_neg > 0 THEN fp / n_neg::DOUBLE END AS fpr FROM cum)"""


def best_sql(slices: str = "", src: str = "curve") -> str:
    part = f"PARTITION BY {slices}" if slices else ""
    return f"""
best AS (SELECT *, row_number() OVER ({part} ORDER BY abs((1e0 - tpr) - fpr), threshold DESC) AS pick FROM {src})"""


@query("confusion_matrix", f"""
WITH {SCORED} SELECT count(CASE WHEN label = 0 AND score < 0.51e0 THEN 1 END) AS tn, count(CASE WHEN label = 0 AND score >= 0.51e0 THEN 1 END) AS fp,
 count(CASE WHEN label = 1 AND score < 0.51e0 THEN 1 END) AS fn, count(CASE WHEN label = 1 AND score >= 0.51e0 THEN 1 END) AS tp, count(*) AS n FROM scored""")
def confusion_matrix(spark, d):
    """AGG-07."""
    return E.confusion(scored(spark, d), [], F.col("score") >= TAU)


RATES = f"""{r('(tn + tp) / n', 6)} AS accuracy,
 {r('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END', 6)} AS precision, {r('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END', 6)} AS recall,
 {r('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END', 6)} AS f1_score,
 {r('CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0e0 END', 6)} AS false_alarm_rate, {r('CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0e0 END', 6)} AS miss_rate"""


def cells(tau: str = "0.51e0") -> str:
    return f"""count(CASE WHEN label = 0 AND score < {tau} THEN 1 END) AS tn, count(CASE WHEN label = 0 AND score >= {tau} THEN 1 END) AS fp,
 count(CASE WHEN label = 1 AND score < {tau} THEN 1 END) AS fn, count(CASE WHEN label = 1 AND score >= {tau} THEN 1 END) AS tp, count(*) AS n"""


@query("detection_rates", f"WITH {SCORED}, m AS (SELECT {cells()} FROM scored) SELECT tn, fp, fn, tp, n, {RATES} FROM m")
def detection_rates(spark, d):
    """AGG-08."""
    return E.rates(E.confusion(scored(spark, d), [], F.col("score") >= TAU))


@query("roc_curve", f"WITH {SCORED}, rows_in AS (SELECT * FROM scored), {curve_sql()} SELECT threshold, tp, fp, {r('tpr', 6)} AS tpr, {r('fpr', 6)} AS fpr FROM curve")
def roc_curve(spark, d):
    """AGG-09, WIN-13."""
    return E.roc_curve(scored(spark, d)).select("threshold", "tp", "fp", rnd("tpr", 6).alias("tpr"), rnd("fpr", 6).alias("fpr"))


@query("roc_curve_corners", f"""
WITH {SCORED}, rows_in AS (SELECT * FROM scored), {curve_sql()},
k AS (SELECT *, lead(pos) OVER w AS npos, lead(neg) OVER w AS nneg, row_number() OVER w AS i FROM curve WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, tp, fp FROM k WHERE i = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg""")
def roc_curve_corners(spark, d):
    """AGG-09 without collinear points."""
    return E.roc_curve(scored(spark, d), drop_intermediate=True).select("threshold", "tp", "fp")


@query("roc_auc_by_language", f"""
WITH {SCORED}, rows_in AS (SELECT * FROM scored), {curve_sql('lang')}
SELECT lang, {r('sum(neg * (tp - pos / 2e0)) / nullif(max(n_pos)::DOUBLE * max(n_neg)::DOUBLE, 0)', 6)} AS roc_auc FROM curve GROUP BY lang""")
def roc_auc_by_language(spark, d):
    """AGG-10."""
    return E.roc_auc(E.roc_curve(scored(spark, d), ["lang"]), ["lang"])


@query("equal_error_rate", f"""
WITH {SCORED}, rows_in AS (SELECT * FROM scored), {curve_sql()}, {best_sql()}
SELECT {r('(fpr + (1e0 - tpr)) / 2e0', 6)} AS eer, threshold AS eer_threshold, true AS both_classes FROM best WHERE pick = 1""")
def equal_error_rate(spark, d):
    """AGG-11, SRT-06."""
    return E.equal_error_rate(E.roc_curve(scored(spark, d)))


SLICED = f"""
WITH {SCORED},
rows_in AS (
  SELECT 'overall' AS kind, 'all' AS slice, label, score FROM scored
  UNION ALL SELECT 'language', lang, label, score FROM scored WHERE lang IN ('en', 'fr', 'de', 'es')
  UNION ALL SELECT 'generator', g, label, score FROM scored, (VALUES ('src1'), ('src2'), ('src3'), ('src7')) t(g) WHERE contains(system_id, g)),
m AS (SELECT kind, slice, {cells()} FROM rows_in GROUP BY kind, slice),
{curve_sql('kind, slice')}, {best_sql('kind, slice')},
auc AS (SELECT kind, slice, {r('sum(neg * (tp - pos / 2e0)) / nullif(max(n_pos)::DOUBLE * max(n_neg)::DOUBLE, 0)', 6)} AS roc_auc FROM curve GROUP BY kind, slice)
SELECT m.kind, m.slice, m.tn, m.fp, m.fn, m.tp, m.n, {RATES.replace('tn', 'm.tn').replace('tp', 'm.tp').replace('fp', 'm.fp').replace('fn', 'm.fn')}, auc.roc_auc,
  CASE WHEN n_pos * n_neg > 0 THEN {r('(fpr + (1e0 - tpr)) / 2e0', 6)} END AS eer, CASE WHEN n_pos * n_neg > 0 THEN threshold END AS eer_threshold, n_pos * n_neg > 0 AS both_classes
FROM m JOIN best ON pick = 1 AND m.kind = best.kind AND m.slice = best.slice JOIN auc ON auc.kind = m.kind AND auc.slice = m.slice WHERE m.n >= 5"""


@query("sliced_metrics", SLICED)
def sliced_metrics(spark, d):
    """AGG-12: overlapping slices by language and by generator substring."""
    rules = {
        "language": {x: F.col("lang") == x for x in ("en", "fr", "de", "es")},
        "generator": {g: F.col("system_id").contains(g) for g in ("src1", "src2", "src3", "src7")},
    }
    return E.sliced_metrics(E.slice_rows(scored(spark, d), rules), ["kind", "slice"], TAU)


@query("subset_metrics", f"""
WITH {SCORED}, rows_in AS (SELECT * FROM scored WHERE contains(system_id, '_en_')), m AS (SELECT {cells()} FROM rows_in), {curve_sql()},
auc AS (SELECT {r('sum(neg * (tp - pos / 2e0)) / nullif(max(n_pos)::DOUBLE * max(n_neg)::DOUBLE, 0)', 6)} AS roc_auc FROM curve)
SELECT n, {r('(tn + tp) / n', 6)} AS accuracy, roc_auc FROM m, auc WHERE n > 10""")
def subset_metrics(spark, d):
    """AGG-16: one subset, only above ten rows."""
    rows = scored(spark, d).filter(F.col("system_id").contains("_en_")).withColumn("scope", F.lit("subset"))
    return E.sliced_metrics(rows, ["scope"], TAU, min_rows=11).select("n", "accuracy", "roc_auc")


@query("score_histogram", f"WITH {SCORED} SELECT label, CAST(least(floor(score * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY ALL".replace("SELECT label", "SELECT CAST(label AS INTEGER) AS label"))
def score_histogram(spark, d):
    """AGG-24."""
    return E.score_histogram(scored(spark, d))


@query("calibrate_on_dev", f"""
WITH {SCORED}, rows_in AS (SELECT * FROM scored WHERE doc_id % 2 = 0), test AS (SELECT * FROM scored WHERE doc_id % 2 = 1), {curve_sql()}, {best_sql()},
tau AS (SELECT threshold AS eer_threshold, {r('(fpr + (1e0 - tpr)) / 2e0', 6)} AS dev_eer FROM best WHERE pick = 1),
m AS (SELECT eer_threshold, dev_eer, {cells('eer_threshold')} FROM test, tau GROUP BY ALL)
SELECT eer_threshold, dev_eer, tn, fp, fn, tp, n, {RATES} FROM m""")
def calibrate_on_dev(spark, d):
    """ML-07: even documents calibrate, odd documents test."""
    rows = scored(spark, d)
    return E.calibrate_and_apply(rows.filter(F.pmod("doc_id", F.lit(2)) == 0), rows.filter(F.pmod("doc_id", F.lit(2)) == 1))


SYSTEMS = """
sys_in AS (SELECT CASE WHEN p_size % 16 < 13 THEN 'A' || lpad(CAST(p_size % 16 + 7 AS VARCHAR), 2, '0') WHEN p_size % 16 = 13 THEN 'nat'
   WHEN p_size % 16 = 14 THEN 'librispeech_human' ELSE 'X' || p_size END AS system_id,
   CAST(l_returnflag = 'R' AS INTEGER) AS label, (CAST(l_extendedprice * 100 AS BIGINT) % 1000) / 1000e0 AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def system_scores(spark, d):
    """Line items as scored clips of a generator derived from the part size."""
    part = table(spark, d, "part").select("p_partkey", F.pmod("p_size", F.lit(16)).alias("m"), "p_size")
    system = (
        F.when(F.col("m") < 13, F.format_string("A%02d", F.col("m") + 7)).when(F.col("m") == 13, "nat")
        .when(F.col("m") == 14, "librispeech_human").otherwise(F.concat(F.lit("X"), F.col("p_size").cast("string"))))
    part = part.select("p_partkey", system.alias("system_id"))
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.pmod(F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.lit(1000)) / 1000.0).alias("score"))
    return li.join(part, "p_partkey")


PROFILES = ", ".join(str(p) for p in E.GENERATOR_PROFILES)
BENCH = f"""
WITH {SYSTEMS}, prof AS (SELECT * FROM (VALUES {PROFILES}) t(system_id, system_type, acoustic, vocoder, split_kind)),
g AS (SELECT system_id, count(*) AS samples, avg(score) AS mean_prob, count(CASE WHEN score >= 0.4652e0 THEN 1 END) AS flagged FROM sys_in GROUP BY 1),
b AS (SELECT g.*, coalesce(system_type, 'Unknown') AS system_type, coalesce(split_kind, 'Unknown') AS split_kind, coalesce(vocoder, 'N/A') AS vocoder,
  CASE WHEN system_type = 'Human' THEN samples - flagged ELSE flagged END AS correct FROM g LEFT JOIN prof USING (system_id))"""


@query("system_benchmark", f"{BENCH} SELECT system_id, system_type, split_kind, vocoder, samples, {r('mean_prob', 4)} AS mean_prob, correct, {r('(samples - correct) / samples', 6)} AS error_rate FROM b")
def system_benchmark(spark, d):
    """AGG-13, JOIN-05, SRT-02 (report order)."""
    return E.system_benchmark(system_scores(spark, d), 0.4652).select(
        "system_id", "system_type", "split_kind", "vocoder", "samples", rnd("mean_prob", 4).alias("mean_prob"), "correct", rnd("error_rate", 6).alias("error_rate")
    ).orderBy("system_id")


@query("generalisation_gap", f"""{BENCH}, s AS (SELECT
  sum(CASE WHEN system_type = 'Human' THEN correct END) / sum(CASE WHEN system_type = 'Human' THEN samples END)::DOUBLE * 100 AS h,
  sum(CASE WHEN system_type <> 'Human' AND split_kind = 'Known' THEN correct END) / sum(CASE WHEN system_type <> 'Human' AND split_kind = 'Known' THEN samples END)::DOUBLE * 100 AS k,
  sum(CASE WHEN system_type <> 'Human' AND split_kind <> 'Known' THEN correct END) / sum(CASE WHEN system_type <> 'Human' AND split_kind <> 'Known' THEN samples END)::DOUBLE * 100 AS u FROM b)
SELECT {r('h', 2)} AS genuine_accuracy, {r('100e0 - h', 2)} AS genuine_far, {r('k', 2)} AS known_detected_pct, {r('u', 2)} AS unseen_detected_pct, {r('abs(k - u)', 2)} AS generalization_gap_pct FROM s""")
def generalisation_gap(spark, d):
    """AGG-14."""
    return E.generalisation(E.system_benchmark(system_scores(spark, d), 0.4652))


@query("single_system_detection", f"WITH {SYSTEMS} SELECT count(*) AS samples, {r('avg(CASE WHEN score >= 0.4652e0 THEN 1e0 ELSE 0e0 END)', 6)} AS detection_rate, {r('avg(score)', 4)} AS mean_prob FROM sys_in WHERE system_id = 'A19'")
def single_system_detection(spark, d):
    """AGG-15."""
    one = system_scores(spark, d).filter("system_id = 'A19'")
    return one.agg(F.count("*").alias("samples"), rnd(F.avg(F.when(F.col("score") >= 0.4652, 1.0).otherwise(0.0)), 6).alias("detection_rate"),
                   rnd(F.avg("score"), 4).alias("mean_prob"))
