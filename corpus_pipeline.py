"""The corpus pipeline: quality rules, near-dedup, decontamination, secrets and packing, each stage a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import decontaminate, packing, quality, secrets, shingles
from earshot.llm.common import frozen, is_listed, own_path, temporary_tables, with_row_ids, write_id_lists
from earshot.session import scratch, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; the others go.

    Null, empty and blank texts fail; null languages and sources are groups of their own; repeated rows are judged alike; an
    empty table stays empty; columns of any names pass through.
    """
    ship_package(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id (of equal ids, the first row).

    Links are pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, computed exactly; candidates
    are the links of the trie join of fingerprints, and what shares a MinHash band. Groups
    whose ids are all null keep one row too; null and blank texts are one group. An empty table stays empty; columns of
    any names pass through. Documents are written once and not moved: the rows to drop are lists of ids beside them.
    """
    ship_package(spark)
    rows = with_row_ids(docs)
    rows = frozen(rows.select("row_id", "doc", shingles.sketch_column(F.col("doc.text"), size=5).alias("sketch")), "near-dedup", "zstd")
    dropped = own_path(spark, "dropped")
    with temporary_tables(spark):
        slim = rows.select("row_id", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "sketch")
        write_id_lists(shingles.repeated_rows(slim, 0.8, size=5), dropped)
    return rows.filter(~is_listed(F.col("row_id"), dropped)).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item.

    Null and empty texts hold none and stay; null items match nothing; repeated rows and ids are judged by their own text; an
    empty table stays empty; columns of any names pass through.
    """
    ship_package(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; ``n_chars`` follows the new text where it changed, if there is one.

    Null texts stay null; repeated rows are redacted alike; an empty table stays empty; columns of any names pass through.
    """
    ship_package(spark)
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), secrets.scan_column(docs["text"]).alias("scan"))
    rows = frozen(rows, "secrets", "zstd")
    spans = secrets.chosen_spans(F.col("scan"), secrets.cuts(rows))
    rows = rows.select("doc", spans.alias("spans")).select("doc", "spans", secrets.redact_column(F.col("doc.text"), F.col("spans")).alias("clean"))
    changed = F.size("spans") > 0
    new = {"text": F.col("clean")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and the sequence that each lies in.

    A null or empty text is one piece with the end id; repeated rows and equal or null ids are separate documents; an empty
    table gives no pieces; other columns are not read.
    """
    ship_package(spark)
    pieces, places = packing.pack(docs, 1024)
    digests = pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(places, ["row_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", best_fit_packing),
]

#: fingerprints, similarities and token ids are beyond SQL: tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written below the shared folder and read again as the next one's input.

    What a stage wrote for itself is removed once its output is written;
    the outputs and the last stage's tables stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
