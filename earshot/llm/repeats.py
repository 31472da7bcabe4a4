"""Substring dedup by unit hashing: normalise units, group their digests over the whole corpus, keep the first.

Units are lines, cut further after the stops and commas in them, so that a passage is found whatever stands before it in
its line. Neighbouring repeated units form a run; runs of at least ``least_words`` words are removed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, with_row_ids

UNITS = "row_id long, rank long, unit int, start int, size int, words int, d1 long, d2 int"
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?。！？]+(?=\s)|(?=\n)|\Z)")
_CLAUSE = re.compile(r"[^\n]+?(?:[.!?,;:。！？、，；：]+(?=\s)|(?=\n)|\Z)")
_PARAGRAPH = re.compile(r"(?:[^\n]+\n?)+")
_BATCH = 50_000


def units_of(text: str, kind: str = "clause"):
    """(start, end, words, normalised text) of the units of a text; units without a word are left out."""
    pattern = {"line": _LINE, "sentence": _SENTENCE, "clause": _CLAUSE, "paragraph": _PARAGRAPH}[kind]
    for match in pattern.finditer(text):
        words = match.group().lower().split()
        if words:
            yield match.start(), match.end(), len(words), " ".join(words)


def _unit_rows(kind: str):
    def run(batches):
        import pyarrow as pa
        import xxhash

        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        names, held = [c.split()[0] for c in UNITS.split(", ")], []
        for batch in batches:
            for row, rank, text in zip(batch["row_id"].to_pylist(), batch["rank"].to_pylist(), batch["text"]):
                for unit, (start, end, words, plain) in enumerate(units_of(text.as_py() or "", kind)):
                    both = xxhash.xxh3_128_intdigest(plain.encode())
                    held.append((row, rank, unit, start, end - start, words, (both >> 64) - (1 << 63), (both & (1 << 32) - 1) - (1 << 31)))
                if len(held) > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return run


def repeated_spans(docs: DataFrame, row: str = "row_id", rank: str = "doc_id", text: str = "text", kind: str = "clause", least_words: int = 25) -> DataFrame:
    """Spans to remove: row_id, ``rank``, start, end (code points), words, ``kept_rank`` and ``kept_start``.

    ``row`` numbers the rows (see ``with_row_ids``). The occurrence with the smallest (rank, row, start) stays; a null
    rank comes last. A span is a run of units that each occur earlier, of ``least_words`` words or more together;
    ``kept_*`` is the place of its first unit's first occurrence. Units are compared in lower case with white space
    collapsed, by 96 bits of XXH3 (too long for a chance match among 10 ** 12 units). Null, empty and blank texts have no
    units. Repeats within one text count too.
    """
    docs = docs.select(F.col(row).alias("row_id"), F.col(rank).cast("long").alias("rank"), F.col(text).alias("text"))
    units = frozen(docs.mapInArrow(_unit_rows(kind), UNITS), "units", "zstd")
    last = F.coalesce("rank", F.lit((1 << 63) - 1))
    # combined before the exchange: a very frequent unit leaves each task as one row
    first = units.groupBy("d1", "d2").agg(F.min(F.struct(last.alias("rank"), "row_id", "start")).alias("first"), F.count(F.lit(1)).alias("times"))
    first = first.filter("times > 1").select("d1", "d2", "first")
    # this exchange moves every unit, so it carries no more than the runs need
    again = units.drop("rank").join(first, ["d1", "d2"]).filter((F.col("first.row_id") != F.col("row_id")) | (F.col("first.start") != F.col("start")))
    # gaps and islands inside one document
    order = Window.partitionBy("row_id").orderBy("unit")
    runs = again.withColumn("run", F.col("unit") - F.row_number().over(order)).groupBy("row_id", "run").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.sum("words").alias("words"), F.min(F.struct("unit", "first")).getField("first").alias("first")
    )
    runs = runs.filter(F.col("words") >= least_words).join(units.groupBy("row_id").agg(F.max("rank").alias("rank")), "row_id")
    kept = F.when(F.col("first.rank") < (1 << 63) - 1, F.col("first.rank"))
    return runs.select("row_id", "rank", "start", "end", "words", kept.alias("kept_rank"), F.col("first.start").alias("kept_start"))


def _without(text: str, spans: list) -> str:
    at, out = 0, []
    for span in spans:
        out.append(text[at : span["start"]])
        at = span["end"]
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All rows of ``docs`` with ``clean_text`` and ``removed``: the spans taken out, in offsets of the original text.

    Documents without repeats keep their text, null texts stay null, and no row is dropped. Input columns named like
    the two results get ``_in`` at their end.
    """
    from .common import without_clash

    docs = without_clash(docs, ["clean_text", "removed"])
    rows = frozen(with_row_ids(docs), "numbered", "zstd")
    slim = rows.select("row_id", F.col(f"doc.`{key}`").alias("doc_id"), F.col(f"doc.`{text}`").alias("text"))
    # the spans of one text: bounded by the text itself
    spans = repeated_spans(slim, **options).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "words", "kept_rank", "kept_start"))).alias("removed"))

    @F.arrow_udf("string")
    def cut(texts, removed):
        import pyarrow as pa

        return pa.array([t.as_py() if not r.is_valid or not t.is_valid else _without(t.as_py(), r.as_py()) for t, r in zip(texts, removed)], pa.string())

    joined = rows.join(spans, "row_id", "left")
    return joined.select("doc.*", cut(F.col(f"doc.`{text}`"), "removed").alias("clean_text"), "removed")
