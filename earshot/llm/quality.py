"""Quality rules whose limits follow the data: per language and source, from mergeable quantile sketches.

A sketch counts values in bins whose bounds grow by two per cent, so it merges by adding counts and is accurate to one
per cent. Limits stand well outside the quartiles of a document's own language and source; groups of few documents
take those of their language, and small languages those of all. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, with_row_ids

SPACES = " \t\n\x0b\f\r"
GROWTH = 1.02
LEAST_DOCS = 100  # a group needs so many documents for limits of its own
REACH = 4.0  # interquartile ranges beyond the quartiles
FEW_GROUPS = 50_000  # groups, beyond which their limits are joined by a shuffle
# what a measure may always exceed its quartile by (one repeated line in a short text is no fault), and whether it is
# also limited from below
MEASURES = {"word_length": (2.0, True), "symbol_rate": (0.15, False), "dup_line_rate": (0.5, False), "repeat_rate": (0.35, False)}
_PLACE_BITS = 28
_LOW = (1 << _PLACE_BITS) - 1


def measure(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with word, symbol and line counts of ``text``; a null text has none.

    ``n_repeat_words``: words that lie in a three-word window found twice or more in the text. Windows are compared
    by 64-bit hashes: sorted with their places packed below, neighbours that agree are looked up in full.
    """
    plain = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(plain, F.lit(SPACES))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(plain, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(*keep, words.alias("words"), lines.alias("lines"), F.regexp_count(plain, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    windows = F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    counted = first.select(
        *keep, "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    carried = [*keep, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    packed = F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
    sorted_ = counted.select(*carried, "windows", packed.alias("packed"))

    def agrees(array: str, at: Column, step: int) -> Column:
        return F.get(array, at).bitwiseXOR(F.get(array, at + step)).bitwiseAND(F.lit(~_LOW)) == 0

    near = F.filter("packed", lambda p, i: F.coalesce(agrees("packed", i, -1), F.lit(False)) | F.coalesce(agrees("packed", i, 1), F.lit(False)))
    near = sorted_.select(*carried, "windows", near.alias("near"))

    def same(at: Column, step: int) -> Column:
        own, other = (F.get("windows", F.get("near", k).bitwiseAND(F.lit(_LOW)).cast("int")) for k in (at, at + step))
        return F.coalesce(own == other, F.lit(False))

    twice = F.filter("near", lambda p, i: same(i, -1) | same(i, 1) | same(i, -2) | same(i, 2))
    places = near.select(*carried, F.sort_array(F.transform(twice, lambda p: p.bitwiseAND(F.lit(_LOW)))).alias("places"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("covered"))
    step = lambda s, p: F.struct((p + 3).alias("end"), (s["covered"] + p + 3 - F.greatest(p, s["end"])).alias("covered"))
    return places.select(*carried, F.aggregate("places", zero, step, lambda s: s["covered"]).alias("n_repeat_words"))


def with_rates(measured: DataFrame) -> DataFrame:
    """Add the measures that have limits, null without words, and ``base_failed``."""
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words"))
    return measured.withColumns({
        "word_length": per_word("word_chars"),
        "symbol_rate": per_word("n_symbols"),
        "dup_line_rate": F.when(F.col("n_words") > 0, F.col("n_dup_lines") / F.col("n_lines")),
        "repeat_rate": per_word("n_repeat_words"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def group_keys(lang: Column, source: Column) -> list[Column]:
    """Group names that are never null: a null language or source is a group of its own."""
    return [F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("")).alias("lang_key"), F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("source_key")]


def sketches(rated: DataFrame) -> DataFrame:
    """Sketch per group and measure: lang_key, source_key, measure, bin, n. Merged upwards: ``*`` stands for all.

    Values are counted within each task before the exchange, so hot groups send a few hundred rows per task.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    bin_ = F.when(F.col("v.value") > 0, F.ceil(F.round(F.ln("v.value") / F.log(F.lit(GROWTH)), 6)).cast("int")).otherwise(F.lit(-(1 << 30)))
    fine = rated.filter("n_words > 0").select("lang_key", "source_key", values.alias("v")).groupBy("lang_key", "source_key", F.col("v.measure").alias("measure"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    fine = frozen(fine, "sketches")
    lang = fine.groupBy("lang_key", "measure", "bin").agg(F.sum("n").alias("n")).select("lang_key", F.lit("*").alias("source_key"), "measure", "bin", "n")
    every = lang.groupBy("measure", "bin").agg(F.sum("n").alias("n")).select(F.lit("*").alias("lang_key"), F.lit("*").alias("source_key"), "measure", "bin", "n")
    return fine.unionByName(lang).unionByName(every)


def limits(sketch: DataFrame) -> DataFrame:
    """A row per language and source: the lowest and highest accepted value of each measure."""
    by = ["lang_key", "source_key", "measure"]
    # bins of one sketch: some hundreds
    order = Window.partitionBy(*by).orderBy("bin")
    value = F.when(F.col("bin") > -(1 << 30), 2 * F.pow(F.lit(GROWTH), F.col("bin")) / (1 + GROWTH)).otherwise(0.0)
    ranked = sketch.select(*by, "n", value.alias("value"), F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("docs"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("docs"), F.col("value")))
    quartiles = ranked.groupBy(*by).agg(F.first("docs").alias("docs"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    slack = F.create_map(*[F.lit(x) for m, (s, _) in MEASURES.items() for x in (m, s)])[F.col("measure")]
    below = F.col("measure").isin([m for m, (_, b) in MEASURES.items() if b])
    reach = F.greatest(REACH * (F.col("q3") - F.col("q1")), slack)
    fences = quartiles.groupBy("lang_key", "source_key").agg(
        F.max("docs").alias("docs"), *[F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"{m}_high") for m in MEASURES],
        *[F.max(F.when((F.col("measure") == m) & below, F.col("q1") - reach)).alias(f"{m}_low") for m, (_, b) in MEASURES.items() if b],
    )
    fences = frozen(fences, "limits")
    names = [c for c in fences.columns if c not in ("lang_key", "source_key", "docs")]
    as_ = lambda df, tag: df.select(*[F.col(c) for c in df.columns if c in ("lang_key", "source_key")], F.struct("docs", *names).alias(tag))
    own = as_(fences.filter("source_key != '*'"), "own")
    lang = as_(fences.filter("source_key = '*' AND lang_key != '*'").drop("source_key"), "lang")
    # a single row: a scalar, not a join
    every = fences.filter("lang_key = '*'").select(F.struct("docs", *names)).scalar()
    levels = own.join(lang, "lang_key").withColumn("every", every)
    pick = F.when(F.col("own.docs") >= LEAST_DOCS, F.col("own")).when(F.col("lang.docs") >= LEAST_DOCS, F.col("lang")).otherwise(F.col("every"))
    return levels.select("lang_key", "source_key", pick.alias("limit")).select("lang_key", "source_key", "limit.*").drop("docs")


def judge(rated: DataFrame) -> DataFrame:
    """``rated`` (frozen: it is read twice) with ``kept``: not ``base_failed`` and every measure within its limits."""
    table = frozen(limits(sketches(rated)), "limits")
    table = table.withColumnsRenamed({"lang_key": "limit_lang", "source_key": "limit_source"})
    if table.count() <= FEW_GROUPS:  # under 200 bytes each
        table = F.broadcast(table)
    joined = rated.join(table, (rated["lang_key"] == table["limit_lang"]) & (rated["source_key"] == table["limit_source"]), "left")
    within = F.lit(True)
    for name, (_, below) in MEASURES.items():
        within = within & (F.col(name) <= F.col(f"{name}_high"))
        if below:
            within = within & (F.col(name) >= F.col(f"{name}_low"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def rate_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row per document: key, its counts and measures, ``base_failed`` and ``kept``.

    A null, empty or blank text has no words and fails; a null language or source is a group of its own; repeated rows
    are judged alike; an empty table gives no rows; extra columns are not read.
    """
    slim = docs.select(F.col(f"`{key}`").alias("doc_id"), *group_keys(F.col(f"`{lang}`"), F.col(f"`{source}`")), F.col(f"`{text}`").alias("text"))
    rated = frozen(with_rates(measure(slim, F.col("text"), ["doc_id", "lang_key", "source_key"])), "rated")
    return judge(rated)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``rate_documents`` keeps, with their columns as they were."""
    rows = with_row_ids(docs).select("doc", *group_keys(F.col(f"doc.`{lang}`"), F.col(f"doc.`{source}`")))
    rated = frozen(with_rates(measure(rows, F.col(f"doc.`{text}`"), ["doc", "lang_key", "source_key"])), "rated", "zstd")
    return judge(rated).filter("kept").select("doc.*")
