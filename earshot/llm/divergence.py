"""How far the sources of a language differ in their words, from count-level bitmaps.

Terms that enough documents of a language use get numbers. For every group (language, source) and every count, the set
of terms with that count is a bitmap, stored as its non-zero 64-bit words. AND and popcount of two groups' bitmaps give
how many terms have count a in one and b in the other; each such cell is multiplied by the difference of the two smoothed
shares. Cells with a count of zero follow by complement, from the sizes of the bitmaps, so no zero is stored.

Shares are whole numbers: ``1 + floor(scale * (count + smoothing) / (n_group + smoothing * n_terms))``, exact at any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen

_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ENTRIES = 300_000  # (group, term) pairs that a task holds between two outputs, beside the terms of one document
BLOCK_WORDS = 64  # bitmap words of a task's block: 4 096 terms
TILE = 64  # sources of a language that meet in a task: two tiles at most


# ---- counts ------------------------------------------------------------------------------------------------------------


def terms_of(text: str) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, with A-Z in lower case, and of characters beyond ASCII."""
    return text.encode().translate(_SPACE).split()


def _count(batches):
    from collections import Counter

    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (counts, docs) in held.items():
            # a row without a term says that the group exists
            rows = [(None, 0, 0), *((term.decode(), n, docs[term]) for term, n in counts.items())]
            for low in range(0, len(rows), 50_000):
                term, n, d = zip(*rows[low : low + 50_000])
                some = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]
                yield pa.RecordBatch.from_arrays(some, schema=schema)
        held.clear()

    entries = 0
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
            group = held.get((lang, source))
            if group is None:
                group = held[lang, source] = (Counter(), Counter())
            terms = terms_of(text.as_py())
            before = len(group[0])
            group[0].update(terms)
            group[1].update(set(terms))
            entries += len(group[0]) - before
            if entries > _ENTRIES:
                yield from flush()
                entries = 0
    yield from flush()


def count_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Partial counts, written once: lang, source, term, ``n`` occurrences, ``docs`` documents; a null term marks a group."""
    read = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return frozen(read.mapInArrow(_count, "lang string, source string, term string, n long, docs long"), "terms", "zstd")


def kept_terms(counts: DataFrame, least_docs: int = 30) -> DataFrame:
    """Terms in at least ``least_docs`` documents of their language: lang, term, ``id``, ``total``, ``sources`` (source, n).

    Written once. ``id`` is a number of its own for each term; terms of a language with like totals lie together, so few
    counts share a bitmap word.
    """
    # dealt by (lang, term) once: both sums below then need no further exchange; tasks have summed their own rows before
    dealt = counts.filter("term is not null").repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("sources"))
    kept = by_term.filter(F.col("docs") >= least_docs).sortWithinPartitions("lang", F.desc("total"), "term")
    return frozen(kept.select("lang", "term", F.monotonically_increasing_id().alias("id"), "total", "sources"), "kept", "zstd")


def share(count: Column, total: Column, terms: Column, scale: int, smoothing: int) -> Column:
    """``1 + floor(scale * (count + smoothing) / (total + smoothing * terms))`` in whole decimals; 0 without any term."""
    top = F.lit(scale).cast("decimal(12,0)") * (count + smoothing).cast("decimal(20,0)")
    below = (total + F.lit(smoothing) * terms).cast("decimal(20,0)")
    return F.when(below > 0, F.call_function("div", top, below) + 1).otherwise(F.lit(0).cast("long"))


def group_totals(counts: DataFrame, kept: DataFrame, scale: int, smoothing: int) -> DataFrame:
    """A row per group, written once: lang, source, ``sid`` (its number in the language), ``sources``, ``n_terms`` (kept in the language), ``n_group``, ``used``
    (kept terms with a count), ``n_lang``, and ``p0``, the share of a term with count zero."""
    each = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n_group"), F.count(F.lit(1)).alias("used"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_lang"))
    groups = counts.filter("term is null").select("lang", "source").distinct()
    zero = F.lit(0).cast("long")
    joined = groups.join(each, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n_group", "used", "n_terms", "n_lang")])
    # one short row per source of a language
    of_lang = Window.partitionBy("lang")
    numbered = joined.withColumn("sid", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(of_lang))
    return frozen(numbered.withColumn("p0", share(zero, F.col("n_group"), F.col("n_terms"), scale, smoothing)), "groups")


def count_bitmaps(kept: DataFrame, groups: DataFrame, scale: int, smoothing: int) -> DataFrame:
    """The bitmaps, written once: a row per language, group, count and 64 terms of which one or more have that count:
    lang, sid, sources, ``n`` (the count), ``p`` (its share), p0, ``word`` (place of the 64 terms), ``bits``."""
    rows = kept.select("lang", "id", F.explode("sources").alias("s")).select("lang", "id", F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    rows = rows.join(groups, ["lang", "source"])
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    words = rows.groupBy("lang", F.shiftright("id", 6).alias("word"), "sid", "n").agg(
        F.bit_or(bit).alias("bits"), F.first("sources").alias("sources"), F.first("n_group").alias("n_group"), F.first("n_terms").alias("n_terms"), F.first("p0").alias("p0")
    )
    return frozen(words.select("lang", "word", "sid", "n", "bits", "sources", "p0", share(F.col("n"), F.col("n_group"), F.col("n_terms"), scale, smoothing).alias("p")), "bitmaps", "zstd")


# ---- pairs -------------------------------------------------------------------------------------------------------------


def _cells(key, table):
    """Sum over the joint cells of a block, per pair of sources of two tiles: a cell's terms times its correction.

    A cell (a, b) of n terms adds n * (f(a,b) - f(a,0) - f(0,b) + f(0,0)); the other three are added by complement.
    """
    import pyarrow as pa

    lang, _, low, high = (k.as_py() for k in key)
    sid, word, bits, p, p0 = (table[c].to_numpy() for c in ("sid", "word", "bits", "p", "p0"))
    bits = bits.view(np.uint64)  # NumPy counts the bits of a negative number's absolute value
    sums = np.zeros((2 * TILE, 2 * TILE), dtype=np.int64)
    # a source's place: tile `low` first, then tile `high`
    at = np.where(sid // TILE == low, sid - low * TILE, sid - high * TILE + (TILE if high > low else 0))
    order = np.lexsort((at, word))
    at, bits, p, p0 = at[order], bits[order], p[order], p0[order]
    edges = np.flatnonzero(np.diff(word[order], prepend=-1, append=-1))
    for first, last in zip(edges, edges[1:]):
        for begin in range(first, last, 256):
            left, right = slice(begin, min(begin + 256, last)), slice(begin, last)
            shared = np.bitwise_count(bits[left][:, None] & bits[right][None, :])
            pair = at[left][:, None] < at[right][None, :]
            if high > low:
                pair &= (at[left] < TILE)[:, None] & (at[right] >= TILE)[None, :]
            i, j = np.nonzero(pair & (shared > 0))
            pa_, pb, za, zb = p[left][i], p[right][j], p0[left][i], p0[right][j]
            weight = np.abs(pa_ - pb) - np.abs(pa_ - zb) - np.abs(za - pb) + np.abs(za - zb)
            np.add.at(sums, (at[left][i], at[right][j]), shared[i, j].astype(np.int64) * weight)
    i, j = np.nonzero(sums)
    back = lambda k: np.where(k < TILE, k + low * TILE, k - TILE + high * TILE)
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array(back(i), pa.int64()), "b": pa.array(back(j), pa.int64()), "x": pa.array(sums[i, j], pa.int64())})


def pair_sums(bitmaps: DataFrame) -> DataFrame:
    """Joint cells of all pairs of sources: lang, a, b (numbers, a < b) and ``x``.

    A group holds two tiles of sources and a block of words: at most ``2 * TILE * 64 * BLOCK_WORDS`` short rows, however
    many terms or sources there are.
    """
    tile = F.expr(f"sid div {TILE}").cast("long")
    tiles = F.expr(f"(sources - 1) div {TILE}").cast("long")
    rows = bitmaps.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles)))
    rows = rows.select(
        "lang", F.expr(f"word div {BLOCK_WORDS}").alias("block"), F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        F.col("sid").cast("long").alias("sid"), "word", "bits", "p", "p0",
    )
    cells = rows.groupBy("lang", "block", "low", "high").applyInArrow(_cells, "lang string, a long, b long, x long")
    return cells.groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))


def source_pairs(bitmaps: DataFrame, groups: DataFrame) -> DataFrame:
    """For each group and each other source of its language: lang, source, item, ``value``, the summed difference."""
    joint = pair_sums(bitmaps)
    sides = joint.select("lang", F.col("a").alias("g"), F.col("b").alias("q"), F.col("x").alias("v")).unionByName(joint.select("lang", F.col("b").alias("g"), F.col("a").alias("q"), F.col("x").alias("v")))
    own = groups.select("lang", F.col("sid").cast("long").alias("g"), F.col("source"), F.col("used").alias("used_g"), F.col("p0").alias("p0_g"), "n_terms")
    other = groups.select("lang", F.col("sid").cast("long").alias("q"), F.col("source").alias("item"), F.col("used").alias("used_q"), F.col("p0").alias("p0_q"))
    # the report itself has a row per pair of sources of a language
    pairs = own.join(other, "lang").filter("g <> q")
    neither = pairs.select("lang", "g", "q", ((F.col("n_terms") - F.col("used_g") - F.col("used_q")) * F.abs(F.col("p0_g") - F.col("p0_q"))).alias("v"))
    # count a here and zero there, as if no term were shared: the cells above take back what is
    levels = bitmaps.groupBy("lang", F.col("sid").cast("long").alias("g"), "p").agg(F.sum(F.bit_count("bits")).alias("terms"))
    one = levels.join(other.select("lang", "q", "p0_q"), "lang").filter("g <> q").groupBy("lang", "g", "q").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("p0_q"))).alias("v"))
    parts = sides.unionByName(neither).unionByName(one).unionByName(one.select("lang", F.col("q").alias("g"), F.col("g").alias("q"), "v"))
    sums = parts.groupBy("lang", "g", "q").agg(F.sum("v").alias("value"))
    return sums.join(own.select("lang", "g", "source"), ["lang", "g"]).join(other.select("lang", "q", "item"), ["lang", "q"]).select("lang", "source", "item", "value")


def distinct_terms(kept: DataFrame, groups: DataFrame, most: int, scale: int, smoothing: int) -> DataFrame:
    """The ``most`` terms of each group with the largest surplus over their language: lang, source, item, value, rank."""
    rows = kept.select("lang", "term", "total", F.explode("sources").alias("s")).select("lang", "term", "total", F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    rows = rows.join(groups.select("lang", "source", "n_group", "n_terms", "n_lang"), ["lang", "source"])
    over = share(F.col("n"), F.col("n_group"), F.col("n_terms"), scale, smoothing) - share(F.col("total"), F.col("n_lang"), F.col("n_terms"), scale, smoothing)
    rows = rows.select("lang", "source", F.col("term").alias("item"), over.alias("value")).filter("value > 0")
    # the limit on the row number is pushed below the exchange: a task sends `most` rows of a group at most
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def audit_sources(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, smoothing: int = 5, scale: int = 1_000_000_000, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Differences between sources of a language: lang, source, ``part``, item, ``value``, ``rank``.

    Part ``pair``: item is each other source of the language, value the sum over its kept terms of the difference of the
    two shares (0 without kept terms). Part ``term``: item is a kept term that the group uses more than its language
    does, value the surplus, the ``most_terms`` largest. Ranks go by value, then by item in UTF-8 order.

    Null languages, sources and texts are empty strings. Repeated rows count each time. A group without any term, and a
    language with one source (no pairs), is an ordinary case; an empty table gives no rows. Columns other than the three
    are not read. Memory of a task: its hash tables of terms, the terms of the longest document, or one block of bitmaps.
    """
    counts = count_terms(docs, lang, source, text)
    kept = kept_terms(counts, least_docs)
    groups = group_totals(counts, kept, scale, smoothing)
    pairs = source_pairs(count_bitmaps(kept, groups, scale, smoothing), groups)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms = distinct_terms(kept, groups, most_terms, scale, smoothing)
    return ranked.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
