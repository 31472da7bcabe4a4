"""Sampling, splitting and balancing of corpora (CUR-*, WIN-16, SRT-03 .. SRT-07, JOIN-04/06/07).

Random choices are hash order: every row has a draw key, the md5 of its id and a seed, and "n random
rows of a group" means "the n smallest draw keys". Instead of ranking all rows, ``hash_cuts`` finds
the draw key at a wanted rank: rows are counted per (group, key prefix), and only the one prefix that
holds the rank is ranked. Wide rows are then filtered by comparing keys. Nothing large is sorted, a
hot group costs no more than any other, and the same ids give the same draw on every run.

Ids must be unique in the table they are drawn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, ratio, rnd
from .joins import match

KEY, SCOPE = "__draw", "__scope"
ALL_ROWS, NO_ROWS = "z", ""  # above and below every hex digest


def draw_key(ident, seed=42) -> Column:
    return F.md5(F.concat_ws(":", as_col(ident).cast("string"), F.lit(str(seed))))


def hash_fraction(hex_key) -> Column:
    """Uniform number in [0, 1) from the first 8 hex digits of a draw key."""
    return F.conv(F.substring(as_col(hex_key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def key_histogram(keyed: DataFrame, strata: list[str], key: str = KEY, digits: int = 4) -> DataFrame:
    """Rows per (stratum, key prefix): all that sizes, quotas and cuts need. Combined map-side."""
    return keyed.groupBy(*strata, F.substring(key, 1, digits).alias("prefix")).agg(F.count("*").alias("n"))


def hash_cuts(df: DataFrame, strata: list[str], key: str, wanted: DataFrame, hist: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """Draw key at each wanted rank. ``wanted`` has strata, ``cut`` and 1-based ``rank``.

    Returns strata, cut, cut_key with: row is among the first ``rank`` of its stratum exactly when its
    key <= cut_key. Pass the histogram when ``wanted`` was derived from it, so it is computed once.
    """
    hist = key_histogram(df, strata, key, digits) if hist is None else hist
    earlier = Window.partitionBy(*strata).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    spans = hist.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    hit = match(spans, wanted, strata).filter((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
    hit = hit.select(*strata, "prefix", "cut", (F.col("rank") - F.col("before")).alias("local_rank"))
    inside = Window.partitionBy(*strata, "prefix", "cut").orderBy("k")
    slim = df.select(*strata, F.col(key).alias("k"), F.substring(key, 1, digits).alias("prefix"))
    found = match(slim, hit, [*strata, "prefix"]).withColumn("rn", F.row_number().over(inside)).filter("rn = local_rank")
    full = match(wanted, found.select(*strata, "cut", "k"), [*strata, "cut"], "left")
    cut_key = F.when(F.col("rank") <= 0, F.lit(NO_ROWS)).otherwise(F.coalesce(F.col("k"), F.lit(ALL_ROWS)))
    return full.select(*strata, "cut", cut_key.alias("cut_key"))


def _sizes(hist: DataFrame, strata: list[str]) -> DataFrame:
    return hist.groupBy(*strata).agg(F.sum("n").alias("size"))


def _scoped(df: DataFrame, ident, seed) -> DataFrame:
    return df.withColumn(KEY, draw_key(ident, seed)).withColumn(SCOPE, F.lit("all"))


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(KEY, SCOPE)


def take_quota(df: DataFrame, strata: list[str], quotas: DataFrame, ident, seed=42) -> DataFrame:
    """Up to ``quota`` random rows per stratum; rows of strata without a quota are left out."""
    keyed = df.withColumn(KEY, draw_key(ident, seed))
    wanted = quotas.select(*strata, F.lit("q").alias("cut"), F.col("quota").alias("rank"))
    cuts = hash_cuts(keyed, strata, KEY, wanted).select(*strata, "cut_key")
    return match(keyed, cuts, strata).filter(F.col(KEY) <= F.col("cut_key")).drop(KEY, "cut_key")


def take_random(df: DataFrame, n, ident, seed=42) -> DataFrame:
    """SRT-04: ``n`` random rows without replacement; ``n`` is a number or a scalar subquery."""
    keyed = _scoped(df, ident, seed)
    hist = key_histogram(keyed, [SCOPE])
    wanted = _sizes(hist, [SCOPE]).select(SCOPE, F.lit("q").alias("cut")).withColumn("rank", as_col(n))
    cut = hash_cuts(keyed, [SCOPE], KEY, wanted, hist).select("cut_key").scalar()
    return _clean(keyed.filter(F.col(KEY) <= F.coalesce(cut, F.lit(NO_ROWS))))


def shuffle_rows(df: DataFrame, ident, seed=42) -> DataFrame:
    """SRT-05: rows in draw-key order (a distributed range sort)."""
    return df.withColumn(KEY, draw_key(ident, seed)).orderBy(KEY).drop(KEY)


def head_per_group(df: DataFrame, groups: list[str], order: list, n: int) -> DataFrame:
    """SRT-03 / SRT-07: first ``n`` rows per group. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def _two_cuts(keyed, strata, first, second) -> DataFrame:
    """Join two cut keys per stratum; ``first``/``second`` map the stratum size to ranks."""
    hist = key_histogram(keyed, strata)
    sizes = _sizes(hist, strata)
    pair = F.array(F.struct(F.lit("a").alias("cut"), first.alias("rank")), F.struct(F.lit("b").alias("cut"), second.alias("rank")))
    wanted = sizes.select(*strata, F.explode(pair).alias("c")).select(*strata, "c.cut", "c.rank")
    cuts = hash_cuts(keyed, strata, KEY, wanted, hist)
    return cuts.groupBy(*strata).agg(
        F.max(F.when(F.col("cut") == "a", F.col("cut_key"))).alias("cut_a"), F.max(F.when(F.col("cut") == "b", F.col("cut_key"))).alias("cut_b"))


def _name_split(key=KEY) -> Column:
    return F.when(F.col(key) <= F.col("cut_a"), "train").when(F.col(key) <= F.col("cut_b"), "dev").otherwise("test")


def stratified_split(df: DataFrame, ident, label: str | None = "label", train=0.70, dev=0.15, seed=42) -> DataFrame:
    """CUR-01: adds ``split``; each label is cut at the same shares (``label=None``: one common cut).

    The cuts, one row per label, go to the clips: a join that deals clips by label puts half of them into one task.
    """
    keyed = _scoped(df, ident, seed)
    strata = [label] if label else [SCOPE]
    cuts = _two_cuts(keyed, strata, F.floor(F.col("size") * train), F.floor(F.col("size") * (train + dev)))
    return _clean(match(keyed, F.broadcast(cuts), strata).withColumn("split", _name_split()).drop("cut_a", "cut_b"))


def fixed_split(df: DataFrame, ident, train: int = 1400, dev: int = 300, seed=42) -> DataFrame:
    """CUR-03: the first ``train`` and the next ``dev`` rows of the draw, the rest is test."""
    keyed = _scoped(df, ident, seed)
    cuts = _two_cuts(keyed, [SCOPE], F.lit(train), F.lit(train + dev))
    return _clean(keyed.join(F.broadcast(cuts), [SCOPE]).withColumn("split", _name_split()).drop("cut_a", "cut_b"))


def speaker_disjoint_split(df: DataFrame, speaker: str = "speaker_id", train=0.70, dev=0.15, seed=42) -> DataFrame:
    """CUR-02 / JOIN-04: whole speakers go to one split; train and dev get at least one speaker.

    Only distinct speakers are ranked; clips compare their speaker's draw key with two scalars, so a
    speaker with very many clips is never gathered anywhere.
    """
    speakers = _scoped(df.select(speaker).distinct(), speaker, seed)
    n_train = F.greatest(F.lit(1), F.floor(F.col("size") * train))
    n_dev = F.greatest(F.lit(1), F.floor(F.col("size") * dev))
    cuts = _two_cuts(speakers, [SCOPE], n_train, n_train + n_dev).select(F.struct("cut_a", "cut_b"))
    keyed = df.withColumn(KEY, draw_key(speaker, seed)).withColumn("__cuts", cuts.scalar()).select("*", "__cuts.*").drop("__cuts")
    return keyed.withColumn("split", _name_split()).drop(KEY, "cut_a", "cut_b")


def _even_quota(counts: DataFrame, group: str, target: Column, remainder: bool, scope: list[str] = ()) -> DataFrame:
    """Even share per group; ``remainder`` hands the rest to the first groups by name."""
    w = Window.partitionBy(*scope)
    groups = F.count("*").over(w)
    share = F.floor(target / groups)
    if remainder:
        place = F.row_number().over(w.orderBy(group))
        quota = share + F.when(place <= F.pmod(target, groups), 1).otherwise(0)
    else:
        quota = F.greatest(F.lit(1), share)
    return counts.withColumn("quota", quota)


def quota_with_refill(df: DataFrame, group: str, target, ident, seed=42, remainder=True) -> DataFrame:
    """WIN-16: even quota per group, any shortfall refilled from the rows not yet chosen (JOIN-07, SET-03).

    ``target`` is a number or a scalar subquery.
    """
    keyed = _scoped(df, ident, seed)
    target = as_col(target).cast("bigint")
    hist = key_histogram(keyed, [group])
    counts = _sizes(hist, [group]).select(F.lit("all").alias(SCOPE), group, F.col("size").alias("n")).withColumn("target", target)
    quotas = _even_quota(counts, group, F.col("target"), remainder, [SCOPE])
    cuts = hash_cuts(keyed, [group], KEY, quotas.select(group, F.lit("q").alias("cut"), F.col("quota").alias("rank")), hist)
    marked = match(keyed, cuts.select(group, "cut_key"), [group]).withColumn("chosen", F.col(KEY) <= F.col("cut_key"))
    taken = F.sum(F.least("n", "quota"))
    missing = quotas.groupBy(SCOPE).agg((F.max("target") - taken).alias("rank")).select(SCOPE, F.lit("r").alias("cut"), "rank")
    pool_cut = hash_cuts(marked.filter(~F.col("chosen")), [SCOPE], KEY, missing).select("cut_key").scalar()
    refill = ~F.col("chosen") & (F.col(KEY) <= F.coalesce(pool_cut, F.lit(NO_ROWS)))
    return _clean(marked.filter(F.col("chosen") | refill).drop("cut_key", "chosen"))


def balance_classes(df: DataFrame, ident, label="label", system="system_id", seed=42) -> DataFrame:
    """CUR-04: equal class sizes; the spoof side spread evenly over systems, then refilled."""
    genuine, spoof = df.filter(F.col(label) == 0), df.filter(F.col(label) == 1)
    sizes = df.agg(F.least(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)), F.sum(F.when(F.col(label) == 1, 1).otherwise(0))).cast("bigint").alias("t"))
    target = sizes.scalar()
    return take_random(genuine, target, ident, seed).unionByName(quota_with_refill(spoof, system, target, ident, seed))


def balanced_universe(df: DataFrame, size: int, ident, label="label", system="system_id", seed=42) -> DataFrame:
    """CUR-05: half of ``size`` per class; spoof even per system (at least one each), then refilled."""
    half = size // 2
    genuine = take_random(df.filter(F.col(label) == 0), half, ident, seed)
    spoof = quota_with_refill(df.filter(F.col(label) == 1), system, size - half, ident, seed, remainder=False)
    return genuine.unionByName(spoof)


def priority_universe(df: DataFrame, size: int, priority: Column, ident, label="label", share=0.80, seed=42) -> DataFrame:
    """CUR-06: half per class, 80 % of it from priority rows, each side back-filled by the other."""
    half = {0: size // 2, 1: size - size // 2}
    marked = df.withColumn("__prio", F.coalesce(priority, F.lit(False)))
    target = F.when(F.col(label) == 0, half[0]).otherwise(half[1])
    count = lambda flag: F.sum(F.when(F.col("__prio") == flag, 1).otherwise(0))
    sizes = marked.groupBy(label).agg(count(True).alias("p"), count(False).alias("o")).withColumn("t", target)
    p0 = F.least("p", F.floor(F.col("t") * share))
    sizes = sizes.withColumn("p0", p0).withColumn("o0", F.least(F.col("o"), F.col("t") - F.col("p0")))
    short = F.col("p0") + F.col("o0") < F.col("t")
    p1 = F.when(short & (F.col("p") > F.col("p0")), F.least(F.col("p"), F.col("t") - F.col("o0"))).otherwise(F.col("p0"))
    o1 = F.when(short & (F.col("p") <= F.col("p0")), F.least(F.col("o"), F.col("t") - F.col("p0"))).otherwise(F.col("o0"))
    sides = F.array(F.struct(F.lit(True).alias("__prio"), p1.alias("quota")), F.struct(F.lit(False).alias("__prio"), o1.alias("quota")))
    quotas = sizes.select(label, F.explode(sides).alias("s")).select(label, "s.*")
    return take_quota(marked, [label, "__prio"], quotas, ident, seed).drop("__prio")


def two_source_mix(df: DataFrame, first: Column, ident, label="label", seed=42) -> DataFrame:
    """CUR-07: all genuine rows and as many spoof rows, half of them from the first source."""
    spoof = df.filter(F.col(label) == 1).withColumn("__first", F.coalesce(first, F.lit(False)))
    n = df.agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("bigint").alias("n")).scalar()
    sizes = spoof.agg(F.sum(F.when(F.col("__first"), 1).otherwise(0)).alias("a")).withColumn("n", n)
    a = F.least(F.col("a"), F.floor(F.col("n") / 2))
    sides = F.array(F.struct(F.lit(True).alias("__first"), a.alias("quota")), F.struct(F.lit(False).alias("__first"), (F.col("n") - a).alias("quota")))
    quotas = sizes.select(F.explode(sides).alias("s")).select("s.*")
    chosen = take_quota(spoof, ["__first"], quotas, ident, seed).drop("__first")
    return df.filter(F.col(label) == 0).unionByName(chosen)


def noise_plan(df: DataFrame, ident, share=0.35, low=0.003, high=0.015, genuine_only=True, label="label", peak="peak", seed=42) -> DataFrame:
    """CUR-08: which rows get noise and how much: U(low, high) * max(0.05, peak)."""
    pick = hash_fraction(draw_key(ident, f"{seed}:pick")) < share
    if genuine_only:
        pick = pick & (F.col(label) == 0)
    amount = (hash_fraction(draw_key(ident, f"{seed}:amp")) * (high - low) + low) * F.greatest(F.lit(0.05), as_col(peak))
    return df.withColumn("augmented", pick).withColumn("noise_amp", F.when(pick, amount).otherwise(0.0))


# --- checks and statistics -----------------------------------------------------------------------

def split_stats(df: DataFrame, split="split", label="label") -> DataFrame:
    """AGG-01."""
    genuine = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    spoof = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    out = df.groupBy(split).agg(F.count("*").alias("total"), genuine.alias("genuine"), spoof.alias("spoof"))
    pct = lambda c: rnd(F.col(c) / F.col("total") * 100, 2)
    return out.withColumns({"genuine_pct": pct("genuine"), "spoof_pct": pct("spoof")})


def speaker_leakage(df: DataFrame, split="split", speaker="speaker_id") -> DataFrame:
    """JOIN-06 / CUR-09: speakers present in more than one split, counted per pair of splits.

    One aggregation by speaker; only three flags are kept, so hot speakers reduce before the shuffle.
    """
    has = lambda s: F.max((F.col(split) == s).cast("int")).alias(s)
    flags = df.groupBy(speaker).agg(has("train"), has("dev"), has("test"))
    both = lambda a, b: F.sum(F.col(a) * F.col(b)).cast("bigint")
    return flags.agg(
        both("train", "test").alias("train_test"), both("train", "dev").alias("train_dev"), both("dev", "test").alias("dev_test"),
    ).withColumn("leak_free", (F.col("train_test") + F.col("train_dev") + F.col("dev_test")) == 0)


def shared_speakers(df: DataFrame, a: str, b: str, split="split", speaker="speaker_id") -> DataFrame:
    """SET-04: the speakers themselves."""
    side = lambda s: df.filter(F.col(split) == s).select(speaker)
    return side(a).intersect(side(b))


def corpus_audit(files: DataFrame) -> DataFrame:
    """AGG-04 counts: files, valid, corrupted, mean duration and hours per side (label)."""
    ok = F.col("is_valid")
    dur = F.when(ok, F.col("duration"))
    return files.groupBy("label").agg(
        F.count("*").alias("total_files"),
        F.sum(ok.cast("int")).alias("valid_files"),
        F.sum((~ok).cast("int")).alias("corrupted_files"),
        rnd(F.coalesce(F.avg(dur), F.lit(0.0)), 2).alias("avg_duration_sec"),
        rnd(F.coalesce(F.sum(dur), F.lit(0.0)) / 3600.0, 3).alias("total_duration_hours"),
    )


def corpus_breakdown(files: DataFrame) -> DataFrame:
    """AGG-04 language and generator counts of valid files, in long form."""
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("name"))
    keys = F.array_compact(F.array(pair("language", F.col("language")), F.when(F.col("label") == 1, pair("generator", F.col("generator")))))
    return files.filter("is_valid").select("label", F.explode(keys).alias("k")).groupBy("label", "k.kind", "k.name").agg(F.count("*").alias("n"))


def balance_verdict(audit: DataFrame) -> DataFrame:
    """AGG-05."""
    side = lambda label, c: F.sum(F.when(F.col("label") == label, F.col(c)).otherwise(0))
    one = audit.agg(side(0, "valid_files").alias("genuine"), side(1, "valid_files").alias("spoof"), F.sum("corrupted_files").alias("corrupted"))
    total = F.col("genuine") + F.col("spoof")
    pct = lambda c: rnd(ratio(F.col(c), total) * 100, 2)
    one = one.withColumns({"genuine_percentage": pct("genuine"), "spoof_percentage": pct("spoof")})
    balanced = F.abs(F.col("genuine_percentage") - F.col("spoof_percentage")) <= 15.0
    return one.withColumn("is_balanced", balanced).withColumn("status", F.when(balanced & (F.col("corrupted") == 0), "PASSED").otherwise("WARNING"))


def manifest_report(manifest: DataFrame, group: str) -> DataFrame:
    """AGG-06: files, hours, distinct speakers and share per language or split.

    Distinct speakers are counted as a two-step aggregation, never as a set in memory.
    """
    per_speaker = manifest.groupBy(group, "speaker_id").agg(F.count("*").alias("files"), F.sum("duration_sec").alias("sec"))
    out = per_speaker.groupBy(group).agg(F.sum("files").alias("files"), rnd(F.sum("sec") / 3600.0, 4).alias("hours"), F.count("*").alias("speakers"))
    return out.withColumn("pct", rnd(F.col("files") / F.sum("files").over(Window.partitionBy()) * 100, 1))
