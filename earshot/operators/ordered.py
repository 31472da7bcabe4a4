"""Windows over clips and ordered operations over calls (WIN-01 .. WIN-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col, clamp
from . import blocks

WINDOW_SAMPLES, HOP_SAMPLES = 48000, 16000


def sliding_windows(clips: DataFrame, length: str = "n_samples", window: int = WINDOW_SAMPLES, hop: int = HOP_SAMPLES) -> DataFrame:
    """WIN-01: win_idx, start_sample, padded. A short clip is one padded window; the tail is dropped."""
    n = F.col(length)
    starts = F.when(n < window, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(n - window, F.lit(0)).cast("bigint"), F.lit(hop).cast("bigint")))
    return clips.select("*", F.posexplode(starts).alias("win_idx", "start_sample")).withColumn("padded", F.col(length) < window)


def strategic_windows(clips: DataFrame, length: str = "n_samples", window: int = WINDOW_SAMPLES, minimum: int = 56000, most: int = 5) -> DataFrame:
    """WIN-02: up to five evenly spaced windows for clips of at least 3.5 s; shorter clips give none."""
    long_enough = clips.filter(F.col(length) >= minimum)
    last = (F.col(length) - window).cast("bigint")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(last / (most - 1)))
    starts = F.slice(F.sequence(F.lit(0).cast("bigint"), last, step), 1, most)
    return long_enough.select("*", F.posexplode(starts).alias("win_idx", "start_sample"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, pad, gap, block: Column, total: str | None = None) -> DataFrame:
    """WIN-03: pad each interval, then join those closer than ``gap``: keys, island, start, end, parts."""
    df = df.withColumns({"__s": F.greatest(F.lit(0), F.col(start) - pad), "__e": F.col(end) + pad})
    if total:
        df = df.withColumn("__e", F.least(F.col(total), F.col("__e")))
    df = df.withColumn("__blk", block)
    order = ["__s", "__e"]
    df = blocks.running(df, keys, order, F.col("__blk"), exclusive=True, __reach=("max", "__e"))
    fresh = F.col("__reach").isNull() | (F.col("__s") > F.col("__reach") + gap)
    df = blocks.running(df.withColumn("__new", fresh.cast("int")), keys, order, F.col("__blk"), island=("sum", "__new"))
    return df.groupBy(*keys, "island").agg(F.min("__s").alias(start), F.max("__e").alias(end), F.count("*").alias("parts"))


def split_intervals(df: DataFrame, start: str, end: str, longest: int, shortest: int) -> DataFrame:
    """WIN-04: pieces of at most ``longest``; pieces shorter than ``shortest`` are dropped."""
    starts = F.sequence(F.col(start), F.greatest(F.col(end) - 1, F.col(start)), F.lit(longest).cast("bigint"))
    cut = df.select("*", F.posexplode(starts).alias("piece", "__from"))
    stop = F.least(F.col(end), F.col("__from") + longest)
    return cut.withColumn(end, stop).withColumn(start, F.col("__from")).drop("__from").filter(F.col(end) - F.col(start) >= shortest)


def with_whole_clip(pieces: DataFrame, clips: DataFrame, keys: list[str], start: str, end: str, total: str) -> DataFrame:
    """WIN-04 fallback: clips without any piece become one piece of full length."""
    missing = clips.join(pieces.select(*keys).distinct(), keys, "left_anti")
    whole = missing.select(*keys, F.lit(0).cast("bigint").alias(start), F.col(total).cast("bigint").alias(end), F.lit(0).alias("piece"))
    return pieces.select(*keys, start, end, "piece").unionByName(whole)


def turn_changes(df: DataFrame, keys: list[str], order: list, block: Column, speaker: str) -> DataFrame:
    """WIN-05: ``changed`` marks the first row of every turn, ``turn_no`` numbers the turns."""
    df = blocks.lagged(df, keys, order, block, __before=speaker)
    df = df.withColumn("changed", (F.col("__before").isNull() | (F.col("__before") != F.col(speaker))).cast("int")).drop("__before")
    return blocks.running(df, keys, order, block, turn_no=("sum", "changed"))


def mean_abs_step(df: DataFrame, keys: list[str], order: list, block: Column, value: str) -> DataFrame:
    """WIN-07: mean |x[n] - x[n-1]|, its ratio to the mean, and the share of steps above a limit."""
    df = blocks.lagged(df, keys, order, block, __before=value)
    step = F.abs(F.col(value) - F.col("__before"))
    return df.groupBy(*keys).agg(
        F.avg(step).alias("mean_step"), F.avg(value).alias("mean_value"), F.avg((step > 75.0).cast("double")).alias("jump_ratio"), F.count("*").alias("n"))


def first_is_a(df: DataFrame, keys: list[str], order: list, label: str) -> DataFrame:
    """WIN-08: the label active first in a call is "Speaker A", any other "Speaker B"."""
    first = df.groupBy(*keys).agg(F.min_by(label, F.struct(*order)).alias("__first"))
    return df.join(first, keys).withColumn("speaker", F.when(F.col(label) == F.col("__first"), "Speaker A").otherwise("Speaker B")).drop("__first")


def suppress_repeats(df: DataFrame, keys: list[str], order: list, block: Column, text: str) -> DataFrame:
    """WIN-14: leave out an event whose text equals the event before it."""
    df = blocks.lagged(df, keys, order, block, __before=text)
    return df.filter(F.col("__before").isNull() | (F.col("__before") != F.col(text))).drop("__before")


def last_events(df: DataFrame, keys: list[str], newest_first: list, n: int) -> DataFrame:
    """WIN-15: last ``n`` events per call; Spark limits each call before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def reevaluation_points(df: DataFrame, keys: list[str], order: list, block: Column, voiced_sec, every: float = 0.5) -> DataFrame:
    """WIN-12: ``voiced_total`` and ``evaluate``, set when the voiced time enters a new half second."""
    df = blocks.running(df.withColumn("__dur", as_col(voiced_sec)), keys, order, block, voiced_total=("sum", "__dur"))
    step = lambda c: F.floor(c / every + 1e-9)
    return df.withColumn("evaluate", step(F.col("voiced_total")) > step(F.col("voiced_total") - F.col("__dur"))).drop("__dur")


# Branch limits and weights of the risk average.
EMA_START, EMA_CALM, EMA_HOT = 5.0, 30.0, 60.0


def risk_ema_pieces(v: Column):
    """WIN-18 as max(a*x + b, c)."""
    hot = v >= EMA_HOT
    a = F.when(v < EMA_CALM, 0.55).when(hot, 1.0).otherwise(0.65)
    b = F.when(v < EMA_CALM, v * 0.45).when(hot, 0.0).otherwise(v * 0.35)
    return a, b, F.when(hot, v)


def risk_ema(df: DataFrame, keys: list[str], order: list, block: Column, value, name: str = "ema_risk") -> DataFrame:
    """WIN-18."""
    return blocks.fold_max_affine(df, keys, order, block, value, EMA_START, risk_ema_pieces, name)


def remote_prob_ema(df: DataFrame, keys: list[str], order: list, block: Column, value, name: str = "ema_prob") -> DataFrame:
    """WIN-19, remote party: 0.70 when rising, 0.35 when falling, start 0.08; published value in [0.01, 0.99]."""

    def step(x, v):
        return F.when(v > x, v * 0.70 + x * (1.0 - 0.70)).otherwise(v * 0.35 + x * (1.0 - 0.35))

    out = blocks.fold_contracting(df, keys, order, block, value, 0.08, step, name)
    return out.withColumn(f"{name}_published", clamp(name, 0.01, 0.99))


def local_prob_ema(df: DataFrame, keys: list[str], order: list, block: Column, value, name: str = "ema_prob") -> DataFrame:
    """WIN-19, local party: 0.30 smoothing from 0.05; published value in [0.01, 0.35]."""
    out = blocks.fold_contracting(df, keys, order, block, value, 0.05, lambda x, v: v * 0.30 + x * 0.70, name)
    return out.withColumn(f"{name}_published", clamp(name, 0.01, 0.35))
