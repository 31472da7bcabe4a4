"""Ordered scans that stay parallel when one key holds a large share of all rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here every key is cut into blocks
along its order (time slot, score slice, hash prefix, row range). Rows are scanned inside their block,
blocks are reduced to one summary row each, the few summaries are scanned per key, and the carried
value is joined back. The large side is shuffled once, by a struct of key and block, which the join of the carried values reuses; only
summaries meet per key.

``block`` must not decrease along ``order``; ``order`` is a list of ascending columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_col

BLOCK = "__block"


# --- block keys ----------------------------------------------------------------------------------

def time_block(ts, seconds: float = 3600.0) -> Column:
    return F.floor(F.unix_micros(as_col(ts)) / F.lit(float(seconds) * 1e6))


def int_block(value, size: int = 4096) -> Column:
    return F.floor(as_col(value) / F.lit(size))


def hash_block(hex_text, digits: int = 4) -> Column:
    """Prefix of a hex digest: even blocks for any order by that digest."""
    return F.substring(as_col(hex_text), 1, digits)


def unit_block(value, slices: int = 4096) -> Column:
    """Equal slices of [0, 1]."""
    return F.floor(as_col(value) * slices)


def depth_bounds(df: DataFrame, value, count: int = 256) -> Column:
    """``count - 1`` ascending bounds that cut the rows of ``df`` into blocks of nearly equal size, as a scalar.

    They come from one mergeable quantile summary whose rank error is a tenth of a block, so a value that many rows lie near
    gets many blocks. NULLs are left out.
    """
    shares = F.array(*[F.lit(k / count) for k in range(1, count)])
    return df.agg(F.percentile_approx(as_col(value), shares, F.lit(10 * count)).alias("bounds")).scalar()


def depth_block(value, bounds: Column, count: int = 256) -> Column:
    """Block of a value among ``depth_bounds``: how many bounds are not above it, by binary search; never decreases with it.

    ``count`` must be a power of two. Without bounds (no rows) it is NULL.
    """
    v = as_col(value)
    steps = F.array(*[F.lit(count >> k) for k in range(1, count.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(bounds, low + step - 1) <= v, low + step).otherwise(low))


def with_depth_block(df: DataFrame, value, name: str, count: int = 256) -> DataFrame:
    """``df`` with the block of ``value`` among blocks of nearly equal size as column ``name``."""
    bound = df.withColumn("__bounds", depth_bounds(df, value, count))
    return bound.withColumn(name, depth_block(value, F.col("__bounds"), count)).drop("__bounds")


# --- plumbing ------------------------------------------------------------------------------------

KEYED = "__keyed"


def _keyed(df: DataFrame, keys: list[str], block) -> DataFrame:
    """Adds one struct of keys and block: never NULL itself, so NULL keys join by plain equality, and the partitioning
    of the scan inside blocks serves the join of the carried values too."""
    df = df.withColumn(BLOCK, block)
    return df.withColumn(KEYED, F.struct(*[F.col(k) for k in keys], F.col(BLOCK)))


def _over_blocks(keys: list[str]):
    return Window.partitionBy(*[F.col(f"{KEYED}.{k}") for k in keys]).orderBy(F.col(f"{KEYED}.{BLOCK}"))


def _before(keys):
    return _over_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
_JOIN = {"sum": lambda a, b: a + b, "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}


def running(df: DataFrame, keys: list[str], order: list, block, exclusive: bool = False, **aggs) -> DataFrame:
    """Running sum / max / min per key. ``aggs``: name=(kind, column). NULL inputs are skipped.

    ``exclusive=True`` leaves the current row out of its own frame.
    """
    df = _keyed(df, keys, block)
    df = df.withColumns({f"__v_{n}": as_col(c) for n, (_, c) in aggs.items()})
    totals = df.groupBy(KEYED).agg(*[_AGG[k](f"__v_{n}").alias(f"__t_{n}") for n, (k, _) in aggs.items()])
    carry = totals.select(KEYED, *[_AGG[k](f"__t_{n}").over(_before(keys)).alias(f"__c_{n}") for n, (k, _) in aggs.items()])
    inside = Window.partitionBy(KEYED).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = df.withColumns({f"__l_{n}": _AGG[k](f"__v_{n}").over(inside) for n, (k, _) in aggs.items()})
    out = local.join(carry, KEYED, "left")
    for n, (k, _) in aggs.items():
        c, l = F.col(f"__c_{n}"), F.col(f"__l_{n}")
        out = out.withColumn(n, F.when(c.isNull(), l).when(l.isNull(), c).otherwise(_JOIN[k](c, l)))
    return out.drop(BLOCK, KEYED, *[f"__{p}_{n}" for n in aggs for p in "vcl"])


def row_index(df: DataFrame, keys: list[str], order: list, block, name: str = "rn") -> DataFrame:
    """Distributed ``row_number`` from 1."""
    return running(df, keys, order, block, **{name: ("sum", F.lit(1))})


def lagged(df: DataFrame, keys: list[str], order: list, block, **cols) -> DataFrame:
    """Value of the previous row of the key. ``cols``: name=column. NULL on the first row."""
    df = _keyed(df, keys, block)
    df = df.withColumns({f"__v_{n}": as_col(c) for n, c in cols.items()})
    packed = F.struct(*[F.col(f"__v_{n}").alias(n) for n in cols])
    rank = F.struct(*[as_col(o).alias(f"o{i}") for i, o in enumerate(order)])
    last = df.groupBy(KEYED).agg(F.max_by(packed, rank).alias("__last"))
    carry = last.select(KEYED, F.lag("__last").over(_over_blocks(keys)).alias("__carry"))
    inside = Window.partitionBy(KEYED).orderBy(*order)
    local = df.withColumns({"__prev": F.lag(packed).over(inside), "__first": F.row_number().over(inside) == 1})
    out = local.join(carry, KEYED, "left")
    prev = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__prev"))
    out = out.withColumn("__pick", prev)
    out = out.withColumns({n: F.col(f"__pick.{n}") for n in cols})
    return out.drop(BLOCK, KEYED, "__prev", "__first", "__carry", "__pick", *[f"__v_{n}" for n in cols])


def numbered(df: DataFrame, keys: list[str], order: list, block, name: str = "rn", **cols) -> DataFrame:
    """``row_index`` and ``lagged`` in one scan: the rows are shuffled and sorted once for both."""
    df = _keyed(df, keys, block)
    df = df.withColumns({f"__v_{n}": as_col(c) for n, c in cols.items()})
    packed = F.struct(*[F.col(f"__v_{n}").alias(n) for n in cols])
    rank = F.struct(*[as_col(o).alias(f"o{i}") for i, o in enumerate(order)])
    each = df.groupBy(KEYED).agg(F.count("*").alias("__n"), F.max_by(packed, rank).alias("__last"))
    carry = each.select(KEYED, F.sum("__n").over(_before(keys)).alias("__before"), F.lag("__last").over(_over_blocks(keys)).alias("__carry"))
    inside = Window.partitionBy(KEYED).orderBy(*order)
    local = df.withColumns({"__prev": F.lag(packed).over(inside), "__at": F.row_number().over(inside)})
    out = local.join(carry, KEYED, "left").withColumn("__pick", F.when(F.col("__at") == 1, F.col("__carry")).otherwise(F.col("__prev")))
    out = out.withColumns({name: F.coalesce("__before", F.lit(0)) + F.col("__at"), **{n: F.col(f"__pick.{n}") for n in cols}})
    return out.drop(BLOCK, KEYED, "__prev", "__at", "__before", "__carry", "__pick", *[f"__v_{n}" for n in cols])


# --- bounded frames ------------------------------------------------------------------------------

def last_rows(df: DataFrame, keys: list[str], order: list, block, rows: int, size: int = 4096, **aggs) -> DataFrame:
    """Aggregates over the last ``rows`` rows of the key, current row included.

    ``aggs``: name=(aggregate function, column). Each block also receives the ``rows - 1`` rows before
    it, so a hot key runs as many independent frames.
    """
    keep = df.columns
    df = row_index(df, keys, order, block, "__rn")
    size = max(size, rows)
    chunk = F.floor((F.col("__rn") - 1) / F.lit(size))
    halo = F.pmod(F.col("__rn") - 1, F.lit(size)) >= size - (rows - 1)
    df = df.withColumn("__own", chunk).withColumn("__chunk", F.explode(F.when(halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy(*keys, "__chunk").orderBy("__rn").rowsBetween(-(rows - 1), 0)
    df = df.withColumns({n: fn(as_col(c)).over(w) for n, (fn, c) in aggs.items()})
    return df.filter(F.col("__chunk") == F.col("__own")).select(*keep, *aggs)


def last_span(df: DataFrame, keys: list[str], position: str, width: float, **aggs) -> DataFrame:
    """Aggregates over rows whose ``position`` lies within ``width`` before the current row's.

    Blocks span 64 widths; rows near the end of a block are also given to the next one.
    """
    keep, span = df.columns, width * 64
    own = F.floor(F.col(position) / span)
    halo = F.col(position) >= (own + 1) * span - width
    df = df.withColumn("__own", own).withColumn("__chunk", F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "__chunk").orderBy(position).rangeBetween(-width, 0)
    df = df.withColumns({n: fn(as_col(c)).over(w) for n, (fn, c) in aggs.items()})
    return df.filter(F.col("__chunk") == F.col("__own")).select(*keep, *aggs)


# --- recursions ----------------------------------------------------------------------------------

def fold_contracting(
    df: DataFrame,
    keys: list[str],
    order: list,
    block,
    value,
    init: float,
    step,
    name: str,
    size: int = 256,
    warmup: int = 128,
) -> DataFrame:
    """x[n] = step(x[n-1], value[n]) for steps that shrink differences by 0.75 or more strongly.

    Rows are cut into blocks of ``size``. A block other than the first starts from ``init`` but first
    replays the ``warmup`` rows before it: 0.75 ** 128 is below one part in 10 ** 15, so the carried
    state is that of the full recursion. Every block is one bounded array.

    A NULL value leaves the state as it was: such rows are not counted, and take the state of the row before.
    """
    rn, keep = "__rn", df.columns
    df = df.withColumn("__key", F.struct(*keys))  # a struct key also matches rows whose key is NULL
    keys = ["__key"]
    df = df.withColumn("__val", as_col(value))
    df = running(df, keys, order, block, **{rn: ("sum", F.col("__val").isNotNull().cast("bigint"))})
    chunk = F.floor((F.col(rn) - 1) / F.lit(size))
    near_end = F.pmod(F.col(rn) - 1, F.lit(size)) >= size - warmup
    slim = df.filter(F.col("__val").isNotNull()).select(*keys, rn, "__val", F.explode(F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))).alias("__chunk"))
    lists = slim.groupBy(*keys, "__chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col(rn).alias("k"), F.col("__val").alias("v")))).alias("__rows")
    )
    start = F.struct(F.lit(float(init)).alias("x"), F.array().cast("array<double>").alias("out"))

    def advance(acc, row):
        nxt = step(acc["x"], row["v"])
        return F.struct(nxt.alias("x"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    states = F.aggregate("__rows", start, advance, lambda acc: acc["out"])
    # "outer" keeps Spark from adding a filter that would compute the array a second time
    flat = lists.select(*keys, "__chunk", F.explode_outer(F.arrays_zip(F.col("__rows.k").alias("k"), states.alias("x"))).alias("__z"))
    flat = flat.select(*keys, "__chunk", F.col("__z.k").alias(rn), F.col("__z.x").alias(name))
    own = flat.filter(F.col("__chunk") == F.floor((F.col(rn) - 1) / F.lit(size))).drop("__chunk")
    return df.join(own, [*keys, rn], "left").withColumn(name, F.coalesce(name, F.lit(float(init)))).select(*keep, name)


def fold_max_affine(df: DataFrame, keys: list[str], order: list, block, value, init: float, pieces, name: str,
                    size: int = 256, fanout: int = 1024) -> DataFrame:
    """x[n] = max(a*x[n-1] + b, c) with a >= 0, where (a, b, c) depend on value[n].

    Such maps are closed under composition, so the recursion is a parallel prefix: rows -> blocks of
    ``size`` -> groups of ``fanout`` blocks -> key. ``pieces(value)`` returns the three columns; a NULL
    ``c`` means there is no lower bound. A NULL value leaves the state as it was.
    """
    low = F.lit(float("-inf"))
    rn, keep = "__rn", df.columns
    df = df.withColumn("__key", F.struct(*keys))  # a struct key also matches rows whose key is NULL
    keys = ["__key"]
    df = row_index(df, keys, order, block, rn)
    value = as_col(value)
    a, b, c = pieces(value)
    a, b, c = F.when(value.isNull(), 1.0).otherwise(a), F.when(value.isNull(), 0.0).otherwise(b), F.when(value.isNotNull(), c)
    df = df.withColumn("__m", F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), F.coalesce(c, low).cast("double").alias("c")))
    df = df.withColumn("__b1", F.floor((F.col(rn) - 1) / F.lit(size))).withColumn("__b2", F.floor((F.col(rn) - 1) / F.lit(size * fanout)))

    ident = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), low.alias("c"))

    def then(f, g):
        """g after f."""
        return F.struct(
            (g["a"] * f["a"]).alias("a"),
            (g["a"] * f["b"] + g["b"]).alias("b"),
            F.greatest(F.when(f["c"] == low, low).otherwise(g["a"] * f["c"] + g["b"]), g["c"]).alias("c"),
        )

    def apply(m, x):
        return F.greatest(m["a"] * x + m["b"], m["c"])

    def ordered(key, val):
        return F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(val).alias("v"))))

    def total(rows):
        return F.aggregate(rows, ident, lambda acc, r: then(acc, r["v"]))

    def states(rows, start, inclusive):
        """State after (or before) every element, from a start value."""
        init_acc = F.struct(start.alias("x"), F.array().cast("array<double>").alias("out"))

        def advance(acc, r):
            nxt = apply(r["v"], acc["x"])
            return F.struct(nxt.alias("x"), F.concat(acc["out"], F.array(nxt if inclusive else acc["x"])).alias("out"))

        return F.aggregate(rows, init_acc, advance, lambda acc: acc["out"])

    def spread(grouped, rows, start, inclusive, key, out):
        zipped = F.arrays_zip(F.col(f"{rows}.k").alias("k"), states(F.col(rows), start, inclusive).alias("x"))
        return grouped.select(*keys, F.explode_outer(zipped).alias("__z")).select(*keys, F.col("__z.k").alias(key), F.col("__z.x").alias(out))

    level1 = df.groupBy(*keys, "__b2", "__b1").agg(ordered(rn, "__m").alias("__rows"))
    level1 = level1.withColumn("__t1", total(F.col("__rows")))
    level2 = level1.groupBy(*keys, "__b2").agg(ordered("__b1", "__t1").alias("__blocks"))
    level2 = level2.withColumn("__t2", total(F.col("__blocks")))
    level3 = level2.groupBy(*keys).agg(ordered("__b2", "__t2").alias("__groups"))

    start2 = spread(level3, "__groups", F.lit(float(init)), False, "__b2", "__s2")
    start1 = spread(level2.join(start2, [*keys, "__b2"]), "__blocks", F.col("__s2"), False, "__b1", "__s1")
    rows = spread(level1.join(start1, [*keys, "__b1"]), "__rows", F.col("__s1"), True, rn, name)
    return df.join(rows, [*keys, rn]).select(*keep, name)
