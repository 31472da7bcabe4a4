"""Sharding by a two-pass external shuffle.

Pass one scatters the rows by a seeded hash over buckets that fit in memory (one exchange, one partition per bucket);
pass two permutes each bucket by Fisher-Yates and writes it. Buckets stand one after another in the shuffled order,
so shards are equal cuts of that order: their counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import scratch
from .common import without_clash


MOST_BUCKETS = 1 << 20  # bounds the table of bucket starts (two numbers each); beyond it buckets grow


def _bucket(seed: int, key: str, buckets: int):
    # the row's place in the input is part of the key, so equal rows scatter like all others
    return F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")


def _permute(seed: int):
    """Fisher-Yates over the bucket of one partition; the order it starts from does not depend on how rows arrived."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        for bucket in pc.unique(rows["bucket"]).to_pylist():
            own = rows.filter(pc.equal(rows["bucket"], bucket))
            order = pc.sort_indices(own, sort_keys=[("place", "ascending")]).to_numpy().copy()
            np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
            for low in range(0, len(order), 1000):
                some = order[low : low + 1000]
                at = pa.array(np.arange(low, low + len(some), dtype=np.int64))
                yield from own.take(pa.array(some)).select(["doc", "bucket"]).append_column("at", at).combine_chunks().to_batches()

    return run


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 7, key: str = "doc_id", text: str = "text", bucket_bytes: int = 32 << 20, path: str | None = None) -> DataFrame:
    """Write all rows of ``docs`` in random order as ``shards`` folders ``shard=N`` of Parquet files and read them back.

    Added columns: ``shard`` and ``slot`` (place in the shard, gapless from 0); input columns of these names (in any
    letter case) get ``_in`` at their end. Law ``rows``: the counts of two shards differ by one at most, so with fewer
    rows than shards the last shards are empty. A null text or key is an ordinary value, equal rows are scattered like
    different ones, and an empty table gives an empty result. A bucket holds about ``bucket_bytes`` of text (more once
    there are ``MOST_BUCKETS``), and at least one row. ``docs`` must give the same rows in the same partitions each
    time it is read, as files do; a difference between the passes raises an error and nothing is returned.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "shards")
    docs = without_clash(docs, ["shard", "slot"])
    total = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(f"`{text}`")).alias("bytes")).first()
    buckets = min(MOST_BUCKETS, max(1, -(-((total["bytes"] or 0) + 32 * total["rows"]) // bucket_bytes)))

    sizes = docs.select(_bucket(seed, key, buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    begins = sizes.select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("before"))

    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scattered = docs.select(columns.alias("doc"), F.monotonically_increasing_id().alias("place"), _bucket(seed, key, buckets).alias("bucket")).repartitionById(buckets, "bucket")
    schema = StructType([f for f in scattered.schema.fields if f.name != "place"] + [StructField("at", LongType())])
    permuted = scattered.mapInArrow(_permute(seed), schema)
    # the first (rows % shards) shards hold one row more than the others
    each, more = divmod(total["rows"], shards)
    edge = more * (each + 1)
    position = F.col("before") + F.col("at")
    shard = F.when(position < edge, F.floor(position / F.lit(each + 1))).otherwise(more + F.floor((position - edge) / F.lit(max(each, 1)))).cast("int")
    slot = F.when(position < edge, position % F.lit(each + 1)).otherwise((position - edge) % F.lit(max(each, 1))).cast("long")
    # a row per bucket, MOST_BUCKETS at most: small enough to broadcast
    placed = permuted.join(F.broadcast(begins), "bucket").select("doc.*", slot.alias("slot"), shard.alias("shard"))
    placed.write.partitionBy("shard").parquet(path)

    out_schema = StructType(docs.schema.fields + [StructField("slot", LongType()), StructField("shard", IntegerType())])
    written = spark.read.schema(out_schema).parquet(path)
    seen = written.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"))
    wrong = seen.filter((F.col("n") != F.when(F.col("shard") < more, each + 1).otherwise(each)) | (F.col("last") != F.col("n") - 1)).count()
    if wrong:
        raise RuntimeError(f"{wrong} shards do not hold the rows they should: the input changed between the passes")
    return written
