from collections import Counter

from earshot.llm.sharding import shuffle_into_shards


def test_whole_and_even(spark, odd, odd_rows):
    out = shuffle_into_shards(odd, shards=4, bucket_bytes=20_000)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in odd_rows)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(4))
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    assert {"shard_in", "slot_in", "bucket", "place"} <= set(out.columns)
    assert {r.shard_in for r in rows} == {"x", "y", None}


def test_same_rows_scatter(spark):
    path = __import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp") + "/same"
    spark.range(3000).selectExpr("1L AS doc_id", "'same text' AS text").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    rows = shuffle_into_shards(docs, shards=7, bucket_bytes=2_000).collect()
    assert len(rows) == 3000 and max(Counter(r.shard for r in rows).values()) == 429


def test_order_is_shuffled_and_repeatable(spark):
    path = __import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp") + "/order"
    spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', 20) AS text").coalesce(2).write.parquet(path)
    docs = spark.read.parquet(path)
    one, two = ([r.doc_id for r in shuffle_into_shards(docs, shards=1, seed=s, bucket_bytes=9_000).orderBy("slot").collect()] for s in (3, 3))
    other = [r.doc_id for r in shuffle_into_shards(docs, shards=1, seed=4, bucket_bytes=9_000).orderBy("slot").collect()]
    assert one == two != other
    # a random order: about half of the neighbours rise, and places hardly follow ids
    assert 800 < sum(a < b for a, b in zip(one, one[1:])) < 1200
    mean = sum(abs(i - d) for i, d in enumerate(one)) / 2000
    assert 550 < mean < 780


def test_empty_and_few(spark, none, odd):
    assert shuffle_into_shards(none, shards=3).count() == 0
    rows = shuffle_into_shards(odd, shards=64).collect()
    assert sorted(r.shard for r in rows) == list(range(len(rows))) and {r.slot for r in rows} == {0}
