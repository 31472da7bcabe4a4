import pytest
from pyspark.sql import functions as F

from earshot.operators import curation as K


@pytest.fixture(scope="module")
def clips(spark):
    """2 000 clips; one speaker and one system hold a third of them."""
    df = spark.range(2000).select(F.col("id").alias("audio_id"))
    return df.select("audio_id", F.when(F.col("audio_id") % 3 == 0, 0).otherwise(F.col("audio_id") % 101 + 1).alias("speaker_id"), F.when(F.col("audio_id") % 4 == 0, 0).otherwise(1).alias("label"),
                     F.when(F.col("audio_id") % 3 == 0, "A").otherwise(F.concat(F.lit("S"), (F.col("audio_id") % 7).cast("string"))).alias("system_id")).cache()


def counts(df, *cols):
    return {tuple(r[c] for c in cols): r["count"] for r in df.groupBy(*cols).count().collect()}


def test_stratified_split_is_complete_and_stratified(clips):
    s = K.stratified_split(clips, "audio_id")
    assert s.count() == 2000 and s.select("audio_id").distinct().count() == 2000
    c = counts(s, "label", "split")
    assert c[(0, "train")] == 350 and c[(0, "dev")] == 75 and c[(0, "test")] == 75
    assert c[(1, "train")] == 1050 and c[(1, "dev")] == 225 and c[(1, "test")] == 225


def test_split_is_repeatable_and_seeded(clips):
    a = K.stratified_split(clips, "audio_id", seed=1)
    again = K.stratified_split(clips.repartition(5), "audio_id", seed=1)
    assert a.exceptAll(again.select(a.columns)).count() == 0
    assert a.exceptAll(K.stratified_split(clips, "audio_id", seed=2).select(a.columns)).count() > 0


def test_speaker_disjoint_split(clips):
    s = K.speaker_disjoint_split(clips)
    assert s.count() == 2000
    assert K.speaker_leakage(s).first().leak_free
    assert not K.speaker_leakage(K.stratified_split(clips, "audio_id")).first().leak_free
    assert K.shared_speakers(s, "train", "test").count() == 0


def test_two_speakers_still_give_train_and_dev(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "audio_id int, speaker_id string")
    assert set(counts(K.speaker_disjoint_split(df), "split")) == {("train",), ("dev",)}


def test_balance(clips):
    b = K.balance_classes(clips, "audio_id")
    assert counts(b, "label") == {(0,): 500, (1,): 500}
    assert b.select("audio_id").distinct().count() == 1000
    per_system = [n for (s,), n in counts(b.filter("label = 1"), "system_id").items()]
    assert max(per_system) - min(per_system) <= 1


def test_quota_refills_short_systems(spark):
    rows = [(i, "big") for i in range(100)] + [(100 + i, "small") for i in range(3)]
    df = spark.createDataFrame(rows, "audio_id int, system_id string")
    got = counts(K.quota_with_refill(df, "system_id", 41, "audio_id"), "system_id")
    assert got == {("big",): 38, ("small",): 3}


def test_target_above_supply_takes_all(spark):
    df = spark.createDataFrame([(i, "x") for i in range(10)], "audio_id int, system_id string")
    assert K.quota_with_refill(df, "system_id", 50, "audio_id").count() == 10
    assert K.take_random(df, 50, "audio_id").count() == 10
    assert K.take_random(df, 0, "audio_id").count() == 0
    assert K.take_random(df, 4, "audio_id").count() == 4


def test_priority_backfill(clips):
    prio = F.col("system_id") == "A"
    u = K.priority_universe(clips, 1000, prio, "audio_id")
    c = counts(u.withColumn("p", prio), "label", "p")
    assert c[(0, True)] + c[(0, False)] == 500 and c[(1, True)] == 400 and c[(1, False)] == 100


def test_two_sources(clips):
    m = K.two_source_mix(clips, F.col("system_id") == "A", "audio_id")
    c = counts(m.withColumn("a", F.col("system_id") == "A"), "label", "a")
    assert c[(1, True)] == 250 and c[(1, False)] == 250


def test_noise_plan_share_and_range(clips):
    p = K.noise_plan(clips.withColumn("peak", F.lit(0.5)), "audio_id")
    assert p.filter("augmented AND label = 1").count() == 0
    share = p.filter("augmented").count() / 500
    assert 0.28 < share < 0.42
    lo, hi = p.filter("augmented").agg(F.min("noise_amp"), F.max("noise_amp")).first()
    assert 0.0015 <= lo and hi <= 0.0075


def test_head_per_group_uses_limited_groups(clips):
    h = K.head_per_group(clips, ["speaker_id"], ["audio_id"], 3)
    assert max(counts(h, "speaker_id").values()) == 3
    assert "WindowGroupLimit" in h._jdf.queryExecution().executedPlan().toString()


def test_null_strata_are_strata(clips):
    odd = clips.withColumns({"label": F.when(F.col("audio_id") % 10 != 0, F.col("label")), "system_id": F.when(F.col("audio_id") % 9 != 1, F.col("system_id"))})
    s = K.stratified_split(odd, "audio_id")
    assert s.count() == 2000 and counts(s, "label", "split")[(None, "train")] == 140
    even = K.balance_classes(odd, "audio_id")
    c = counts(even, "label")
    assert c[(0,)] == c[(1,)] == odd.filter("label = 0").count()
    quota = odd.select("system_id").distinct().withColumn("quota", F.lit(5))
    taken = counts(K.take_quota(odd, ["system_id"], quota, "audio_id"), "system_id")
    assert set(taken.values()) == {5} and (None,) in taken


def test_null_slices_keep_their_metrics(spark):
    from earshot.operators import evaluation as E

    rows = spark.createDataFrame([(i % 2, (i % 10) / 10, None if i % 3 else "x") for i in range(60)], "label int, score double, language string")
    got = {r.language: r for r in E.sliced_metrics(rows, ["language"], 0.5).collect()}
    assert got[None].n == 40 and got["x"].n == 20 and got[None].roc_auc is not None


def test_splits_do_not_deal_clips_by_label(spark):
    """Joins by size off, as for large tables: clips meet their cuts where they are."""
    df = spark.range(400).select(F.col("id").alias("audio_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("label"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for split in (K.stratified_split(df, "audio_id"), K.stratified_split(df, "audio_id", label=None), K.fixed_split(df, "audio_id", 100, 50)):
            plan = split._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan) and split.count() == 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
