import random

import corpus_pipeline
import numpy as np
import pytest
from conftest import SCHEMA, prose, rows_of
from pyspark.sql import functions as F

from earshot.llm import shingles
from earshot.llm.common import frozen, with_row_ids


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = sets_of(a), sets_of(b)
    return len(a & b) / len(a | b)


def brute(texts):
    """The smallest index of every component of the pairs at 0.8 or more."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return set(label)


def edited(rng, text, changes):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_pairs_near_the_limit(spark):
    rng = random.Random(11)
    texts, near = [], []
    for k in range(80):  # pairs from about 0.70 to 0.90, and a few chains
        text = prose(rng, 160, vocabulary=1500)
        other = edited(rng, text, 2 + k % 5)
        texts += [text, other]
        near.append(jaccard(text, other))
        if k % 8 == 0:
            texts.append(edited(rng, other, 3))
    assert sum(0.7 <= x < 0.8 for x in near) > 15 and sum(0.8 <= x < 0.9 for x in near) > 15
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, None).collect()
    assert {r.doc_id for r in kept} == brute(texts)


@pytest.mark.parametrize("most", [2, 7, 1000])
def test_split_components_give_the_same_rows(spark, most):
    """A dense group of near copies, another one that its members share words with, loose texts and chains."""
    rng = random.Random(most)
    base = prose(rng, 200, vocabulary=3000)
    words = base.split(" ")
    sibling = " ".join(words[:100]) + " " + prose(rng, 100, vocabulary=3000)
    texts = [edited(rng, base, rng.randint(0, 4)) for _ in range(40)] + [edited(rng, sibling, rng.randint(0, 3)) for _ in range(25)]
    chain = base
    for _ in range(12):
        chain = edited(rng, chain, 4)
        texts.append(chain)
    texts += [prose(rng, 60, vocabulary=3000) for _ in range(10)] + texts[:5]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = spark.createDataFrame(rows_of([texts[k] for k in order], ids=order), SCHEMA).repartition(4)
    rows = frozen(with_row_ids(rows).select("row_id", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), shingles.sketch_column(F.col("doc.text")).alias("sketch")), "split-test")
    gone = shingles.repeated_rows(rows, most=most).join(rows, "row_id").select("doc_id").collect()
    assert {r.doc_id for r in gone} == set(range(len(texts))) - brute(texts)


def test_trie_join_proposes_candidates(spark):
    """Near copies that share no band are found by their fingerprints; what is linked is still decided by the sets."""
    rng = random.Random(21)
    texts = []
    for _ in range(12):
        base = prose(rng, 600, vocabulary=3000)
        texts += [base, edited(rng, base, 1), prose(rng, 40, vocabulary=3000)]
    rows = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    alone = F.struct("sketch.digest", F.array("doc.doc_id").alias("bands"), "sketch.print")
    rows = with_row_ids(rows).withColumn("sketch", shingles.sketch_column(F.col("doc.text")))
    rows = frozen(rows.select("row_id", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), alone.alias("sketch")), "trie-test")
    prints = dict(rows.select("doc_id", "sketch.print").collect())
    near = {k + 1 for k in range(0, 36, 3) if bin((prints[k] ^ prints[k + 1]) & (1 << 64) - 1).count("1") <= 4 and jaccard(texts[k], texts[k + 1]) >= 0.8}
    gone = shingles.repeated_rows(rows).join(rows, "row_id").select("doc_id").collect()
    assert len(near) > 5 and {r.doc_id for r in gone} == near


def test_groups_of_sets():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.choice(200, 60, replace=False)
        for drop in (0, 3, 8, 14):
            sets.append(np.unique(np.concatenate([base[drop:], rng.choice(200, drop)])).astype(np.uint64))
    label = shingles.groups_of(sets, 0.8)
    same = [set(s.tolist()) for s in sets]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(same[i] & same[j]) / len(same[i] | same[j]) >= 0.8 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert label.tolist() == want
