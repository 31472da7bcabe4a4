import random
from collections import Counter

import numpy as np
from conftest import SCHEMA, prose, rows_of

from earshot.llm.decontaminate import BlockIndex, find_leaks, similarity, simhash, shingles, without_leaks
from earshot.llm.words import hash_text, words_of


def brute(text, items, least=0.8):
    """Best similarity of each item over all windows of its length."""
    words, out = words_of(text or ""), {}
    for item, body in items:
        want = words_of(body or "")
        size = min(5, len(want))
        if not want:
            continue
        cut = lambda w: Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
        target = cut(want)
        best = max((similarity(cut(words[k : k + len(want)]), target) for k in range(len(words) - len(want) + 1)), default=0)
        if best >= least:
            out[item] = best
    return out


def test_against_every_window(spark):
    rng = random.Random(21)
    items = [(k, prose(rng, rng.randint(16, 60))) for k in range(12)] + [(100, "tiny item here"), (101, None), (102, " . "), (103, "w " * 20)]
    texts = [None, "", "short", prose(rng, 200), "a tiny ITEM, here it is", "w " * 50]
    for k, body in items[:12]:
        words = body.split(" ")
        for edits in (0, 1, 2, 4):
            changed = list(words)
            for at in rng.sample(range(len(words)), edits):
                changed[at] = "zzz"
            texts.append(prose(rng, 80) + " " + " ".join(changed) + " " + prose(rng, 50))
        longer = words[: len(words) // 2] + ["inserted"] + words[len(words) // 2 :]
        texts.append(prose(rng, 30) + ", " + " ".join(longer).upper())
        texts.append(" ".join(words[: len(words) // 2]) + " " + prose(rng, 60))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in find_leaks(docs, bench).collect():
        got.setdefault(r.doc_id, {})[r.item_id] = r.similarity
    want = {k: b for k, t in enumerate(texts) if (b := brute(t, items))}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys() and all(abs(got[k][i] - want[k][i]) < 1e-9 for i in want[k])
    clean = without_leaks(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - set(want)


def test_index_returns_all_within_the_radius():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(300)]
    index = BlockIndex(base, 24)
    for _ in range(300):
        value = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, 30)):
            value ^= 1 << b
        want = [k for k, v in enumerate(base) if bin(v ^ value).count("1") <= 24]
        assert index.near(value).tolist() == want


def test_similar_windows_lie_within_the_radius():
    rng = random.Random(6)
    worst = 0
    for _ in range(400):
        words = prose(rng, rng.randint(14, 60)).split(" ")
        changed = list(words)
        for at in rng.sample(range(len(words)), 2):
            changed[at] = "zzz"
        a, b = (shingles(hash_text(" ".join(w))) for w in (words, changed))
        if similarity(Counter(a.tolist()), Counter(b.tolist())) >= 0.8:
            worst = max(worst, bin(simhash(a) ^ simhash(b)).count("1"))
    assert worst <= 24


def test_words_of_batches_and_texts_agree():
    import pyarrow as pa

    from earshot.llm.words import batch_words

    texts = ["One two", None, "", "three", "ßé four-five", " x"]
    _, _, hashes, first, _ = batch_words(pa.array(texts))
    for k, text in enumerate(texts):
        assert np.array_equal(hashes[first[k] : first[k + 1]], hash_text(text or ""))
    assert words_of("Don't-STOP  É漢.") == ["don", "t", "stop", "É漢"]


def test_empty(spark, odd, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "these words are in no text of this table at all")], "item_id long, text string")
    assert find_leaks(odd, nothing).count() == 0 and find_leaks(none, one).count() == 0
    assert find_leaks(odd, one).count() == 0 and without_leaks(odd, nothing).count() == odd.count()
