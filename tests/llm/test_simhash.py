import random

import numpy as np
import pytest
import xxhash
from conftest import rows_of, SCHEMA, prose
from pyspark.sql import functions as F

from earshot.llm import simhash
from earshot.llm.simhash import Rule, components, fingerprint, fingerprint_column, forest, linked, near_groups, rule_for, trie_join


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n\x0b", "One", "one TWO\tthree", "a b c d", "a b c d e", "É é\xa0x Ünder\u2003b c\x85d e f", "w " * 500, prose(random.Random(1), 3000)])
def test_fingerprint(text):
    assert fingerprint(text) == [brute_print(text)] and fingerprint(text, words=3)[0] == brute_print(text)


def brute_links(values, budget=4):
    v = np.array(sorted(values), dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= budget
    return {(int(v[i]), int(v[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)))}


def clustered(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            v = c
            for b in rng.sample(range(64), rng.randint(0, flips)):
                v ^= 1 << b
            out.add(v)
    return out | {0, 1, 15, 31, (1 << 64) - 1, 0xF << 32, 0x3 | 0x3 << 32}


def turned(v, k):
    return (v << k | v >> (64 - k)) & (1 << 64) - 1 if k else v


@pytest.mark.parametrize("leaf", [1, 64, 4096])
@pytest.mark.parametrize("rule", [Rule(), Rule(5, 5, 2), Rule(9, 9, 4)])
def test_trie_join_finds_every_pair_once(monkeypatch, leaf, rule):
    monkeypatch.setattr(simhash, "_LEAF", leaf)
    values, found = clustered(random.Random(leaf), 40, 20, 7), []
    for turn in range(rule.blocks):
        k = turn * rule.width
        keys = np.sort(np.array([turned(v, k) for v in values], dtype=np.uint64))
        for i, j in trie_join([keys], None, rule._replace(turn=turn)):
            found += [tuple(sorted((turned(a, 64 - k if k else 0), turned(b, 64 - k if k else 0)))) for a, b in zip(keys[i].tolist(), keys[j].tolist())]
    assert len(found) == len(set(found)) and set(found) == brute_links(values, rule.budget)


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {n: top(n) for n in nodes}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("node_rows", [10, 50_000])
def test_links_connect_all_that_are_near(spark, node_rows):
    values = sorted(clustered(random.Random(8), 25, 30, 5))
    place = {v: k for k, v in enumerate(values)}
    df = spark.createDataFrame([(k, [signed(v)]) for v, k in place.items()], "node long, fp array<long>")
    edges = [(r.a, r.b) for r in linked(df, node_rows=node_rows).collect()]
    assert all(bin(values[a] ^ values[b]).count("1") <= 4 for a, b in edges)
    want = roots(range(len(values)), [(place[a], place[b]) for a, b in brute_links(values)])
    assert roots(range(len(values)), edges) == want
    got = {r.node: r.root for r in components(linked(df, node_rows=node_rows)).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_words_beyond_the_first_count_for_the_whole(spark):
    rng = random.Random(13)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = [base]
    for flips in ((0, 0, 0, 9), (3, 4, 4, 4), (0, 0, 0, 16), (6, 1, 1, 1), (9, 0, 0, 0), (5, 5, 4, 1)):
        words = list(base)
        for k, n in enumerate(flips):
            for b in rng.sample(range(64), n):
                words[k] ^= 1 << b
        prints.append(words)
    rule = Rule(budget=8, whole=15, blocks=4)
    df = spark.createDataFrame([(k, [signed(w) for w in p]) for k, p in enumerate(prints)], "node long, fp array<long>")
    links = [(a, b) for a in range(len(prints)) for b in range(a) if bin(prints[a][0] ^ prints[b][0]).count("1") <= 8 and sum(bin(x ^ y).count("1") for x, y in zip(prints[a], prints[b])) <= 15]
    edges = [(r.a, r.b) for r in linked(df, rule).collect()]
    assert roots(range(len(prints)), edges) == roots(range(len(prints)), links) and 2 < len(set(roots(range(len(prints)), links).values())) < 7


def test_rule_finds_similar_texts():
    rng, rule, lost, wrong = random.Random(14), rule_for(0.8), 0, 0
    for _ in range(150):
        words = prose(rng, 300, vocabulary=3000).split(" ")
        for edits, near in ((2, True), (30, False)):
            other = list(words)
            for at in rng.sample(range(len(words)), edits):
                other[at] = "zzz"
            a, b = (fingerprint(" ".join(w), 5, words=4) for w in (words, other))
            bits = [bin(x ^ y).count("1") for x, y in zip(a, b)]
            linked_ = bits[0] <= rule.budget and sum(bits) <= rule.whole
            lost += near and not linked_
            wrong += linked_ and not near
    assert lost <= 1 and wrong == 0


def test_forest_is_short():
    n = 300
    i, j = np.triu_indices(n, 1)
    assert len(forest(n + 5, [(i, j), (i, j)])) == n - 1


def test_long_chain(spark):
    chain = spark.range(500).selectExpr("(id * 7919) % 500 AS k").selectExpr("k AS a", "k + 1 AS b")
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def test_documents(spark, odd, odd_rows, none):
    prints = odd.select("doc_id", fingerprint_column(F.col("text")).alias("fp"))
    rows = near_groups(simhash.frozen(prints, "t")).collect()
    values = [(r[0], fingerprint(r[1] or "")[0]) for r in odd_rows]
    top = roots({v for _, v in values}, brute_links({v for _, v in values}))
    least = {}
    for i, v in values:
        if i is not None:
            least[top[v]] = min(i, least.get(top[v], i))
    want = sorted(str((i, signed(v), least.get(top[v]))) for i, v in values)
    assert sorted(str((r.doc_id, r.fp[0], r.component_id)) for r in rows) == want
    empty = none.select("doc_id", fingerprint_column(F.col("text")).alias("fp"))
    assert near_groups(simhash.frozen(empty, "t")).count() == 0
    assert rows_of(["x"])[0][1] == "x" and SCHEMA
