import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earshot.llm.packing import ByteBpe, best_fit_decreasing, lower_bound, pack, place


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    bpe = ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lambda text: np.frombuffer(bpe.encode(text), "<u4").tolist()


PIECES = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "a", "word", "don't", "12", "é", "漢字", "ß", ".", "!?", "<|endoftext|>", "\x1c", "\x85", "🙂", "'s"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=40)))
def test_ids_are_those_of_the_tokenizer_file(reference, own, text):
    assert own(text) == reference(text)


def brute(text, reference, most):
    ids = reference(text or "") + [2]
    head = (len(ids) - 1) % most + 1
    cuts = [0, *range(head, len(ids) + 1, most)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_pieces_and_places(odd, odd_rows, reference):
    pieces, places = pack(odd, 64)
    rows = pieces.join(places, ["row_id", "piece"]).collect()
    got = defaultdict(list)
    for r in rows:
        got[r.row_id].append((r.piece, r.start, r.length, zlib.crc32(bytes(r.ids))))
    want = sorted(map(str, ((r[0], brute(r[1], reference, 64)) for r in odd_rows)))
    ids = {r.row_id: r.doc_id for r in rows}
    assert sorted(str((ids[k], sorted(v))) for k, v in got.items()) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64


def test_no_documents(none):
    pieces, places = pack(none)
    assert pieces.count() == 0 and places.count() == 0


def brute_bins(lengths, capacity):
    """Fewest bins by exhaustive search."""
    best = [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= lengths[k]:
                go(k + 1, bins[:b] + [bins[b] - lengths[k]] + bins[b + 1 :])
        go(k + 1, bins + [capacity - lengths[k]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 21), st.data())
def test_bound_and_best_fit(capacity, data):
    lengths = np.array(data.draw(st.lists(st.integers(1, capacity), min_size=1, max_size=8)))
    bins = best_fit_decreasing(lengths, capacity)
    assert np.bincount(bins, weights=lengths).max() <= capacity
    fewest = brute_bins(sorted(lengths.tolist(), reverse=True), capacity)
    assert lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity) <= fewest <= bins.max() + 1


def test_exchange_does_not_lose_or_worsen(spark):
    path = __import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp") + "/items"
    spark.range(6000).selectExpr("id AS row_id", "0 AS piece", "1 + pmod(xxhash64(id), 700) AS length").write.parquet(path)
    items = spark.read.parquet(path)
    one, more = (place(items, 1000, per_part=400, rounds=r) for r in (0, 3))
    assert one.count() == more.count() == 6000 == more.select("row_id").distinct().count()
    fewest = -(-sum(r.length for r in items.collect()) // 1000)
    a, b = (p.select("sequence_id").distinct().count() for p in (one, more))
    assert fewest <= b <= a <= fewest + 15
    loads = more.join(items, "row_id").groupBy("sequence_id").agg({"length": "sum"}).agg({"sum(length)": "max"}).first()[0]
    assert loads <= 1000
