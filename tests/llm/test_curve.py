import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SCHEMA, prose, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earshot.llm import curve
from earshot.llm.curve import ChunkTokeniser, assemble, hilbert, pack_along_curve, tail_cuts, vector_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    return ChunkTokeniser(PATH)


PIECES = st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "a", "Word", "don't", "'s", "12", "é", "é", "́", "漢字", "ΣΑΣ", "ß", ".", "!?", "<|endoftext|>", "<|startoftext|>", "<|end", "\x1c", "\x85", "🙂"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=40)))
def test_ids_are_those_of_the_tokenizer(reference, own, text):
    assert np.frombuffer(own.encode(text), "<u4").tolist() == reference(text)


def test_ids_with_a_full_memory(reference, monkeypatch):
    monkeypatch.setattr(curve, "_CACHED", 20)
    own, rng = ChunkTokeniser(PATH), random.Random(1)
    for _ in range(3):
        text = prose(rng, 3000, vocabulary=2500) + " " + "x" * 50_000
        assert np.frombuffer(own.encode(text), "<u4").tolist() == reference(text)
    assert len(own.known) <= 20


def test_rare_words_are_merged_like_the_tokenizer(own):
    rng = random.Random(8)
    letters = "abcdefghijklmnoprstuvwyz" * 3 + "éèüßñçåøœæłžшщиопрαβγσςθİı'0123456789.,-#_ÀÉΑΒΣ½²ª"
    chunks = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(20_000)] + ["", "\x01", "<|endoftext|>", "a<|startoftext|>b", "漢字"]
    for chunk, ids in zip(chunks, own.ids_of(chunks), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(chunk, add_special_tokens=False).ids


def test_many_texts_at_once(own, reference):
    texts = [None, "", " ", "a b", "\n\n", "one\ntwo", "x" * 5000, None]
    ids, edges = own.encode_many(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [reference(t or "") for t in texts]


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    number = hilbert(cells, bits)
    assert sorted(number.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(number)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_tail_is_made_of_powers_of_two():
    for total in (0, 1, 63, 64, 65, 127, 128, 200):
        ends = tail_cuts(total, 64)
        sizes = np.diff([total - total % 64, *ends])
        assert sum(sizes) == total % 64 and all(bin(s).count("1") == 1 for s in sizes.tolist()) and sorted(sizes, reverse=True) == sizes.tolist()


def check(rows, docs, reference, capacity):
    """Every id once, sequences gapless and full but for powers of two."""
    held, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r.row_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens, r.doc_id))
        bins[r.sequence_id].append((r.offset, r.length))
    got = []
    for parts in held.values():
        parts.sort()
        at, ids = 0, b""
        for start, length, some, tokens, _ in parts:
            assert start == at and len(some) == 4 * length and length > 0
            at, ids = at + length, ids + some
        assert at == parts[0][3]
        got.append((parts[0][4], zlib.crc32(ids), at))
    want = [(d, zlib.crc32(np.array([*reference(t or ""), 2], "<u4").tobytes()), len(reference(t or "")) + 1) for d, t in docs]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and bin(at).count("1") == 1


def test_pieces_hold_every_id_once(spark, odd, odd_rows, none, reference):
    assert pack_along_curve(none).collect() == []
    for capacity, part_bytes in ((64, 64 << 20), (4096, 5000)):
        rows = pack_along_curve(odd, capacity, part_bytes=part_bytes).collect()
        check(rows, [(r[0], r[1]) for r in odd_rows], reference, capacity)


def test_neighbours_are_alike_and_copies_spread(spark, reference):
    rng = random.Random(3)
    topics = [[f"{a}{b}" for a, b in zip(rng.choices("bcdfghjk", k=60), rng.choices(["ale", "one", "ing", "tree", "est"], k=60))] for _ in range(8)]
    texts = [" ".join(rng.choices(topics[k % 8], k=120)) for k in range(400)] + ["the same text again"] * 200
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame(rows_of([texts[k] for k in order], ids=order), SCHEMA).repartition(4)
    # small parts: the copies alone fill several
    rows = pack_along_curve(docs, 256, part_bytes=4000).collect()
    check(rows, [(k, texts[k]) for k in order], reference, 256)
    line = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    place = [k for k, d in enumerate(line) if d >= 400]
    assert place[-1] - place[0] == 199  # copies lie together
    size = Tokenizer.from_file(PATH).get_vocab_size()
    vectors = {d: vector_of(np.array(reference(texts[d])), size, 11) / 4096 for d in range(400)}
    rest = [d for d in line if d < 400]
    near = np.mean([vectors[a] @ vectors[b] for a, b in zip(rest, rest[1:])])
    rng.shuffle(rest)
    far = np.mean([vectors[a] @ vectors[b] for a, b in zip(rest, rest[1:])])
    assert near > far + 0.5 * (1 - far)


def test_whole_sequences(spark, odd, odd_rows):
    pieces = pack_along_curve(odd, 64)
    whole = assemble(pieces, pad_id=7, capacity=64).collect()
    rows = {(r.row_id, r.start): r for r in pieces.collect()}
    assert sum(len(r.docs) for r in whole) == len(rows)
    for r in whole:
        ids = b"".join(bytes(rows[d.row_id, d.start].ids) for d in sorted(r.docs, key=lambda d: d.offset))
        assert bytes(r.ids) == ids
    short = spark.createDataFrame([(0, 0, 3, 1, 1, 0, bytearray(b"\1\0\0\0" * 3))], "sequence_id long, offset long, length long, row_id long, doc_id long, start long, ids binary")
    assert bytes(assemble(short, pad_id=7, capacity=8).first().ids) == b"\1\0\0\0" * 3 + b"\7\0\0\0" * 5
