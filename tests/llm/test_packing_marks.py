import zlib

import numpy as np
import public_tokenizers
from conftest import SCHEMA, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from earshot.llm.packing import ByteBpe, added_tokens, pack

JSON = public_tokenizers.path("byte_bpe_50k.json")
DEFAULT = Tokenizer.from_file(JSON)  # as it is: no switch changed
OWN = ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(JSON))
MARK = "<|endoftext|>"
PARTS = st.sampled_from([MARK, MARK, "<|", "endoftext", "|>", "<|endoftext", " ", "  ", "\n", "word", " word", "don't", "12", "é", "漢字", ".", "🙂"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=14).map("".join), st.text(max_size=40)))
def test_ids_are_those_of_an_unchanged_tokenizer(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == DEFAULT.encode(text, add_special_tokens=False).ids


def test_marks_in_documents(spark):
    texts = ["a b", MARK, f"one text{MARK}another text", f" {MARK} \n{MARK}{MARK}tail ", "<|endoftext |>", None]
    pieces, _ = pack(spark.createDataFrame(rows_of(texts), SCHEMA), 1024)
    got = {r.doc_id: (r.length, zlib.crc32(bytes(r.ids))) for r in pieces.collect()}
    for k, text in enumerate(texts):
        ids = DEFAULT.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
