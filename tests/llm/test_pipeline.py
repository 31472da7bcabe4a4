import random
from collections import defaultdict

import corpus_pipeline
import duckdb
import pytest
from check import compare, connect
from conftest import SCHEMA, prose, rows_of

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables in which every stage has something to do."""
    rng = random.Random(17)
    clean = [prose(rng, 200, vocabulary=2000) for _ in range(120)]
    item = prose(rng, 40, vocabulary=2000)
    words = clean[5].split(" ")
    words[100] = "other"
    texts = [*clean, clean[3], " ".join(words), clean[8] + " " + item, clean[9] + " token = 'abcdef0123456789abcdef0123456789'", "too short", None, "same words " * 60, "| ".join(clean[10].split(" "))]
    rows = rows_of(texts)
    # documents 8 and 9 only in the form with the passage and the secret
    rows = [r for r in rows if r[0] not in (8, 9, 10)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path + "/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path, {r[0]: r[1] for r in rows}


def test_each_stage_acts_on_its_input(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    expected = [{124, 125, 126, 127}, {120, 121}, {122}, set()]
    for (name, stage), gone in zip(corpus_pipeline.STAGES, expected):
        before = {r.doc_id for r in docs.collect()}
        docs = corpus_pipeline.frozen(stage(spark, docs, path), "test-stage")
        after = {r.doc_id: r for r in docs.collect()}
        assert before - set(after) == gone, name
        assert sorted(docs.columns) == sorted(c.split()[0] for c in SCHEMA.split(", "))
        assert docs.count() == len(after)
        assert all(r.text == texts[i] for i, r in after.items() if i != 123)
    assert after[123].text.endswith(" [SECRET]'") and after[123].n_chars == len(after[123].text)
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(after)
    load = defaultdict(int)
    for r in pieces:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 1024
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces)


def test_stages_on_odd_and_empty_tables(spark, odd, none, folder):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder[0])
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder[0]).collect()


@pytest.mark.parametrize("name", ["op2_warc", "op4_urls"])
def test_query_equals_sql(spark, name):
    assert duckdb and compare(connect(SF), entry_module.queries()[name](spark, SF), entry_module.oracle_sql()[name]) is None
