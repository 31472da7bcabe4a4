import random
import re
from collections import Counter

from conftest import CLASH, SCHEMA, prose, rows_of
from pyspark.sql import functions as F

from earshot.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts(spark, odd, odd_rows):
    rng = random.Random(6)
    texts = ["a b c a b c", "a b c d a b c", "x x x x", "a b a b a b a", "l\nl\n\n \nl\r\nl\r", "#*$ %&|<> ##", "🙂 b c 🙂 b c", " ".join(rng.choice("abcd") for _ in range(3000)), (prose(rng, 40) + "\n") * 9]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    rows = quality.rate_documents(docs).collect()
    counts = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
    want = [(k, brute(t)) for k, t in enumerate(texts)] + [(r[0] + 100 if r[0] is not None else None, brute(r[1])) for r in odd_rows]
    assert sorted(str((r.doc_id, counts(r))) for r in rows) == sorted(map(str, want))
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_limits_follow_language_and_source(spark):
    rng = random.Random(9)
    rows, number = [], 0
    for lang, source, symbol, size in (("en", "web", 0.0, 300), ("en", "code", 1.0, 110), ("fr", "web", 0.0, 120), ("fr", "few", 0.0, 5), (None, None, 0.0, 5)):
        for k in range(size):
            words = prose(rng, 80).split(" ")
            if rng.random() < symbol or k == 0:
                words = [w + "$$" for w in words]
            rows.append((number, " ".join(words), lang, source, 1, *["x"] * len(CLASH)))
            number += 1
    got = {r.doc_id: r for r in quality.rate_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    junk = [k for k, r in enumerate(rows) if "$$" in r[1] and r[3] != "code"]
    # what is junk on the web is normal in code; small groups are judged by their language, the nameless by all
    assert [k for k in range(number) if not got[k].kept] == junk and len(junk) == 4


def test_sketch_quartiles_are_close(spark):
    rng = random.Random(12)
    values = [rng.lognormvariate(0, 1.5) for _ in range(4000)]
    rated = spark.createDataFrame([(v,) for v in values], "x double").selectExpr("'=a' AS lang_key", "'' AS source_key", "1L AS n_words", "x AS word_length", "0.0 AS symbol_rate", "x AS dup_line_rate", "x AS repeat_rate")
    row = quality.limits(quality.sketches(rated)).first()
    values.sort()
    q1, q3 = values[999], values[2999]
    high = q3 + max(quality.REACH * (q3 - q1), quality.MEASURES["word_length"][0])
    assert abs(row.word_length_high - high) < 0.03 * high
    assert row.symbol_rate_high == quality.MEASURES["symbol_rate"][0]


def test_stage_keeps_columns(spark, odd, odd_rows, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert 0 < kept.count() < len(odd_rows)
    assert quality.rate_documents(none).count() == 0 and quality.keep_good(none).count() == 0
