import random

import pytest

CLASH = ["shard", "slot", "bucket", "row_id", "doc", "fp", "kept", "scan", "removed", "clean_text", "lang_key", "n_words", "place", "h"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def prose(rng, words, vocabulary=400):
    names = ["".join(rng.choice("abcdefghijklmnoprstuvwyzé") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    out = []
    for k in range(words):
        out.append(rng.choice(names) + (rng.choice([".", ".\n", ","]) if rng.random() < 0.12 else ""))
    return " ".join(out)


def rows_of(texts, ids=None, lang="en", source="s"):
    return [(i, t, lang, source, len(t) if t is not None else None, *["x"] * len(CLASH)) for i, t in zip(ids or range(len(texts)), texts)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 9000)
    plain = [prose(rng, n) for n in (1, 3, 4, 5, 49, 60, 80, 300)]
    texts = [None, "", " \t\n ", "a", "a a a a a", long, long, *plain, plain[-1], "x\x00y é ß 漢字   end", "  two  blanks \n\n and lines \r\n\t"]
    rows = rows_of(texts)
    rows.append(rows[-1])  # a repeated row
    rows.append((None, plain[6], None, None, None, *[None] * len(CLASH)))
    rows.append((None, None, None, None, None, *[None] * len(CLASH)))
    rows.append((3, "b", "en", "s", 1, *["y"] * len(CLASH)))  # an id twice with other text
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    path = __import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp") + "/odd"
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
