import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
from check import compare, connect
from conftest import SCHEMA

import __spark_entry__ as entry_module
from earshot.llm import divergence
from earshot.llm.divergence import audit_sources, count_bitmaps, count_terms, group_totals, kept_terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most):
    """The audit from plain counts: rows are (lang, source, text)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(UPPER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}
    share = lambda c, n, v: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v) if v else 0
    totals = {g: sum(counts[g][t] for t in kept[g[0]]) for g in groups}
    for lang, source in groups:
        v = len(kept[lang])
        n = {s: totals[lang, s] for k, s in groups if k == lang}
        p = {s: [share(counts[lang, s][t], n[s], v) for t in kept[lang]] for s in n}
        every = [sum(counts[lang, s][t] for s in n) for t in kept[lang]]
        q = [share(c, sum(every), v) for c in every]
        pairs = [(s, sum(abs(a - b) for a, b in zip(p[source], p[s]))) for s in n if s != source]
        terms = [(t, a - b) for t, a, b in zip(kept[lang], p[source], q) if counts[lang, source][t] and a > b]
        for part, items, limit in (("pair", pairs, None), ("term", terms, most)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(rng, sources=9, docs=400):
    words = {lang: [lang + "".join(rng.choice("abcdeéxyz漢") for _ in range(rng.randint(1, 4))) for _ in range(150)] for lang in ("en", "de")}
    rows = []
    for k in range(docs):
        lang = "en" if rng.random() < 0.7 else "de"
        source = rng.choice(["hot"] * 4 + [f"s{j}" for j in range(sources)])
        own = sorted(rng.choices(words[lang], k=rng.randint(0, 90)), key=lambda w: zlib.crc32((w + source).encode()) % 7 > 2)
        rows.append((lang, source, " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", ".", "1"]) for w in own[: rng.randint(0, 90)])))
    rows += [("en", "empty", None), ("en", "blank", " 12 \n"), (None, None, "alone alone"), (None, "x", ""), ("fr", "only", "un deux " * 40), rows[0], rows[0]]
    return rows


def test_audit_equals_plain_counts(spark):
    rows = corpus(random.Random(4), sources=75)  # more sources than a tile holds
    docs = spark.createDataFrame([(k, t, lang, s, 0, *["x"] * 14) for k, (lang, s, t) in enumerate(rows)], SCHEMA).repartition(5)
    for least, most in ((3, 50), (20, 4), (10_000, 5)):
        got = sorted(tuple(r) for r in audit_sources(docs, least, most).collect())
        assert got == brute(rows, least, most)


def test_tiles_add_up_to_one_task(spark, monkeypatch):
    rows = corpus(random.Random(5), sources=7)
    docs = spark.createDataFrame([(k, t, lang, s, 0, *["x"] * 14) for k, (lang, s, t) in enumerate(rows)], SCHEMA)
    counts = count_terms(docs)
    kept = kept_terms(counts, 3)
    groups = group_totals(counts, kept, 1_000_000_000, 5)
    maps = count_bitmaps(kept, groups, 1_000_000_000, 5)
    # every kept term is once in the bitmaps of each group that uses it
    assert maps.selectExpr("sum(bit_count(bits))").first()[0] == groups.selectExpr("sum(used)").first()[0]
    import pyarrow as pa

    held = [r for r in maps.collect() if r.lang == "en"]
    table = lambda rs: pa.table({c: pa.array([getattr(r, c) for r in rs], pa.int64()) for c in ("sid", "word", "bits", "p", "p0")})
    key = lambda low, high: [pa.scalar(x) for x in ("en", 0, low, high)]
    cells = lambda t: Counter({(a, b): x for a, b, x in zip(*(t[c].to_pylist() for c in ("a", "b", "x")))})
    whole = cells(divergence._cells(key(0, 0), table(held)))
    monkeypatch.setattr(divergence, "TILE", 3)
    parts = Counter()
    tiles = max(r.sid for r in held) // 3 + 1
    assert tiles > 2
    for low in range(tiles):
        for high in range(low, tiles):
            parts.update(cells(divergence._cells(key(low, high), table([r for r in held if r.sid // 3 in (low, high)]))))
    assert {k: v for k, v in whole.items() if v} == {k: v for k, v in parts.items() if v}


def test_odd_and_empty_tables(spark, odd, odd_rows, none):
    assert audit_sources(none).collect() == []
    for least in (1, 3):
        got = sorted(tuple(r) for r in audit_sources(odd, least).collect())
        assert got == brute([(r[2], r[3], r[1]) for r in odd_rows], least, 50)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert duckdb and compare(connect(sf), entry_module.queries()["op11_divergence"](spark, sf), entry_module.oracle_sql()["op11_divergence"]) is None
