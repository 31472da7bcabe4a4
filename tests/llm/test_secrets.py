import hashlib
import random
import re
import string

from conftest import SCHEMA, prose, rows_of
from pyspark.sql import functions as F

from earshot.llm import secrets


def brute(text):
    """Spans of the patterns as they are stated, failing matches dropped."""
    out = []
    words = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    out += [(m.start(), 0, m.end()) for m in re.finditer(words + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


CASES = [
    "password: abc token: xyz1234", "secret=token: abcdef", "PassWord = 'hunter22'", "api_key:abcdef apikey=\"abc.def\"", "token=token=token=abcdef", "tokentoken = abcdef",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "Z9" * 8, "xAKIA" + "B" * 30, "0" * 23, "0" * 24, "g" + "ab" * 20 + "g", "é" * 7 + "ab" * 12, "password=" + "ab" * 12,
    "ſecret: abcdef", "secreT\x20\x20:\x20\x20\"abcdef", "secret\t: abcdef", "toKen: abcdef",
]


def test_patterns(spark, odd, odd_rows):
    texts = CASES + [r[1] for r in odd_rows]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    found = secrets.find_secrets(docs)
    rows = found.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.sha2(secrets.spans_text(F.col("base")), 256).alias("digest"), secrets.spans_text(F.col("spans")).alias("spans")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert [(s.start, s.kind, s.end) for s in r.base] == want
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for _, k, _ in want) for kind in range(3))
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.digest == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_battery_is_uniform_on_random_strings_and_small_on_others():
    rng = random.Random(2)
    for name, alphabet in secrets.ENCODINGS:
        for n in (24, 40, 80):
            scores = [s[1] for s in (secrets.battery("".join(rng.choice(alphabet) for _ in range(n))) for _ in range(600)) if s]
            assert 0.35 < sum(scores) / len(scores) < 0.65, (name, n)
            assert 0.3 < sum(u > 0.5 for u in scores) / len(scores) < 0.7, (name, n)
    for plain in ("aaaaaaaaaaaaaaaaaaaaaaaa1", "abcdefghijklmnopqrstuvwxyz0123456789", "0101010101010101010a10101", "version-2-2-2-2-2-2-2-2-2-2-2"):
        score = secrets.battery(plain)
        assert score is None or score[1] < 0.05, plain
    assert secrets.battery("a" * 30)[1] < 0.001 and secrets.battery("1" * 30)[1] < 0.001 and secrets.battery("ab1") is None


def test_added_spans_keep_false_discoveries_low(spark):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    texts, truth = [], {}
    for k in range(400):
        words = prose(rng, 60).split(" ")
        if k % 2:
            token = "".join(rng.choice(letters) for _ in range(rng.choice([32, 44, 60])))
            truth[k] = token
        else:  # long ordinary strings with digits
            token = "-".join(rng.choice(["alpha", "release", "build", "server", "2024", "01", "node"]) for _ in range(9)) + "-7"
        texts.append(" ".join([*words[:30], token, *words[30:]]))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    hit = {}
    for r in secrets.find_secrets(docs).collect():
        hit[r.doc_id] = [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == 3]
    right = sum(truth[k] in hit[k] for k in truth)
    wrong = sum(bool(hit[k]) for k in hit if k not in truth)
    assert right > 0.6 * len(truth) and wrong <= 0.05 * right + 1


def test_keys_glued_to_their_names(spark):
    rng = random.Random(8)
    letters = string.ascii_letters + string.digits
    forms = ["AWS_SECRET_ACCESS_KEY={}", "private_key={}", "client_id={}", "https://example.org/a?sig={}&n=1", "see https://example.org/b?x=1&signature={} there", "export SOME_LONG_VARIABLE_NAME_V2={}", "key=={}=="]
    texts, want = [], []
    for form in forms * 12:
        key = "".join(rng.choice(letters) for _ in range(40))
        texts.append(form.format(key))
        want.append(form.index("{"))
    for text, start in zip(texts, want):
        assert start in {c[0] for c in secrets.scan(text)[2]}, text
        assert secrets.CANDIDATE.search(text, start).group().rstrip("=") == text[start : start + 40]
    found = secrets.find_secrets(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert sum(want[r.doc_id] in {s.start for s in r.spans} for r in found) > 0.7 * len(texts)


def test_keys_inside_paths_and_names(spark):
    rng = random.Random(12)
    letters = string.ascii_letters + string.digits
    forms = ["https://ex.org/v1_2/files/{}/get", "/srv/my_app/{}", "hooks.example.org/services/T0_1/{}", "id-{}+x", "name_{}", "{}-{}", "a/b/{}=="]
    kinds = {"mixed": letters, "letters": string.ascii_letters, "lower": string.ascii_lowercase, "digits": string.digits}
    texts, want = [], []
    for kind in kinds.values():
        for form in forms * 30:
            keys = ["".join(rng.choice(kind) for _ in range(40)) for _ in range(2)]
            texts.append("see " + form.format(*keys) + " there")
            want.append(keys[: form.count("{}")])
    spans = lambda t: [(c[0], c[2]) for part in secrets.scan(t)[1:] for c in part]
    tested = sum(all(any(k in t[a:b] for a, b in spans(t)) for k in keys) for t, keys in zip(texts, want))
    assert tested == len(texts)  # every key is part of a candidate, or of a fixed pattern (digits)
    texts += [prose(rng, 80, vocabulary=3000) + " /usr/share/common_files/application-data/internationalization" for _ in range(200)]
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    found = sum(all(any(k in s or s.rstrip("=") in k for s in got[n]) for k in keys) for n, keys in enumerate(want))
    assert found >= 0.9 * len(want), found / len(want)
    assert sum(bool(got[n]) for n in range(len(want), len(texts))) <= 0.05 * found


def test_planted_keys_are_found_in_sparse_and_dense_strata(spark):
    rng = random.Random(6)
    for keys in (1, 2, 3, 10, 30, 100, 1000):  # uniform u, beside ordinary strings of small u
        kept, rounds = 0, max(5, 600 // keys)
        for _ in range(rounds):
            us = [rng.random() for _ in range(keys)]
            histogram = [0] * 100
            for u in [*us, *[0.0] * 50]:
                histogram[int(u * 100)] += 1
            cut = secrets.cut_of(histogram)
            kept += sum(u >= cut for u in us)
        assert kept > 0.88 * keys * rounds, (keys, kept / keys / rounds)
    letters = string.ascii_letters + string.digits
    for count in (1, 200):
        sizes = (22, 28, 36, 44, 56, 70, 130)  # a stratum each
        texts = [prose(rng, 20) + " " + "".join(rng.choice(letters) for _ in range(n)) for n in sizes for _ in range(count)]
        found = secrets.find_secrets(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
        assert sum(any(s.kind == 3 for s in r.spans) for r in found) > 0.84 * len(texts), count
    assert secrets.cut_of([0] * 100) == 0.5


def test_many_ordinary_strings_still_raise_the_cut():
    assert secrets.cut_of([900, *[20] * 20, *[0] * 79]) > 0.15
    histogram = [500 if k < 10 else 4 for k in range(100)]  # 400 random, the others small
    cut = secrets.cut_of(histogram)
    assert 0.08 <= cut <= 0.2


def test_redaction():
    spans = [dict(start=2, kind=0, end=6), dict(start=4, kind=2, end=9), dict(start=9, kind=3, end=10)]
    assert secrets.redact("0123456789ab", spans) == "01[SECRET][SECRET]ab"
    assert secrets.redact("0123456789ab", spans[:2]) == "01[SECRET]9ab"
    assert secrets.redact("abc", []) == "abc"


def test_empty(none):
    assert secrets.find_secrets(none).count() == 0
