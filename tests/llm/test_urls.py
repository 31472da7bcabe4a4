import random

import pytest

from earshot.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("x.org", "", "block"), ("É.org", "/ü", "block"), ("same.org", "/", "allow"), ("same.org", "/", "block")]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        raw, rest = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.fixture(scope="module")
def index(spark):
    return urls.build_index(urls.rules_table(spark, RULES))


def test_against_every_rule(spark, index):
    rng = random.Random(3)
    hosts = ["net", "example.net", "EXAMPLE.net", "a.b.example.net", "example.com", "xexample.com", "org", "x.org", "w.x.org", "É.org", "same.org", "", "net.", ".net", "a..net"]
    rests = ["", "/", "/en/", "/en", "/en/x", "/de/y?z", "/fr/#a", "?/en/", "#x", "/ü", "/üx", "/éa", "//en/", "\n/en/"]
    cases = [(k, f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(rests)}") for k in range(300)]
    cases += [(900, None), (901, ""), (902, "example.net/en/"), (903, "http://a://net/"), (None, "http://net/"), (903, "http://a://net/")]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in cases], "page_id long, url string, rule string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, index).collect()]
    folded = [(h.lower() if h.isascii() else h, p, "block" if h == "same.org" else v) for h, p, v in RULES]
    assert sorted(map(str, got)) == sorted(str((i, *brute(u, folded))) for i, u in cases)


def test_equal_digests_are_told_apart(index, monkeypatch):
    import xxhash

    reader = urls.RuleIndex(index)
    hit = reader.find([("net", "/")])
    assert hit == ["block"]
    # a probe that is given the digest of a rule it does not equal
    digest = xxhash.xxh64_intdigest(b"net/")
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: digest)
    assert urls.RuleIndex(index).find([("other.net", "/"), ("net", "/")]) == [None, "block"]


def test_many_segments(spark, monkeypatch):
    monkeypatch.setattr(urls, "SEGMENT_KEYS", 40)
    rules = spark.range(300).selectExpr("concat('h', id, '.com') AS host", "concat('/', id % 7) AS path", "if(id % 2 = 0, 'allow', 'block') AS verdict")
    folder = urls.build_index(rules)
    reader = urls.RuleIndex(folder)
    assert reader.bits == 3
    assert reader.find([(f"h{k}.com", f"/{k % 7}") for k in range(300)]) == ["allow" if k % 2 == 0 else "block" for k in range(300)]
    assert reader.find([(f"h{k}.com", "/8") for k in range(300)]) == [None] * 300


def test_empty_tables(spark, index):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge_urls(pages, index).count() == 0
    nothing = urls.build_index(urls.rules_table(spark, []))
    one = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert urls.judge_urls(one, nothing, otherwise="block").first().verdict == "block"


def test_a_host_of_many_labels(spark, index):
    import time

    url = "http://" + "a." * 100_000 + "example.net/en/x"
    reader = urls.RuleIndex(index)
    assert reader.labels == 2
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([url, url.replace("/en", "/de"), "http://" + "." * 50_000 + "org/fr/"])], "page_id long, url string")
    judged = urls.judge_urls(pages, index)
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in judged.collect()}
    assert got == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("org/fr/", "allow")} and time.time() - began < 20
