import random

from conftest import CLASH, SCHEMA, prose, rows_of

from earshot.llm.repeats import remove_repeats, units_of


def brute(texts, kind, least):
    """Spans of each text, given in order of rank; ``texts``: (place, text)."""
    first, out = {}, {}
    for place, text in texts:
        run, spans = [], []
        for unit in [*units_of(text or "", kind), None]:
            old = unit is not None and unit[3] in first
            if unit is not None and not old:
                first[unit[3]] = (place, unit[0])
            if old:
                run.append((unit, first[unit[3]]))
            elif run:
                if sum(u[2] for u, _ in run) >= least:
                    spans.append((run[0][0][0], run[-1][0][1], sum(u[2] for u, _ in run), *run[0][1]))
                run = []
        out[place] = spans
    return out


def test_whole_corpus(spark):
    rng = random.Random(11)
    passage = prose(rng, 70)
    own = [prose(rng, 120) for _ in range(30)]
    texts = [t + ((". " if k % 2 else ".\n") + passage if k % 3 == 0 else "") for k, t in enumerate(own)]
    texts += [texts[4], texts[4], None, "", " \n ", "One two. " * 40, own[7].upper(), passage]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    for kind, least in (("clause", 25), ("sentence", 25), ("line", 10), ("paragraph", 1)):
        want = brute(list(enumerate(texts)), kind, least)
        rows = remove_repeats(docs, kind=kind, least_words=least).collect()
        assert len(rows) == len(texts)
        for r in rows:
            spans = [(s.start, s.end, s.words, s.kept_rank, s.kept_start) for s in r.removed or []]
            assert spans == want[r.doc_id], (kind, r.doc_id)
            kept = texts[r.doc_id]
            for start, end, *_ in reversed(spans):
                kept = kept[:start] + kept[end:]
            assert r.clean_text == kept
            assert r.removed_in == "x" and r.clean_text_in == "x"
    sentence = brute(list(enumerate(texts)), "clause", 25)
    # the shared passage goes from every document but the first, wherever it stands in its line
    assert all(sum(s[2] for s in sentence[k]) >= 50 for k in range(3, 30, 3)) and not sentence[0]
    assert not any(sentence[k] for k in range(1, 30) if k % 3)


def test_odd_rows(odd, odd_rows):
    rows = remove_repeats(odd, least_words=3).collect()
    assert len(rows) == len(odd_rows) and sum(r.clean_text is None for r in rows) == sum(r[1] is None for r in odd_rows)
    # of the two long texts with ids 5 and 6 the first stays whole, the other goes
    by_id = {r.doc_id: r for r in rows if r.doc_id in (5, 6)}
    assert len(by_id[5].clean_text) > 0.9 * len(by_id[5].text) and len(by_id[6].clean_text) < 0.1 * len(by_id[6].text)
    # a row without id never takes the place of one that has one
    assert all(s.kept_rank is not None for r in rows if r.doc_id is None for s in r.removed or [])


def test_empty(none):
    assert remove_repeats(none).count() == 0 and len(CLASH) > 0
