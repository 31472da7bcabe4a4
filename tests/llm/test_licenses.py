import random

import numpy as np
from conftest import SCHEMA, prose, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm.licenses import TEMPLATES, align, parse_template, scan_licenses
from earshot.llm.words import words_of


def longest_common(a, b):
    rows = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1, j + 1] = rows[i, j] + 1 if x == y else max(rows[i, j + 1], rows[i + 1, j])
    return int(rows[-1, -1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=14), st.lists(st.integers(0, 12), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    best = longest_common(a, b)
    assert len(pairs) <= best
    if len(set(a)) == len(a) and len(set(b)) == len(b):
        assert len(pairs) == best  # all words are anchors, so nothing is missed


PLAIN = {(name, k): parse_template(text)[0] for name, texts in TEMPLATES.items() for k, text in enumerate(texts)}


def test_every_template_is_found_in_running_text(spark):
    rng = random.Random(3)
    texts, want = [], []
    for (name, k), body in PLAIN.items():
        before, after = prose(rng, 40), prose(rng, 2000)
        texts.append(f"{before}\n{body}\n{after}")
        want.append((name, k, len(before) + 1, body))
        words = body.split(" ")
        named = {i for a, b in parse_template(TEMPLATES[name][k])[1] for i in range(a, b)}
        if len(words) > 30 and len(words_of(body)) > 30:  # a few words changed and some added, but for the name
            places = [i for i in range(len(words)) if len(words_of(words[i])) == 1 and not ({j for j in range(len(words_of(" ".join(words[:i]))), len(words_of(" ".join(words[: i + 1]))))} & named)]
            for at in (places[3], places[9], places[15]):
                words[at] = "changed"
            texts.append(before.upper() + " " + " ".join(words).upper() + "\n" + after)
            want.append((name, k, len(before) + 1, " ".join(words)))
    texts += ["Licensed under the Foo License.", "the of and to license", prose(rng, 3000), None, "", "Released under the MIT License. " * 5]
    got = {}
    for r in scan_licenses(spark.createDataFrame(rows_of(texts), SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, (name, number, start, body) in enumerate(want):
        assert len(got[k]) == 1, (k, name, got.get(k))
        hit = got[k][0]
        assert (hit.license, hit.template) == (name, number) and hit.start == start, (name, number, hit)
        assert hit.coverage >= 0.8 and abs(hit.end - start - len(body)) < 4
    assert set(got) == {*range(len(want)), len(texts) - 1}
    assert len(got[len(texts) - 1]) == 5


def test_siblings_are_told_apart(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 2.0.": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 2.1.": None,
        "This work is licensed under the GNU General Public License, version 3. 2024 Someone": "GPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        gpl.format("", "2"): "GPL-2.0", gpl.format("", "3"): "GPL-3.0", gpl.format("Affero", "3"): "AGPL-3.0", gpl.format("Lesser", "2.1"): "LGPL-2.1", gpl.format("Lesser", "3"): "LGPL-3.0",
        gpl.format("", "4"): None, gpl.format("Foo", "3"): None,
        PLAIN["BSD-3-Clause", 0]: "BSD-3-Clause", PLAIN["BSD-2-Clause", 0]: "BSD-2-Clause",
        "Licensed under the Apache License, Version 1.1.": None, "Licensed under the MIT-0 License.": None, "Licensed under CC BY 3.0.": None, "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
    }
    for parts in ("", "-ShareAlike", "-NonCommercial", "-NoDerivatives", "-NonCommercial-ShareAlike", "-NonCommercial-NoDerivatives"):
        short = "".join({"S": "-SA", "N": "-NC" if "Com" in p else "-ND"}[p[0]] for p in parts.split("-")[1:])
        cases[f"This work is licensed under a Creative Commons Attribution{parts} 4.0 International License."] = f"CC-BY{short}-4.0"
        cases[f"licensed under cc by{short.lower()} 4.0"] = f"CC-BY{short}-4.0"
    rows = scan_licenses(spark.createDataFrame(rows_of(list(cases)), SCHEMA)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.license)
    for k, (text, license_) in enumerate(cases.items()):
        assert got.get(k, []) == ([license_] if license_ else []), text


def brute(text, limit):
    """Licenses with a place whose coverage by longest common subsequences reaches ``limit``."""
    words, out = words_of(text), set()
    for name, texts in TEMPLATES.items():
        for raw in texts:
            plain, parts = parse_template(raw)
            template = words_of(plain)
            places = [[p for p in range(len(words)) if words[p : p + b - a] == template[a:b]] for a, b in parts]
            for first in places[0]:
                pins = [first]
                for k in range(1, len(parts)):
                    pins += [p for p in places[k] if 0 <= p - pins[-1] - (parts[k - 1][1] - parts[k - 1][0]) and p - pins[-1] <= 1.5 * (parts[k][0] - parts[k - 1][0])][:1]
                if len(pins) < len(parts):
                    continue
                cover = sum(b - a for a, b in parts)
                ends = [(max(0, first - -(-3 * parts[0][0] // 2)), 0), *[(p + b - a, b) for p, (a, b) in zip(pins, parts)]]
                starts = [*[(p, a) for p, (a, b) in zip(pins, parts)], (ends[-1][0] + -(-3 * (len(template) - parts[-1][1]) // 2), len(template))]
                for (p, q), (r, s) in zip(ends, starts):
                    cover += longest_common(words[p:r], template[q:s])
                if cover >= limit * len(template):
                    out.add(name)
    return out


def test_scan_equals_brute_force(spark):
    rng = random.Random(9)
    texts = []
    short = [t for t in PLAIN.values() if len(t) < 420]
    for _ in range(60):
        words = (prose(rng, 8) + " " + rng.choice(short) + " " + prose(rng, 8) + " " + rng.choice(short)).split(" ")
        for _ in range(rng.randint(0, len(words) // 5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([["other"], ["one", "more"], []])
        texts.append(" ".join(words))
    got = {}
    for r in scan_licenses(spark.createDataFrame(rows_of(texts), SCHEMA)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    hit = 0
    for k, text in enumerate(texts):
        found = got.get(k, set())
        assert found <= brute(text, 0.8 - 1e-9), text
        hit += len(found)
        # of overlapping places only one is kept, so a sibling of a longer notice may be left out
        assert {name.split("-")[0] for name in brute(text, 0.9)} <= {name.split("-")[0] for name in found}, text
    assert hit > 40


def test_changed_beyond_the_limit_is_not_found(spark):
    words = PLAIN["ISC", 0].split(" ")
    for k in range(0, len(words), 3):
        words[k] = "other"
    assert scan_licenses(spark.createDataFrame(rows_of([" ".join(words)]), SCHEMA)).count() == 0


def test_odd_rows(spark, odd, none):
    assert scan_licenses(odd).count() == 0 and scan_licenses(none).count() == 0
    notice = "Licensed under CC BY 4.0."
    rows = rows_of([notice, notice, None, "", notice + " " + notice, "x" * 100_000 + " " + notice], ids=[7, 7, 7, 8, None, 9])
    rows.append((None, notice, None, None, None, *[None] * (len(rows[0]) - 5)))
    got = sorted((str(r.doc_id), r.license, r.start, r.end) for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([("7", "CC-BY-4.0", 0, 24)] * 2 + [("None", "CC-BY-4.0", 0, 24), ("None", "CC-BY-4.0", 26, 50), ("None", "CC-BY-4.0", 0, 24), ("9", "CC-BY-4.0", 100_001, 100_025)])
