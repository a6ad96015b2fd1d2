"""Licence texts and notices inside larger units, windows against brute force."""

import random

from rivulet.llm import license_scan

SCHEMA = "doc_id long, text string"


def best_window(text, template):
    w, t = license_scan.template_words(text), license_scan.template_words(template)
    tg = set(license_scan.bigrams(t))
    k = min(len(t), len(w))
    grams = [set(license_scan.bigrams(w[i : i + k])) for i in range(len(w) - k + 1)]
    return max((2.0 * len(g & tg) / (len(g) + len(tg)) for g in grams), default=0.0)


def test_notices_in_larger_units_and_full_texts(spark):
    texts = dict(license_scan.TEXTS)
    data = [
        (1, "Copyright 2020 Foo Inc. All rights reserved."),
        (2, "Copyright 2020 Foo Inc.\nLicensed under the Apache License,\nVersion 2.0."),
        (3, "// some code before\n" + texts["MIT"].replace("\n", "\n// ") + "\nint main() { return 0; }"),
        (4, "Copyright (c) 2019, Someone\n\n" + texts["BSD-3-Clause"]), (5, texts["ISC"].upper()), (6, "intro words here\n" + texts["Apache-2.0"]),
        (7, "nothing of this kind, all the rights were reserved"), (8, None), (9, ""),
    ]
    got = {r["doc_id"]: (set(filter(None, r["licenses"].split(","))), r["license"], r["dice"]) for r in license_scan.license_scan(spark.createDataFrame(data, SCHEMA)).collect()}
    assert {i: got[i][1] for i in got} == {1: "proprietary", 2: "Apache-2.0", 3: "MIT", 4: "BSD-3-Clause", 5: "ISC", 6: "Apache-2.0", 7: None, 8: None, 9: None}
    assert all(got[i][2] == 1.0 for i in (1, 2, 3, 4, 5, 6)) and got[7][2] == 0.0


def test_windows_equal_brute_force(spark):
    rng = random.Random(2)
    templates = [("x", "a b c d e a b f"), ("y", "all rights reserved"), ("z", " ".join(rng.choice("abcdefgh") for _ in range(30)))]
    texts = []
    for i in range(150):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 25))]
        t = rng.choice(templates)[1].split()
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("abq")
        at = rng.randrange(len(words) + 1)
        texts.append(rng.choice([" ", "\n", ", "]).join(words[:at] + t + words[at:]) if i % 5 else " ".join(words[:4]))
    got = {(r["doc_id"], r["license"]): r["dice"] for r in license_scan.window_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, _text string").selectExpr("*", "1L AS _key"), templates, 0.7).collect()}
    want = {(i, n): best_window(t, p) for i, t in enumerate(texts) for n, p in templates}
    want = {k: v for k, v in want.items() if v >= 0.7}
    # No match is without an anchor word.
    held = {r["doc_id"] for r in license_scan.likely(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates, 0.7).collect()}
    assert held >= {i for i, _ in want}
    assert license_scan.likely(spark.createDataFrame([(1, "no such words"), (2, None)], SCHEMA), license_scan.TEMPLATES, 0.85).isEmpty()
    assert len(want) > 60 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_templates_of_one_word_and_short_ones(spark):
    """Bounds hold at the least sizes: one distinct word, one-letter words, ties and repeated rows."""
    data = [(1, "a a"), (2, "x\na b c d e f g h\ny"), (3, "b a"), (4, "a b c d e f g i"), (4, "a b c d e f g i"), (4, "other")]
    got = sorted((r["doc_id"], r["licenses"], r["license"]) for r in license_scan.license_scan(spark.createDataFrame(data, SCHEMA), templates=[("one", "a a"), ("z", "a b c d e f g h"), ("k", "h g a b c d e f g h")], least=0.75, texts=()).collect())
    assert got == [(1, "one", "one"), (2, "k,z", "z"), (3, "", None), (4, "", None), (4, "k,z", "z"), (4, "k,z", "z")]
