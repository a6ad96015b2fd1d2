"""License scans: normalised segments against licence templates by Dice coefficient over word bigrams.

A segment is a line, a paragraph of several lines, or a window of a template's
number of words anywhere in the text (the whole text if that is shorter); full
licence texts are compared with windows only.  With n and m distinct
bigrams the coefficient is at most 2 * min(n, m) / (n + m), so a template is
compared only with segments of between t / (2 - t) and (2 - t) / t times its
size; most segments are dropped by that bound before a bigram is made.  A match
also holds one of any m + 1 words of a template of which it may lack m, so texts
without such anchor words are left out by one pass over their words, and windows
are made only in texts that hold enough of a template's words.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import cut, text_of, with_bound

# Licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)
#: Full licence texts, named by their files.
TEXTS = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
LEAST_DICE = 0.85
#: Words that many texts hold; they are anchors only where a template has too few others.
COMMON = frozenset("a all and any are as at be but by can for from have if in is it its may must no not of on or other see shall such that the their these this to under use used version was were which will with within without work you your".split())


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _listed(items) -> Column:
    """A constant array of words or bigrams, as one literal."""
    return F.split(F.lit("|".join(items)), "\\|")


def _need(grams: list[str], least: float) -> int:
    """Bigrams that a match shares with a template: s >= least * (n + m) / 2 with m >= s."""
    return math.ceil(len(grams) * least / (2 - least) - 1e-9)


def _able(words: list[str], least: float) -> int:
    """Distinct words of a template that a match has: m bigrams fewer are at most m words fewer, one at least stays."""
    grams = bigrams(words)
    return max(1, len(set(words)) - (len(grams) - _need(grams, least)))


def anchors(templates, least: float) -> list[str]:
    """Words of which each match with a template holds one: of each template one more than it may lack, rare ones if possible."""
    out = set()
    for _, text in templates:
        w = template_words(text)
        if bigrams(w):
            own = sorted(set(w), key=lambda x: (x in COMMON, -len(x), x))
            out |= set(own[: len(own) - _able(w, least) + 1])
    return sorted(out)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def likely(docs: DataFrame, templates, least: float) -> DataFrame:
    """doc_id, _key, _text of the rows with an anchor word, the only ones that can match; written."""
    text = text_of(docs)
    held = F.arrays_overlap(F.split(F.lower(text), "[^a-z0-9]+"), _listed(anchors(templates, least)))
    return cut(docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("_key"), text.alias("_text")).where(held))


def window_matches(rows: DataFrame, templates, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, _key, license, dice: the best window of each template found, of all windows with its number of words.  rows: doc_id, _key, _text."""
    table, every = [], set()
    for name, text in templates:
        w = template_words(text)
        grams = bigrams(w)
        if not grams:
            continue
        every |= set(w)
        table.append(F.struct(F.lit(name).alias("license"), _listed(sorted(set(w))).alias("words"), _listed(grams).alias("grams"), F.lit(len(w) - 1).alias("k"), F.lit(_need(grams, least)).alias("need"), F.lit(_able(w, least)).alias("able")))
    df = rows.select("doc_id", "_key", _words(F.col("_text")).alias("_w")).withColumn("_f", F.array_intersect("_w", _listed(sorted(every))))
    # What a lambda uses is handed to it as its argument, else it would be made again for each element.
    fitting = F.transform(F.array("_f"), lambda f: F.filter(F.array(*table), lambda t: (F.size(f) >= t["able"]) & (F.size(F.array_intersect(f, t["words"])) >= t["able"])))[0]
    # The outer form does not evaluate the array twice, as a filter derived from an explode would.
    df = df.where(F.size("_w") > 1).select("doc_id", "_key", "_w", F.explode_outer(fitting).alias("_t")).where(F.col("_t").isNotNull())
    df = df.select("doc_id", "_key", "_t", F.transform(F.array("_w"), lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))[0].alias("_g"))
    df = cut(df.withColumn("_hit", F.array_intersect("_g", "_t.grams")).withColumn("_pin", F.rand(0)).where((F.size("_hit") >= F.col("_t.need")) & (F.col("_pin") >= 0)).select("doc_id", "_key", F.col("_t.license").alias("license"), F.size("_t.grams").alias("_m"), F.col("_t.k").alias("_k"), "_g", "_hit"))
    df = df.withColumn("_b", F.array(F.struct(F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))).alias("s"), F.col("_hit").alias("hit"), F.size("_g").alias("n"), F.least(F.size("_g"), "_k").alias("k"), F.col("_m").alias("m"))))
    # A bigram at i counts in the windows that begin after its last occurrence before i, at i - k + 1 at the earliest, and no later than i.
    begin = "greatest(0, x.i - b.k + 1, if(j > 0 and b.s[j - 1].g = x.g, b.s[j - 1].i + 1, 0))"
    marks = f"transform(b.s, (x, j) -> struct(x.i as i, {begin} as a, if(array_contains(b.hit, x.g), 1, 0) as h))"
    events = f"flatten(transform({marks}, m -> array(struct(m.a as at, 1 as d, m.h as s), struct(m.i + 1 as at, -1 as d, -m.h as s))))"
    # Running sums: a.d distinct bigrams, a.s of them shared, in each window that begins at a.at or later, before e.at.
    here = "if(e.at > a.at and a.at <= b.n - b.k, greatest(a.best, 2.0D * a.s / (a.d + b.m)), a.best)"
    best = f"aggregate(sort_array({events}), named_struct('at', 0, 'd', 0, 's', 0, 'best', 0.0D), (a, e) -> named_struct('at', e.at, 'd', a.d + e.d, 's', a.s + e.s, 'best', {here}), a -> a.best)"
    return df.select("doc_id", "_key", "license", F.expr(f"transform(_b, b -> {best})[0]").alias("dice")).where(F.col("dice") >= least)


def segment_matches(rows: DataFrame, templates, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, _key, license, dice of the lines and paragraphs that match.  rows: doc_id, _key, _text."""
    known = [(name, bigrams(template_words(text)), _able(template_words(text), least)) for name, text in templates]
    known = [(name, grams, able) for name, grams, able in known if grams]
    least_n = min(len(g) for _, g, _ in known) * least / (2 - least)
    most_n = max(len(g) for _, g, _ in known) * (2 - least) / least
    vocabulary = _listed(sorted({w for _, text in templates for w in template_words(text)}))
    least_able = min(able for *_, able in known)

    def grams(segment):
        """A segment's distinct bigrams, or null where the size bounds already exclude every template."""

        def made(w):
            pairs = F.array_distinct(F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
            # n distinct bigrams have at most n + 1 distinct words.
            able = (F.size(w) > least_n) & (F.size(F.array_distinct(w)) <= most_n + 1) & (F.size(F.array_intersect(w, vocabulary)) >= least_able)
            return F.when(able, pairs)

        # n bigrams take 2 n + 1 characters or more.
        return F.when(F.length(segment) > 2 * least_n, F.transform(F.array(_words(segment)), made)[0])

    # A paragraph joins the lines between blank ones; one of a single line is that line already.
    parts = F.concat(F.split("_text", "\n", -1), F.filter(F.split("_text", "\n[\\x20\\x09\\x0B-\\x0D]*\n"), lambda p: p.contains("\n")))
    seg = rows.select("doc_id", "_key", F.explode_outer(F.transform(parts, grams)).alias("_g"))
    seg = seg.where(F.size("_g").between(least_n - 1e-9, most_n + 1e-9))
    table = F.array(*[F.struct(F.lit(n).alias("license"), _listed(g).alias("grams")) for n, g, _ in known])
    pairs = seg.withColumn("_t", F.explode(table)).where(F.size("_g").between(F.size("_t.grams") * (least / (2 - least)) - 1e-9, F.size("_t.grams") * ((2 - least) / least) + 1e-9))
    dice = 2.0 * F.size(F.array_intersect("_g", "_t.grams")) / (F.size("_g") + F.size("_t.grams"))
    return pairs.select("doc_id", "_key", F.col("_t.license").alias("license"), dice.alias("dice")).where(F.col("dice") >= least)


def license_matches(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_DICE, texts=TEXTS) -> DataFrame:
    """doc_id, _key, license, dice: a row for each document and licence that it matches."""
    rows = likely(docs, (*templates, *texts), least)
    pairs = segment_matches(rows, templates, least).unionByName(window_matches(rows, (*templates, *texts), least))
    return pairs.groupBy("doc_id", "_key", "license").agg(F.max("dice").alias("dice"))


def license_scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST_DICE, texts=TEXTS) -> DataFrame:
    """doc_id, n_licenses (long), licenses (names in order, comma-joined), license (best, first by name on ties), dice: one row per input row.

    Null and empty texts match nothing (license null, dice 0); repeated rows
    of a document repeat its result, and two texts under one id are told apart;
    an empty table gives an empty result.
    """
    found = license_matches(docs, templates, least, texts).groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"))
    found = found.agg(F.array_sort(F.collect_set("license")).alias("_all"), F.array_sort(F.collect_list(F.struct((-F.col("dice")).alias("d"), "license"))).alias("_ranked"))
    found = with_bound(cut(found.select("_d", "_k", "_all", F.element_at("_ranked", 1).alias("_best"))))
    base = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text_of(docs)).alias("_key"))
    out = base.join(found, base["doc_id"].eqNullSafe(F.col("_d")) & (base["_key"] == F.col("_k")), "left")
    return out.select(
        "doc_id",
        F.coalesce(F.size("_all"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("_all", ","), F.lit("")).alias("licenses"),
        F.col("_best.license").alias("license"),
        F.coalesce(-F.col("_best.d"), F.lit(0.0)).alias("dice"),
    )
