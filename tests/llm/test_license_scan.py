"""Operator 9: every template is found in running text, near texts by their Dice coefficient, clean texts stay clean."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from weftline.llm import license_scan as L


def bag(words):
    return Counter(zip(words, words[1:], strict=False))


@pytest.mark.parametrize("k", range(len(L.TEMPLATES)))
def test_each_template_is_found(k):
    name, text = L.TEMPLATES[k]
    known = L.Templates()
    words = ["filler"] * 30 + L.words_of(text.upper()) + ["more"] * 30
    found = known.find(words)
    assert name in {f[0] for f in found} and all(f[1] >= L.LEAST for f in found)


def test_scores_are_dice_coefficients():
    rng, known = random.Random(1), L.Templates()
    for name, text in L.TEMPLATES:
        w = L.words_of(text)
        if len(w) < 20:
            continue
        for share in (0.02, 0.05, 0.3):
            x = [rng.choice(["zzz", "yyy"]) if rng.random() < share else a for a in w]
            found = known.find(["pad"] * 20 + x + ["pad"] * 20)
            for lic, score, a, b in found:
                span = (["pad"] * 20 + x + ["pad"] * 20)[a:b]
                best = max(L.dice(bag(L.words_of(t)), bag(span)) for n, t in L.TEMPLATES if n == lic)
                assert best == pytest.approx(score, abs=1e-6) or best > score
            if share == 0.02 and L.dice(bag(w), bag(x)) > 0.9:
                assert name in {f[0] for f in found}


def test_table(spark):
    rows = [(1, None), (2, ""), (3, "MIT License"), (4, "prose without anything of that kind " * 50), (4, "Licensed under the Apache License, Version 2.0."), (5, " ".join(L._MIT for _ in range(3)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted((r["doc_id"], r["license"]) for r in L.licenses(df).collect())
    assert got == [(3, "MIT"), (4, "Apache-2.0"), (5, "MIT"), (5, "MIT"), (5, "MIT")]
    assert L.licenses(df.limit(0)).count() == 0


def test_templates_from_a_table(spark):
    own = spark.createDataFrame([("House-1.0", "you may use this text at home but never in the garden"), (None, "x y"), ("Empty", None)], "license string, text string")
    known = L.template_table(own)
    df = spark.createDataFrame([(1, "z z You may use this text at home, but never in the garden! z z"), (2, "MIT License")], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["dice"]) for r in L.licenses(df, known).collect()] == [(1, "House-1.0", 1.0)]
    assert L.licenses(df, L.template_table(own.limit(0))).count() == 0


def test_long_text_ties_and_clashing_columns(spark):
    many = " and ".join(["MIT License"] * 3000) + " word" * 200_000
    df = spark.createDataFrame([(1, many, 2, 0.5), (1, many, 3, 0.1)], "doc_id long, text string, first_word int, dice double")
    got = L.licenses(df)
    assert got.columns == ["doc_id", "license", "dice", "first_word", "end_word"] and got.count() == 6000  # repeated rows each for itself


@pytest.mark.parametrize("n", [5, 9, 15, 30])
@pytest.mark.parametrize("k", [k for k, (_, t) in enumerate(L.TEMPLATES) if len(L.words_of(t)) > 120])
def test_inserts_do_not_split_a_license(k, n):
    name, text = L.TEMPLATES[k]
    w = L.words_of(text)
    for at in (len(w) // 3, len(w) // 2, 2 * len(w) // 3):
        x = w[:at] + [f"new{i}" for i in range(n)] + w[at:]
        found = L.Templates().find(["pad"] * 20 + x + ["pad"] * 20)
        assert found == [(name, round(L.dice(bag(w), bag(x)), 6), 20, 20 + len(x))]


def test_replaced_holder_keeps_the_license():
    holder = L._BSD3.replace("the copyright holder", "the University of California, Berkeley")
    assert [f[0] for f in L.Templates().find(L.words_of(L._BSD2 + holder + L._BSD_END))] == ["BSD-3-Clause"]


def test_all_spans_by_brute_force():
    """Passages are the greedy choice among all spans of a text."""
    rng = random.Random(3)
    for _ in range(150):
        templates = [(f"t{k}", " ".join(rng.choice("abcde") for _ in range(rng.randint(2, 12)))) for k in range(3)]
        known, words = L.Templates(templates), [rng.choice("abcdexy") for _ in range(40)]
        for _, t in templates:
            at = rng.randrange(len(words))
            words[at:at] = t.split()
        spans = []
        for name, t in templates:
            size = len(t.split()) - 1
            for a in range(len(words)):
                for b in range(a + 2, len(words) + 1):
                    score = L.dice(bag(t.split()), bag(words[a:b]))
                    if score >= L.LEAST:
                        spans.append((-(score * min(1, size / 8)), -size, a, -b, name, score))
        taken = []
        for _, _, a, b, name, score in sorted(spans):
            if all(-b <= c or a >= d for _, _, c, d in taken):
                taken.append((name, round(score, 6), a, -b))
        assert known.find(words) == sorted(taken, key=lambda x: x[2])
