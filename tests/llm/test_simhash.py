"""Operator 10 against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from weftline.llm import simhash as S


M = (1 << 64) - 1


def brute_mix(h, repetition):
    if not repetition:
        return h
    x = (h + repetition * 0x9E3779B97F4A7C15) & M
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M
    return x ^ x >> 31


def brute_print(text, repetition=0):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [brute_mix(xxhash.xxh64_intdigest(g.encode(), 42), repetition) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp); the smallest id of each component over links of at most four bits."""
    parent = {f: f for _, f in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = list(parent)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return {(d, f): least.get(root(f)) for d, f in rows}


def brute_repeated(rows):
    """rows: (doc_id, prints of all repetitions); the smallest id reachable over links of any repetition."""
    rows = sorted(rows)
    component = {d: d for d, _ in rows}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if component[a] != component[b] and any((p ^ q).bit_count() <= 4 for p, q in zip(x, y, strict=True)):
                low, high = sorted((component[a], component[b]))
                component = {d: low if c == high else c for d, c in component.items()}
    return component


def check(spark, docs):
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"] or -1) for r in S.near_duplicates(df).collect())
    rows = [(d, brute_print(t)) for d, t in docs]
    of = brute_components(rows)
    assert got == sorted((d or -1, f"{f:016x}", of[d, f] or -1) for d, f in rows)


def test_documents(spark, sf_dir):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_odd_rows(spark):
    check(spark, [(5, None), (3, ""), (9, " \n\t"), (7, "A b"), (8, "a B"), (2, "a b c d"), (2, "x y z w v"), (11, "É é " * 40), (4, "w " * 20_000), (None, "n u l l"), (1, "\x0b\x0c")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0


def chains(seed, n):
    """Random fingerprints and walks from them of one to six flipped bits."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(f)
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 6])):
                f ^= 1 << b
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("tile", "midpoints"), [(4096, S.MIDPOINTS), (8, S.MIDPOINTS), (8, 12)])
def test_links_lose_nothing(spark, tile, midpoints):
    prints = chains(3, 400) + [x ^ (1 << b) for x in (0,) for b in range(64)] + [0]
    prints = list(dict.fromkeys(prints))
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(prints)]
    edges = S.links(spark.createDataFrame(rows, "node long, fp long"), tile=tile, midpoints=midpoints)
    got = {r["node"]: r["component"] for r in S.components(edges).collect()}
    of = brute_components(list(enumerate(prints)))
    assert {i: got.get(i, i) for i in range(len(prints))} == {i: of[i, f] for i, f in enumerate(prints)}


def test_every_pair_within_two_bits_shares_an_anchor():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 31, 200).astype(np.uint64)
    near = w ^ (np.uint64(1) << rng.integers(0, 31, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 31, 200).astype(np.uint64))
    (r1, a1), (r2, a2) = S.anchors(w), S.anchors(near)
    for i in range(200):
        assert set(a1[r1 == i].tolist()) & set(a2[r2 == i].tolist())


def test_long_path_settles(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "u long, v long")
    assert {r["component"] for r in S.components(edges).collect()} == {0}


def test_representatives(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(4, text), (2, text), (3, text + " z"), (9, "other words here now"), (None, text)], "doc_id long, text string")
    assert sorted(r["doc_id"] or -1 for r in S.representatives(df).collect()) == [-1, 2, 9]


def variants(seed, n):
    """Texts of 150 words and copies of them with some words replaced."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        out.append(" ".join(words))
        for edits in (1, 2, 3, 5):
            copy = list(words)
            for at in rng.sample(range(150), edits):
                copy[at] = "new"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("tile", "midpoints"), [(4096, S.MIDPOINTS), (8, 12)])
def test_repetitions_link_what_any_of_them_links(spark, tile, midpoints, monkeypatch):
    monkeypatch.setattr(S.links, "__defaults__", (S.THRESHOLD, tile, midpoints))
    docs = list(enumerate(variants(5, 30)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    of = brute_repeated([(d, tuple(brute_print(t, r) for r in range(3))) for d, t in docs])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df, repetitions=3).collect()}
    assert got == {d: (f"{brute_print(t):016x}", of[d]) for d, t in docs}
    assert {r["doc_id"] for r in S.representatives(df, repetitions=3).collect()} == {d for d in of if of[d] == d}
    single = brute_repeated([(d, (brute_print(t),)) for d, t in docs])
    assert len(set(of.values())) < len(set(single.values()))  # repetitions find more copies


def test_repetitions_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, "a b c d e"), (8, "A b c d e"), (None, "x y"), (1, "w " * 20_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp1 int")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in S.near_duplicates(df, repetitions=4).collect())
    assert got == [(-1, -1), (1, 1), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert S.near_duplicates(df.limit(0), repetitions=4).count() == 0
