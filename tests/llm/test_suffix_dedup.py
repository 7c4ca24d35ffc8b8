"""Operator 3 against brute force over all strings of 100 bytes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from weftline.llm import suffix_dedup as S


def brute(docs):
    """docs: (doc_id, text) in any order; rows of one id are ordered by text."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode())):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - S.LENGTH + 1):
            part = raw[i : i + S.LENGTH]
            if part in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(part)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs, crowd=S.CROWD):
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n long, spans string").repartition(3)
    return sorted((tuple(r) for r in S.dedup(df, crowd).collect()), key=str)


def corpus(seed: int, n: int = 60) -> list:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randint(10, 80)) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(1, 40)) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.1:
            parts.append("ab" * rng.randint(40, 300))
        if rng.random() < 0.1:
            parts.append("x" * rng.randint(90, 500))
        docs.append((k, " ".join(parts)))
    return docs + [(1000 + k, docs[k * 7][1]) for k in range(5)]


@pytest.mark.parametrize(("seed", "crowd"), [(1, S.CROWD), (2, S.CROWD), (1, 3), (3, 0)])
def test_random_corpora(spark, seed, crowd):
    """crowd: also with surroundings of crowded hashes told by digests."""
    docs = corpus(seed)
    assert run(spark, docs, crowd) == brute(docs)


def test_one_passage_in_all_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    docs = [(k, f"{word()} {word()} {passage} {word()}") for k in range(300)]
    assert run(spark, docs) == brute(docs) == run(spark, docs, 20)


def test_repeats_of_a_task():
    """Across calls, in any order of places: what is told repeats an earlier place, and the earliest is never told."""
    rng = np.random.default_rng(2)
    r, seen = S.Repeats(bound=4), {}
    for _ in range(30):
        h, d = rng.integers(0, 3, 40).astype(np.uint64), rng.integers(0, 4, 40).astype(np.uint64)
        doc, n, lo = rng.permutation(100_000)[:40], np.zeros(40, np.int64), rng.integers(0, 9, 40)
        for i, told in enumerate(r.of(h, d, doc, n, lo)):
            seen.setdefault((h[i], d[i]), []).append((doc[i], lo[i], told))
    for rows in seen.values():
        assert not min(rows)[2]


def test_odd_rows(spark):
    long = "".join(chr(97 + (i * i) % 23) for i in range(150))
    docs = [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (4, long[:120]), (5, long[20:]), (None, long[:110]), (6, "é" * 60), (7, "é" * 200), (8, "x" * 99), (9, "x" * 101)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_driver_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bound", [3, 8_000_000])
def test_suffix_order(bound):
    """The order by induced sorting, with queues in memory and on disk, is the order of the strings."""
    rng = random.Random(5)
    for alphabet in ("ab", "abcd", "a"):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(8)]
        text = np.array([x for p in parts for x in [*(ord(c) - 96 for c in p), 0]], np.int16)
        got, common = S.suffix_order(text, 50, bound)
        assert sorted(got.tolist()) == list(range(len(text)))
        cut = lambda i: text[i : i + int(np.flatnonzero(text[i:] == 0)[0]) + 1].tolist()
        keys = [cut(i) for i in got]
        assert keys == sorted(keys)
        for a, b, c in zip(keys, keys[1:], common[1:].tolist(), strict=False):
            same = next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == 0)
            assert c == min(same, 50)


def test_common_prefixes_stop_at_the_depth():
    text = np.array(([1, 2] * 40 + [0]) * 3 + [1] * 90 + [0, 1] + [1] * 95 + [0], np.int16)
    got, common = S.suffix_order(text, 30)
    for a, b, c in zip(got, got[1:], common[1:].tolist(), strict=False):
        x, y = (list(text[i : i + 31]) for i in (a, b))
        same = next((i for i in range(min(len(x), len(y))) if x[i] != y[i] or x[i] == 0), 31)
        assert c == min(same, 30)


def test_crowds_of_a_task():
    """A row is called open only if the task has sent two digests of its hash before, and `few` rows of it."""
    rng = np.random.default_rng(3)
    crowds, sent = S.Crowds(few=5, bound=4), {}
    for _ in range(60):
        h, d = rng.integers(0, 6, 25).astype(np.uint64), rng.integers(0, 3, 25).astype(np.uint64)
        rest = rng.random(25) < 0.8
        told = crowds.of(h, d, rest)
        assert not (told & ~rest).any()
        for k in set(h[told].tolist()):
            assert len(sent[k]) >= 5 and len(set(sent[k])) > 1
        for i in np.flatnonzero(rest & ~told):
            sent.setdefault(int(h[i]), []).append(int(d[i]))
    assert any(len(v) < 60 for v in sent.values())


def test_a_line_between_texts_of_their_own(spark):
    """A common line with unlike neighbours in every document: each of three tasks sends FEW rows of its hashes and calls the others open."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(9))
    docs = [(k, f"{' '.join(word() for _ in range(rng.randint(5, 12)))} {line} {rng.choice(['x y z ' * 9, ''])}{word()} {word()} {line} {word()}") for k in range(900)]
    assert run(spark, docs) == brute(docs) == run(spark, docs, 5)


def test_shards(spark, monkeypatch):
    """Sorting in very small shards gives the same."""
    docs = corpus(9, 30)
    contexts = [t.encode()[:300] for _, t in docs if len(t) > 150]
    counts = np.array([len(c) - 99 for c in contexts])
    keep = counts > 0
    contexts, counts = [c for c, k in zip(contexts, keep, strict=True) if k], counts[keep]
    a = S.repeated_starts(contexts, counts)
    b = S.repeated_starts(contexts, counts, in_memory=50)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
