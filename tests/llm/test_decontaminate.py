"""Operator 2 against a brute-force search by edit distance."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq

from weftline.llm import decontaminate as D


def brute(docs, items):
    out = {}
    for doc, text in docs:
        w = D.words_of(text)
        for item, t in items:
            x = D.words_of(t)
            if not w or not x:
                continue
            row = [0] * (len(w) + 1)
            for i, a in enumerate(x, 1):
                new = [i]
                for j, b in enumerate(w, 1):
                    new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
                row = new
            if min(row) <= D.allowed(len(x)) and doc is not None:
                out[doc, item] = min(out.get((doc, item), 10**9), min(row))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r["distance"] for r in D.leaks(d, b).collect()}


def test_planted_edits_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randint(5, 60)))) for k in range(40)]
    docs = []
    for k in range(160):
        w = items[k % 40][1].split()
        for _ in range(rng.randint(0, int(0.3 * len(w)))):
            at = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w[at] = word()
            elif kind == 1:
                w.insert(at, word())
            elif len(w) > 1:
                w.pop(at)
        text = " ".join([word() for _ in range(rng.randint(0, 60))] + w + [word() for _ in range(rng.randint(0, 60))])
        docs.append((k, text.upper() if k % 5 == 0 else text))
    expected, got = brute(docs, items), run(spark, docs, items)
    assert set(got) <= set(expected)
    assert all(got[k] == expected[k] for k in got)
    assert len(got) >= 0.98 * len(expected)
    # What differs by a tenth at most is always found.
    sizes = {k: len(t.split()) for k, t in items}
    assert all(k in got for k, d in expected.items() if d <= 0.1 * sizes[k[1]])


def test_driver_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    small = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(60).collect() if len((r["text"] or "").split()) < 3000]
    some = [(r["item_id"], r["text"]) for r in items.orderBy("item_id").limit(25).collect()]
    assert run(spark, small, some) == brute(small, some)


def test_odd_rows(spark):
    items = [(1, "a b c d e f"), (1, "a b c d e g"), (2, None), (3, ""), (4, "one"), (None, "q r s")]
    docs = [(1, None), (2, ""), (3, " \n "), (4, "A B C D E F"), (4, "a b c d e f"), (5, "one"), (6, "x " * 3000 + "a b c x e f"), (None, "a b c d e f")]
    got = run(spark, docs, items)
    assert got[4, 1] == 0 and got[6, 1] == 1 and got[5, 4] == 0 and {k for k in got if k[0] is not None} == {(4, 1), (6, 1), (5, 4)}
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_clean_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "z"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert sorted((r["doc_id"] or -1) for r in D.clean(docs, items).collect()) == [-1, 2, 3]


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "STEP_WORDS", 50)
    items = D.Items([(1, "p q r s t u v w x y")])
    import pyarrow as pa

    for at in range(30, 70):
        text = " ".join(["z"] * at + list("pqrstuvwxy") + ["z"] * 80)
        batch = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([text])], names=["doc_id", "text"])
        rows = [r for b in D._scan(items)(iter([batch])) for r in b.to_pylist()]
        assert min((r["distance"], r["doc_id"], r["item_id"]) for r in rows) == (0, 9, 1), at


def planted(rng, items, n):
    """Texts of real words that hold an item edited up to its threshold, with the item's number."""
    every = [w for _, t in items for w in t.split()]
    for _ in range(n):
        k = rng.randrange(len(items))
        w = items[k][1].split()
        for _ in range(D.allowed(len(w))):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            if kind == 0:
                w[at] = rng.choice(every)
            elif kind == 1:
                w.insert(at, rng.choice(every))
            elif len(w) > 1:
                w.pop(at)
        yield k, [rng.choice(every) for _ in range(rng.randint(0, 30))] + w + [rng.choice(every) for _ in range(rng.randint(0, 30))]


def recall(items, found, n=3000, seed=11):
    hits = 0
    for k, text in planted(random.Random(seed), items, n):
        words = np.array([0] * (found.longest + 1) + [found.vocabulary.get(w.encode(), 0) for w in text] + [0] * (found.longest + 1))
        hits += any(j == k for _, j, _ in found.search(words, np.zeros(len(words), int)))
    return hits / n


def test_recall_of_the_buckets_reaches_the_target(sf_dir):
    """On the driver's items with as many edits as the threshold allows, by words of the items, unlike those of the calibration."""
    items = [(r["item_id"], r["text"].lower()) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist() if r["text"]]
    found = D.Items(items)
    assert not any(c.exact for c in found.classes)
    assert recall(items, found) >= D.TARGET - 0.002
    assert recall(items, D.Items(items, target=0.5), 500) < 0.99  # the buckets decide


def test_class_out_of_repetitions_is_searched_exactly(sf_dir, monkeypatch):
    monkeypatch.setattr(D, "MOST_REPEATS", 1)
    items = [(r["item_id"], r["text"].lower()) for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist() if r["text"]][:40]
    found = D.Items(items)
    assert all(c.exact for c in found.classes)
    assert recall(items, found, 200) == 1.0


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(4, 20)))) for k in range(30)]
    docs = [(k, items[k % 30][1] + " z z " + items[(k + 7) % 30][1]) for k in range(50)]
    one = run(spark, docs, items)
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    assert run(spark, docs, items) == one
    assert all((k, k % 30) in one for k in range(50))
