"""The pipeline: every stage on what the one before kept, decisions in effect, clean documents kept."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline as C
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute_print, brute_repeated
from weftline.llm import sentence_pieces, secret_scan


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(C.STAGES) - 1:
            assert sorted(out.columns) == sorted(C.COLUMNS), name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(C.STAGES) - 1:
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, ruled, unique, clean, redacted = kept
    assert set(ruled) <= set(start) and len(ruled) < len(start)
    assert all(len((start[d] or "").split()) >= 45 for d in ruled)
    # near duplicates: exactly the smallest id of each component stays
    of = brute_repeated([(d, tuple(brute_print(t, r) for r in range(C.REPETITIONS))) for d, t in ruled.items()])
    assert set(unique) == {d for d in of if of[d] == d}
    # decontamination: what goes, leaks
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = [(d, unique[d]) for d in unique if d not in clean and len(unique[d].split()) < 2000]
    for d, t in gone[:5]:
        assert leaks([(d, t)], items)
    # secrets: all documents stay, no span stays
    assert set(redacted) == set(clean)
    assert all(not secret_scan.spans_of(t) for t in redacted.values())
    # tokens: one row a document, ids of the text
    p = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(redacted)
    assert all(p.encode(redacted[r["doc_id"]]) == b"".join(x.to_bytes(4, "little") for x in r["ids"]) for r in rows[:40])


def test_run_is_the_stages(spark, sf_dir):
    assert C.run(spark, sf_dir).count() > 0


def test_empty_documents(spark, tmp_path, sf_dir):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    """Null, empty, repeated, tied and very long rows, null ids, and extra columns named like computed ones."""
    words = lambda seed, n: " ".join(f"{chr(97 + seed % 26)}{(seed * 7919 + i * i * 31 + i) % 999983}" for i in range(n))
    long = words(3, 120_000)
    rows = [(1, None), (2, ""), (3, words(1, 80)), (4, words(1, 80)), (5, words(2, 90)), (5, words(2, 90)), (6, long), (None, words(4, 70)), (7, words(5, 60) + " token=abcdefghijkl " + words(6, 60)), (8, "\n \t")]
    docs = spark.createDataFrame([(*r, "en", "s", 0, 1, "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _leaked long, _kept string, kept boolean")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(9, 40).split()))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 3), (False, 5), (False, 5), (False, 6), (False, 7), (True, 0)]
    p = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: p.decode(p_ids(r["ids"])) for r in got}
    assert texts[6] == long and "token=abc" not in texts[7] and "[secret]" in texts[7]


def p_ids(ids):
    import numpy as np

    return np.array(ids, "<i4")
