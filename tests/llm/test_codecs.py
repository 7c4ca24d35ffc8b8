"""Operators 6 and 7: brute-force segmentation, the library's own ids, and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from weftline.llm import sentence_pieces as P
from weftline.llm import token_files as T

MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "\n", "  two  spaces ", "Hello world", "Don't we'll I'M it'S", "á é é İ ı ß ſ ŉ", "日本語 テキスト", "\U0001f600\U0001f468‍\U0001f469", "x" * 500,
    "<|endoftext|> a<|startoftext|>b <| |>", "12345 6.7e8", "▁ mark", "tab\tx\x0by\x0cz\r\n", " nbsp　x y", "\x00\x01\x7f", "Σας ΣΑΣ ς", "ǅ ﬁ ½ ² Ⅳ", "naïve café's ÀÉÎÕÜ ÿŸ Œœ", "a-b_c/d\\e#f", "''s 'S 're'RE",
]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


def test_word_ids_are_the_library_s(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    code = T.WordEncoder(VOCABULARY)
    assert code.plain
    got = code.encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]


def test_random_strings_as_the_library(spark):
    from tokenizers import Tokenizer

    lib, code, rng = Tokenizer.from_file(VOCABULARY), T.WordEncoder(VOCABULARY), random.Random(4)
    alphabet = "abcXYZ'stremdl 019.,!-_<|>\n\téÉ́ßİ×÷ŉ中\U0001f600 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for t, g in zip(texts, code.encode(texts), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 511, 512, 513, 5000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    c = T.Codes(T.pack(ids))
    assert len(c) == n
    assert c.slice(0, n).tolist() == ids.tolist()
    for i in rng.integers(0, n, min(n, 200)) if n else []:
        assert c.access(int(i)) == ids[i]
    for _ in range(20):
        a = int(rng.integers(0, n + 1))
        b = int(rng.integers(a, n + 1))
        assert c.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        c.access(n)


def test_token_table(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, start string, part int").repartition(5)
    got = T.token_table(df, VOCABULARY).collect()
    assert len(got) == len(rows)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    of = {}
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes.get(r[1], 0))):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        of.setdefault(doc, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = {}
    for r in sorted(got, key=lambda r: r["start"]):
        found.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], r["ids_crc32"]))
    assert found == of


def test_any_token_from_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string")
    T.write(df, path := f"{tmp_path}/t", VOCABULARY)
    files = spark.read.parquet(path)
    code = T.WordEncoder(VOCABULARY)
    all_ids = [int(x) for i in range(50) for x in [*np.frombuffer(code.encode([f"word{i} and more"])[0], "<u4"), 1]]
    for place in (0, 5, 77, len(all_ids) - 1):
        assert T.token(files, place) == all_ids[place]
    with pytest.raises(IndexError):
        T.token(files, len(all_ids))


def test_files_are_addressable(spark, tmp_path):
    """Codes lie uncompressed in the file, one segment a page: every segment's image is found there as it is."""
    import glob

    import pyarrow.parquet as pq

    df = spark.createDataFrame([(i, f"some words of {i} " * 4000) for i in range(40)], "doc_id long, text string")
    T.write(df, path := f"{tmp_path}/t", VOCABULARY, n=2)
    images = [bytes(r["codes"]) for r in spark.read.parquet(path).select("codes").collect()]
    assert len(images) > 4
    raw = b"".join(open(f, "rb").read() for f in glob.glob(f"{path}/*.parquet"))
    assert all(i in raw for i in images)
    meta = pq.ParquetFile(glob.glob(f"{path}/*.parquet")[0]).metadata.row_group(0)
    codes = next(meta.column(i) for i in range(meta.num_columns) if meta.column(i).path_in_schema == "codes")
    assert codes.compression == "UNCOMPRESSED" and not codes.has_dictionary_page and codes.has_offset_index


def test_memory_of_words_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(T, "CACHE_BYTES", 20_000)
    code, rng = T.WordEncoder(VOCABULARY), random.Random(6)
    for _ in range(20):
        before = code.held
        code.encode([" ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(40))])
        assert code.held <= max(before, 20_000) + 40 * 800 and sum(len(k) + len(v) for k, v in code.cache.items()) <= code.held


def test_an_id_that_all_rows_share(spark):
    rows = [(7, f"text number {i} of many") for i in range(400)]
    got = T.token_table(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect()
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["doc_id"] == 7
        at += r["n_tokens"]
    assert len(got) == 400


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_table(empty, VOCABULARY).count() == 0
    assert P.encoded(empty, MODEL).count() == 0


def brute_best(p: P.Pieces, lib, text: str) -> float:
    """The best score over the whole text by trying every piece at every place."""
    scores, longest = {}, 1
    for i in range(lib.vocab_size()):
        if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
            piece = lib.id_to_piece(i).replace(P.MARK, " ")
            scores[piece] = max(lib.get_score(i), scores.get(piece, float("-inf")))
            longest = max(longest, len(piece))
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(1, min(longest, end) + 1):
            s = scores.get(text[end - size : end])
            if s is None and size == 1:
                s = p.unknown_score
            if s is not None:
                best[end] = max(best[end], best[end - size] + s)
    return best[-1]


def test_best_path(texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    p = P.Pieces(MODEL)
    for t in ODD + [x[:400] for x in texts[len(ODD) : len(ODD) + 30] if x]:
        ids = np.frombuffer(p.encode(t), "<i4").tolist()
        if not t:
            assert ids == []
            continue
        score, k = 0.0, 0
        while k < len(ids):
            if lib.is_byte(ids[k]):
                first = p.bytes_of[ids[k]][0]
                n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                score, k = score + p.unknown_score, k + n
            else:
                score, k = score + lib.get_score(ids[k]), k + 1
        assert score == pytest.approx(brute_best(p, lib, " " + t.replace(P.MARK, " ")), rel=1e-9), repr(t)[:60]


def test_memory_of_segments_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 20_000)
    p, fresh, rng = P.Pieces(MODEL), P.Pieces(MODEL), random.Random(6)
    for _ in range(30):
        t = " ".join("".join(rng.choice("abcdeé中") for _ in range(rng.choice([3, 8, 2000]))) for _ in range(30))
        assert p.encode(t) == b"".join(np.array(fresh.best(s), "<i4").tobytes() for s in P._SEGMENTS.findall(" " + t))
        assert p.held <= 22_500 and sum(len(s) + len(g) for s, g in p.cache.items()) <= p.held


def test_very_long_text(spark):
    """Over a million characters, with and without spaces, in one text."""
    long = ["lorem ipsum dolor " * 70_000, "ab中" * 40_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    assert {r["text"] for r in P.decoded(P.encoded(df, MODEL), MODEL).collect()} == set(long)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCABULARY)
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_table(df, VOCABULARY).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(long)}


def test_round_trip(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, ids array<int>")
    got = P.encoded(df, MODEL)
    back = {r["doc_id"]: r["text"] for r in P.decoded(got, MODEL).collect()}
    for r in got.collect():
        t = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(r["ids"])
        assert r["round_trip"] == (P.MARK not in t)
        assert back[r["doc_id"]] == t.replace(P.MARK, " ")
