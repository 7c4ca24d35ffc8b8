"""Sources and sinks: errors, odd files, several files, ranges."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.sources import files as S
from weftline.sources import formats as M
from weftline.sources import sinks as K


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def test_lines_of_several_files_and_blocks(spark, tmp_path):
    for k in range(3):
        put(tmp_path, f"f{k}.txt", "".join(f"{k}:{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = S.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 6000 and all(r["line"] == f"{r['path'][-5]}:{r['at']}" for r in rows)


def test_broken_json_line_names_its_number(spark, tmp_path):
    p = put(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": \n')
    schema = spark.createDataFrame([], "a long").schema
    with pytest.raises(PySparkException, match="line 3"):
        S.read_json_lines(spark, p, schema).collect()
    assert [r["a"] for r in S.read_json_lines(spark, p, schema, 0, 2).collect()] == [1]


def test_csv_quotes_and_skip(spark, tmp_path):
    p = put(tmp_path, "a.csv", 'junk\n1,"a, ""b"""\n2,c\n')
    assert [tuple(r) for r in S.read_csv(spark, p, skip=1, kinds=["int", "string"], width=2).orderBy("c0").collect()] == [(1, 'a, "b"'), (2, "c")]
    assert [tuple(r) for r in S.read_csv(spark, p, skip=1, use=[1], width=2).orderBy("c1").collect()] == [('a, "b"',), ("c",)]


def test_malformed_subtitles(spark, tmp_path):
    p = put(tmp_path, "a.srt", "﻿1\n00:00:01,000 --> 00:00:02,000\nx\n\nnope\n00:00:01,000 --> 00:00:02,000\n")
    with pytest.raises(PySparkException, match="line 5"):
        M.read_srt(spark, p).collect()
    good = put(tmp_path, "b.srt", "﻿1\n00:00:01,000 --> 00:00:02,000\nx\n\n\n")
    assert [(r["num"], r["start"], r["lines"]) for r in M.read_srt(spark, good).collect()] == [(1, 1000, ["x"])]


def test_duplicate_vector_word(spark, tmp_path):
    with pytest.raises(PySparkException, match="duplicate word a"):
        M.read_vectors(spark, put(tmp_path, "v.txt", "a 1 2\na 3 4\n"), False).collect()


def test_unsupported_sources_say_so():
    for f in (S.read_7zip, S.read_msgpack, S.read_pickle, S.read_pdf, S.query_endpoint):
        with pytest.raises(S.Unsupported):
            f("x")


def test_typed_csv_round_trip_of_odd_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b,c', 1.5), (2, None, None), (3, "é", -0.25)], "k long, t string, v double")
    K.export_csv(df, f"{tmp_path}/x")
    got = K.import_csv(spark, f"{tmp_path}/x")
    assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_pattern_table_is_bounded(spark):
    with pytest.raises(ValueError):
        M.match_patterns(spark.range(1).select(F.lit("x").alias("a")), "a", spark.range(20).select(F.col("id").cast("string").alias("p")), "p", 10)


def test_chunk_sizes(spark, tmp_path):
    put(tmp_path, "d/a", b"0123456789")
    put(tmp_path, "d/b", b"")
    put(tmp_path, "d/c", b"ab")
    assert [bytes(r["chunk"]) for r in S.chunks_across(spark, f"{tmp_path}/d", 4).orderBy("at").collect()] == [b"0123", b"4567", b"89ab"]
    assert [bytes(r["chunk"]) for r in S.chunks(spark, f"{tmp_path}/d/a", 4, 1, 6).orderBy("at").collect()] == [b"1234", b"56"]
