"""Sources and sinks: tables of the driver are written to the shared folder in each format and read back."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from weftline.catalog import add
from weftline.functions import hashing as H
from weftline.session import scratch_dir, table
from weftline.sources import files as S
from weftline.sources import formats as M
from weftline.sources import sinks as K


def _put(s, lines, files=1):
    """Lines as text files in a new shared folder; its path."""
    path = scratch_dir(s)
    if files == 1:
        K.write_file(s, lines, path)
    else:
        for k in range(files):
            K.write_file(s, lines[k::files], f"{path}/f{k}")
    return path


def _put_bytes(s, names, make):
    """Binary files in a new shared folder, written through Hadoop's file system; its path."""
    path, jvm = scratch_dir(s), s._jvm
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{n}")
        out = p.getFileSystem(s._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(make(n)))
        out.close()
    return path


def _csv(s, d, **kw):
    path = scratch_dir(s)
    table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.options(**kw).csv(path)
    return path


add("iter_csv_suppliers", lambda s, d: S.read_csv(s, _csv(s, d)).select("c0", "c1", "c2"), "SELECT s_suppkey::VARCHAR AS c0, s_name AS c1, s_nationkey::VARCHAR AS c2 FROM supplier")
add("read_csv_columns", lambda s, d: S.read_csv(s, _csv(s, d, sep=";"), ";", 0, [0, 3], ["bigint", "double"]), "SELECT s_suppkey AS c0, s_acctbal AS c3 FROM supplier")
add("read_csv_skip", lambda s, d: S.read_csv(s, _put(s, ["# a", "# b", "1,x", "2,y"]), ",", 2, None, ["int", "string"], width=2), "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) t(c0, c1)")
add("read_csv_header_latin1", lambda s, d: S.read_csv_header(s, _csv(s, d, header="true", encoding="ISO-8859-1")).select("s_name", "s_nationkey"), "SELECT s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier")


def _jsonl(s, d):
    path = scratch_dir(s)
    K.write_json_lines(table(s, d, "nation").select("n_nationkey", "n_name"), path)
    return path


_NATION = "n_nationkey long, n_name string"


def _schema(s, ddl):
    return s.createDataFrame([], ddl).schema


add("read_json_lines_nation", lambda s, d: S.read_json_lines(s, _jsonl(s, d), _schema(s, _NATION)).select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")
add("json_lines_range", lambda s, d: S.read_json_lines(s, _put(s, ['{"a": 0}', "", "\x00\x00" + '{"a": 2}  ', '{"a": 3}', '{"a": 4}']), _schema(s, "a long"), 1, 4).select("at", "a"), "SELECT * FROM (VALUES (2::BIGINT, 2::BIGINT), (3, 3)) t(\"at\", a)")
add("write_json_lines_tee", lambda s, d: K.write_json_lines(table(s, d, "region").select("r_regionkey", "r_name"), scratch_dir(s)), "SELECT r_regionkey, r_name FROM region")
add("read_json_document", lambda s, d: S.read_json(s, _put(s, ["{", ' "a": {"b": [1, 2]},', ' "c": "x"', "}"]), _schema(s, "a struct<b:array<int>>, c string")).select(F.get("a.b", 1).alias("b"), "c"), "SELECT 2 AS b, 'x' AS c")


def _jl_to_csv(s, d):
    path = scratch_dir(s)
    K.json_lines_to_csv(s, _jsonl(s, d), path, _schema(s, _NATION), [F.col("n_name"), (F.col("n_nationkey") * 2).alias("k")])
    return S.read_csv(s, path)


add("jl_to_csv_nation", _jl_to_csv, "SELECT n_name AS c0, (n_nationkey * 2)::VARCHAR AS c1 FROM nation")


def _dump(s, d):
    n = K.dump_csv(table(s, d, "nation"), path := scratch_dir(s), {"n_name": "name", "n_nationkey": "id"})
    return S.read_csv_header(s, path, "UTF-8").select("name", "id", F.lit(n).cast("long").alias("n"))


add("dump_csv_nation", _dump, "SELECT n_name AS name, n_nationkey::VARCHAR AS id, CAST(25 AS BIGINT) AS n FROM nation")


def _typed(s, d):
    K.export_csv(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path := scratch_dir(s))
    return K.import_csv(s, path)


add("export_import_typed_csv", _typed, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
add("parquet_bytes_round_trip", lambda s, d: K.from_parquet_bytes(K.to_parquet_bytes(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")), "data", _schema(s, _NATION)), "SELECT n_nationkey, n_name FROM nation")


def _schema_bytes(s, d):
    import pyarrow.parquet as pq

    schema = pq.read_schema(io.BytesIO(K.schema_bytes(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"))))
    return s.createDataFrame([(f.name, str(f.type)) for f in schema], "name string, kind string")


add("parquet_schema_bytes", _schema_bytes, "SELECT * FROM (VALUES ('n_nationkey', 'int64'), ('n_name', 'string')) t(name, kind)")
add("batch_executer_orders", lambda s, d: K.run_batches(table(s, d, "orders").select("o_orderkey"), len, 500).agg(F.sum("rows").alias("n"), (F.max("rows") <= 500).alias("small")), "SELECT count(*)::BIGINT AS n, true AS small FROM orders")


def _refuse(f):
    if (f["id"] % 20 == 3).any():
        raise ValueError


add("safe_batch_executer", lambda s, d: K.run_batches(s.range(0, 100, 1, 4), _refuse, 5, (ValueError,)).groupBy("done").agg(F.sum("rows").alias("n")), "SELECT * FROM (VALUES (true, 75::BIGINT), (false, 25)) t(done, n)")

_LINES = [f"line {k}" for k in range(40)]
add("iter_lines_numbered", lambda s, d: S.numbered_lines(s, _put(s, _LINES)).select("at", "line"), "SELECT i AS at, 'line ' || i AS line FROM range(40) t(i)")
add("iter_stripped_lines", lambda s, d: S.stripped_lines(s, _put(s, ["a\r", "b  ", "c"])), "SELECT * FROM (VALUES ('a'), ('b  '), ('c')) t(line)")


def _gzip(s, d):
    path = scratch_dir(s)
    table(s, d, "nation").select("n_name").write.option("compression", "gzip").text(path)
    return S.stripped_lines(s, path)


add("copen_gzip_lines", _gzip, "SELECT n_name AS line FROM nation")
_BYTES = lambda s: _put_bytes(s, ["a.bin", "b.bin"], lambda n: bytes(range(0 if n == "a.bin" else 100, 25 if n == "a.bin" else 110)))
add("blockfile_chunks", lambda s, d: S.chunks(s, _BYTES(s), 10).select(F.substring_index("path", "/", -1).alias("f"), "at", F.hex("chunk").alias("h")),
    "SELECT * FROM (VALUES ('a.bin', 0, '00010203040506070809'), ('a.bin', 1, '0A0B0C0D0E0F10111213'), ('a.bin', 2, '1415161718'), ('b.bin', 0, '6465666768696A6B6C6D')) t(f, \"at\", h)")
add("blockfiles_across", lambda s, d: S.chunks_across(s, _BYTES(s), 10).select("at", F.hex("chunk").alias("h")),
    "SELECT * FROM (VALUES (0::BIGINT, '00010203040506070809'), (1, '0A0B0C0D0E0F10111213'), (2, '14151617186465666768'), (3, '696A6B6C6D')) t(\"at\", h)")


def _zip(_):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("dir/", "")
        z.writestr("dir/x.txt", "hello")
        z.writestr("y.txt", "world")
    return out.getvalue()


def _tar(_):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for n, b in (("x.txt", b"hello"), ("d/y.txt", b"world")):
            info = tarfile.TarInfo(n)
            info.size = len(b)
            t.addfile(info, io.BytesIO(b))
    return out.getvalue()


add("iter_zip_members", lambda s, d: S.read_zip(s, _put_bytes(s, ["a.zip"], _zip)).select("name", F.decode("content", "UTF-8").alias("v")), "SELECT * FROM (VALUES ('dir/x.txt', 'hello'), ('y.txt', 'world')) t(name, v)")
add("iter_tar_members", lambda s, d: S.read_tar(s, _put_bytes(s, ["a.tar.gz"], _tar)).select("name", F.decode("content", "UTF-8").alias("v")), "SELECT * FROM (VALUES ('x.txt', 'hello'), ('d/y.txt', 'world')) t(name, v)")
_TREE = ["a.txt", "b.TXT", "d/c.csv", "d/e/f.txt", "d/e/g.bin"]
_tree = lambda s: _put_bytes(s, _TREE, lambda n: n.encode())
add("iter_dir_archives", lambda s, d: S.read_tree(s, _put_bytes(s, ["a.zip", "p/b.txt"], lambda n: _zip(n) if n == "a.zip" else b"plain"), True, "!").select(F.substring_index("name", "/", -1).alias("n"), F.decode("content", "UTF-8").alias("v")), "SELECT * FROM (VALUES ('x.txt', 'hello'), ('a.zip!y.txt', 'world'), ('b.txt', 'plain')) t(n, v)")
add("scandir_rec", lambda s, d: S.listing(s, _tree(s)).select("relative", "length"), "SELECT r AS relative, length(r)::BIGINT AS length FROM (VALUES ('a.txt'), ('b.TXT'), ('d/c.csv'), ('d/e/f.txt'), ('d/e/g.bin')) t(r)")
add("scandir_ext", lambda s, d: S.by_extension(S.listing(s, _tree(s)), [".txt"]).select("relative"), "SELECT * FROM (VALUES ('a.txt'), ('b.TXT'), ('d/e/f.txt')) t(relative)")
add("scandir_depth", lambda s, d: S.with_depth(S.listing(s, _tree(s))).select("relative", "depth"), "SELECT r AS relative, length(r) - length(replace(r, '/', '')) AS depth FROM (VALUES ('a.txt'), ('b.TXT'), ('d/c.csv'), ('d/e/f.txt'), ('d/e/g.bin')) t(r)")
add("scandir_counts", lambda s, d: S.folder_counts(S.listing(s, _tree(s))), "SELECT * FROM (VALUES ('', 1::BIGINT, 2::BIGINT), ('d', 1, 1), ('d/e', 0, 2)) t(folder, dirs, files)")
add("scandir_counts_total", lambda s, d: S.folder_counts(S.listing(s, _tree(s)), True), "SELECT * FROM (VALUES ('', 2::BIGINT, 5::BIGINT), ('d', 1, 3), ('d/e', 0, 2)) t(folder, dirs, files)")
add("search_wildcard", lambda s, d: S.search(S.listing(s, _tree(s)), "?.txt").select("relative"), "SELECT * FROM (VALUES ('a.txt'), ('d/e/f.txt')) t(relative)")
add("equal_dirs_diff", lambda s, d: S.equal_folders(s, _tree(s), _put_bytes(s, [*_TREE[1:], "z"], lambda n: b"other" if n == "b.TXT" else n.encode())), "SELECT * FROM (VALUES ('a.txt', 'only_a'), ('b.TXT', 'differs'), ('z', 'only_b')) t(relative, state)")
add("hash_file_sha256", lambda s, d: S.hash_files(s, _put_bytes(s, _TREE[:2], lambda n: n.encode())).select("digest"), "SELECT sha256(r) AS digest FROM (VALUES ('a.txt'), ('b.TXT')) t(r)")
add("multi_hash_columns", lambda s, d: table(s, d, "region").select("r_regionkey", H.digest(F.col("r_name").cast("binary"), "md5").alias("md5"), H.digest(F.col("r_name").cast("binary"), "sha1").alias("sha1"), H.digest(F.col("r_name").cast("binary"), "sha256").alias("sha256")), "SELECT r_regionkey, md5(r_name) AS md5, sha1(r_name) AS sha1, sha256(r_name) AS sha256 FROM region")

_SRT = ["1", "00:00:01,500 --> 00:00:02,000", "- Hello", "there", "- You", "", "2", "01:02:03,004 --> 01:02:04,005", "Bye", ""]
add("srt_read", lambda s, d: M.read_srt(s, _put(s, _SRT)).select("num", "start", "end", F.array_join("lines", "|").alias("t")), "SELECT * FROM (VALUES (1, 1500::BIGINT, 2000::BIGINT, '- Hello|there|- You'), (2, 3723004, 3724005, 'Bye')) t(num, start, \"end\", t)")
add("srt_merge_lines", lambda s, d: M.read_srt(s, _put(s, _SRT)).select("num", F.array_join(M.merge_lines(F.col("lines"), "- "), "|").alias("t")), "SELECT * FROM (VALUES (1, 'Hello there|You'), (2, 'Bye')) t(num, t)")
add("srt_times", lambda s, d: s.range(0, 100_000_000, 7_654_321).select("id", M.to_time(F.col("id")).alias("t"), M.to_millis(M.to_time(F.col("id"))).alias("back")),
    "SELECT i AS id, printf('%02d:%02d:%02d,%03d', i // 3600000, i // 60000 % 60, i // 1000 % 60, i % 1000) AS t, i AS back FROM range(0, 100000000, 7654321) t(i)")
add("srt_write_read", lambda s, d: M.read_srt(s, _put(s, "\n".join(r[0] for r in M.read_srt(s, _put(s, _SRT)).orderBy("num").select(M.srt_text(F.col("num"), F.col("start"), F.col("end"), F.col("lines"))).collect()).split("\n"))).select("num", "end"), "SELECT * FROM (VALUES (1, 2000::BIGINT), (2, 3724005)) t(num, \"end\")")
add("sub_read", lambda s, d: M.read_microdvd(s, _put(s, ["{10}{20}a|b", "{30}{40}c"])).select("start", "end", F.array_join("lines", "+").alias("t")), "SELECT * FROM (VALUES (10, 20, 'a+b'), (30, 40, 'c')) t(start, \"end\", t)")
_VEC = ["3 2", "the 0.5 1.5", "of -1 2", "x 0 0"]
add("vectors_muse_format", lambda s, d: M.read_vectors(s, _put(s, _VEC), True, 2).select("word", "idx", "count", F.array_join(F.transform("vector", lambda x: x.cast("double").cast("string")), ",").alias("v")), "SELECT * FROM (VALUES ('the', 0::BIGINT, 2::BIGINT, '0.5,1.5'), ('of', 1, 1, '-1.0,2.0')) t(word, idx, count, v)")
add("vectors_glove_format", lambda s, d: M.read_vectors(s, _put(s, _VEC[1:]), False, None, lambda w: w != "of").select("word", "idx", "count"), "SELECT * FROM (VALUES ('the', 0::BIGINT, 2::BIGINT), ('x', 1, 1)) t(word, idx, count)")
add("vectors_add_words", lambda s, d: M.add_vectors(M.read_vectors(s, _put(s, _VEC[1:]), False), s.createDataFrame([("new", 0, 9, [1.0, 1.0])], "word string, place long, count long, vector array<float>")).select("word", "idx", "count"), "SELECT * FROM (VALUES ('the', 0::BIGINT, 3::BIGINT), ('of', 1, 2), ('x', 2, 1), ('new', 3, 9)) t(word, idx, count)")
add("load_freqs", lambda s, d: M.read_counts(s, _put(s, ["a 3", "b 1", "c 4"])), "SELECT * FROM (VALUES ('a', 3::BIGINT), ('b', 1), ('c', 4)) t(word, count)")
add("load_freqs_normalized", lambda s, d: M.read_counts(s, _put(s, ["a 3", "b 1", "c 4"]), True, 2), "SELECT * FROM (VALUES ('a', 0.75::DOUBLE), ('b', 0.25)) t(word, count)")
add("browscap_patterns", lambda s, d: M.match_patterns(s.createDataFrame([("Mozilla/5.0 (X11) Fox/1",), ("curl/8",)], "agent string"), "agent", s.createDataFrame([("mozilla/5.? (*) fox*", "fox"), ("curl*", "curl"), ("wget*", "wget")], "pattern string, kind string"), "pattern").select("agent", "kind"), "SELECT * FROM (VALUES ('Mozilla/5.0 (X11) Fox/1', 'fox'), ('curl/8', 'curl')) t(agent, kind)")
add("microdata_items", lambda s, d: s.createDataFrame([('<div itemscope itemtype="T"><span itemprop="name"> A <b>B</b></span><meta itemprop="m" content="5"><a itemprop="url" href="u">x</a></div>',)], "h string").select(M.microdata("h").alias("j")), """SELECT '{"T": [{"name": ["A B"], "m": ["5"], "url": ["u"]}]}' AS j""")
add("iterfetch_rows", lambda s, d: s.createDataFrame([(sum(1 for _ in table(s, d, "nation").toLocalIterator()),)], "n long"), "SELECT count(*) AS n FROM nation")
