"""Text, CSV, JSON-lines, binary and archive sources, directory listings.

All go through Spark's readers, so any store that Spark knows will do; files are listed and split by it, and archives are
opened on the executors, one file a row.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordering import with_index

Names = Sequence[str]


class Unsupported(NotImplementedError):
    """A source that needs a library or a network that is not there."""


def unsupported(what: str) -> Callable:
    def refuse(*_, **__):
        raise Unsupported(f"{what} is not supported")

    return refuse


read_7zip = unsupported("the 7z format")
read_msgpack = unsupported("the msgpack format")
read_pickle = unsupported("pickle, which runs code of the file,")
write_msgpack = unsupported("the msgpack format")
write_pickle = unsupported("pickle, which no reader here takes,")
read_pdf = unsupported("text of PDF files")
read_torrents = unsupported("the bencode format")
read_http_cache = unsupported("a dbm cache")
query_endpoint = unsupported("a query over the network")
read_video = unsupported("media decoding")


def numbered_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """path, at, line: lines of each file with their 0-based numbers.

    A file's blocks are counted first (one number a block), so lines are numbered without gathering a file in one task.
    """
    reader = spark.read.option("encoding", encoding) if encoding else spark.read
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    sizes = lines.groupBy("path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    from pyspark.sql import Window as W

    before = sizes.select("path", "_block", "_first", (F.sum("_n").over(W.partitionBy("path").orderBy("_block")) - F.col("_n")).alias("_before"))
    return lines.join(before, ["path", "_block"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first")).alias("at"), "line")


def stripped_lines(spark: SparkSession, path: str) -> DataFrame:
    """line without its end, a carriage return included."""
    return spark.read.text(path).select(F.rtrim(F.col("value"), F.lit("\r\n")).alias("line"))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", skip: int = 0, use: Sequence[int] | None = None, kinds: Sequence[str] | None = None, encoding: str = "UTF-8", width: int | None = None) -> DataFrame:
    """c0, c1, ..: CSV without header; the first `skip` rows of each file go, columns are chosen by place and cast by `kinds`.

    The width is read from the first row unless it is given; only chosen columns are parsed.
    """
    if width is None:
        width = len(spark.read.option("sep", delimiter).option("encoding", encoding).csv(path).columns)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    reader = spark.read.schema(schema).option("sep", delimiter).option("encoding", encoding).option("quote", '"').option("escape", '"')
    df = reader.option("multiLine", skip > 0).csv(path)
    if skip:  # files are read whole then, so the rows of a file stand in one task in their order
        df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"))
        first = df.groupBy("_file").agg(F.min("_id").alias("_first"))
        df = df.join(first, "_file").where(F.col("_id") - F.col("_first") >= skip)
    chosen = list(use) if use is not None else list(range(width))
    return df.select(*[(F.col(f"c{i}").try_cast(kinds[k]) if kinds else F.col(f"c{i}")).alias(f"c{i}") for k, i in enumerate(chosen)])


def read_csv_header(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", delimiter: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).option("sep", delimiter).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Whole-document JSON; with a schema, a document that breaks it fails the read."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema).option("mode", "FAILFAST") if schema is not None else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, start: int = 0, stop: int | None = None) -> DataFrame:
    """Documents of the lines from start to stop of each file, blank lines counted and left out; a broken line fails with its number."""
    asked = (F.col("at") >= start) & (F.col("at") < stop if stop is not None else F.lit(True))
    lines = numbered_lines(spark, path).where(asked)
    text = F.ltrim(F.rtrim("line"), F.lit("\x00"))
    held = lines.select("path", "at", text.alias("line")).where("line <> ''")
    # A column for broken text makes the parser say which line it could not read.
    loose = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    parsed = held.withColumn("doc", F.from_json("line", loose, {"columnNameOfCorruptRecord": "_broken"}))
    failed = F.raise_error(F.concat(F.lit("broken JSON in line "), (F.col("at") + 1).cast("string"), F.lit(" of "), F.col("path"))).cast("string")
    checked = parsed.withColumn("line", F.when(asked & F.col("doc._broken").isNotNull(), failed).otherwise(F.col("line"))).where("line IS NOT NULL")
    return checked.select("path", "at", *[F.col(f"doc.{f.name}").alias(f.name) for f in schema.fields])


def chunks(spark: SparkSession, path: str, size: int, start: int = 0, amount: int | None = None) -> DataFrame:
    """path, at, chunk: each file's bytes from start on, in pieces of `size`."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", start + 1, amount if amount is not None else 2**31 - 1).alias("content"))
    last = F.greatest(F.floor((F.length("content") - 1) / size), F.lit(0)).cast("int")
    laid = files.where(F.length("content") > 0).select("path", "content", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return laid.select("path", "at", F.substr("content", F.col("at") * size + 1, F.lit(size)).alias("chunk"))


def chunks_across(spark: SparkSession, path: str, size: int) -> DataFrame:
    """at, chunk: the bytes of all files, one after the other by path, cut anew to `size`.

    Files are never gathered: each says from its offset which chunks it holds parts of, and parts meet per chunk.
    """
    from pyspark.sql import Window as W

    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    offsets = sizes.select("path", (F.sum("length").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).alias("base"))
    held = spark.read.format("binaryFile").load(path).where("length > 0").join(offsets, "path")
    first, last = F.floor(F.col("base") / size), F.floor((F.col("base") + F.col("length") - 1) / size)
    laid = held.select("base", "content", F.explode(F.sequence(first, last)).alias("at"))
    begin = F.greatest(F.col("at") * size - F.col("base"), F.lit(0))
    end = (F.col("at") + 1) * size - F.col("base")
    parts = laid.select("at", (F.col("base") + begin).alias("place"), F.substr("content", (begin + 1).cast("int"), (end - begin).cast("int")).alias("bytes"))
    joined = parts.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("place", F.hex("bytes").alias("h")))).alias("l"))
    return joined.select("at", F.unhex(F.array_join(F.transform("l", lambda x: x["h"]), "")).alias("chunk"))


# ---- archives


def _members(open_members: Callable[[bytes], Iterator[tuple[str, bytes]]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                for name, data in open_members(content):
                    yield pd.DataFrame({"path": [path], "name": [name], "content": [data]})

    return run


def zip_members(data: bytes, password: str | None = None) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                yield info.filename, z.read(info, password.encode() if password else None)


def tar_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r|*") as t:
        for m in t:
            if m.isreg():
                yield m.name, t.extractfile(m).read()


def _binary(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_zip(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """path, name, content of each file in zip archives."""
    return _binary(spark, path).select("path", "content").mapInPandas(_members(lambda b: zip_members(b, password)), "path string, name string, content binary")


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """The same for tar archives, compressed or not."""
    return _binary(spark, path).select("path", "content").mapInPandas(_members(tar_members), "path string, name string, content binary")


def read_tree(spark: SparkSession, path: str, archives: bool = False, joiner: str = "/") -> DataFrame:
    """name, content of all files below a folder; with archives, of their members by joined names."""

    def members(f: pd.DataFrame) -> Iterator[tuple[str, bytes]]:
        for p, content in zip(f["path"], f["content"], strict=True):
            low = p.lower()
            inner = zip_members if low.endswith(".zip") else tar_members if low.endswith((".tar", ".tgz", ".tar.gz", ".tbz", ".tar.bz2")) else None
            if inner is None or not archives:
                yield p, content
            else:
                for name, data in inner(content):
                    yield p + joiner + name, data

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = list(members(f))
            if rows:
                yield pd.DataFrame(rows, columns=["name", "content"])

    return _binary(spark, path, recursive=True).select("path", "content").mapInPandas(run, "name string, content binary")


# ---- listings: path, relative path, length and time of files; contents are not read


def listing(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, relative, length, modified of the files below root."""
    files = _binary(spark, root, glob, recursive).select("path", "length", F.col("modificationTime").alias("modified"))
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/")
    where = F.locate(base + "/", F.col("path"))
    return files.withColumn("relative", F.substr("path", where + len(base) + 1, F.lit(2**31 - 1)))


def by_extension(files: DataFrame, include: Names | None = None, exclude: Names | None = None) -> DataFrame:
    """Files whose extension (lower case, with its dot) is included and not excluded."""
    ext = F.lower(F.regexp_extract("relative", r"[^/](\.[^./]*)$", 1))
    out = files if include is None else files.where(ext.isin(*include))
    return out if exclude is None else out.where(~ext.isin(*exclude))


def with_depth(files: DataFrame) -> DataFrame:
    return files.withColumn("depth", F.size(F.split("relative", "/")) - 1)


def folder_counts(files: DataFrame, total: bool = False) -> DataFrame:
    """folder, dirs, files: what stands in each folder, or with total also below it. The root is ''."""
    parts = files.select(F.split("relative", "/").alias("p"))
    held = parts.select("p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("n"))
    folder = F.array_join(F.slice("p", F.lit(1), F.col("n")), "/")
    direct = F.size("p") - 1 == F.col("n")
    n_files = held.where(direct if not total else F.lit(True)).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    dirs = held.where("n > 0").select(F.slice("p", F.lit(1), F.col("n")).alias("d")).distinct()
    above = dirs.select("d", F.explode(F.sequence(F.lit(0), F.size("d") - 1)).alias("n")).where(F.lit(True) if total else F.col("n") == F.size("d") - 1)
    n_dirs = above.groupBy(F.array_join(F.slice("d", F.lit(1), F.col("n")), "/").alias("folder")).agg(F.count(F.lit(1)).alias("dirs"))
    folders = held.select(folder.alias("folder")).distinct()
    zero = F.lit(0).cast("long")
    return folders.join(n_files, "folder", "left").join(n_dirs, "folder", "left").select("folder", F.coalesce("dirs", zero).alias("dirs"), F.coalesce("files", zero).alias("files"))


def search(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose name matches a wildcard pattern."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in pattern)
    return files.where(F.regexp_extract("relative", "([^/]*)$", 1).rlike(f"^{regex}$"))


def equal_folders(spark: SparkSession, a: str, b: str) -> DataFrame:
    """relative, state (only_a, only_b, differs) of files that two folders do not share; contents are compared by digest."""

    def digests(root: str, name: str) -> DataFrame:
        base = root.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/")
        files = _binary(spark, root, recursive=True)
        return files.select(F.substr("path", F.locate(base + "/", F.col("path")) + len(base) + 1, F.lit(2**31 - 1)).alias("relative"), F.sha2("content", 256).alias(name))

    both = digests(a, "a").join(digests(b, "b"), "relative", "full")
    state = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") != F.col("b"), "differs")
    return both.select("relative", state.alias("state")).where("state IS NOT NULL")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines of all files with one global number, files by path."""
    return with_index(numbered_lines(spark, path), ["path", "at"], (), "number").select("number", "line")


def hash_files(spark: SparkSession, path: str, bits: int = 256) -> Column | DataFrame:
    """path and SHA-2 digest of each file."""
    return _binary(spark, path).select("path", F.sha2("content", bits).alias("digest"))
