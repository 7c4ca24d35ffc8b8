"""Words of documents in blocks, so that what meets a vocabulary is a block's distinct words and not every word.

A block is one row: some documents of about WORDS words in all, their words as places (codes) in the list of the block's distinct words. Tables of
words are joined with these lists, and come back to the block by its number; documents and their words are never dealt out one by one. Blocks are
written once, as only stored numbers mean the same to everyone who reads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weftline.session import written

#: Words of a block, about; a longer document is one block.
WORDS = 1 << 20


def numbers(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy())


def listed(values: pa.Array, sizes: np.ndarray | None = None) -> pa.ListArray:
    """Lists of so many values each; without sizes one list of all."""
    ends = np.concatenate([[0], np.cumsum([len(values)] if sizes is None else sizes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, values, places to blocks; documents without values go."""
    part, k = TaskContext.get().partitionId(), 0
    for b in batches:
        docs, lists, places = b.column(0), b.column(1), b.column(2)
        sizes = numbers(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        held = np.flatnonzero(sizes)
        for of in np.split(held, np.flatnonzero(np.diff(np.cumsum(sizes[held]) // WORDS)) + 1):
            if not len(of):
                continue
            of = of[numbers(pc.sort_indices(docs.take(pa.array(of))))]  # nulls last
            own, ends = docs.take(pa.array(of)), np.cumsum(sizes[of])
            coded = lists.take(pa.array(of)).flatten().dictionary_encode()
            codes, values = numbers(coded.indices), coded.dictionary
            at = None if places.null_count else places.take(pa.array(of)).flatten()
            first = np.empty(len(values), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            first_doc = np.searchsorted(ends, first, "right")
            first_pos = first - (ends - sizes[of])[first_doc] if at is None else numbers(at)[first]
            columns = [
                pa.array([(part << 32) + k], pa.int64()),
                listed(own),
                listed(pa.array(sizes[of], pa.int32())),
                pa.array([None], pa.list_(pa.int32())) if at is None else listed(at),
                listed(pa.array(codes, pa.int32())),
                listed(values),
                listed(pa.array(np.bincount(codes, minlength=len(values)), pa.int64())),
                listed(own.take(pa.array(first_doc))),
                listed(pa.array(first_pos, pa.int32())),
            ]
            k += 1
            yield pa.RecordBatch.from_arrays(columns, names=["block", "docs", "sizes", "places", "codes", "words", "counts", "first_docs", "first_places"])


def pack(lists: DataFrame) -> DataFrame:
    """Blocks of a table doc, values[, places]: a block's documents in order of doc, their sizes, places (null: 0, 1, ..), codes; and of each distinct value its count and first place."""
    doc, value = lists.schema["doc"].dataType.simpleString(), lists.schema["values"].dataType.elementType.simpleString()
    places = F.col("places") if "places" in lists.columns else F.lit(None).cast("array<int>").alias("places")
    schema = f"block long, docs array<{doc}>, sizes array<int>, places array<int>, codes array<int>, words array<{value}>, counts array<bigint>, first_docs array<{doc}>, first_places array<int>"
    return written(lists.select("doc", "values", places).mapInArrow(_packed, schema))


def repeated(blocks: DataFrame) -> bool:
    """Whether a document's id comes more than once."""
    ids = blocks.select(F.explode("docs").alias("doc"))
    return not ids.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).isEmpty()


def grouped(tok: DataFrame) -> DataFrame:
    """Blocks of a table doc, pos, token; rows of an equal id are one document. Rows without a token go."""
    docs = tok.where("token IS NOT NULL").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "token"))).alias("w"))
    return pack(docs.select("doc", F.col("w.token").alias("values"), F.col("w.pos").alias("places")))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of the lower-cased words of texts, each text whole."""
    return packed_lists(docs.select(F.col(id_col), F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+").alias("words")), id_col, "words")


def packed_lists(docs: DataFrame, id_col: str, words: str) -> DataFrame:
    """Blocks of lists of words; nulls and empty words go, and rows of an equal id are one document."""
    held = docs.select(F.col(id_col).alias("doc"), F.filter(F.col(words), lambda w: w != "").alias("values"))
    blocks = pack(held)
    return grouped(held.select("doc", F.posexplode("values").alias("pos", "token"))) if repeated(blocks) else blocks


def is_blocks(df: DataFrame) -> bool:
    return {"block", "codes", "words"} <= set(df.columns)


def cells(blocks: DataFrame) -> DataFrame:
    """token, count, first_doc, first_place: one row a distinct word of a block."""
    zipped = F.arrays_zip("words", "counts", "first_docs", "first_places")
    return blocks.select(F.explode(zipped).alias("x")).select(F.col("x.words").alias("token"), F.col("x.counts").alias("count"), F.col("x.first_docs").alias("first_doc"), F.col("x.first_places").alias("first_place"))


def entries(blocks: DataFrame, name: str = "token") -> DataFrame:
    """block, code, token of the distinct words of each block."""
    return blocks.select("block", F.posexplode("words").alias("code", name))


def nothing(schema: str) -> pa.Table:
    """No rows of a schema."""
    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()


def met(blocks: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """run(one row of blocks, the rows of found with its number) for each block, as Arrow tables."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows else empty

    empty = nothing(schema)
    found = found.withColumn("_of", F.col("block") + 0).drop("block")  # a column of its own, as both may come from one table
    return blocks.groupBy("block").cogroup(found.groupBy("_of")).applyInArrow(one, schema)


def flat(t: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    """The values of the first row's list."""
    c = t.column(name)
    return (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)[0].values


def of_code(right: pa.Table, size: int) -> np.ndarray:
    """For each code the row of `right` that has it, or -1."""
    at = np.full(size, -1, np.int64)
    at[numbers(right.column("code"))] = np.arange(right.num_rows)
    return at


def laid(blocks: DataFrame, found: DataFrame, value: str, name: str) -> DataFrame:
    """doc, values in order of place, from found (block, code, value); words that have none are skipped, and documents of such alone have no row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, sizes, docs = numbers(flat(left, "codes")), numbers(flat(left, "sizes")), flat(left, "docs")
        at = of_code(right, int(codes.max()) + 1)[codes]
        hit = at >= 0
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
        some = np.flatnonzero(sizes)
        values = right.column(value).combine_chunks().take(pa.array(at[hit]))
        return pa.Table.from_arrays([docs.take(pa.array(some)), listed(values, sizes[some])], names=["doc", name])

    schema = f"doc {blocks.schema['docs'].dataType.elementType.simpleString()}, {name} array<{found.schema[value].dataType.simpleString()}>"
    return met(blocks.select("block", "docs", "sizes", "codes"), found.select("block", "code", value), run, schema)


def pairs(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, times, pair of each word) of the distinct pairs of a block."""
    codes, sizes = numbers(flat(t, "codes")).astype(np.int64), numbers(flat(t, "sizes"))
    size = int(codes.max()) + 1
    key, of, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * size + codes, return_inverse=True, return_counts=True)
    return key // size, key % size, n, of


def distinct_pairs(blocks: DataFrame) -> DataFrame:
    """doc, token of each distinct pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                doc, code, _, _ = pairs(row)
                yield pa.RecordBatch.from_arrays([flat(row, "docs").take(pa.array(doc)), flat(row, "words").take(pa.array(code))], names=["doc", "token"])

    return blocks.select("docs", "sizes", "codes", "words").mapInArrow(run, _pair_schema(blocks))


def _pair_schema(blocks: DataFrame) -> str:
    return f"doc {blocks.schema['docs'].dataType.elementType.simpleString()}, token {blocks.schema['words'].dataType.elementType.simpleString()}"


def valued_pairs(blocks: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """doc, token, n (times in the document), value of each distinct pair; values: token, value. Words without a value go."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, code, n, _ = pairs(left)
        at = of_code(right, int(code.max()) + 1)[code]
        hit = at >= 0
        columns = [flat(left, "docs").take(pa.array(doc[hit])), flat(left, "words").take(pa.array(code[hit])), pa.array(n[hit], pa.int64()), right.column(value).combine_chunks().take(pa.array(at[hit]))]
        return pa.Table.from_arrays(columns, names=["doc", "token", "n", value])

    found = entries(blocks).join(values.select("token", value), "token").select("block", "code", value)
    return met(blocks.select("block", "docs", "sizes", "codes", "words"), found, run, f"{_pair_schema(blocks)}, n long, {value} {values.schema[value].dataType.simpleString()}")


def word_counts(blocks: DataFrame) -> DataFrame:
    """token, n: how often each word comes."""
    flat = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x"))
    return flat.groupBy(F.col("x.words").alias("token")).agg(F.sum("x.counts").alias("n"))


def document_counts(blocks: DataFrame) -> DataFrame:
    """token, df: the documents that each word comes in; ids don't repeat over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                words = flat(row, "words")
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(pairs(row)[1], minlength=len(words)), pa.int64())], names=["token", "df"])

    token = blocks.schema["words"].dataType.elementType.simpleString()
    return blocks.select("sizes", "codes", "words").mapInArrow(run, f"token {token}, df long").groupBy("token").agg(F.sum("df").alias("df"))


def documents(blocks: DataFrame) -> Column:
    """The number of documents with an id, as an aggregate."""
    return F.sum(F.size(F.filter("docs", lambda d: d.isNotNull())))
