"""Vocabularies, label encoders, topic tables and paragraph search.

A vocabulary is a table (token, idx, count). Encoding is a join of the distinct words of blocks of documents with it, so it may be as large as it
likes; ids follow first appearance or frequency by a sort, never by a driver-side dictionary.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from weftline.operators import blocks as B
from weftline.operators.ordering import with_index
from weftline.session import written

Names = Sequence[str]


def label_ids(df: DataFrame, value: str, order_by: Names) -> DataFrame:
    """value, idx: numbers by first appearance."""
    first = df.groupBy(value).agg(F.min(F.struct(*order_by)).alias("_first"))
    return with_index(first, ["_first"], (), "idx").select(value, "idx")


def encode(df: DataFrame, value: str, labels: DataFrame) -> DataFrame:
    """Rows with idx; rows whose value has no label go."""
    return df.join(labels.select(value, "idx"), value)


def decode(df: DataFrame, labels: DataFrame, value: str, idx: str = "idx") -> DataFrame:
    return df.join(labels.select(F.col("idx").alias(idx), value), idx)


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, pos, token: lower-cased words with their places."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != "")
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(words).alias("pos", "token"))


#: Sizes up to this are numbered by one window over so many rows; larger vocabularies by a range-partitioned sort.
SMALL = 100_000


def vocabulary(tok: DataFrame, size: int | None = None) -> DataFrame:
    """token, count, idx: by first appearance, or with a size its most frequent tokens (ties by token) by count. Written once, so that it may be used often.

    tok: doc, pos, token, or blocks of documents (:func:`weftline.operators.blocks.packed`), which count what they hold first.
    """
    packed = B.is_blocks(tok)
    words = B.cells(tok) if packed else tok
    counts = F.sum("count") if packed else F.count(F.lit(1))
    if size is None:
        doc, pos = ("first_doc", "first_place") if packed else ("doc", "pos")
        # The place of whole-number ids as one number: a struct's least can't be kept in a hash aggregation, and would sort all words.
        whole = isinstance(words.schema[doc].dataType, T.IntegralType)
        place = F.col(doc).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(pos) if whole else F.struct(doc, pos)
        counted = words.groupBy("token").agg(counts.alias("count"), F.min(place).alias("_first"))
        return with_index(counted, ["_first"], (), "idx").select("token", "count", "idx")
    order = [F.col("count").desc(), F.col("token").asc()]
    top = words.groupBy("token").agg(counts.alias("count")).orderBy(*order).limit(size)
    if size > SMALL:
        return with_index(top, order, (), "idx").select("token", "count", "idx")
    return written(top.withColumn("idx", (F.row_number().over(W.orderBy(*order)) - 1).cast("long")))


def transform(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc, ids: token numbers in order of place; unknown tokens are skipped, and documents of such alone have none. tok: doc, pos, token, or blocks."""
    blocks = tok if B.is_blocks(tok) else B.grouped(tok)
    return B.laid(blocks, B.entries(blocks).join(vocab.select("token", "idx"), "token"), "idx", "ids")


def inverse_transform(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc, tokens from doc, ids."""
    blocks = B.pack(ids.select("doc", F.filter("ids", lambda i: i.isNotNull()).alias("values")))
    if B.repeated(blocks):
        flat = ids.select("doc", F.posexplode("ids").alias("pos", "idx")).join(vocab.select("idx", "token"), "idx")
        return flat.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_l")).select("doc", F.transform("_l", lambda x: x["token"]).alias("tokens"))
    return B.laid(blocks, B.entries(blocks, "idx").join(vocab.select("idx", "token"), "idx"), "token", "tokens")


# ---- topics: a table (doc, token, topic) of assignments, one row a word


def theta(assigned: DataFrame, topics: int, alpha: float) -> DataFrame:
    """doc, topic, theta = (n + alpha / K) / (words of doc + alpha), for every topic."""
    own = assigned.groupBy("doc", "topic").agg(F.count(F.lit(1)).alias("n"))
    docs = own.groupBy("doc").agg(F.sum("n").alias("m"), F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("_n"))
    laid = docs.select("doc", "m", "_n", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))).alias("topic"))
    return laid.select("doc", "topic", ((F.coalesce(F.element_at("_n", F.col("topic")), F.lit(0)) + alpha / topics) / (F.col("m") + alpha)).alias("theta"))


def phi(assigned: DataFrame, topics: int, beta: float) -> DataFrame:
    """topic, token, phi = (n + beta / V) / (words of topic + beta), for every topic and token."""
    own = assigned.groupBy("token", "topic").agg(F.count(F.lit(1)).alias("n"))
    size = assigned.agg(F.count_distinct("token").alias("_v"))
    totals = own.groupBy("topic").agg(F.sum("n").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("topic", "m"))).alias("_m"))  # one entry a topic
    rows = own.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("_n"))
    laid = rows.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(totals)).select("token", "_n", "_v", "_m", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))).alias("topic"))
    n, m = F.coalesce(F.element_at("_n", F.col("topic")), F.lit(0)), F.coalesce(F.element_at("_m", F.col("topic")), F.lit(0))
    return laid.select("topic", "token", ((n + beta / F.col("_v")) / (m + beta)).alias("phi"))


def perplexity(tok: DataFrame, thetas: DataFrame, phis: DataFrame) -> DataFrame:
    """One row: exp(-mean of log p(word)); vectors of one value a topic meet in the blocks of the documents. tok: doc, pos, token, or blocks."""
    blocks = tok if B.is_blocks(tok) else B.grouped(tok)
    vector = lambda df, key, v: df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("topic", v))), lambda x: x[v]).alias("v"))
    words = B.entries(blocks).join(vector(phis, "token", "phi"), "token").select("block", F.lit(True).alias("word"), "code", "v")
    docs = blocks.select("block", F.posexplode("docs").alias("code", "doc")).join(vector(thetas, "doc", "theta"), "doc").select("block", F.lit(False).alias("word"), "code", "v")
    found = B.met(blocks.select("block", "sizes", "codes"), words.unionByName(docs), _likelihood, "total double, n long")
    return found.agg(F.exp(-F.sum("total") / F.sum("n")).alias("perplexity"))


def _likelihood(left: pa.Table, right: pa.Table) -> pa.Table:
    """The sum of log p(word) of a block and its number of words with vectors."""
    codes, sizes = B.numbers(B.flat(left, "codes")), B.numbers(B.flat(left, "sizes"))
    of = B.numbers(right.column("word")).astype(bool)

    def vectors(rows: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array]:
        some = right.take(pa.array(np.flatnonzero(rows)))
        v = some.column("v").combine_chunks()
        return B.of_code(some, size), B.numbers(v.flatten()).reshape(len(v), -1)

    (word, phi), (doc, theta) = vectors(of, int(codes.max()) + 1), vectors(~of, len(sizes))
    w, d = word[codes], np.repeat(doc, sizes)
    hit = (w >= 0) & (d >= 0)
    w, d, total = w[hit], d[hit], 0.0
    for at in range(0, len(w), 1 << 16):
        p = (phi[w[at : at + (1 << 16)]] * theta[d[at : at + (1 << 16)]]).sum(axis=1)
        total += float(np.log(p[p > 0]).sum())
    return pa.table({"total": pa.array([total], pa.float64()), "n": pa.array([len(w)], pa.int64())})


def main_topics(thetas: DataFrame) -> DataFrame:
    """doc, topic: the most likely, of ties the lower."""
    return thetas.groupBy("doc").agg(F.min_by("topic", F.struct(-F.col("theta"), F.col("topic"))).alias("topic"))


def top_words(phis: DataFrame, k: int = 10, places: int = 2) -> DataFrame:
    """topic, rank, token, prob of the k likeliest tokens of each topic."""
    w = W.partitionBy("topic").orderBy(F.col("phi").desc(), "token")
    return phis.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("topic", "rank", "token", F.round("phi", places).alias("prob"))


def format_topics(top: DataFrame) -> DataFrame:
    """topic, line: (token,prob) joined by tabs."""
    cell = F.concat(F.lit("("), "token", F.lit(","), F.col("prob").cast("string"), F.lit(")"))
    return top.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", cell.alias("c")))).alias("_l")).select("topic", F.array_join(F.transform("_l", lambda x: x["c"]), "\t").alias("line"))


def fit_topics(docs: DataFrame, id_col: str, text_col: str, topics: int, vocabulary_size: int = 5000, seed: int = 1, rounds: int = 10):
    """(model, vocabulary list, vectors): variational LDA of the ML library, which is distributed; counts weigh words."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    words = docs.select(F.col(id_col).alias("doc"), F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != "").alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary_size).fit(words)
    vectors = counter.transform(words).select("doc", "features")
    return LDA(k=topics, seed=seed, maxIter=rounds).fit(vectors), counter.vocabulary, vectors


def infer_topics(model, vectors: DataFrame) -> DataFrame:
    """doc, theta array<double> under a fitted model."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(vectors).select("doc", vector_to_array("topicDistribution").alias("theta"))


def best_paragraph(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """doc, paragraph, shared: of each text the first paragraph that shares most words with the query."""
    asked = F.array_distinct(F.filter(F.split(F.lower(F.lit(query)), r"\s+"), lambda w: w != ""))
    paragraphs = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(r"((?:[^\n]\n?)+)"), F.lit(1)), lambda p: F.trim(p) != "")
    scored = F.transform(paragraphs, lambda p, i: F.struct((-shared_words(F.split(F.lower(p), r"\s+"), asked)).alias("s"), i.alias("i"), p.alias("p")))
    return docs.select(F.col(id_col).alias("doc"), F.get(F.array_sort(scored), 0).alias("b")).select("doc", F.col("b.p").alias("paragraph"), (-F.col("b.s")).alias("shared"))


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))
