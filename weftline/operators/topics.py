"""Collapsed Gibbs sampling of topics, distributed over documents, with optional term weights.

Blocks of documents keep their assignments in a table. In each round a block is joined with the counts of its distinct words, and each
document is sampled against these counts of the round before, changed by its own moves alone (approximate distributed sampling, as published for
parallel topic models); the sums of all blocks are formed where the rows of a word meet, and go back to the blocks from there. A document's result follows
from its id, its words and the round's counts, so it is the same however documents are dealt to blocks and tasks, and a lost task draws the same again.
Nothing that grows with the vocabulary comes to the driver or is sent in a closure: that is one total a topic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators import aggregates as A
from weftline.operators import blocks as B
from weftline.session import written


def term_weights(tok: DataFrame, scheme: str, seed: int = 0) -> DataFrame:
    """doc, token, weight of each distinct pair by ONE, TF, IDF, PMI or RAND. tok: doc, token, or blocks, whose pairs are formed where they lie."""
    packed = B.is_blocks(tok)
    if scheme in ("ONE", "RAND"):  # RAND: a seeded hash, so that a task that is run again draws the same
        pairs = B.distinct_pairs(tok) if packed else tok.select("doc", "token").distinct()
        return pairs.withColumn("weight", F.lit(1.0) if scheme == "ONE" else _uniform(F.xxhash64(F.lit(seed), "doc", "token")))
    if packed:
        found = B.valued_pairs(tok, _of_words(tok, scheme), "value")
        return found.select("doc", "token", (F.greatest(F.log2(F.col("value") / F.col("n")), F.lit(0.0)) if scheme == "PMI" else F.col("value")).alias("weight"))
    if scheme == "TF":
        return tok.select("doc", "token").distinct().join(A.term_frequency(tok).withColumnRenamed("tf", "weight"), "token")
    if scheme == "IDF":
        return tok.select("doc", "token").distinct().join(A.inverse_document_frequency(tok).withColumnRenamed("idf", "weight"), "token")
    if scheme == "PMI":
        return A.pointwise_information(tok).withColumnRenamed("pmi", "weight")
    raise NotImplementedError(scheme)


def _of_words(blocks: DataFrame, scheme: str) -> DataFrame:
    """token, value: what a weight takes from the whole corpus: the weight itself, or for PMI how often the word comes."""
    if scheme == "TF":
        return A.with_total(B.word_counts(blocks), "n").select("token", (-F.log2(F.col("n") / F.col("total"))).alias("value"))
    if scheme == "IDF":
        docs = blocks.agg(B.documents(blocks).alias("m"))
        return B.document_counts(blocks).crossJoin(F.broadcast(docs)).select("token", F.log2(F.col("m") / F.col("df")).alias("value"))
    if scheme == "PMI":
        return B.word_counts(blocks).select("token", F.col("n").cast("double").alias("value"))
    raise NotImplementedError(scheme)


def _uniform(h: Column) -> Column:
    return F.pmod(h, F.lit(1 << 30)).cast("double") / (1 << 30)


def _swept(now: np.ndarray, codes: np.ndarray, weights: np.ndarray, pair: np.ndarray, counts: np.ndarray, sizes: np.ndarray, draws: list[np.ndarray], totals: np.ndarray, size: int, alpha: float, beta: float, frozen: bool) -> None:
    """One sweep over documents' words, in place: the k-th words of all documents at a time, as a document's words depend on each other only.

    counts: one row a code, or unless frozen one row a pair of document and word, which the document's own moves change.
    """
    topics, order = len(totals), np.argsort(-sizes, kind="stable")
    starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    point = np.concatenate(draws) if draws else np.zeros(0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    own = np.bincount(of * topics + now, weights, len(sizes) * topics).reshape(-1, topics)[order]
    every = totals if frozen else np.repeat(totals[None], len(sizes), axis=0)
    active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    rows, word = np.arange(len(sizes)), codes if frozen else pair
    for i, m in enumerate(active):
        at, r = starts[:m] + i, rows[:m]
        w, k, c = weights[at], now[at], word[at]
        own[r, k] -= w
        if frozen:
            p = (own[:m] + alpha / topics) * (counts[c] + beta / size) / (every + beta)
        else:
            counts[c, k] -= w
            every[r, k] -= w
            p = (own[:m] + alpha / topics) * (counts[c] + beta / size) / (every[:m] + beta)
        p = np.cumsum(np.maximum(p, 0, out=p), axis=1)
        k = np.minimum((p <= (point[at] * p[:, -1])[:, None]).sum(axis=1), topics - 1)
        now[at] = k
        own[r, k] += w
        if not frozen:
            counts[c, k] += w
            every[r, k] += w


#: Numbers of the counts of a step's pairs of document and word, about.
CELLS = 1 << 22
_STATE = "block long, docs array<bigint>, sizes array<int>, places binary, codes binary, idx array<bigint>, shared int, of_codes array<double>, weights binary, topics binary, sums array<double>"


def _blob(a: np.ndarray | None, kind) -> pa.Array:
    """Numbers as bytes, all lowest bytes first: small numbers compress to their own size."""
    return pa.array([None if a is None else np.ascontiguousarray(a, kind).view(np.uint8).reshape(len(a), -1).T.tobytes()], pa.binary())


def _read(t: pa.Table | pa.RecordBatch, name: str, kind) -> np.ndarray | None:
    v = t.column(name)[0]
    return np.ascontiguousarray(np.frombuffer(v.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if v.is_valid else None


def _weights(t: pa.Table, codes: np.ndarray, scheme: str) -> np.ndarray:
    """The weight of each word of a block, from what its state has: one a word, one a distinct word, or for PMI how often that comes in the corpus."""
    if scheme == "ONE":
        return np.ones(len(codes))
    if scheme == "RAND":
        return _read(t, "weights", np.float64)
    value = B.numbers(B.flat(t, "of_codes"))[codes]
    if scheme == "PMI":
        sizes = B.numbers(B.flat(t, "sizes"))
        _, of, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (int(codes.max()) + 1) + codes, return_inverse=True, return_counts=True)
        value = np.maximum(np.log2(value / n[of]), 0)
    return value


def _round(topics: int, alpha: float, beta: float, totals: list[float] | None, size: int, seed: int, sweeps: int, frozen: bool, scheme: str = "ONE"):
    """A block's state and the counts of its words (code, c: one number a topic) to the state with new topics; random ones without totals."""

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        docs, sizes = B.numbers(B.flat(left, "docs")), B.numbers(B.flat(left, "sizes")).astype(np.int64)
        codes, old = _read(left, "codes", np.int32).astype(np.int64), _read(left, "topics", np.int32)
        weights = _weights(left, codes, scheme)
        now = np.zeros(len(codes), np.int64) if old is None else old.astype(np.int64)
        known = np.zeros((len(left.column("idx")[0]), topics))
        if not frozen and old is not None:  # words of this block alone
            known += np.bincount(codes * topics + now, weights, len(known) * topics).reshape(-1, topics)
        if right is not None and right.num_rows:
            known[B.numbers(right.column("code"))] = B.numbers(right.column("c").combine_chunks().flatten()).reshape(-1, topics)
        ends = np.cumsum(sizes)
        for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends * topics // CELLS)) + 1):
            lo, hi = int(ends[some[0]] - sizes[some[0]]), int(ends[some[-1]])
            draws, mine = [[] for _ in range(sweeps)], now[lo:hi]
            for d in some:
                rng = np.random.default_rng([seed, int(docs[d]) & 0x7FFFFFFF])
                n = int(sizes[d])
                if old is None:
                    now[ends[d] - n : ends[d]] = rng.integers(0, topics, n)
                if totals is not None:
                    for each in draws:
                        each.append(rng.random(n))
            if totals is not None:
                own, pair, counts = codes[lo:hi], None, known
                if not frozen:
                    key, pair = np.unique(np.repeat(np.arange(len(some)), sizes[some]) * len(known) + own, return_inverse=True)
                for each in draws:
                    if not frozen:
                        counts = known[key % len(known)]
                    _swept(mine, own, weights[lo:hi], pair, counts, sizes[some], each, np.array(totals), size, alpha, beta, frozen)
        names = left.column_names
        sums = B.listed(pa.array(np.bincount(now, weights, topics)))
        return pa.table({n: _blob(now, np.int32) if n == "topics" else sums if n == "sums" else left.column(n) for n in names})

    return run


def _each(run):
    """A function of one block's row, over batches."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from run(pa.Table.from_batches([b.slice(i, 1)])).to_batches()

    return over


def _cells(held: DataFrame, topics: int, scheme: str, every: bool) -> DataFrame:
    """idx, block, code, c0, c1, ..: how much of each distinct word of a block has each topic; unless every, of words that other blocks share."""

    def run(t: pa.Table) -> pa.Table:
        codes, now, idx = _read(t, "codes", np.int32).astype(np.int64), _read(t, "topics", np.int32), B.flat(t, "idx")
        some = len(idx) if every else t.column("shared")[0].as_py()
        n = np.bincount(codes * topics + now, _weights(t, codes, scheme), len(idx) * topics).reshape(-1, topics)[:some]
        block = np.full(some, t.column("block")[0].as_py(), np.int64)
        return pa.table({"idx": idx.slice(0, some), "block": pa.array(block), "code": pa.array(np.arange(some, dtype=np.int32)), **{f"c{k}": pa.array(np.ascontiguousarray(n[:, k]), pa.float64()) for k in range(topics)}})

    schema = "idx long, block long, code int, " + ", ".join(f"c{k} double" for k in range(topics))
    return held.select("block", "sizes", "codes", "idx", "shared", "of_codes", "weights", "topics").mapInArrow(_each(run), schema)


def _counted(held: DataFrame, topics: int, scheme: str) -> DataFrame:
    """block, code, c: the counts of the whole corpus for each distinct word of a block that another one shares."""
    w = W.partitionBy("idx")  # one row a block at most
    return _cells(held, topics, scheme, False).select("block", "code", F.array(*[F.sum(f"c{k}").over(w) for k in range(topics)]).alias("c"))


def _counts(held: DataFrame, topics: int, scheme: str) -> DataFrame:
    """idx, counts (array of one number a topic)."""
    rows = _cells(held, topics, scheme, True).groupBy("idx").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(topics)])
    return rows.select("idx", F.array(*[F.col(f"c{k}") for k in range(topics)]).alias("counts"))


def _totals(counts: DataFrame, topics: int, name: str = "counts") -> list[float]:
    """One number a topic."""
    return [float(x or 0) for x in counts.agg(*[F.sum(F.get(name, F.lit(k))).alias(f"t{k}") for k in range(topics)]).first()]


def _known(blocks: DataFrame, vocab: DataFrame) -> DataFrame:
    """The blocks with whole-number ids and the vocabulary's words only, their numbers in `idx`; documents without either go.

    The `shared` first of a block's words are in other blocks too.
    """
    blocks = blocks.withColumn("docs", F.col("docs").cast("array<bigint>"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes, sizes, docs = B.numbers(B.flat(left, "codes")), B.numbers(B.flat(left, "sizes")), B.flat(left, "docs")
        words, n = B.flat(left, "words"), len(B.flat(left, "words"))
        at = B.of_code(right, n)
        of = np.repeat(np.arange(len(sizes)), sizes)
        hit = (at[codes] >= 0) & B.numbers(pc.is_valid(docs))[of]
        times = np.bincount(codes[hit], minlength=n)
        used = np.flatnonzero(times)
        if not len(used):
            return none
        spread = B.numbers(right.column("blocks"))[at[used]] > 1
        used = used[np.lexsort((-times[used], ~spread))]  # frequent words have small numbers
        new = np.zeros(n, np.int64)
        new[used] = np.arange(len(used))
        given = left.column("places").combine_chunks()
        places = None
        if given.null_count == 0:
            places = B.numbers(given[0].values)[hit]
        elif not hit.all():
            places = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[hit]
        short = np.bincount(of[hit], minlength=len(sizes))
        some = np.flatnonzero(short)
        codes = new[codes[hit]]
        lists = {"docs": docs.take(pa.array(some)), "sizes": pa.array(short[some], pa.int32()), "codes": pa.array(codes, pa.int32()), "words": words.take(pa.array(used)), "counts": pa.array(np.bincount(codes, minlength=len(used)), pa.int64()), "idx": right.column("idx").combine_chunks().take(pa.array(at[used]))}
        listed = {k: B.listed(v) for k, v in lists.items()} | {"places": pa.array([None], pa.list_(pa.int32())) if places is None else B.listed(pa.array(places, pa.int32()))}
        whole = {"block": left.column("block"), "shared": pa.array([int(spread.sum())], pa.int32()), **listed}
        return pa.table({c: whole[c] for c in none.column_names})

    schema = "block long, docs array<bigint>, sizes array<int>, places array<int>, codes array<int>, words array<string>, counts array<bigint>, idx array<bigint>, shared int"
    none = B.nothing(schema)
    numbered = B.entries(blocks).join(vocab.select("token", F.col("idx").cast("long").alias("idx")), "token")
    found = numbered.select("block", "code", "idx", F.count(F.lit(1)).over(W.partitionBy("token")).alias("blocks"))
    return B.met(blocks.select("block", "docs", "sizes", "places", "codes", "words"), found, run, schema)


_WEIGHED = "block long, docs array<bigint>, sizes array<int>, places array<int>, codes array<int>, idx array<bigint>, shared int"


def _weighed(known: DataFrame, scheme: str, seed: int) -> DataFrame:
    """known with what its words' weights follow from: of_codes, one number a distinct word, or weights, one a word."""
    names = ["block", "docs", "sizes", "places", "codes", "idx", "shared"]
    if scheme == "ONE":
        return known.select(*names, F.lit(None).cast("array<double>").alias("of_codes"), F.lit(None).cast("binary").alias("weights"))
    if scheme == "RAND":

        def drawn(t: pa.Table) -> pa.Table:
            doc, code, _, _ = B.pairs(t)
            return pa.table({**{c: t.column(c) for c in t.column_names}, "pair_docs": B.listed(pa.array(doc, pa.int32())), "pair_words": B.listed(pa.array(code, pa.int32()))})

        def weighed(t: pa.Table) -> pa.Table:
            return pa.table({**{c: t.column(c) for c in names}, "of_codes": pa.array([None], pa.list_(pa.float64())), "weights": _blob(B.numbers(B.flat(t, "drawn"))[B.pairs(t)[3]], np.float64)})

        all_pairs = known.select(*names, "words").mapInArrow(_each(drawn), f"{_WEIGHED}, words array<string>, pair_docs array<int>, pair_words array<int>")
        chance = F.transform(F.arrays_zip("pair_docs", "pair_words"), lambda p: _uniform(F.xxhash64(F.lit(seed), F.get("docs", p["pair_docs"]), F.get("words", p["pair_words"]))))
        return all_pairs.select(*names, chance.alias("drawn")).mapInArrow(_each(weighed), f"{_WEIGHED}, of_codes array<double>, weights binary")

    def valued(left: pa.Table, right: pa.Table) -> pa.Table:
        v = B.numbers(right.column("value"))[B.of_code(right, len(left.column("idx")[0]))]
        return pa.table({**{c: left.column(c) for c in names}, "of_codes": B.listed(pa.array(v, pa.float64())), "weights": _blob(None, np.float64)})

    found = B.entries(known).join(_of_words(known, scheme), "token").select("block", "code", "value")
    return B.met(known.select(*names), found, valued, f"{_WEIGHED}, of_codes array<double>, weights binary")


def _state(known: DataFrame) -> DataFrame:
    """Blocks with weights as the rounds take them: numbers of words as bytes, no topics yet."""

    def run(t: pa.Table) -> pa.Table:
        blobs = {n: _blob(B.numbers(B.flat(t, n)) if t.column(n)[0].is_valid else None, np.int32) for n in ("places", "codes")}
        return pa.table({"block": t.column("block"), "docs": t.column("docs"), "sizes": t.column("sizes"), **blobs, **{n: t.column(n) for n in ("idx", "shared", "of_codes", "weights")}, "topics": _blob(None, np.int32), "sums": pa.array([None], pa.list_(pa.float64()))})

    return known.select("block", "docs", "sizes", "places", "codes", "idx", "shared", "of_codes", "weights").mapInArrow(_each(run), _STATE)


def _blocks(tok: DataFrame) -> DataFrame:
    """Blocks of rows (doc, pos, token), whose ids are whole numbers; blocks as they are."""
    return tok if B.is_blocks(tok) else B.grouped(tok.where("doc IS NOT NULL").select(F.col("doc").cast("long").alias("doc"), "pos", "token"))


def sample_topics(tok: DataFrame, vocab: DataFrame, topics: int, rounds: int = 20, alpha: float = 0.1, beta: float = 0.01, seed: int = 0, scheme: str = "ONE") -> tuple[DataFrame, DataFrame]:
    """(doc, pos, idx, topic of every word in the vocabulary; idx, counts: the word-topic counts of the last round).

    tok: doc (a whole number), pos, token, or blocks of documents; vocab: token, idx. Words outside the vocabulary and rows without a document's id go;
    empty tables give empty ones. A document must fit a task, a vocabulary need not.
    """
    size = max(vocab.count(), 1)
    known = _known(_blocks(tok), vocab)
    held = _state(_weighed(known if scheme == "ONE" else written(known), scheme, seed))
    held = written(held.mapInArrow(_each(_round(topics, alpha, beta, None, size, seed, 1, False, scheme)), _STATE))
    for r in range(1, rounds + 1):
        step = _round(topics, alpha, beta, _totals(held, topics, "sums"), size, seed + r, 1, False, scheme)
        held = written(B.met(held, _counted(held, topics, scheme), step, _STATE))

    def laid(t: pa.Table) -> pa.Table:
        docs, sizes, codes = B.flat(t, "docs"), B.numbers(B.flat(t, "sizes")), _read(t, "codes", np.int32)
        of, places = pa.array(np.repeat(np.arange(len(sizes)), sizes)), _read(t, "places", np.int32)
        places = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if places is None else places
        return pa.table({"doc": docs.take(of), "pos": pa.array(places, pa.int32()), "idx": B.flat(t, "idx").take(pa.array(codes)), "topic": pa.array(_read(t, "topics", np.int32))})

    return held.mapInArrow(_each(laid), "doc long, pos int, idx long, topic int"), _counts(held, topics, scheme)


def infer(tok: DataFrame, vocab: DataFrame, counts: DataFrame, topics: int, rounds: int = 10, alpha: float = 0.1, beta: float = 0.01, seed: int = 0) -> DataFrame:
    """doc, topics of new documents under frozen word-topic counts (idx, counts), in one pass; a word without counts has zeros. tok: doc, pos, token, or blocks."""
    counts = written(counts)
    held = written(_state(_weighed(_known(_blocks(tok), vocab), "ONE", seed)))
    step = _round(topics, alpha, beta, _totals(counts, topics), max(vocab.count(), 1), seed, rounds, True)
    found = held.select("block", F.posexplode("idx").alias("code", "idx")).join(counts.select("idx", F.col("counts").alias("c")), "idx").select("block", "code", "c")

    def laid(t: pa.Table) -> pa.Table:
        sizes = B.numbers(B.flat(t, "sizes"))
        return pa.table({"doc": B.flat(t, "docs"), "topics": B.listed(pa.array(_read(t, "topics", np.int32)), sizes)})

    return B.met(held, found, lambda left, right: laid(step(left, right)), "doc long, topics array<int>")


def categorical(key: Column, weights: Column, seed: int = 0) -> Column:
    """A place of the array, drawn with its weights by a seeded hash of the key."""
    whole = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    point = _uniform(F.xxhash64(F.lit(seed), key)) * whole
    upto = lambda i: F.aggregate(F.slice(weights, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x)
    passed = F.size(F.filter(F.transform(weights, lambda _, i: upto(i)), lambda c: c <= point))
    return F.least(passed, F.size(weights) - 1)


def generate(lengths: DataFrame, theta: DataFrame, phi: DataFrame, seed: int = 0) -> DataFrame:
    """doc, pos, topic, word: synthetic documents. lengths: doc, n; theta: doc, weights; phi: topic, weights."""
    laid = lengths.join(theta, "doc").select("doc", F.col("weights").alias("_t"), F.explode(F.filter(F.sequence(F.lit(0), F.col("n")), lambda i: i < F.col("n"))).alias("pos"))
    drawn = laid.withColumn("topic", categorical(F.struct("doc", "pos"), F.col("_t"), seed))
    return drawn.join(phi.select("topic", F.col("weights").alias("_p")), "topic").select("doc", "pos", "topic", categorical(F.struct("doc", "pos"), F.col("_p"), seed + 1).alias("word"))
