"""Benchmark decontamination by edit distance (operator 2).

A document leaks an item if some window of its words is within edit distance ``floor(0.2 * n)`` of the item's n words
(similarity 0.8 at least); words are compared lower-cased (A-Z) and cut at ASCII white space.

1. Items are read in blocks of bounded size, and those of like length are a class. A block's words, and nothing of the documents, goes to
   the workers; its findings are written before the next block is read.
2. Every place of a text begins a window of the item's size. Windows that hold fewer words of the class's items than any match must are
   passed over; this loses nothing.
3. The others are embedded by CGK random walks: step j writes the word under the pointer, and a random bit of (j, word)
   says whether the pointer moves on, so edit distance becomes Hamming distance. Each repetition has a walk and a few sampled places of
   its own; the words written there are the window's bucket, and the items of the same bucket are its candidates. The walk up to
   place p reads p + 1 words at most, so with places below the class's smallest size a bucket is that of all its window sizes.
4. The number of repetitions is calibrated per class: items edited at random up to the threshold, with words of the block, stand between other
   such words, and repetitions are added until TARGET of them share a bucket with their original from some window. A class that would
   need over MOST_REPEATS takes every window of step 2 as a candidate instead, so the target is never missed in silence.
5. Candidates of one item that overlap are one area, whose best window is found by exact edit distance with free ends.

Defined results: null and empty texts and items match nothing; rows that repeat a doc_id count as one document, items that repeat an
item_id as one item with the best match; empty tables give no rows; other columns are ignored. Long texts are handled
whole, in pieces that overlap by the longest window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import shared_dir

RATE, TARGET = 0.2, 0.999
#: Sampled places of a repetition in blocks of up to FEW_WORDS words of items, and in larger ones, where buckets must part more items.
FEW_SAMPLES, SAMPLES, FEW_WORDS = 2, 3, 100_000
#: Repetitions beyond which a class is searched without buckets.
MOST_REPEATS = 1024
#: The longest item of a class has so many times the words of its shortest.
SPREAD = 1.25
#: Words of items that one pass over the documents takes to the workers.
BLOCK_WORDS = 2_000_000
#: Edited items of a class that the repetitions are calibrated with.
TRIALS = 4000
#: Words of documents that one vector step looks at.
STEP_WORDS = 300_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def allowed(n: int, rate: float = RATE) -> int:
    return int(rate * n + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buckets(words: np.ndarray, starts: np.ndarray, repetition: int, places: np.ndarray, vocabulary: int) -> np.ndarray:
    """The bucket of the window at each start: a hash of the words that the repetition's CGK walk writes at the sampled places.

    The text goes on for places[-1] words after each start; a walk takes 64 random bits of each word per 64 steps.
    """
    at, key, k = starts.copy(), np.zeros(len(starts), np.uint64), 0
    numbers = np.arange(vocabulary + 1, dtype=np.uint64)
    for j in range(int(places[-1]) + 1):
        if j % 64 == 0:
            moves = _mix(numbers + np.uint64((repetition * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        here = words[at]
        if j == places[k]:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + here.astype(np.uint64) + np.uint64(1))
            k += 1
        at += (moves[here] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
    return key


@dataclass
class Class:
    """Items of like length: their numbers, smallest and largest size, words that a window must hold, and the places of each repetition."""

    members: list[int]
    least: int
    most: int
    need: int
    known: np.ndarray
    places: list[np.ndarray] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    exact: bool = False


class Items:
    """A block of items, made ready for search; sent to workers as it is."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, target: float = TARGET):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        for item, text in items:
            w = words_of(text)
            if w:
                numbers = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)
                self.items.append((item, numbers, allowed(len(w), rate)))
        self.longest = max((len(w) + 2 * e for _, w, e in self.items), default=0)
        self.samples = FEW_SAMPLES if sum(len(w) for _, w, _ in self.items) <= FEW_WORDS else SAMPLES
        self.classes: list[Class] = []
        for k in sorted(range(len(self.items)), key=lambda k: len(self.items[k][1])):
            _, w, e = self.items[k]
            c = self.classes[-1] if self.classes else None
            if c is None or len(w) > SPREAD * c.least or (e == 0) != (self.items[c.members[0]][2] == 0):
                c = Class([], len(w), 0, len(w) - e, np.zeros(len(self.vocabulary) + 1, bool))
                self.classes.append(c)
            c.members.append(k)
            c.most, c.need = len(w) + e, min(c.need, len(w) - e)
            c.known[w] = True
        for c in self.classes:
            self.calibrate(c, target)

    def places(self, c: Class, repetition: int) -> np.ndarray:
        rng = np.random.default_rng([c.least, repetition])
        return np.sort(rng.choice(c.least, min(self.samples, c.least), replace=False))

    def live(self, c: Class, words: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold enough words of the class's items."""
        sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(c.known[words], dtype=np.int32)])
        n = len(words)
        held = np.r_[sums[c.most :], np.full(min(c.most, n + 1), sums[-1], np.int32)][:n] - sums[:n]
        return np.flatnonzero(held >= c.need)

    def own_keys(self, c: Class, repetition: int, places: np.ndarray) -> np.ndarray:
        """The buckets of the class's items."""
        words = np.concatenate([self.items[k][1] for k in c.members])
        sizes = np.array([len(self.items[k][1]) for k in c.members])
        return buckets(words, np.cumsum(sizes) - sizes, repetition, places, len(self.vocabulary))

    def calibrate(self, c: Class, target: float) -> None:
        """Add repetitions until `target` of randomly edited items share a bucket with their original."""
        rng = np.random.default_rng(7)
        every = np.concatenate([w for _, w, _ in self.items])
        owner, parts, begin, at = rng.integers(0, len(c.members), TRIALS if self.items[c.members[0]][2] else 1), [], [], 0
        for o in owner.tolist():
            _, w, e = self.items[c.members[o]]
            x = w.tolist()
            for place, kind, new in zip(rng.random(e).tolist(), rng.integers(0, 3, e).tolist(), every[rng.integers(0, len(every), e)].tolist(), strict=True):
                i = int(place * len(x))
                if kind == 0:
                    x[i] = new
                elif kind == 1:
                    x.insert(i, new)
                elif len(x) > 1:
                    x.pop(i)
            around = every[rng.integers(0, len(every), c.most + c.least)]
            parts += [around[: c.most - c.least + 1], np.array(x, np.int64), around]
            begin.append(at + c.most - c.least + 1)
            at += c.most - c.least + 1 + len(x) + len(around)
        words = np.concatenate([*parts, np.zeros(c.most, np.int64)])
        lived = np.zeros(len(words), bool)
        lived[self.live(c, words)] = True
        trial, shift = np.repeat(np.arange(len(owner)), 2 * (c.most - c.least) + 1), np.tile(np.arange(c.least - c.most, c.most - c.least + 1), len(owner))
        starts = np.array(begin)[trial] + shift
        edits_of = np.array([self.items[k][2] for k in c.members])[owner]
        near = lived[starts] & (np.abs(shift) <= edits_of[trial])
        trial, starts, missed = trial[near], starts[near], np.ones(len(owner), bool)
        for r in range(MOST_REPEATS):
            places = self.places(c, r)
            own = self.own_keys(c, r, places)
            order = np.argsort(own, kind="stable")
            c.places.append(places)
            c.keys.append((own[order], np.array(c.members)[order]))
            hit = buckets(words, starts, r, places, len(self.vocabulary)) == own[owner[trial]]
            missed[trial[hit]] = False
            rest = missed[trial]
            trial, starts = trial[rest], starts[rest]
            if missed.sum() <= (1 - target) * len(owner):
                return
        c.exact, c.places, c.keys = True, [], []

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, start), ordered, of all windows that share a bucket with an item."""
        found, n = [], len(words)
        for c in self.classes:
            starts = self.live(c, words)
            starts = starts[starts + c.least <= n]
            if c.exact:
                found += [k * n + starts for k in c.members]
            for r, (places, (keys, items)) in enumerate(zip(c.places, c.keys, strict=True)):
                if len(starts):
                    b = buckets(words, starts, r, places, len(self.vocabulary))
                    low, high = np.searchsorted(keys, b, "left"), np.searchsorted(keys, b, "right")
                    got = np.flatnonzero(high > low)
                    count = (high - low)[got]
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    found.append(items[np.repeat(low[got], count) + step] * n + np.repeat(starts[got], count))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(n, 1), pairs % max(n, 1)

    def search(self, words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row of owner, item number, distance) of every match; words: numbers, with room of zeros before, between and after texts."""
        items, starts = self.candidates(words)
        cuts = np.flatnonzero(np.r_[True, items[1:] != items[:-1], True]) if len(items) else np.zeros(0, np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            k, own = int(items[a]), starts[a:b]
            _, item, e = self.items[k]
            n = len(item)
            known = np.zeros(len(self.vocabulary) + 1, bool)
            known[item] = True
            sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(known[words], dtype=np.int32)]) if len(own) * n > len(words) else None
            low, high = np.maximum(own - e, 0), np.minimum(own + n + e, len(words))
            if sums is not None:
                held = sums[high] - sums[low]
            else:
                area = np.minimum(low[:, None] + np.arange(n + 2 * e)[None, :], len(words) - 1)
                held = (known[words[area]] & (area < high[:, None])).sum(axis=1)
            enough = held >= n - e
            low, high = low[enough], high[enough]
            if not len(low):
                continue
            first = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])  # windows that overlap are one area
            last = np.r_[first[1:] - 1, len(low) - 1]
            for i, j in zip(low[first].tolist(), high[last].tolist(), strict=True):
                inside = owner[i:j]
                for o in range(int(inside.min()), int(inside.max()) + 1):  # rooms keep texts apart, so this is one text but for its rooms
                    distance = edits(item, words[i:j][inside == o])
                    if distance <= e:
                        yield o, k, distance


def edits(item: np.ndarray, area: np.ndarray) -> int:
    """Smallest edit distance between the item and a window of the area."""
    row, places = np.zeros(len(area) + 1, np.int64), np.arange(len(area) + 1)
    for i, w in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (area != w), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def _scan(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, room = items.vocabulary.get, items.longest + 1

        def flush(arrays: list[np.ndarray], owners: list[int]) -> Iterator[pa.RecordBatch]:
            gap = np.zeros(room, np.int32)
            words = np.concatenate([x for a in arrays for x in (gap, a)] + [gap])
            sizes = [len(a) + room for a in arrays]
            owner = np.repeat(np.arange(len(arrays), dtype=np.int32), sizes)
            owner = np.r_[owner, np.full(room, len(arrays) - 1, np.int32)]
            best: dict[tuple[int, int], int] = {}
            for row, k, distance in items.search(words, owner):
                key = (owners[row], items.items[k][0])
                best[key] = min(best.get(key, distance), distance)
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in best], pa.int64()), pa.array([x[1] for x in best], pa.int64()), pa.array(list(best.values()), pa.int64())],
                    names=["doc_id", "item_id", "distance"],
                )

        arrays, owners, held = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    w = words_of(text)
                    for first in range(0, max(1, len(w)), STEP_WORDS):  # very long texts in overlapping pieces
                        piece = w[first : first + STEP_WORDS + room]
                        arrays.append(np.array([get(x, 0) for x in piece], np.int32))
                        owners.append(doc)
                        held += len(piece) + room
                        if held >= STEP_WORDS:
                            yield from flush(arrays, owners)
                            arrays, owners, held = [], [], 0
        if arrays:
            yield from flush(arrays, owners)

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, as many at a time as BLOCK_WORDS allows."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1].split())
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, target: float = TARGET) -> DataFrame:
    """doc_id, item_id, distance (words) for every document and item within the threshold."""
    spark = docs.sparkSession
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema, path = "doc_id long, item_id long, distance long", f"{shared_dir(spark)}/leaks"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(benchmark):  # one block's items at a time are in memory
        items = Items(block, rate, target)
        if items.items:
            held.mapInArrow(_scan(items), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item; rows without an id stay, as no other row can be meant by them."""
    leaked = leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")
