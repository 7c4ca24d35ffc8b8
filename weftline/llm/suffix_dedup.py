"""Exact removal of repeated byte strings by induced suffix sorting (operator 3).

A byte goes if a string of LENGTH bytes that covers it also starts earlier, in a smaller doc_id or in the same document.
All strings of that length are judged, on the input as it is:

1. Anchors. Of the hashes of a string's K-byte parts the leftmost smallest is its anchor, so equal strings have equal
   anchors at equal places, and the strings of one anchor are neighbours. About one byte in 35 is an anchor. Its row is
   (hash, digest of the bytes that its strings span, place); no text is shuffled.
2. Rows are dealt by hash, in order of (hash, digest). All rows of one digest but the earliest repeat in full. Anchors with one
   digest only are done. This is lossless: what remains, and is open, are the edges of repeated passages, where equal anchors have unequal surroundings.
   A passage that a third of all documents share would make its hash one task's; so what a task can tell by itself is told before the
   shuffle and dealt by document: that a surrounding is a repeat of one that the task has seen (:class:`Repeats`), and that a hash is open, once the
   task has sent FEW rows of it with two digests at least (:class:`Crowds`). A hash then gets FEW rows from each task at most.
3. The surroundings of what is open are gathered per shard of hashes and sorted as suffixes by induced sorting (:func:`suffix_order`). Bucket
   queues that spill to disk carry tuples of place and common prefix with the neighbour through the induction of the L- and S-type suffixes: between
   two suffixes of a bucket it is one more than the least value among their inducers. It gives the classes of equal strings; all but the
   earliest of a class repeat.
   The surroundings of a hash that has over CROWD of them are split further, so that they are no single task's: each of their strings goes by its
   128-bit digest, whose earliest place is partially aggregated before the shuffle.
4. Repeated intervals are merged per document and joined to the texts.

Queues are monotone: tuples arrive in rank order of the suffixes that induce them, so a bucket is a first-in-first-out file and
needs no heap. Departures from external induced sorting in full are named in the README: shards are cut so that they fit a task, and the names of left-most-S
substrings are ordered by doubling and not by a recursive induction.

Defined results: null and empty texts have no bytes, no removals and the digest of nothing; rows that share a doc_id are
documents of their own, ordered by text (exact copies among them: the later goes); null ids come first; texts shorter than LENGTH
keep all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, parts, written

LENGTH, K = 100, 32
#: Bytes that one sort takes at once if its anchors allow, and tuples that a queue holds in memory.
SHARD, IN_MEMORY = 4_000_000, 4_000_000
#: Surroundings of one hash that one task sorts, surroundings and hashes that a task remembers, and rows of a hash that it sends there before it calls it open.
CROWD, REMEMBERED, FEW = 2_000, 100_000, 64
#: Hashes with a crowd that are counted and then broadcast.
MOST_BROADCAST = 1_000_000
#: Common prefixes are held in so many bits of a tuple, below the place.
_BITS = 16
#: Bytes of text that one vector step looks at.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = np.array([base], np.uint64)  # arrays wrap around in silence
    while len(out) < n:
        out = np.concatenate([out, out * step])
        step = step * step
    return out[:n]


_CHUNK = 1 << 20
_UP, _DOWN = _powers(_CHUNK + LENGTH, _BASE), _powers(_CHUNK + LENGTH, _INVERSE)


def part_hashes(b: np.ndarray, k: int = K) -> np.ndarray:
    """Mixed rolling hashes of all k-byte parts; computed by chunks, each part from its own bytes alone."""
    out = np.empty(max(0, len(b) - k + 1), np.uint64)
    for at in range(0, len(out), _CHUNK):
        piece = b[at : min(at + _CHUNK, len(out)) + k - 1].astype(np.uint64) + np.uint64(1)
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * _UP[: len(piece)], dtype=np.uint64)])
        m = len(piece) - k + 1
        h = (s[k:] - s[:m]) * _DOWN[:m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[at : at + m] = h ^ (h >> np.uint64(32))
    return out


def _slide(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each w neighbours."""
    n, out, have = len(h) - w + 1, h, 1
    while 2 * have <= w:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[:n], out[w - have : w - have + n]) if have < w else out[:n]


def anchor_ranges(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(hash, first start, number of starts, whether the hash occurs again there) of each anchor of texts laid end to end.

    Neighbouring strings with the same smallest part hash are one anchor's; runs are cut at the ends of texts, and at w strings.
    """
    n, w = len(b) - length + 1, length - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none.astype(bool)
    h = part_hashes(b, k)
    low = _slide(h, w, np.minimum)
    inside = np.ones(n, bool)
    for e in ends.tolist():
        inside[max(0, e - length + 1) : e] = False
    new = np.r_[True, (low[1:] != low[:-1]) | ~inside[:-1]] & inside
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True]) + 1
    count = last - first
    over = count > w
    if over.any():  # periodic text
        pieces = -(-count // w)
        owner = np.repeat(np.arange(len(first)), pieces)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = first[owner] + step * w, last[owner]
        count = np.minimum(last - first, w)
    # A part that is the smallest of some string, and its next such neighbour, equal and near: strings there may repeat each other.
    top = _slide(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    least = np.flatnonzero(top == h)
    near = np.flatnonzero((h[least[1:]] == h[least[:-1]]) & (np.diff(least) <= w))
    again = np.zeros(len(first) + 1, np.int64)
    if len(near) and len(first):
        np.add.at(again, np.maximum(np.searchsorted(first, least[near] - w + 1, side="right") - 1, 0), 1)
        np.add.at(again, np.searchsorted(first, least[near + 1], side="right"), -1)
    return low[first], first, count, np.cumsum(again[:-1]) > 0


class Repeats:
    """Which anchors of a task repeat an equal surrounding that starts earlier; surroundings seen often are remembered."""

    def __init__(self, bound: int = REMEMBERED):
        self.best: dict[tuple[int, int], tuple[int, int, int]] = {}
        self.bound, self.known = bound, np.zeros(0, np.uint64)

    def of(self, h: np.ndarray, d: np.ndarray, doc: np.ndarray, n: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True where the task has seen the same surrounding at an earlier place; of each, the earliest so far stays False."""
        order = np.lexsort((lo, n, doc, d, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])]
        done = np.zeros(len(h), bool)
        done[order[~new]] = True
        first = order[new]
        often = np.diff(np.r_[np.flatnonzero(new), len(order)]) > 1
        if len(self.known):
            at = np.searchsorted(self.known, d[first])
            often |= self.known[np.minimum(at, len(self.known) - 1)] == d[first]
        grown = False
        for i in first[often].tolist():
            key, place = (int(h[i]), int(d[i])), (int(doc[i]), int(n[i]), int(lo[i]))
            best = self.best.get(key)
            if best is not None and best < place:
                done[i] = True
            elif best is not None or len(self.best) < self.bound:
                self.best[key] = place
                grown |= best is None
        if grown:
            self.known = np.unique(np.array([k[1] for k in self.best], np.uint64))
        return done


class Crowds:
    """Which hashes a task knows to be open, as it has sent `few` rows of them with two digests at least; hashes seen often are remembered."""

    def __init__(self, few: int = FEW, bound: int = REMEMBERED):
        self.seen: dict[int, list] = {}  # hash: rows sent, digest of the first, whether another was sent
        self.few, self.bound, self.known = few, bound, np.zeros(0, np.uint64)

    def of(self, h: np.ndarray, d: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """True for rows (of those where rest holds) that need not be sent to their hash; the others are counted as sent."""
        open_ = np.zeros(len(h), bool)
        live = np.flatnonzero(rest)
        order = live[np.argsort(h[live], kind="stable")]
        if not len(order):
            return open_
        cuts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1], True])
        heads = h[order[cuts[:-1]]]
        often = np.diff(cuts) > 1
        if len(self.known):
            often |= self.known[np.minimum(np.searchsorted(self.known, heads), len(self.known) - 1)] == heads
        grown = False
        for g in np.flatnonzero(often).tolist():
            rows, key = order[cuts[g] : cuts[g + 1]], int(heads[g])
            entry = self.seen.get(key)
            if entry is None:
                if len(self.seen) >= self.bound:
                    continue
                entry = self.seen[key] = [0, int(d[rows[0]]), False]
                grown = True
            if entry[2] and entry[0] >= self.few:
                open_[rows] = True
                continue
            entry[0] += len(rows)
            entry[2] |= bool((d[rows] != np.uint64(entry[1])).any())
        if grown:
            self.known = np.sort(np.array(list(self.seen), np.uint64))
        return open_


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    repeats, crowds = Repeats(), Crowds()

    def flush(pieces: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch | None:
        raw = b"".join(x[3] for x in pieces)
        ends = np.cumsum([len(x[3]) for x in pieces])
        h, first, count, again = anchor_ranges(np.frombuffer(raw, np.uint8), ends)
        if not len(h):
            return None
        owner = np.searchsorted(ends, first, side="right")
        doc, n, base = (np.array([x[i] for x in pieces], np.int64)[owner] for i in range(3))
        lo = first - (ends - [len(x[3]) for x in pieces])[owner] + base
        view = memoryview(raw)
        d = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True)], np.uint64)
        done = repeats.of(h, d, doc, n, lo)
        told = crowds.of(h, d, ~done)
        dealt = doc.view(np.uint64) * _BASE + lo.view(np.uint64)  # what is told is dealt by its place, and an open row's hash goes along
        h, d = np.where(done | told, dealt, h), np.where(done, np.uint64(0), np.where(told, h, d))
        at = lo << 10 | told.astype(np.int64) << 9 | done.astype(np.int64) << 8 | again.astype(np.int64) << 7 | count
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), d.view(np.int64), doc, n, at)], names=["h", "ctx", "doc", "n", "at"])

    pieces, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            for doc, n, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for base in range(0, max(0, len(raw) - LENGTH + 1), PIECE):  # pieces share LENGTH - 1 bytes, so each string is in one
                    pieces.append((doc, n, base, raw[base : base + PIECE + LENGTH - 1]))
                    size += len(pieces[-1][3])
                    if size >= PIECE // 2 and (got := flush(pieces)) is not None:
                        yield got
                        pieces, size = [], 0
    if pieces and (got := flush(pieces)) is not None:
        yield got


def _sorted_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, ctx, doc, n, at). Kind 1: repeats of an earlier equal surrounding.

    Kind 0: the first of each surrounding, where its hash has others or occurs again inside. The last first of a batch
    waits for the next batch, which may show that its hash has another.
    """
    waiting: list[int] | None = None  # h, ctx, doc, n, at of the last first
    sent = False
    for b in batches:
        cols = [np.asarray(b.column(i)) for i in range(5)]
        told = (cols[4] >> 8 & 3) > 0
        if told.any():
            kind = cols[4][told] >> 8 & 1  # 1: a repeat; 0: open, of the hash that stands in ctx
            yield pa.RecordBatch.from_arrays([pa.array(kind), *[pa.array(c[told]) for c in cols[1:]]], names=["kind", "h", "doc", "n", "at"])
            cols = [c[~told] for c in cols]
        h, ctx = cols[0], cols[1]
        if not len(h):
            continue
        head = waiting is None or (waiting[0], waiting[1]) != (int(h[0]), int(ctx[0]))
        new = np.r_[head, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])]
        firsts = [np.r_[np.array([] if waiting is None else [waiting[i]], np.int64), c[new]] for i, c in enumerate(cols)]
        equal = firsts[0][1:] == firsts[0][:-1]
        send = np.r_[False, equal] | np.r_[equal, False] | (firsts[4] >> 7 & 1).astype(bool)
        done = send.copy()
        if waiting is not None:
            done[0] |= sent
            send[0] &= not sent
        waiting, sent = [int(f[-1]) for f in firsts], bool(done[-1])
        out = [np.r_[c[~new], f[send]] for c, f in zip(cols, firsts, strict=True)]
        kind = np.r_[np.ones(int((~new).sum()), np.int64), np.zeros(int(send.sum()), np.int64)]
        if len(kind):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, out[0], *out[2:])], names=["kind", "h", "doc", "n", "at"])


class BucketQueue:
    """Monotone priority queue over symbols: each bucket is first in, first out, and goes to disk beyond a bound."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.chunks: dict[int, list] = {}
        self.bound, self.held, self.file = in_memory, 0, None

    def push(self, symbol: int, places: np.ndarray) -> None:
        self.chunks.setdefault(symbol, []).append(places)
        self.held += len(places)
        if self.held > self.bound:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="weftline-queue-")
        self.file.seek(0, 2)
        for list_ in self.chunks.values():
            for i, x in enumerate(list_):
                if isinstance(x, np.ndarray):
                    list_[i] = (self.file.tell(), len(x))
                    self.file.write(x.tobytes())
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray:
        """All tuples of the bucket in order of arrival; the bucket is empty then."""
        out = []
        for x in self.chunks.pop(symbol, ()):
            if isinstance(x, tuple):
                self.file.seek(x[0])
                out.append(np.frombuffer(self.file.read(8 * x[1]), np.int64))
            else:
                self.held -= len(x)
                out.append(x)
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Induction:
    """Tuples (place << _BITS | common prefix with the one before) pushed to the buckets of their symbols, in the order of their inducers.

    The common prefix of two neighbours in a bucket is one more than the least among those of the processed suffixes after the first's inducer up to the
    second's; `least` holds that minimum per symbol since its last push.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int, in_memory: int, carry: bool):
        self.text, self.depth, self.queue, self.carry = text, depth, BucketQueue(in_memory), carry
        self.least, self.empty = np.full(symbols, depth, np.int64), np.ones(symbols, bool)

    def process(self, common: np.ndarray, from_: np.ndarray, places: np.ndarray) -> None:
        """The next suffixes in order have these common prefixes with those before them; the from_-th of them induces places."""
        if not self.carry:  # the first induction, of names, needs places alone
            if len(places):
                symbols = self.text[places]
                order = np.argsort(symbols, kind="stable")
                symbols, places = symbols[order], places[order] << _BITS
                cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1], True])
                for a, b in zip(cuts, cuts[1:], strict=False):
                    self.queue.push(int(symbols[a]), places[a:b])
            return
        if not len(common):
            return
        padded = np.r_[common, self.depth]
        least = np.minimum(self.least, common.min())
        if len(places):
            symbols = self.text[places]
            order = np.argsort(symbols, kind="stable")
            symbols, from_, places = symbols[order], from_[order], places[order]
            cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1], True])
            upto = np.minimum.accumulate(common)
            for a, b in zip(cuts, cuts[1:], strict=False):
                c, inducers = int(symbols[a]), from_[a:b]
                between = np.minimum.reduceat(padded, inducers + 1)  # the last is what follows the last inducer
                first = 0 if self.empty[c] else 1 + min(int(self.least[c]), int(upto[inducers[0]]))
                values = np.minimum(np.r_[first, 1 + between[:-1]], self.depth)
                self.queue.push(c, places[a:b] << _BITS | values)
                least[c], self.empty[c] = between[-1], False
        self.least = least


def _induce(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, symbols: int, in_memory: int, common: np.ndarray | None = None, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes in order, common prefix of each with the one before, up to depth), induced from an order of the left-most-S suffixes and their common prefixes."""
    carry = common is not None
    common = common if carry else np.zeros(len(seeds), np.int64)
    in_order: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    starts = text[seeds]
    order = np.argsort(starts, kind="stable")
    cuts = np.flatnonzero(np.r_[True, starts[order][1:] != starts[order][:-1], True])
    for a, b in zip(cuts, cuts[1:], strict=False):
        in_order[int(starts[order[a]])] = seeds[order[a:b]], common[order[a:b]]
    change = np.flatnonzero(np.diff(text, append=-1))

    def run(place: int) -> int:
        """How often the symbol at a place is repeated from there on."""
        return int(change[np.searchsorted(change, place)]) - place + 1 if text[place] else 0

    left: dict[int, np.ndarray] = {}
    none, low = np.zeros(0, np.int64), (1 << _BITS) - 1
    level = _Induction(text, symbols, depth, in_memory, carry)

    def induced(places: np.ndarray, values: np.ndarray, kept) -> None:
        from_ = np.flatnonzero(places > 0)
        before = places[from_] - 1
        mask = kept(before)
        level.process(values, from_[mask], before[mask])

    def is_left(before: np.ndarray) -> np.ndarray:
        return ~s_type[before]

    for c in range(symbols):
        found = [none]
        while len(now := level.queue.pop(c)):  # L-type suffixes of this symbol, wave by wave
            found.append(now)
            induced(now >> _BITS, now & low, is_left)
        left[c] = np.concatenate(found)
        if c in in_order:
            places, values = in_order[c]
            values = values.copy()
            values[0] = min(run(int(left[c][-1] >> _BITS)), run(int(places[0])), depth) if len(left[c]) else 0
            induced(places, values, is_left)
    level.queue.close()
    level = _Induction(text, symbols, depth, in_memory, carry)
    out = [none]

    def is_small(before: np.ndarray) -> np.ndarray:
        return s_type[before] & (text[before] > 0)

    for c in range(symbols - 1, -1, -1):
        last = None
        while len(now := level.queue.pop(c)):  # S-type suffixes, largest first
            out.append(now)
            last = int(now[-1] >> _BITS)
            induced(now >> _BITS, now & low, is_small)
        places, values = left[c][::-1] >> _BITS, left[c] & low
        values = np.r_[values[1:], 0][::-1] if len(values) else values  # now with the larger neighbour
        if len(places) and last is not None:
            values = values.copy()
            values[0] = min(run(last), run(int(places[0])), depth)
        if c == 0:  # separators are S-type by definition, nothing induces them, and no two are equal
            ends = in_order[0][0][::-1] if 0 in in_order else none
            places, values = np.r_[places, ends], np.r_[values, np.zeros(len(ends), np.int64)]
        if len(places):
            out.append(places << _BITS | values)
            left[c] = none
            induced(places, values, is_small)
    level.queue.close()
    both = np.concatenate(out)[::-1]
    return both >> _BITS, np.r_[0, both[:-1] & low] if len(both) else none


def suffix_order(text: np.ndarray, depth: int = LENGTH, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a text of small symbols, each part ended by a 0, sorted by their first `depth` symbols at least, and the common prefix of each with the one before, up to depth."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if text[-1] != 0:
        raise ValueError("the last part has no end")
    change = np.sign(np.diff(text.astype(np.int32), append=0)).astype(np.int8)
    change[text == 0] = 1  # an end is smaller than all that follows
    nearest = np.where(change != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    s_type = change[nearest] > 0
    del nearest, change
    lms = np.flatnonzero(s_type & ~np.r_[True, s_type[:-1]])
    if not len(lms):
        lms = np.flatnonzero(text == 0)
    symbols = int(text.max()) + 1
    # Sort the left-most-S substrings by inducing from any order of their first symbols, then name them.
    rough, _ = _induce(text, s_type, lms, symbols, in_memory)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    del rough, is_lms
    index = np.zeros(n, np.int32)
    index[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.diff(np.r_[lms, n - 1]) + 1
    a, b = ordered[:-1], ordered[1:]
    la, lb = size[index[a]], size[index[b]]
    differ = la != lb
    live, k = np.flatnonzero(~differ), 0
    while len(live):
        unequal = text[np.minimum(a[live] + k, n - 1)] != text[np.minimum(b[live] + k, n - 1)]
        differ[live[unequal]] = True
        live = live[~unequal]
        k += 1
        live = live[la[live] > k]
    rank = np.zeros(len(lms), np.int64)
    rank[index[ordered]] = np.r_[0, np.cumsum(differ)]
    # Ranks of 2k names from ranks of k names, until `depth` symbols are covered: a name spans two new symbols at least.
    k, order = 1, np.argsort(rank, kind="stable")
    while 2 * k < depth + 2 and rank.max(initial=0) < len(lms) - 1:
        second = np.r_[rank[k:], np.full(min(k, len(rank)), -1)][: len(rank)] + 1
        key = rank * (len(lms) + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        k *= 2
    del index, rank
    sorted_lms = lms[order]
    return _induce(text, s_type, sorted_lms, symbols, in_memory, common_prefixes(text, sorted_lms, depth), depth)


def common_prefixes(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols, up to depth, each place of a text of 16-bit symbols has in common with the one before in the list; an end (0) equals no other."""
    padded = np.r_[text.astype(np.int16), np.zeros(depth + 4, np.int16)]
    fours = np.ndarray((len(padded) - 3,), "<u8", padded, strides=(2,))
    common, live, k = np.zeros(len(places), np.int64), np.arange(1, len(places)), 0
    while len(live) and k < depth:
        x = fours[places[live] + k]
        ended = (x - np.uint64(0x0001000100010001)) & ~x & np.uint64(0x8000800080008000) > 0
        stops = ended | (x != fours[places[live - 1] + k])
        some = live[stops]
        for j in range(k, min(k + 4, depth)):
            x = padded[places[some] + j]
            some = some[(x == padded[places[some - 1] + j]) & (x > 0)]
            common[some] = j + 1
        live, k = live[~stops], k + 4
        common[live] = min(k, depth)
    return common


def repeated_starts(contexts: list[bytes], counts: np.ndarray, length: int = LENGTH, in_memory: int = IN_MEMORY) -> list[np.ndarray]:
    """Per context the starts, of its first `count`, whose string also starts earlier; contexts come in order of their places."""
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1
    text[firsts + sizes - 1] = 0
    order, common = suffix_order(text, length, in_memory)
    judged = np.zeros(n + 1, np.int64)
    np.add.at(judged, firsts, 1)
    np.add.at(judged, firsts + counts, -1)
    taken = np.flatnonzero(np.cumsum(judged[:n])[order] > 0)
    # Between neighbours that are judged, the least common prefix of all suffixes after the one up to the other.
    new = np.r_[True, np.minimum.reduceat(np.r_[common, length], taken + 1)[:-1] < length] if len(taken) else np.zeros(0, bool)
    order = order[taken]
    heads = np.flatnonzero(new)
    repeated = np.ones(n, bool)
    if len(heads):
        repeated[np.minimum.reduceat(order, heads)] = False
    keep = np.zeros(n, bool)
    keep[order] = True
    repeated &= keep
    places = np.flatnonzero(repeated)
    owner = np.searchsorted(firsts, places, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(contexts) + 1))
    return [places[a:b] - f for a, b, f in zip(cuts, cuts[1:], firsts, strict=False)]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]]


_FETCHED = "h long, doc long, n long, lo long, count long, bytes binary, k1 long, k2 long"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n, text, [(h, at, crowd)]) to the bytes of each surrounding, or, of a crowd, to the 128-bit digests of its strings."""
    names = [x.split()[0] for x in _FETCHED.split(", ")]
    digest = xxhash.xxh3_128_digest

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            rows = []
            for doc, n, text, asked in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for x in asked:
                    lo, count = x["at"] >> 10, x["at"] & 127
                    if not x["crowd"]:
                        rows.append((x["h"], doc, n, lo, count, raw[lo : lo + count + LENGTH - 1], None, None))
                        continue
                    for i in range(lo, lo + count):
                        k1, k2 = struct.unpack("<qq", digest(raw[i : i + LENGTH]))
                        rows.append((x["h"], doc, n, i, 1, None, k1, k2))
                    if len(rows) > 20_000:
                        yield rows_of(rows)
                        rows = []
            if rows:
                yield rows_of(rows)


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, doc, n, lo): sort the suffixes of as many anchors as fit, give the repeated intervals."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: r[1:4])
        out = []
        for r, starts in zip(rows, repeated_starts([r[5] for r in rows], np.array([r[4] for r in rows], np.int64)), strict=True):
            a, b = _runs(starts)
            out += [(r[1], r[2], r[3] + x, r[3] + y + LENGTH) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "n", "a", "b"])

    rows, size = [], 0
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if size > SHARD and r[0] != rows[-1][0]:
                yield from flush(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[5]) + 1
    if rows:
        yield from flush(rows)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            rows = []
            for doc, text, spans in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                keep, last, removed, n_spans = [], 0, 0, 0
                end = -1
                for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                    if a > end:  # touching runs are one
                        if end >= 0:
                            last = end
                        keep.append(raw[last:a])
                        n_spans += 1
                        removed += b - a
                        end = b
                    elif b > end:
                        removed += b - end
                        end = b
                keep.append(raw[max(end, 0) :])
                kept = b"".join(keep)
                rows.append((doc, len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[:5], types, strict=True)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (id, null first), n (number among rows of the same id), doc_id, text."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    if docs.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return held.select(doc.alias("doc"), F.lit(0).cast("long").alias("n"), "doc_id", "text")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1).cast("long")
    return held.select(doc.alias("doc"), number.alias("n"), "doc_id", "text")


def intervals(keyed: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc, n, a, b: byte intervals that repeat an earlier string; they may overlap."""
    n = parts(keyed.sparkSession)
    rows = keyed.select("doc", "n", "text").mapInArrow(_anchors, "h long, ctx long, doc long, n long, at long")
    classes = written(
        rows.repartition(n, "h")
        .sortWithinPartitions("h", "ctx", "doc", "n", "at")
        .mapInArrow(_sorted_classes, "kind long, h long, doc long, n long, at long")
    )
    lo, count = F.shiftright("at", 10), F.col("at").bitwiseAND(F.lit(127).cast("long"))
    whole = classes.where("kind = 1").select("doc", "n", lo.alias("a"), (lo + count + F.lit(LENGTH - 1)).cast("long").alias("b"))
    open_ = classes.where("kind = 0")
    crowded = cut(open_.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > crowd).select("h", F.lit(True).alias("crowd")))
    if crowded.count() <= MOST_BROADCAST:  # at most open rows / crowd
        crowded = F.broadcast(crowded)
    marked = open_.join(crowded, "h", "left").select("doc", "n", F.struct("h", "at", F.coalesce("crowd", F.lit(False)).alias("crowd")).alias("x"))
    asked = marked.groupBy("doc", "n").agg(F.collect_list("x").alias("asked"))  # of one document each
    sought = keyed.select("doc", "n", "text").join(asked, ["doc", "n"]).select("doc", "n", "text", "asked")
    fetched = written(sought.mapInArrow(_fetch, _FETCHED))
    shards = fetched.where("k1 IS NULL").select("h", "doc", "n", "lo", "count", "bytes").repartition(n, "h").sortWithinPartitions("h", "doc", "n", "lo")
    sorted_ = shards.mapInArrow(_sort_shards, "doc long, n long, a long, b long")
    strings, place = fetched.where("k1 IS NOT NULL").select("h", "k1", "k2", "doc", "n", F.col("lo").alias("a")), F.struct("doc", "n", "a")
    first = strings.groupBy("h", "k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    later = strings.join(first, ["h", "k1", "k2"]).where(place > F.col("first")).select("doc", "n", "a", (F.col("a") + LENGTH).alias("b"))
    return whole.unionByName(sorted_).unionByName(later)


def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    keyed = _keyed(docs)
    spans = intervals(keyed, crowd).groupBy("doc", "n").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = keyed.join(spans, ["doc", "n"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
