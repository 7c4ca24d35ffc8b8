"""Token ids in directly addressable codes (operator 7).

A segment of ids is split into chunks of eight bits. Level 0 holds the lowest chunk of every id and a bitmap that says
which ids go on; level 1 holds the next chunk of those alone, and so on. A rank directory counts the bitmap's ones before
every 512 bits, so the place of an id in the next level is one look-up and a few bit counts, and any id is read without
decoding another (:meth:`Codes.access`).

Documents are dealt to ranges of (doc_id, hash of the text), sorted inside each, and encoded there, so an id that very many rows share
is many ranges. Segments of whole documents, SEGMENT ids or one document, become the rows of Parquet files in the shared
folder, written by Spark's committer: a lost executor repeats its partition and leaves no half file. The codes are not
compressed, not dictionary-coded, and a page holds one segment, so that the file is addressable: a look-up by place reads the
page index, then the bytes of one segment, and decodes nothing but the one id (:func:`token`).

Every text is split at ASCII white space, plain words further at the borders of letters, digits and signs, and each
distinct piece is encoded by the tokenizers library once per worker and cache life. The vocabulary's own pre-tokenizer
never joins across these borders, so the ids are those of the whole text; tests compare them on odd strings.

Defined results: null, empty and blank texts have the end id alone; rows that repeat a doc_id each get a place, one after
the other, in order of a hash of the text; null ids come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import parts, shared_dir

END_ID = 1
SEGMENT = 1 << 16
#: Bytes of words and their ids that a worker remembers; beyond, it forgets all and starts anew, which costs time and never a result.
CACHE_BYTES, ENTRY_BYTES = 320 << 20, 160
MAGIC = b"WDAC\x01"
RANK_BITS = 512


#: Words of ASCII and precomposed Latin letters: normal forms and lower case are character by character there, and the
#: vocabulary's pre-tokenizer cuts them as _CUT does. All other words, and those that may hold a special token, go whole to the library.
_PLAIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]+")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\u017e]+")


#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_OWN))}


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes, one library call for the new words of a batch."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.cache: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.held = 0
        self.model = self.tokenizer.model
        self.plain = self._cuts_alike()

    def _cuts_alike(self) -> bool:
        """Whether the vocabulary is of the kind that _CUT describes: lower case, and cut like a probe text."""
        probe = "It'S Don't 12a3,b!! Éa-ß_(x)"
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        cut = b"".join(self._run(c) for w in probe.split() for c in _CUT.findall(w.lower()))
        return np.array(whole, "<u4").tobytes() == cut

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _run(self, run: str) -> bytes:
        """One piece by the library's model alone; bytes above 127 and blanks are written as the byte-level alphabet has them."""
        text = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_LEVEL)
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[bytes]) -> None:
        rest, run, cache, plain = [], self.runs, self.cache, _PLAIN.fullmatch if self.plain else lambda w: None
        for raw in words:
            w = raw.decode("utf-8", "surrogatepass")
            if plain(w) and "<|" not in w:
                ids = b""
                for p in _CUT.findall(w.lower()):
                    got = run.get(p)
                    if got is None:
                        got = run[p] = self._run(p)
                        self.held += 4 * len(p) + len(got) + ENTRY_BYTES
                    ids += got
                cache[raw] = ids
                self.held += len(raw) + len(ids) + ENTRY_BYTES
            else:
                rest.append(w)
        if rest:
            for w, ids in zip(rest, self._whole(rest), strict=True):
                raw = w.encode("utf-8", "surrogatepass")
                cache[raw] = ids
                self.held += len(raw) + len(ids) + ENTRY_BYTES

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.runs.clear()
            self.held = 0
        get, got, holes, new = self.cache.get, [], [], set()
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").split()
            ids = list(map(get, words))
            got.append(ids)
            if None in ids:
                at = [(i, words[i]) for i, x in enumerate(ids) if x is None]
                holes.append((ids, at))
                new.update([w for _, w in at])
        if new:
            self.learn(list(new))
        for ids, at in holes:
            for i, w in at:
                ids[i] = get(w)
        return [b"".join(ids) for ids in got]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One per worker and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def pack(ids: np.ndarray) -> bytes:
    """The file image of one segment."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(bits).astype(np.int64)
        blocks = np.add.reduceat(ones, np.arange(0, len(ones), RANK_BITS // 8)) if len(ones) else ones
        ranks = np.r_[0, np.cumsum(blocks)[:-1]].astype("<u4") if len(blocks) else np.zeros(0, "<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<B", len(levels))
    return head + b"".join(struct.pack("<Q", n) + chunks + bits + ranks for n, chunks, bits, ranks in levels)


class Codes:
    """Reader of one segment."""

    def __init__(self, image: bytes):
        if image[: len(MAGIC)] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        view, at = memoryview(image), len(MAGIC) + 1
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(image[len(MAGIC)]):
            (n,) = struct.unpack_from("<Q", view, at)
            at += 8
            n_bits = -(-n // 8)
            n_ranks = -(-n_bits // (RANK_BITS // 8))
            self.levels.append(
                (
                    np.frombuffer(view, np.uint8, n, at),
                    np.frombuffer(view, np.uint8, n_bits, at + n),
                    np.frombuffer(view, "<u4", n_ranks, at + n + n_bits),
                )
            )
            at += n + n_bits + 4 * n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // RANK_BITS
        first = block * (RANK_BITS // 8)
        ones = int(ranks[block]) + int(np.bitwise_count(bits[first : i >> 3]).sum())
        return ones + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()

    def access(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        out = shift = 0
        for chunks, bits, ranks in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            i, shift = self.rank(bits, ranks, i), shift + 8
        raise ValueError("the last level says that it goes on")

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop: two ranks a level, and no id outside is touched."""
        out = np.zeros(stop - start, np.uint32)
        places, shift = np.arange(stop - start), 0
        for chunks, bits, ranks in self.levels:
            out[places] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if start == stop:
                break
            flags = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].astype(bool)
            places = places[flags]
            start = self.rank(bits, ranks, start)
            stop, shift = start + len(places), shift + 8
            if not len(places):
                break
        return out


def _segments(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(vocabulary), struct.pack("<I", end_id)
        number = before = 0
        docs, sizes, held = [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, before, docs, sizes, held
            ids = np.frombuffer(b"".join(held), "<u4")
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([docs], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([pack(ids)], pa.binary()),
                ],
                names=["part", "segment", "start", "doc_ids", "sizes", "n_tokens", "codes"],
            )
            number, before, docs, sizes, held = number + 1, before + len(ids), [], [], []
            return row

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                for doc, ids in zip(piece.column(0).to_pylist(), code.encode(piece.column(1).to_pylist()), strict=True):
                    held.append(ids + end)
                    docs.append(doc)
                    sizes.append(len(ids) // 4 + 1)
                    total += sizes[-1]
                    if total >= SEGMENT:
                        yield flush()
                        total = 0
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, n: int | None = None) -> None:
    """Write the ids of all documents in ascending doc_id order to the folder path, in n or fewer ranges."""
    spark = docs.sparkSession
    n = n or parts(spark)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc(), F.asc_nulls_first("text")]
    # With a number of partitions, ranges are not coalesced: partition numbers are in order of doc_id.
    rows = held.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).mapInArrow(
        _segments(vocabulary, end_id),
        "part int, segment int, start long, doc_ids array<long>, sizes array<long>, n_tokens long, codes binary",
    )
    plain = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1", "parquet.block.size": str(16 << 20)}
    rows.write.options(**plain).parquet(path)


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row a range of the layout, as many as shuffle partitions: a fixed bound for the window and the broadcast.
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                codes, start = Codes(b.column(4)[i].as_py()), b.column(0)[i].as_py() + b.column(1)[i].as_py()
                sizes = np.asarray(b.column(3)[i].values, dtype=np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(codes.slice(e - s, e).astype("<u4").tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(2)[i].values, pa.array(start + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = files.join(F.broadcast(before), "part").select("base", "start", "doc_ids", "sizes", "codes")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token(files: DataFrame, place: int) -> int:
    """The id at one place of the whole corpus: only the segment that holds it is read."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a range
    ends = np.cumsum([r["n"] for r in totals]).tolist()
    k = bisect_right(ends, place)
    if place < 0 or k == len(ends):
        raise IndexError(place)
    local = place - (ends[k - 1] if k else 0)
    row = files.where((F.col("part") == totals[k]["part"]) & (F.col("start") <= local) & (F.col("start") + F.col("n_tokens") > local)).first()
    return Codes(bytes(row["codes"])).access(local - row["start"])


def token_table(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write docs to a new shared folder and read the table back."""
    write(docs, path := f"{shared_dir(docs.sparkSession)}/tokens", vocabulary, end_id)
    return read(docs.sparkSession.read.parquet(path))
