"""SentencePiece encoding and decoding (operator 6).

The pieces form an Aho-Corasick automaton. One pass over a text follows it; at each position the output links list all
pieces that end there, and each relaxes the best score of its end (Viterbi). A character that no piece covers costs the
lowest score less ten and becomes its bytes, as in the public library's unigram segmentation. Scores are summed in double
precision and the result is the exact optimum; among equal paths the one whose last piece begins first wins.

No piece holds a space mark after another character and none holds a line feed beside others (checked when the model is
loaded), so a best path always breaks before each run of spaces and around each line feed. The pass therefore runs on such segments,
and a worker remembers the ids of segments that it has seen; what it forgets is computed anew.

Decoding joins the pieces' bytes and takes off the one space that encoding puts first. It gives the text back unless the
text holds U+2581, which the model itself uses for the space.

Defined results: null and empty texts have no ids; blank texts keep their spaces; repeated rows are encoded each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of segments and their ids that a worker remembers; beyond, it forgets all and starts anew, which costs time and never a result.
CACHE_BYTES, ENTRY_BYTES, LONGEST_KEPT = 128 << 20, 160, 256
_SEGMENTS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Pieces:
    """The automaton of a model's pieces: piece, score and kind are read with the public library; segmentation is our own."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.unknown = lib.unk_id()
        self.automaton = ahocorasick.Automaton()
        lowest, whole = 0.0, True
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text, score = piece.replace(MARK, " "), lib.get_score(i)
                self.automaton.add_word(text, (len(text), score, i))
                self.bytes_of.append(text.encode())
                lowest = min(lowest, score)
                whole &= " " not in text.lstrip(" ") and ("\n" not in text or text == "\n")
        self.automaton.make_automaton()
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.segmented = whole
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def best(self, text: str) -> list[int]:
        """Ids of the best path over one segment."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        at, single = 0, False

        def close(end: int) -> None:
            """All pieces that end at `end` are known; without a one-character piece the unknown character competes."""
            if not single:
                s = best[end - 1] + self.unknown_score
                if best[end] is None or s > best[end]:
                    best[end], back[end] = s, (1, None)

        for last, (size, score, piece) in self.automaton.iter(text):
            end = last + 1
            while at < end:
                if at:
                    close(at)
                at, single = at + 1, False
            single |= size == 1
            s = best[end - size] + score
            # Of equal paths the one whose last piece begins first stays, which the library's left-to-right pass finds first.
            if best[end] is None or s > best[end] or (s == best[end] and size > back[end][0]):
                best[end], back[end] = s, (size, piece)
        while at < n:
            if at:
                close(at)
            at, single = at + 1, False
        if n:
            close(n)
        out: list[int] = []
        while n:
            size, piece = back[n]
            if piece is None:
                raw = text[n - 1].encode("utf-8", "surrogatepass")
                out += [self.byte_id.get(b, self.unknown) for b in reversed(raw)] if self.byte_id else [self.unknown]
            else:
                out.append(piece)
            n -= size
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        line = " " + text.replace(MARK, " ")
        segments = _SEGMENTS.findall(line) if self.segmented else [line]
        get = self.cache.get
        got = list(map(get, segments))
        if None in got:
            for i, (s, g) in enumerate(zip(segments, got, strict=True)):
                if g is None and (g := get(s)) is None:
                    g = np.array(self.best(s), "<i4").tobytes()
                    if len(s) <= LONGEST_KEPT:  # long segments hardly come again
                        if self.held > CACHE_BYTES:
                            self.cache.clear()
                            self.held = 0
                        self.cache[s] = g
                        self.held += 4 * len(s) + len(g) + ENTRY_BYTES
                got[i] = g
        return b"".join(got)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_MODELS: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One per worker and model."""
    if model not in _MODELS:
        _MODELS[model] = Pieces(model)
    return _MODELS[model]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, ids_crc32 and round_trip (decoding gives the text back) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = [p.encode(t) for t in texts]
                arrays = [np.frombuffer(x, "<i4") for x in ids]
                sizes = np.array([len(a) for a in arrays], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes),
                        lists,
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([p.decode(a) == (t or "") for a, t in zip(arrays, texts, strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"],
                )

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean"
    )


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids array<int>; a null array is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = [p.decode(np.asarray(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
