"""SimHash near duplicates by anchor-point covering (operator 10).

Fingerprints are made in one pass. They are linked when at most four bits differ, and no two fingerprints are compared
unless a code word brings them together:

* The 64 bits are two halves of 32. Of four differing bits at most two fall into one of the halves.
* In each half, 31 bits are read as a word of the perfect Hamming [31, 26] code; its code words are the anchors and its
  covering radius is 1. Between two words that differ in two bits lies a midpoint one bit from both, so with a threshold
  of one bit on each side, every fingerprint is replicated to all anchors within covering radius plus threshold = 2:
  the one or sixteen code words whose distance is at most two. Two words within two bits always share an anchor.
* Per anchor, rows are compared exactly on all 64 bits and only a spanning forest of the links is emitted, so a group of
  n near copies gives n - 1 rows and not n * n / 2. Anchors that hold many fingerprints are cut into tiles, and each pair of
  tiles is a task's group of bounded size.

* An anchor with over MIDPOINTS fingerprints would need too many pairs of tiles. There, every fingerprint goes to all words within two bits of it
  instead: two fingerprints link if and only if they share such a midpoint, so those of one midpoint are linked without a comparison, by
  the least of them, which is aggregated before it is shuffled. Its cost is 2081 short rows a fingerprint, however many there are.

Components come from star contraction over the forest edges, with every round written to the checkpoint folder; hubs are broadcast.

Defined results: null, empty and blank texts have no words and fingerprint zero, and link like any other; repeated
ids share what their texts give; a null id is kept as a row of its own fingerprint; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut, parts, written
from weftline.operators.graphs import components as graph_components

SEED, SHINGLE, THRESHOLD = 42, 4, 4
#: Fingerprints of one anchor that one group may hold; larger anchors are tiled.
TILE = 4096
#: Fingerprints of an anchor from which pairs of tiles cost more than midpoints: 2081 copies, of tiles of half a TILE.
MIDPOINTS = 2081 * TILE // 2


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    return int(repeated_fingerprints(text, 1, k)[0])


def _mixed(h: np.ndarray, repetition: int) -> np.ndarray:
    """The hashes of one repetition: h itself in the first, then a 64-bit finaliser of h and the repetition."""
    if not repetition:
        return h
    x = h + np.uint64(repetition * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_fingerprints(text: str | None, repetitions: int, k: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit SimHashes of one text, by independent hashes of the same shingles; the first is :func:`fingerprint`."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and exactly \x20 \x09-\x0D
    if not words:
        return np.zeros(repetitions, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = memoryview(b" ".join(words))
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, [s - 1 for s in starts[k:]], strict=False)]
    n = len(hashes)
    counts = np.zeros((repetitions, 64), dtype=np.int64)
    for at in range(0, n, 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        for r in range(repetitions):
            bits = np.unpackbits(_mixed(block, r).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[r] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repetitions: int = 1) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; fp1, fp2 and so on of further repetitions."""
    names = _names(repetitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([repeated_fingerprints(t.as_py(), repetitions) for t in b.column(1)], dtype=np.uint64).reshape(-1, repetitions).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(fps[:, r].copy()) for r in range(repetitions))], names=["doc_id", *names])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *names])
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def _names(repetitions: int) -> list[str]:
    return ["fp", *(f"fp{r}" for r in range(1, repetitions))]


def _syndromes(words: np.ndarray) -> np.ndarray:
    """XOR of the 1-based places of the set bits among the low 31: the Hamming syndrome."""
    out = np.zeros(len(words), dtype=np.uint64)
    for bit in range(31):
        out ^= ((words >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all code words within two bits of each 31-bit word."""
    s = _syndromes(words)
    rows, out = [np.arange(len(words))], [words ^ np.where(s > 0, np.uint64(1) << np.maximum(s, 1) - np.uint64(1), 0).astype(np.uint64)]
    live = np.flatnonzero(s)
    for a in range(1, 32):  # pairs of places whose XOR is the syndrome, each once
        b = s[live] ^ np.uint64(a)
        ok = b > a
        rows.append(live[ok])
        out.append(words[live[ok]] ^ (np.uint64(1) << np.uint64(a - 1)) ^ (np.uint64(1) << (b[ok] - np.uint64(1))))
    return np.concatenate(rows), np.concatenate(out)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = np.uint64((1 << 31) - 1)
    for b in batches:
        for at in range(0, b.num_rows, 20_000):
            part = b.slice(at, 20_000)
            node = np.asarray(part.column(0))
            for repetition in range(part.num_columns - 1):
                fp = np.asarray(part.column(repetition + 1))
                bits = fp.view(np.uint64)
                for half in (0, 1):
                    r, a = anchors((bits >> np.uint64(32 * half)) & low)
                    a |= np.uint64(repetition << 32 | half << 31)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(node[r]), pa.array(fp[r])], names=["anchor", "node", "fp"])


def forest(node: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph of one group.

    A breadth-first search that compares each found fingerprint with those not yet reached: a dense group of copies is
    consumed in a few vector steps, and only rows of different components are compared pair by pair.
    """
    left = np.argsort(node, kind="stable")
    bits = fp.view(np.uint64)
    child, root = [], []
    while len(left) > 1:
        start, left = left[0], left[1:]
        queue, member = [start], []
        while queue and len(left):
            near = np.bitwise_count(bits[left] ^ bits[queue.pop()]) <= threshold
            if near.any():
                got = left[near]
                left = left[~near]
                member.append(got)
                queue.extend(got.tolist())
        if member:
            all_of = np.concatenate(member)
            child.append(node[all_of])
            root.append(np.full(len(all_of), node[start]))
    if not child:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(child), np.concatenate(root)


def _compare(threshold: int):
    """Rows sorted by group: compare inside each group; groups may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        for b in batches:
            cols = [np.concatenate([h, np.asarray(b.column(i))]) for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            held = [c[end:] for c in cols]
            yield from edges(*(c[:end] for c in cols))
        yield from edges(*held)

    def edges(anchor: np.ndarray, tile: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(anchor)
        if n < 2:
            return
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])])
        sizes = np.diff(np.r_[new, n])
        child, root = [], []
        small = np.repeat(sizes <= 32, sizes)
        place = np.arange(n) - np.repeat(new, sizes)
        bits = fp.view(np.uint64)
        most = int(sizes[sizes <= 32].max(initial=1))
        for d in range(1, most):  # all small groups at once: each row with the d-th before it
            i = np.flatnonzero(small & (place >= d))
            i = i[np.bitwise_count(bits[i] ^ bits[i - d]) <= threshold]
            i = i[node[i] != node[i - d]]
            child.append(np.maximum(node[i], node[i - d]))
            root.append(np.minimum(node[i], node[i - d]))
        for g in np.flatnonzero(sizes > 32):
            at = slice(new[g], new[g] + sizes[g])
            c, r = forest(node[at], fp[at], threshold)
            child.append(c[c != r])
            root.append(r[c != r])
        if child and sum(map(len, child)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(child)), pa.array(np.concatenate(root))], names=["u", "v"])

    return run


def links(nodes: DataFrame, threshold: int = THRESHOLD, tile: int = TILE, midpoints: int = MIDPOINTS) -> DataFrame:
    """Forest edges u > v between nodes (node, fp and perhaps fp1, fp2 and so on) with a fingerprint within threshold bits of the other's of the
    same repetition; every link's ends are connected by them.

    threshold may be at most 4, which the two halves and the radius of the code cover.
    """
    if not 0 <= threshold <= 4:
        raise ValueError("the covering is made for at most four differing bits")
    spark = nodes.sparkSession
    copies = nodes.select("node", *[c for c in nodes.columns if c != "node"]).mapInArrow(_replicate, "anchor long, node long, fp long")
    return tiled(copies, threshold, tile, parts(spark), midpoints)


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repetition, node, fp) to (repetition, point, node) for the 2081 words within two bits; each task keeps the least node of its points in a batch."""
    ones = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.r_[np.zeros(1, np.uint64), ones, ones[i] | ones[j]]
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            repetition, node, fp = np.asarray(part.column(0)), np.asarray(part.column(1)), np.asarray(part.column(2)).view(np.uint64)
            points, n = (fp[:, None] ^ flips[None, :]).ravel().view(np.int64), len(flips)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(repetition, n)), pa.array(points), pa.array(np.repeat(node, n))], names=["repetition", "point", "node"])


def by_midpoints(nodes: DataFrame) -> DataFrame:
    """Edges u > v between each fingerprint and the least one at each of its midpoints: those within four bits are connected, and no others."""
    key = ["repetition", "point"]
    points = nodes.select("repetition", "node", "fp").mapInArrow(_midpoints, "repetition long, point long, node long")
    least = points.groupBy(*key).agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select(*key, "v")
    return points.join(least, key).where("node > v").select(F.col("node").alias("u"), "v").distinct()


def tiled(copies: DataFrame, threshold: int, tile: int, n: int, midpoints: int = MIDPOINTS) -> DataFrame:
    """Compare per anchor. Rows of an anchor with over `tile` fingerprints are dealt to k blocks by hash, and go to each pair of blocks; with over `midpoints`, by those."""
    every = copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > tile)
    sizes = cut(every)  # anchors are few: at most rows / tile
    dense = sizes.where(F.col("size") > midpoints)
    extra = None
    if threshold == 4 and not dense.isEmpty():
        crowd = copies.join(dense.select("anchor"), "anchor", "left_semi")
        extra = by_midpoints(crowd.select(F.shiftright("anchor", 32).alias("repetition"), "node", "fp").distinct())
        copies = copies.join(dense.select("anchor"), "anchor", "left_anti")
    k = F.ceil(F.col("size") / (tile / 2)).cast("int")
    both = copies.join(sizes, "anchor", "left").select(
        "anchor", "node", "fp", F.when(F.col("size").isNull(), F.lit(0)).otherwise(k).alias("k")
    )
    own = F.pmod(F.xxhash64("node"), F.greatest("k", F.lit(1)).cast("long")).cast("int")
    pairs = F.when(F.col("k") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0))),
            lambda j: (F.least(j, own) * F.col("k").cast("long") + F.greatest(j, own)).cast("long") + 1,
        )
    )
    dealt = both.select("anchor", F.explode(pairs).alias("tile"), "node", "fp")
    found = dealt.repartition(n, "anchor", "tile").sortWithinPartitions("anchor", "tile").mapInArrow(_compare(threshold), "u long, v long").distinct()
    return found if extra is None else found.unionByName(extra).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node with an edge; no number of rounds is too many, no node's edges are one task's."""
    return graph_components(edges.where("u <> v"), "u", "v")


def _joined(nodes: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """nodes with their component, themselves where they have no edge, instead of `node`."""
    return nodes.join(found, "node", "left").withColumn(name, F.coalesce("component", "node")).drop("node", "component")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, repetitions: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    With repetitions, texts have so many independent fingerprints and link where any of them is within the threshold: one fingerprint at four bits
    finds few of the pairs at a similarity of 0.8, and each repetition finds its own share of the rest. Equal texts are equal in all.
    """
    names = _names(repetitions)
    prints = cut(fingerprints(docs, repetitions=repetitions))
    nodes = prints.where("doc_id IS NOT NULL").groupBy(*names).agg(F.min("doc_id").alias("node"))
    of_print = _joined(nodes, components(links(nodes.select("node", "fp"), threshold)), "component_id")
    if repetitions > 1:
        # The further fingerprints stand for the component that the first one made, so what is linked already gives no edges again.
        first = written(of_print).withColumnRenamed("component_id", "node")
        later = components(links(first.select("node", *names[1:]).distinct(), threshold))
        of_print = _joined(first, later, "component_id")
    of_print = of_print.select(*names, "component_id")
    return prints.join(of_print, names, "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(docs: DataFrame, threshold: int = THRESHOLD, repetitions: int = 1) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; rows without an id stay.

    Of rows that repeat the kept id with the same fingerprint, all stay: ids are the table's key.
    """
    kept = near_duplicates(docs, threshold, repetitions).where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi").unionByName(docs.where("doc_id IS NULL"))
