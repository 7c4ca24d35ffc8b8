"""Joins beyond equality: as-of, band, range, similarity and pair generation.

Nearest-value and band joins never pair all rows. An as-of join is a union of both sides and one ordered window per
key, so the cost is a sort. A band join meets rows of neighbouring buckets as wide as the band. Cross products exist for
small generated ranges and check what they are given.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions import arrays as V
from weftline.operators.ordering import hashable, ranged, with_index

Names = Sequence[str]


def asof(left: DataFrame, right: DataFrame, on: str, by: Names = (), direction: str = "backward", prefix: str = "r_", split: bool | None = None) -> DataFrame:
    """Each left row with the nearest right row of its group: at or before (backward), at or after (forward), or nearest.

    Right columns get the prefix; nulls where there is none. Of equal right values the one that orders first by its other columns
    counts; of equally near ones the earlier.

    With by, each group is one ordered window. Without, or with split (for tables one of whose groups is a large share of the
    rows), the search runs over the distinct times of a range-partitioned table, and the last values of its ranges are carried on.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    rest = [c for c in right.columns if c not in by]
    if split or split is None and not by:
        return _asof_split(left, right, on, by, direction, prefix)
    once = right.groupBy(*by, on).agg(F.min(F.struct(*[c for c in rest if c != on])).alias("_r")) if len(rest) > 1 else right.select(*by, on).distinct().withColumn("_r", F.struct(F.lit(1)))
    payload = F.struct(F.col(on).alias("at"), F.col("_r").alias("row"))
    kind = f"struct<at:{dict(right.dtypes)[on]},row:{dict(once.dtypes)['_r']}>"
    marked = once.select(*by, F.col(on), F.lit(0).alias("_side"), payload.alias("_right"), F.lit(None).cast(left.select(F.struct("*")).dtypes[0][1]).alias("_left"))
    asked = left.select(*by, F.col(on), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_right"), F.struct(*left.columns).alias("_left"))
    both = marked.unionByName(asked)
    w = W.partitionBy(*by)
    # Of equal times the right side comes first when looking back, and when looking ahead.
    back = F.last("_right", ignorenulls=True).over(w.orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.last("_right", ignorenulls=True).over(w.orderBy(F.col(on).desc(), "_side").rowsBetween(W.unboundedPreceding, 0))
    if direction == "backward":
        found = both.withColumn("_hit", back)
    elif direction == "forward":
        found = both.withColumn("_hit", ahead)
    else:
        held = both.withColumn("_b", back).withColumn("_a", ahead)
        nearer = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b"))
        found = held.withColumn("_hit", nearer.otherwise(F.when((F.col("_a.at") - F.col(on)) < (F.col(on) - F.col("_b.at")), F.col("_a")).otherwise(F.col("_b"))))
    out = [F.col(f"_left.{c}").alias(c) for c in left.columns] + [F.col("_hit.at").alias(prefix + on)]
    out += [F.col(f"_hit.row.{c}").alias(prefix + c) for c in rest if c != on]
    return found.where("_side = 1").select(*out)


def _asof_split(left: DataFrame, right: DataFrame, on: str, by: Names, direction: str, prefix: str) -> DataFrame:
    """asof over range partitions. A row is (_by, _on, _r): _r is null for the times of the left side, which are asked for once each."""
    rest = [c for c in right.columns if c not in by and c != on]
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    value = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    known = right.select(group.alias("_by"), F.col(on).alias("_on"), value.alias("_v")).groupBy("_by", "_on").agg(F.min("_v").alias("_v"))
    known = known.select("_by", "_on", F.struct(F.col("_on").alias("at"), F.col("_v").alias("row")).alias("_r"))
    asked = left.select(group.alias("_by"), F.col(on).alias("_on")).distinct()
    keys = ["_by", F.struct("_on").alias("_at")]  # inside a struct, null times meet each other
    held = ranged(asked.select(*keys, F.lit(True).alias("_asked")).join(known.select(*keys, "_r"), ["_by", "_at"], "full"), ["_by", "_at"])
    own, across = W.partitionBy("_by", "_part").orderBy("_at"), W.partitionBy("_by").orderBy("_part")
    # A row for each range that a group touches.
    when = F.when(F.col("_r").isNotNull(), F.col("_at"))
    ends = held.groupBy("_by", "_part").agg(F.max_by("_r", when).alias("_last"), F.min_by("_r", when).alias("_first"))
    ends = ends.select(
        "_by",
        "_part",
        F.last("_last", True).over(across.rowsBetween(W.unboundedPreceding, -1)).alias("_last"),
        F.first("_first", True).over(across.rowsBetween(1, W.unboundedFollowing)).alias("_first"),
    )
    found = held.withColumn("_b", F.last("_r", True).over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("_a", F.first("_r", True).over(own.rowsBetween(0, W.unboundedFollowing)))
    found = found.where("_asked").join(ends, ["_by", "_part"])
    b, a, t = F.coalesce("_b", "_last"), F.coalesce("_a", "_first"), F.col("_at._on")
    nearer = F.when(b.isNull(), a).when(a.isNull(), b).when((a["at"] - t) < (t - b["at"]), a).otherwise(b)
    hits = found.select("_by", "_at", {"backward": b, "forward": a, "nearest": nearer}[direction].alias("_hit"))
    joined = left.withColumn("_by", group).withColumn("_at", F.struct(F.col(on).alias("_on"))).join(hits, ["_by", "_at"])
    return joined.select(*left.columns, F.col("_hit.at").alias(prefix + on), *[F.col(f"_hit.row.{c}").alias(prefix + c) for c in rest])


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, low: int, high: int, by: Names = ()) -> DataFrame:
    """Pairs with a + low <= b <= a + high over whole numbers; rows meet in buckets of the band's width, each pair once."""
    if high < low:
        raise ValueError("the band is empty")
    width = high - low + 1
    first = F.floor((F.col(a) + low) / width)
    # The band of a left row touches two buckets at most.
    lefts = left.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, F.floor((F.col(a) + high) / width)))))
    rights = right.withColumn("_bucket", F.floor(F.col(b) / width))
    hit = (F.col(b) >= F.col(a) + low) & (F.col(b) <= F.col(a) + high)
    return lefts.join(rights, [*by, "_bucket"]).where(hit).drop("_bucket")


def range_join(points: DataFrame, ranges: DataFrame, x: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside [start, end): ranges are laid over the buckets of `width` that they touch; wide ranges cost one row a bucket."""
    laid = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_bucket", F.floor(F.col(x) / width)).join(laid, "_bucket").where((F.col(x) >= F.col(start)) & (F.col(x) < F.col(end))).drop("_bucket")


def lte(values: Column, target: Column) -> Column:
    """struct(index, value) of the largest element <= target, the first of equals; (-1, null) without one."""
    return _extreme(F.filter(_numbered(values), lambda s: s["v"] <= target), lambda s: F.struct(-s["v"], s["i"]))


def gte(values: Column, target: Column) -> Column:
    """struct(index, value) of the smallest element >= target, likewise."""
    return _extreme(F.filter(_numbered(values), lambda s: s["v"] >= target), lambda s: F.struct(s["v"], s["i"]))


def closest(values: Column, target: Column) -> Column:
    """struct(index, value) of the nearest element; the first of ties."""
    return _extreme(_numbered(values), lambda s: F.struct(F.abs(s["v"] - target), s["i"]), target)


def _numbered(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(v.alias("v"), i.cast("long").alias("i")))


def _extreme(found: Column, key, target: Column | None = None) -> Column:
    keyed = F.transform(found, lambda s: F.struct(key(s).alias("k"), s.alias("s")))
    best = F.array_min(keyed)
    return F.when(best.isNull(), F.struct(F.lit(-1).cast("long").alias("i"), F.lit(None).cast("double").alias("v"))).otherwise(
        F.struct(best["s"]["i"].alias("i"), best["s"]["v"].cast("double").alias("v"))
    )


def bisect_left(values: Column, target: Column) -> Column:
    """Position before which all elements of a sorted array are smaller."""
    return F.size(F.filter(values, lambda v: v < target)).cast("long")


def bisect_right(values: Column, target: Column) -> Column:
    return F.size(F.filter(values, lambda v: v <= target)).cast("long")


def bisect_predicate(low: int, high: int, test, right: bool = False) -> int:
    """Binary search for the border of a monotone function that returns a negative, zero or positive number."""
    while low < high:
        mid = (low + high) // 2
        r = test(mid)
        if r < 0 or right and r == 0:
            low = mid + 1
        else:
            high = mid
    return low


def triangular(df: DataFrame, key: str, columns: Names) -> DataFrame:
    """All pairs of rows with key < key; a theta join for small tables of unlike rows (its result is quadratic by definition)."""
    left = df.select(*[F.col(c).alias(f"{c}_a") for c in columns])
    right = df.select(*[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, F.col(f"{key}_a") < F.col(f"{key}_b"))


def product(tables: Sequence[DataFrame]) -> DataFrame:
    """All combinations, the first table outermost; for small tables, as the result is their product."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out


def range_product(spark: SparkSession, n: int, depth: int) -> DataFrame:
    """i0, i1, ..: the depth-fold product of range(n)."""
    return product([spark.range(n).select(F.col("id").alias(f"i{k}")) for k in range(depth)])


def monotone_indices(spark: SparkSession, *sizes: int) -> DataFrame:
    """Index tuples that never fall."""
    out = spark.range(sizes[0]).select(F.col("id").alias("i0"))
    for k, n in enumerate(sizes[1:], 1):
        out = out.join(spark.range(n).select(F.col("id").alias(f"i{k}")), F.col(f"i{k - 1}") <= F.col(f"i{k}"))
    return out


def within_hamming(df: DataFrame, key: str, words: str, threshold: int, pieces: int) -> DataFrame:
    """Pairs of rows whose arrays of longs differ in at most `threshold` < `pieces` places of `pieces`; an equal piece brings them together."""
    if threshold >= pieces:
        raise ValueError("more pieces than differing places are needed for one to be equal")
    held = df.select(F.col(key), F.col(words))
    laid = held.select(key, words, F.posexplode(words).alias("_p", "_w"))
    a, b = laid.select(F.col(key).alias("a"), F.col(words).alias("_wa"), "_p", "_w"), laid.select(F.col(key).alias("b"), F.col(words).alias("_wb"), "_p", "_w")
    differ = F.size(F.filter(F.zip_with("_wa", "_wb", lambda x, y: x != y), lambda z: z))
    near = a.join(b, ["_p", "_w"]).where(F.col("a") < F.col("b")).withColumn("distance", differ.cast("long")).where(F.col("distance") <= threshold)
    return near.select("a", "b", "distance").distinct()


#: Shares of a key's rows in joins whose keys may be hot; what is joined with them goes to every share.
SHARES = 16


def meet(rows: DataFrame, asked: DataFrame, on: Names) -> DataFrame:
    """rows joined with asked on equal columns. A row goes to one share of its key and an asked one to all, so the pairs of a hot key are many tasks' work."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    share = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema.fields if hashable(f.dataType)]), F.lit(SHARES)).cast("int")
    dealt = rows.withColumn("_share", share).repartition(n, *on, "_share")
    return dealt.join(asked.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(n, *on, "_share"), [*on, "_share"]).drop("_share")


def metric_range(df: DataFrame, queries: DataFrame, x: str, q: str, radius: float, pivot: float) -> DataFrame:
    """One-dimensional metric search |x - q| <= radius; rows meet by their distance from a pivot, in rings as wide as the radius."""
    ring = F.floor(F.abs(F.col(x) - pivot) / radius)
    asked = queries.withColumn("_ring", F.explode(F.array(*[F.floor(F.abs(F.col(q) - pivot) / radius) + k for k in (-1, 0, 1)])))
    return meet(df.withColumn("_ring", ring), asked, ["_ring"]).where(F.abs(F.col(x) - F.col(q)) <= radius).drop("_ring")


def metric_search(df: DataFrame, queries: DataFrame, x: str, q: str, distance, radius: float, pivots: Sequence[Column], name: str = "distance") -> DataFrame:
    """Rows and queries with distance(x, q) <= radius under any metric over any type (a function of two columns).

    Distances to fixed pivots stand for the tree's nodes: by the triangle inequality they differ by radius at most between
    rows that match. Distinct values meet in rings of the first pivot, a row's in its ring and a query's in three; the other
    pivots filter what meets, and the metric itself is computed last, once for equal values. Then the values' rows are laid out. radius is above 0.
    """
    if radius <= 0 or not pivots:
        raise ValueError("a radius above 0 and a pivot are needed")

    def rings(c: str, out: str) -> list[Column]:
        return [distance(F.col(c), p).cast("double").alias(f"_{out}{i}") for i, p in enumerate(pivots)]

    def matched(rows: DataFrame, asked: DataFrame, x: str, q: str) -> DataFrame:
        rows = rows.select("*", *rings(x, "x")).withColumn("_ring", F.floor(F.col("_x0") / radius))
        asked = asked.select("*", *rings(q, "q")).withColumn("_ring", F.explode(F.array(*[F.floor(F.col("_q0") / radius) + k for k in (-1, 0, 1)])))
        met = meet(rows, asked, ["_ring"])
        for i in range(len(pivots)):
            met = met.where(F.abs(F.col(f"_x{i}") - F.col(f"_q{i}")) <= radius)
        hit = met.withColumn(name, distance(F.col(x), F.col(q))).where(F.col(name) <= radius)
        return hit.drop("_ring", *[f"_{s}{i}" for s in "xq" for i in range(len(pivots))])

    if not (hashable(df.schema[x].dataType) and hashable(queries.schema[q].dataType)):  # values that can't be told to be equal
        return matched(df, queries, x, q)
    values = matched(df.select(F.col(x).alias("_value")).distinct(), queries.select(F.col(q).alias("_wanted")).distinct(), "_value", "_wanted")
    asked = queries.withColumn("_wanted", F.col(q)).join(values, "_wanted").drop("_wanted")
    return meet(df.withColumn("_value", F.col(x)), asked, ["_value"]).drop("_value")


#: Vectors of a block in manhattan_search, and rows of it that are compared with all queries of a block at a time.
VECTORS, ROWS = 1024, 64


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, vector to length, keys, numbers: blocks of vectors of equal length; those with a null can't match and go."""
    for b in batches:
        keys, vectors = b.column(0), b.column(1)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
        for length in np.unique(lengths[lengths >= 0]):
            of = pa.array(np.flatnonzero(lengths == length))
            flat, held = vectors.take(of).flatten(), keys.take(of)
            whole = np.asarray(pc.is_valid(flat)).reshape(len(of), length).all(axis=1)
            numbers, held = flat.to_numpy(zero_copy_only=False).reshape(len(of), length)[whole], held.filter(pa.array(whole))
            for at in range(0, len(held), VECTORS):
                part, some = held.slice(at, VECTORS), numbers[at : at + VECTORS]
                ends = lambda n: pa.array([0, n], pa.int32())
                columns = [pa.array([length], pa.int32()), pa.ListArray.from_arrays(ends(len(part)), part), pa.ListArray.from_arrays(ends(some.size), pa.array(some.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_length", "_k", "_v"])


def _near_vectors(radius: float, names: Names):
    """Blocks (length, keys, numbers, keys, numbers) to keys and vectors with a sum of differences within the radius and what rounding may add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                length, keys, xs, asked, qs = b.column(0)[i].as_py(), *(b.column(c)[i].values for c in range(1, 5))
                x, q = (v.to_numpy(zero_copy_only=False).reshape(-1, length) if length else np.zeros((n, 0)) for v, n in ((xs, len(keys)), (qs, len(asked))))
                most = radius * (1 + 4 * (length + 2) * float(np.finfo(x.dtype).eps)) + 1e-12
                columns, half = np.ascontiguousarray(q.T), length // 2
                for at in range(0, len(x), ROWS):
                    some = x[at : at + ROWS]
                    total, gap = np.zeros((len(some), len(q)), x.dtype), np.empty((len(some), len(q)), x.dtype)
                    for j in range(half):
                        np.subtract(some[:, j, None], columns[j], out=gap)
                        total += np.abs(gap, out=gap)
                    one, two = np.nonzero(total <= most)
                    for k in range(0, len(one), 1 << 16):
                        u, v = one[k : k + (1 << 16)], two[k : k + (1 << 16)]
                        near = np.abs(some[u] - q[v]).sum(axis=1) <= most
                        u, v = u[near], v[near]
                        if len(u):
                            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * length), pa.array(w.ravel())) for w in (some[u], q[v])]
                            yield pa.RecordBatch.from_arrays([keys.take(pa.array(u + at)), lists[0], asked.take(pa.array(v)), lists[1]], names=list(names))

    return run


def manhattan_search(df: DataFrame, queries: DataFrame, key: str, x: str, query: str, q: str, radius: float) -> DataFrame:
    """key, x, query, q: vectors whose sum of absolute differences is at most the radius, by blocks of vectors that all meet.

    The sums of half the dimensions rule out most pairs. Rounding may let in pairs just beyond the radius, so the caller computes the distance
    that it wants of the few that are left. Vectors of unlike lengths, with a null or with NaN match nothing.
    """
    number = max((t.schema[c].dataType.elementType.simpleString() for t, c in ((df, x), (queries, q))), key=["float", "double"].index)

    def blocks(t: DataFrame, k: str, v: str, names: str) -> DataFrame:
        kind = t.schema[k].dataType.simpleString()
        held = t.select(F.col(k), F.col(v).cast(f"array<{number}>")).mapInArrow(_vectors, f"_length int, _k array<{kind}>, _v array<{number}>")
        return held.select("_length", F.col("_k").alias(f"_k{names}"), F.col("_v").alias(f"_v{names}"))

    met = meet(blocks(df, key, x, "x"), blocks(queries, query, q, "q"), ["_length"]).select("_length", "_kx", "_vx", "_kq", "_vq")
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {x} array<{number}>, {query} {queries.schema[query].dataType.simpleString()}, {q} array<{number}>"
    return met.mapInArrow(_near_vectors(radius, [key, x, query, q]), schema)


#: Queries that one pass of metric_nearest takes to the rows.
MOST_QUERIES = 10_000


def metric_nearest(df: DataFrame, queries: DataFrame, key: str, x: str, query: str, q: str, distance, k: int = 1) -> DataFrame:
    """query, rank, key, distance: the k nearest rows of each query under any metric, ties by key.

    The queries are a stated set that is compared with all rows: they are counted, and go to the rows in blocks. Of rows with equal
    values only the k of the smallest keys can be near, and equal queries are asked once. The k best of a query are chosen among the rows of each
    task's share first (window group limits cut them before the shuffle), then among those.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    rows, wanted = df.select(F.col(key).alias("_key"), F.col(x).alias("_x")), queries.select(F.col(query).alias("_query"), F.col(q).alias("_q"))
    alike = hashable(df.schema[x].dataType) and hashable(queries.schema[q].dataType)
    if alike:
        rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy("_x").orderBy("_key"))).where(F.col("_rn") <= k).drop("_rn")
    one_each = wanted.select("_q").distinct() if alike else wanted
    group = one_each.columns[0]
    asked = with_index(one_each, [group], (), "_block").withColumn("_block", F.expr(f"_block div {MOST_QUERIES}"))
    last = asked.agg(F.max("_block")).first()[0]
    out = None
    for b in range((last if last is not None else -1) + 1):
        met = rows.crossJoin(F.broadcast(asked.where(F.col("_block") == b).drop("_block")))
        near = met.select(group, "_key", distance(F.col("_x"), F.col("_q")).alias("distance")).where("distance IS NOT NULL")
        one = near.withColumn("_shard", F.spark_partition_id())
        for w in (W.partitionBy(group, "_shard"), W.partitionBy(group)):
            one = one.withColumn("rank", F.row_number().over(w.orderBy("distance", "_key"))).where(F.col("rank") <= k)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return queries.select(F.col(query), F.lit(1).alias("rank")).crossJoin(df.select(key, F.lit(0.0).alias("distance"))).limit(0)
    if alike:
        laid = wanted.join(out.drop("rank"), "_q")
        out = laid.withColumn("rank", F.row_number().over(W.partitionBy("_query").orderBy("distance", "_key"))).where(F.col("rank") <= k)
    return out.select(F.col("_query").alias(query), "rank", F.col("_key").alias(key), "distance")


def sign_distances(df: DataFrame, queries: DataFrame, key: str, x: str, query: str, q: str, name: str = "distance") -> DataFrame:
    """query, key, places at which the signs of two arrays of numbers differ, for every row and query; its result is a product by definition.

    Signs are packed into longs first, so that a pair costs a few bit counts. A null array has no distance (null).
    """
    most = df.select(F.size(x).alias("n")).unionByName(queries.select(F.size(q).alias("n"))).agg(F.max("n")).first()[0]
    planes = 3 * -(-max(most or 0, 0) // 64)

    def packed(t: DataFrame, k: str, v: str, to: str) -> DataFrame:
        bits = V.sign_planes(F.col(v), max(most or 0, 0))
        return t.select(F.col(k), F.col(v).isNotNull().alias(f"_{to}"), *[b.alias(f"_{to}{i}") for i, b in enumerate(bits)])

    spark = df.sparkSession
    rows = packed(df, key, x, "x").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)
    met = rows.crossJoin(F.broadcast(packed(queries, query, q, "q")))  # a stated set, a few longs each
    differ = V.differing_planes([F.col(f"_x{i}") for i in range(planes)], [F.col(f"_q{i}") for i in range(planes)])
    return met.select(query, key, F.when(F.col("_x") & F.col("_q"), differ).alias(name))
