"""Sorts, ranks, limits, samples and set operations on rows.

A total order is Spark's range-partitioned sort, which spills; with a limit it becomes a bounded top-k per partition.
Samples are drawn by a seeded hash of a key, so a lost partition that is computed anew draws the same rows.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from weftline.operators.ordering import frame, with_index

Names = Sequence[str]


def external_sort(df: DataFrame, keys: Sequence[str | Column], limit: int | None = None) -> DataFrame:
    """Rows in order of the keys; at most `limit` of them."""
    ordered = df.orderBy(*keys)
    return ordered if limit is None else ordered.limit(limit)


def sorted_with_keys(df: DataFrame, key: Column, order_by: Names, reverse: bool = False, name: str = "key") -> DataFrame:
    """Rows with their key, in its order; of equal keys in order of position."""
    held = df.withColumn(name, key)
    return held.orderBy(F.col(name).desc() if reverse else F.col(name).asc(), *order_by)


def sorted_by_list(values: DataFrame, keys: DataFrame, order_by: Names, key_order: Names, key: str, reverse: bool = False) -> DataFrame:
    """Rows of `values` beside the key of the same position, in order of it; the shorter table counts."""
    left = with_index(values, order_by, (), "_at")
    right = with_index(keys, key_order, (), "_at").select("_at", F.col(key).alias("sort_key"))
    return left.join(right, "_at").orderBy(F.col("sort_key").desc() if reverse else F.col("sort_key").asc(), "_at").drop("_at")


def nulls_first(*columns: str) -> list[Column]:
    """Order with nulls before all values, as structs compare inside too."""
    return [F.col(c).asc_nulls_first() for c in columns]


def locale_order(column: str, lower_first: bool = True) -> list[Column]:
    """Case-insensitive Unicode order; of words that differ in case only, lower case first (or last)."""
    c = F.col(column)
    tie = F.transform(F.split(c, ""), lambda x: (x == F.lower(x)).cast("int") * (-1 if lower_first else 1))
    return [F.collate(F.lower(c), "UNICODE"), tie, c]


def sort_nested(values: Column, depth: int) -> Column:
    """Arrays sorted at every level, the innermost first."""
    return F.array_sort(values if depth == 1 else F.transform(values, lambda v: sort_nested(v, depth - 1)))


@pandas_udf(ArrayType(ArrayType(IntegerType())))
def cycle_swaps(arrays: pd.Series) -> pd.Series:
    """Swaps (i, j) that sort an array with the fewest writes: those of the cycles of its sorting permutation."""

    def one(values) -> list[list[int]]:
        target = [0] * len(values)
        for rank, i in enumerate(sorted(range(len(values)), key=lambda i: (values[i], i))):
            target[i] = rank
        out = []
        for i in range(len(target)):
            while target[i] != i:
                j = target[i]
                out.append([i, j])
                target[i], target[j] = target[j], target[i]
        return out

    return arrays.map(one)


def buffer_sorted(values: Iterator, size: int) -> Iterator:
    """A stream put in order as far as a heap of `size` values allows."""
    heap: list = []
    for v in values:
        if len(heap) < size:
            heapq.heappush(heap, v)
        else:
            yield heapq.heappushpop(heap, v)
    while heap:
        yield heapq.heappop(heap)


def buffer_sort(df: DataFrame, value: str, size: int, order_by: Names, partition_by: Names) -> DataFrame:
    """partition_by, position, value: each group streamed in order through a bounded buffer; no group is gathered."""
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in partition_by)
    dealt = df.select(*partition_by, *[c for c in order_by if c not in partition_by], value).repartition(*partition_by).sortWithinPartitions(*partition_by, *order_by)
    keys, n = list(partition_by), len(partition_by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, heap, place = None, [], 0
        for f in frames:
            rows = []

            def put(v):
                nonlocal place
                rows.append((*now, place, v))
                place += 1

            for row in f[[*keys, value]].itertuples(index=False, name=None):
                if row[:n] != now:
                    while heap:
                        put(heapq.heappop(heap))
                    now, place = row[:n], 0
                if len(heap) < size:
                    heapq.heappush(heap, row[n])
                else:
                    put(heapq.heappushpop(heap, row[n]))
            yield pd.DataFrame(rows, columns=[*keys, "position", value])
        if heap:
            yield pd.DataFrame([(*now, place + i, v) for i, v in enumerate(heapq.nsmallest(len(heap), heap))], columns=[*keys, "position", value])

    return dealt.mapInPandas(run, f"{fields}, position long, `{value}` {kinds[value]}")


def shuffled(df: DataFrame, key: Names, seed: int = 0) -> DataFrame:
    """Rows in a random order that the seed fixes."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def buffer_shuffled(values: Iterator, size: int, seed: int = 0) -> Iterator:
    """A stream in partly random order, through a buffer of `size` values: each new value takes the place of one drawn from it."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    rng, held = random.Random(seed), []
    for v in values:
        if len(held) < size:
            held.append(v)
            continue
        k = rng.randrange(size)
        yield held[k]
        held[k] = v
    rng.shuffle(held)
    yield from held


def buffer_shuffle(df: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The rows of each partition in partly random order, without a shuffle between tasks and with `size` rows in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema, out = None, []

        def rows() -> Iterator[dict]:
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield from b.to_pylist()

        for r in buffer_shuffled(rows(), size, hash((seed, TaskContext.get().partitionId()))):
            out.append(r)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return df.mapInArrow(run, df.schema)


def sample_range(spark: SparkSession, total: int, count: int, seed: int = 0, ordered: bool = False) -> DataFrame:
    """count of the numbers below total, without replacement."""
    if count > total:
        raise ValueError("more than there are")
    out = spark.range(total).orderBy(F.xxhash64(F.lit(seed), "id")).limit(count)
    return out.orderBy("id") if ordered else out


def train_test_split(df: DataFrame, label: str, key: Names, test_share: float, seed: int = 0, name: str = "is_test") -> DataFrame:
    """Rows with a flag; of each label the same share is for tests."""
    # Positions of a range-partitioned sort by (label, hash): a label that most rows have is many ranges, not one window.
    at = with_index(df.withColumn("_chance", F.xxhash64(F.lit(seed), *key)), [label, "_chance", *key], (), "_at")
    sizes = at.groupBy(F.struct(label).alias("_l")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    held = at.withColumn("_l", F.struct(label)).join(sizes, "_l")
    return held.withColumn(name, F.col("_at") - F.col("_first") < F.round(F.col("_n") * test_share)).select(*df.columns, name)


def top_per_group(df: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    """The k rows of the highest score of each group, with their rank."""
    w = W.partitionBy(group).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def median_position(df: DataFrame, value: str, partition_by: Names = ()) -> DataFrame:
    """The approximate median and exact bounds of its group, from one mergeable sketch."""
    return df.groupBy(*partition_by).agg(F.percentile_approx(value, 0.5, 10_000).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


# ---- sets


def no_dupes(tables: Sequence[DataFrame], value: str, order_by: Names) -> DataFrame:
    """First occurrence of each value over the tables, one after the other; partial aggregation, no window over a hot value."""
    parts = [t.select(F.struct(F.lit(k).alias("source"), *order_by).alias("at"), F.col(value)) for k, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(value).agg(F.min("at").alias("at")).select(value, "at.*")


def drop_adjacent(df: DataFrame, key: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Rows whose key differs from that of the row before."""
    w = frame(order_by, partition_by)
    held = df.withColumn("_first", F.lag(F.lit(1)).over(w).isNull()).withColumn("_before", F.lag(key).over(w))
    return held.where(F.col("_first") | ~F.col(key).eqNullSafe(F.col("_before"))).drop("_first", "_before")


def pop_many(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, the others); a test that gives null does not pass."""
    passed = F.coalesce(test, F.lit(False))
    return df.where(passed), df.where(~passed)


# ---- places in a matrix that is stored row by row


def to_2d(n: Column, width: int) -> Column:
    return F.struct(F.floor(n / width).cast("long").alias("y"), (n % width).cast("long").alias("x"))


def same_row(spark: SparkSession, n: int, side: int) -> DataFrame:
    """Places of the row of place n in a square matrix."""
    return spark.range(side * side).where(F.floor(F.col("id") / side) == n // side).withColumnRenamed("id", "place")


def same_column(spark: SparkSession, n: int, side: int) -> DataFrame:
    return spark.range(side * side).where(F.col("id") % side == n % side).withColumnRenamed("id", "place")


def same_block(spark: SparkSession, n: int, side: int, block: int) -> DataFrame:
    """Places of the block of place n; blocks are squares of `block` by `block`."""
    key: Callable = lambda y, x: (y // block, x // block)
    want = key(n // side, n % side)
    y, x = F.floor(F.col("id") / side), F.col("id") % side
    return spark.range(side * side).where((F.floor(y / block) == want[0]) & (F.floor(x / block) == want[1])).withColumnRenamed("id", "place")
