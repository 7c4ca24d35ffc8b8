"""Explicit order: row numbers, run numbers and frames over them.

Order is data here: every positional operator takes the columns to order by, and optionally the columns that split the
table into independent sequences. Without a split, positions, running sums and carried values come from a
range-partitioned sort, which is written once with its partition numbers, and one value per partition, so no window gathers the table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from weftline.session import written


def frame(order_by: Sequence[str | Column], partition_by: Sequence[str] = ()) -> WindowSpec:
    """The window of a positional operator."""
    return (W.partitionBy(*partition_by) if partition_by else W.partitionBy(F.lit(0))).orderBy(*order_by)


def hashable(kind: T.DataType) -> bool:
    """Values of the type can be hashed and told to be equal."""
    if isinstance(kind, T.StructType):
        return all(hashable(f.dataType) for f in kind.fields)
    return hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def ranged(df: DataFrame, order_by: Sequence[str | Column], number: bool = False) -> DataFrame:
    """df with `_part`, the number of its range of order_by, and with `number` `_local`, its place there; written once.

    The table must be written: ranges are sampled and partitions are coalesced anew each time that a plan runs, so only a stored
    number means the same to everyone who reads it. A hash of the row breaks ties, so that a hot sort key is no single range.
    """
    tie = [F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if hashable(f.dataType)]).alias("_tie")]
    held = df.select("*", *tie)
    ordered = held.repartitionByRange(*order_by, "_tie").sortWithinPartitions(*order_by, "_tie").drop("_tie")
    ordered = ordered.withColumn("_part", F.spark_partition_id())
    if number:
        ordered = ordered.withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return written(ordered)


def with_index(df: DataFrame, order_by: Sequence[str | Column], partition_by: Sequence[str] = (), name: str = "_idx") -> DataFrame:
    """Add the 0-based position of each row; rows that tie in order_by have positions of their own, in order of a hash of the row.

    With partition_by: one window per group. Without: each range of a sorted table (:func:`ranged`) numbers its own rows from
    its offset, and the offsets are the sizes of the ranges before.
    """
    if partition_by:
        return df.withColumn(name, (F.row_number().over(frame(order_by, partition_by)) - 1).cast("long"))
    local = ranged(df, order_by, True)
    sizes = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row a partition: a fixed bound for the window and for the broadcast.
    offsets = sizes.select("_part", (F.sum("_size").over(W.orderBy("_part")) - F.col("_size")).alias("_offset"))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset", "_size")


def running_sum(df: DataFrame, column: str, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """Add the sum of the column up to each row, over the whole table; ties are summed in order of a hash of the row."""
    held = ranged(df, order_by)
    own = held.withColumn("_own", F.sum(column).over(frame(order_by, ["_part"]).rowsBetween(W.unboundedPreceding, 0)))
    totals = held.groupBy("_part").agg(F.sum(column).alias("_sum"))  # one row a partition
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def carried(df: DataFrame, columns: Sequence[str], order_by: Sequence[str | Column], forward: bool = True) -> DataFrame:
    """Nulls of the columns filled with the last value before them (or, not forward, the next after them), over the whole table; the order must not tie."""
    held = ranged(df, order_by)
    own, across = frame(order_by, ["_part"]), W.orderBy("_part")
    if forward:
        pick, here, there = F.last, (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    else:
        pick, here, there = F.first, (0, W.unboundedFollowing), (1, W.unboundedFollowing)
    for c in columns:
        held = held.withColumn(f"_c_{c}", pick(c, ignorenulls=True).over(own.rowsBetween(*here)))
    edge = F.max_by if forward else F.min_by
    ends = held.groupBy("_part").agg(*[edge(F.struct(c), F.when(F.col(c).isNotNull(), F.struct(*order_by))).alias(f"_e_{c}") for c in columns])
    # One row a partition.
    ends = ends.select("_part", *[pick(f"_e_{c}", ignorenulls=True).over(across.rowsBetween(*there)).alias(f"_e_{c}") for c in columns])
    filled = held.join(F.broadcast(ends), "_part")
    for c in columns:
        filled = filled.withColumn(c, F.coalesce(f"_c_{c}", F.col(f"_e_{c}.{c}")))
    return filled.select(*df.columns)


def run_number(df: DataFrame, starts: Column, order_by: Sequence[str | Column], partition_by: Sequence[str] = (), name: str = "_run") -> DataFrame:
    """Number runs: a row on which `starts` holds begins a new one."""
    return df.withColumn(name, F.count_if(starts).over(frame(order_by, partition_by).rowsBetween(W.unboundedPreceding, 0)))
