"""Sequence analytics: pairs, windows, batches, runs and peaks over explicitly ordered rows.

All take order_by and partition_by (see :mod:`weftline.operators.ordering`) and are windows with bounded frames, so a
group is streamed in order and never collected, except where a list is the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.ordering import frame, run_number, with_index

Names = Sequence[str]


def pairwise(df: DataFrame, value: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Each row with the next value as `<value>_next`; the last row of a sequence goes."""
    w = frame(order_by, partition_by)
    return df.withColumn("_has", F.lead(F.lit(1)).over(w)).withColumn(f"{value}_next", F.lead(value).over(w)).where("_has = 1").drop("_has")


def x_wise(df: DataFrame, value: str, size: int, order_by: Names, partition_by: Names = (), name: str = "window") -> DataFrame:
    """Each row with the list of its value and the size - 1 that follow; shorter tails go. Nulls count as values."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    w = frame(order_by, partition_by)
    held = df.withColumn("_full", F.lead(F.lit(1), size - 1).over(w) if size > 1 else F.lit(1))
    return held.withColumn(name, F.array(F.col(value), *[F.lead(value, i).over(w) for i in range(1, size)])).where("_full = 1").drop("_full")


def sliding_window(df: DataFrame, value: str, size: int, step: int, order_by: Names, partition_by: Names = (), name: str = "window") -> DataFrame:
    """x_wise at every step-th position."""
    if step < 1:
        raise ValueError("step must be 1 or more")
    indexed = with_index(df, order_by, partition_by, "_at")
    return x_wise(indexed, value, size, order_by, partition_by, name).where(F.col("_at") % step == 0).drop("_at")


def batch(df: DataFrame, value: str, size: int, order_by: Names, partition_by: Names = (), name: str = "values") -> DataFrame:
    """Consecutive chunks of `size` values; the last may be short. One row per chunk: partition_by, batch, values."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    indexed = with_index(df, order_by, partition_by, "_at").withColumn("batch", F.expr(f"_at div {size}"))
    lists = indexed.groupBy(*partition_by, "batch").agg(F.sort_array(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("_l"))
    return lists.select(*partition_by, "batch", F.transform("_l", lambda x: x["v"]).alias(name))


def resizer(df: DataFrame, array: str, size: int, order_by: Names, partition_by: Names = (), pad: Column | None = None) -> DataFrame:
    """Concatenate arrays in order and cut them anew to `size`; pad fills the last if given."""
    flat = df.select(*partition_by, *order_by, F.posexplode(array).alias("_pos", "v"))
    out = batch(flat, "v", size, [*order_by, "_pos"], partition_by)
    if pad is None:
        return out
    return out.withColumn("values", F.concat("values", F.array_repeat(pad, F.lit(size) - F.size("values"))))


def pairwise_skip(df: DataFrame, value: str, skip: Column, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Neighbouring pairs of rows that are not skipped, never across a skipped row."""
    runs = run_number(df, skip, order_by, partition_by).where(~F.coalesce(skip, F.lit(False)))
    return pairwise(runs, value, order_by, [*partition_by, "_run"]).drop("_run")


def remove_consecutive_dupes(df: DataFrame, value: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """The first row of each run of equal values; nulls are equal to each other."""
    w = frame(order_by, partition_by)
    held = df.withColumn("_first", F.lag(F.lit(1)).over(w).isNull()).withColumn("_before", F.lag(value).over(w))
    return held.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_first", "_before")


def collapse_any(df: DataFrame, value: str, members: Sequence, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Collapse runs of one value, for values among the members only."""
    held = df.withColumn("_before", F.lag(value).over(frame(order_by, partition_by)))
    same = F.coalesce((F.col(value) == F.col("_before")) & F.col(value).isin(*members), F.lit(False))
    return held.where(~same).drop("_before")


def collapse_all(df: DataFrame, value: str, members: Sequence, replacement: Column, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Replace each run of members, whichever, by one replacement."""
    inside = F.coalesce(F.col(value).isin(*members), F.lit(False))
    held = df.withColumn("_in", inside).withColumn("_was", F.lag("_in").over(frame(order_by, partition_by)))
    kept = held.where(~(F.col("_in") & F.coalesce("_was", F.lit(False))))
    return kept.withColumn(value, F.when(F.col("_in"), replacement).otherwise(F.col(value))).drop("_in", "_was")


def asc_peaks(df: DataFrame, value: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """The last row of every run that does not fall."""
    held = df.withColumn("_next", F.lead(value).over(frame(order_by, partition_by)))
    return held.where(F.col("_next").isNull() | (F.col("_next") < F.col(value))).drop("_next")


def extrema(
    df: DataFrame, value: str, order_by: Names, partition_by: Names = (),
    first: frozenset = frozenset((1, -1)), last: frozenset = frozenset((1, -1)), derivatives: frozenset = frozenset((1, -1)),
) -> DataFrame:
    """Rows where the sign of the difference changes from one of `derivatives`; plateaus count as a sign of their own.

    The first row counts if the sign after it is in `first`, the last if the sign before it is in `last`; a row alone counts.
    """
    w = frame(order_by, partition_by)
    held = df.withColumn("_up", F.signum(F.lead(value).over(w) - F.col(value)).cast("int")).withColumn(
        "_down", F.signum(F.col(value) - F.lag(value).over(w)).cast("int")
    )

    def among(c: str, s: frozenset) -> Column:
        return F.col(c).isin(*sorted(s)) if s else F.lit(False)

    rule = (
        F.when(F.col("_up").isNull() & F.col("_down").isNull(), F.lit(True))
        .when(F.col("_down").isNull(), among("_up", first))
        .when(F.col("_up").isNull(), among("_down", last))
        .otherwise((F.col("_up") != F.col("_down")) & among("_down", derivatives))
    )
    return held.where(rule).drop("_up", "_down")


def peaks(df: DataFrame, value: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Maxima, ends included where the sequence falls from or rises to them."""
    return extrema(df, value, order_by, partition_by, frozenset((-1,)), frozenset((1,)), frozenset((1,)))


def valleys(df: DataFrame, value: str, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Minima, likewise."""
    return extrema(df, value, order_by, partition_by, frozenset((1,)), frozenset((-1,)), frozenset((-1,)))


def elapsed(df: DataFrame, ts: str, order_by: Names, partition_by: Names = (), name: str = "elapsed_us") -> DataFrame:
    """Microseconds since the row before."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn(name, micros - F.lag(micros).over(frame(order_by, partition_by)))


def sorted_index(df: DataFrame, value: str, order_by: Names, partition_by: Names = (), reverse: bool = False, name: str = "rank") -> DataFrame:
    """The 1-based rank of each value; equal values rank in order of position."""
    key = F.col(value).desc() if reverse else F.col(value).asc()
    return df.withColumn(name, F.row_number().over(frame([key, *order_by], partition_by)).cast("long"))


def _both_sides(value: str, size: int, order_by: Names, partition_by: Names) -> tuple[Column, Column, Column]:
    w = frame(order_by, partition_by)
    before, after = w.rowsBetween(-size, -1), w.rowsBetween(1, size)
    full = (F.count(F.lit(1)).over(before) == size) & (F.count(F.lit(1)).over(after) == size)
    return full, F.least(F.min(value).over(before), F.min(value).over(after)), F.greatest(F.max(value).over(before), F.max(value).over(after))


def fill_gaps(df: DataFrame, value: str, order_by: Names, partition_by: Names = (), size: int = 2, name: str = "filled") -> DataFrame:
    """A 0 with `size` ones on each side becomes 1; the ends stay."""
    full, least, _ = _both_sides(value, size, order_by, partition_by)
    return df.withColumn(name, F.when(full & (least == 1), F.lit(1)).otherwise(F.col(value)))


def remove_spikes(df: DataFrame, value: str, order_by: Names, partition_by: Names = (), size: int = 2, name: str = "smoothed") -> DataFrame:
    """A 1 with `size` zeros on each side becomes 0; the ends stay."""
    full, _, most = _both_sides(value, size, order_by, partition_by)
    return df.withColumn(name, F.when(full & (most == 0), F.lit(0)).otherwise(F.col(value)))


def every_n(df: DataFrame, n: int, order_by: Names, partition_by: Names = (), pos: int = 0) -> DataFrame:
    """Every n-th row from position pos on."""
    at = F.col("_at")
    return with_index(df, order_by, partition_by, "_at").where((at >= pos) & ((at - pos) % n == 0)).drop("_at")


def split(df: DataFrame, size: int, order_by: Names, partition_by: Names = (), name: str = "bucket") -> DataFrame:
    """Deal rows to `size` streams in turn."""
    return with_index(df, order_by, partition_by, "_at").withColumn(name, F.col("_at") % size).drop("_at")


def select_by_indices(df: DataFrame, indices: Sequence[int], order_by: Names, partition_by: Names = (), skip: bool = False) -> DataFrame:
    """Rows at (or, with skip, not at) the given positions."""
    held = F.col("_at").isin(*sorted(set(indices))) if indices else F.lit(False)
    return with_index(df, order_by, partition_by, "_at").where(~held if skip else held).drop("_at")


def positions(df: DataFrame, start: int | None, stop: int | None, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Rows of positions start to stop, stop excluded."""
    at = F.col("_at")
    rule = (at >= (start or 0)) & (at < stop if stop is not None else F.lit(True))
    return with_index(df, order_by, partition_by, "_at").where(rule).drop("_at")


def decompress(slots: DataFrame, selector: str, data: DataFrame, value: str, order_by: Names, data_order: Names, default: Column | None = None) -> DataFrame:
    """Slots with the k-th data value in the k-th selected one, default elsewhere. Too few data give nulls."""
    numbered = with_index(slots, order_by, (), "_slot")
    marked = with_index(numbered.where(F.col(selector)), order_by, (), "_k").select("_slot", "_k")
    values = with_index(data.select(F.col(value).alias("_value"), *data_order), data_order, (), "_k").select("_k", "_value")
    filled = numbered.join(marked.join(values, "_k", "left"), "_slot", "left")
    return filled.withColumn(value, F.when(F.col(selector), F.col("_value")).otherwise(F.lit(None) if default is None else default)).drop("_slot", "_k", "_value")


def zip_right(a: DataFrame, b: DataFrame, order_by: Names, partition_by: Names = ()) -> DataFrame:
    """Rows of two tables matched from their ends; the shorter length counts."""
    backwards = [F.col(c).desc() for c in order_by]
    left = with_index(a, backwards, partition_by, "_at")
    right = with_index(b, backwards, partition_by, "_at")
    keys = [*partition_by, "_at"]
    right = right.select(*keys, *[F.col(c).alias(f"{c}_right") for c in b.columns if c not in partition_by])
    return left.join(right, keys).drop("_at")


def interleave(tables: Sequence[DataFrame], order_by: Names, name: str = "position") -> DataFrame:
    """Rows of the tables in turn until the shortest ends; `position` orders the result."""
    n = len(tables)
    indexed = [with_index(t, order_by, (), "_at") for t in tables]
    sizes = [t.groupBy().agg(F.count(F.lit(1)).alias("_n")) for t in tables]
    least = sizes[0]
    for s in sizes[1:]:
        least = least.unionByName(s)
    least = least.agg(F.min("_n").alias("_n"))
    out = None
    for i, t in enumerate(indexed):
        one = t.withColumn(name, F.col("_at") * n + i)
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(least)).where(F.col("_at") < F.col("_n")).drop("_at", "_n")


def equal_sequences(a: DataFrame, b: DataFrame, value: str, order_by: Names) -> DataFrame:
    """One row `equal`: whether both have the same values in the same order and the same length."""
    left = with_index(a, order_by, (), "_at").select("_at", F.struct(F.col(value)).alias("x"))
    right = with_index(b, order_by, (), "_at").select("_at", F.struct(F.col(value)).alias("y"))
    return left.join(right, "_at", "full").agg(F.coalesce(F.bool_and(F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("equal"))
