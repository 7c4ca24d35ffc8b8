"""Whole-table helpers and the latest-version-per-key table with its writes.

A write is a plan: it returns the table's new content and leaves committing to the caller, so any sink will do. Keys are
joined by Catalyst's choice of strategy; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

Names = Sequence[str]


class NoResult(LookupError):
    """A query that must find a row found none."""


class InconsistentState(RuntimeError):
    """A query that must find one row found more."""


def find_one(df: DataFrame):
    """The only row; NoResult or InconsistentState otherwise. Reads two rows at most."""
    rows = df.limit(2).collect()
    if not rows:
        raise NoResult("no row")
    if len(rows) > 1:
        raise InconsistentState("more than one row")
    return rows[0]


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def intersect_columns(*tables: DataFrame, sort: bool = False) -> list[DataFrame]:
    """The tables cut to the columns that all have, in one order."""
    names = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    return [t.select(*(sorted(names) if sort else names)) for t in tables]


def null_columns(df: DataFrame) -> list[str]:
    """Columns without a value, in one pass; of an empty table, all."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] == 0]


def drop_null_columns(df: DataFrame) -> DataFrame:
    return df.drop(*null_columns(df))


def nested_cells(df: DataFrame, key: str, columns: Names) -> DataFrame:
    """Columns-first view: per column a map from key to its non-empty cells."""
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], list(columns), "column", "cell")
    kept = long.where(F.col("cell").isNotNull() & (F.col("cell") != ""))
    return kept.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "cell")))).alias("cells"))


def latest(history: DataFrame, keys: Names, version: Sequence[str | Column]) -> DataFrame:
    """The newest row of each key; version columns order the rows, the last breaks ties."""
    newest = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) if isinstance(c, str) else c for c in version])
    return history.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def latest_many(history: DataFrame, requests: DataFrame, keys: Names, version: Names) -> DataFrame:
    """The newest row of each requested key. Null keys match nothing. Requests' other columns (their order, say) are kept."""
    known = history.join(requests.select(*keys).distinct(), list(keys), "left_semi")
    return requests.join(latest(known, keys, version), list(keys))


def latest_one(history: DataFrame, values: dict, version: Names):
    """The newest row that matches all values, null by null; NoResult without one."""
    rule = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in values.items()], F.lit(True))
    return find_one(history.where(rule).orderBy(*[F.desc_nulls_last(c) for c in version]).limit(1))


def last_of_batch(batch: DataFrame, keys: Names, order_by: Names) -> DataFrame:
    """Of a batch's rows for one key the last counts."""
    return latest(batch, keys, order_by)


def upsert(target: DataFrame, source: DataFrame, keys: Names) -> DataFrame:
    """Rows of target replaced by source's of the same key, and source's new rows."""
    if not keys:
        raise ValueError("an upsert needs a key")
    return target.join(source, list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def upsert_flags(target: DataFrame, source: DataFrame, keys: Names) -> DataFrame:
    """source with `inserted`: whether its key is new to target."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return source.join(known, list(keys), "left").withColumn("inserted", F.col("_known").isNull()).drop("_known")


def add_rows(target: DataFrame, source: DataFrame, keys: Names, mandatory: Names, derived: Names, replace: bool = True) -> DataFrame:
    """Write source over target. Derived values that source does not give become null with replace, and else stay while all mandatory ones stay equal."""
    given = [c for c in derived if c in source.columns]
    old = target.select(*[F.col(c).alias(f"_old_{c}") for c in target.columns])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_old_{k}") for k in keys])
    both = source.withColumn("_new", F.lit(True)).join(old.withColumn("_had", F.lit(True)), on, "full")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in mandatory], F.lit(True))
    out = []
    for c in target.columns:
        was = F.col(f"_old_{c}")
        if c in source.columns and (c not in derived or c in given):
            now = F.col(c)
        elif replace:
            now = F.lit(None)
        else:
            now = F.when(F.col("_had") & same, was)
        out.append(F.when(F.col("_new"), now).otherwise(was).alias(c))
    return both.select(*out)


def add_no_dup(target: DataFrame, source: DataFrame, fields: Names) -> DataFrame:
    """target and those rows of source that match none of it in all fields, null by null."""
    on = reduce(lambda a, b: a & b, [source[c].eqNullSafe(target[c]) for c in fields])
    return target.unionByName(source.join(target, on, "left_anti").dropDuplicates(list(fields)), allowMissingColumns=True)


def set_default(target: DataFrame, computed: DataFrame, keys: Names, name: str) -> DataFrame:
    """Read-through: a stored derived value stays, a missing one is filled from computed."""
    new = computed.select(*keys, F.col(name).alias("_computed"))
    return target.join(new, list(keys), "left").withColumn(name, F.coalesce(name, "_computed")).drop("_computed")


def schema_of(simple: dict, sort_keys: bool = False) -> T.StructType:
    """A simple schema {name: type name, [element] or {..}} as a StructType; an empty list drops its field."""
    kinds = {"bool": T.BooleanType(), "int32": T.IntegerType(), "uint32": T.LongType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "str": T.StringType(),
             "bytes": T.BinaryType(), "float": T.DoubleType(), "datetime": T.TimestampType(), "date": T.DateType()}

    def kind(x):
        if isinstance(x, dict):
            return schema_of(x, sort_keys)
        if isinstance(x, list):
            return T.ArrayType(kind(x[0]))
        return kinds[x]

    names = sorted(simple) if sort_keys else list(simple)
    return T.StructType([T.StructField(n, kind(simple[n])) for n in names if simple[n] != []])


def infer_schema(rows) -> dict:
    """The simple schema of dict rows: union of keys, integer width from the extremes; a change of type is a TypeError."""

    def one(v):
        if isinstance(v, bool):
            return "bool"
        if isinstance(v, int):
            return (v, v)
        if isinstance(v, dict):
            return {k: one(x) for k, x in v.items() if x is not None}
        if isinstance(v, (list, tuple)):
            out = []
            for x in v:
                out = [merge(out[0], one(x))] if out else [one(x)]
            return out
        name = {str: "str", float: "float", bytes: "bytes"}.get(type(v), type(v).__name__)
        return name

    def merge(a, b):
        if isinstance(a, tuple) and isinstance(b, tuple):
            return (min(a[0], b[0]), max(a[1], b[1]))
        if isinstance(a, dict) and isinstance(b, dict):
            return {**a, **{k: merge(a[k], v) if k in a else v for k, v in b.items()}}
        if isinstance(a, list) and isinstance(b, list):
            return [merge(a[0], b[0])] if a and b else a or b
        if a != b:
            raise TypeError(f"{a} and {b} for one field")
        return a

    def name(x):
        if isinstance(x, tuple):
            low, high = x
            return "int32" if -(1 << 31) <= low and high < 1 << 31 else "uint32" if 0 <= low and high < 1 << 32 else "int64" if high < 1 << 63 else "uint64"
        if isinstance(x, dict):
            return {k: name(v) for k, v in x.items()}
        return [name(v) for v in x] if isinstance(x, list) else x

    out: dict = {}
    for r in rows:
        out = merge(out, one(r))
    return name(out)
