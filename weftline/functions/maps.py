"""Map and struct functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_one_of(m: Column, keys: Sequence[str]) -> Column:
    """struct(key, value) of the first key present; an error if none is."""
    out = F.raise_error(F.lit(f"none of {list(keys)} is present")).cast("struct<key:string,value:string>")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(m, k), F.struct(F.lit(k).alias("key"), m[k].cast("string").alias("value"))).otherwise(out)
    return out


def get_available(m: Column, keys: Sequence[str]) -> Column:
    """The entries of the keys that are present."""
    return F.map_filter(m, lambda k, v: k.isin(*keys))


def subdict(m: Column, keys: Sequence[str]) -> Column:
    """The same; an error if a key is missing."""
    found = get_available(m, keys)
    return F.when(F.size(found) == len(set(keys)), found).otherwise(F.raise_error(F.lit("a key is missing")).cast("map<string,string>"))


def subdict_default(m: Column, keys: Sequence[str], default: Column) -> Column:
    """The keys' entries, with a default for those that are missing."""
    ks = F.array(*[F.lit(k) for k in keys])
    return F.map_from_arrays(ks, F.transform(ks, lambda k: F.when(F.map_contains_key(m, k), F.element_at(m, k)).otherwise(default)))


def has_values(m: Column) -> Column:
    """Entries whose value is neither null nor empty nor zero."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~v.cast("string").isin("", "0", "0.0", "false"))


def value_map(m: Column, f) -> Column:
    return F.transform_values(m, lambda k, v: f(v))


def map_values(m: Column, keys: Column) -> Column:
    """The values of an array of keys, null where a key is missing."""
    return F.transform(keys, lambda k: F.try_element_at(m, k))


def zip_get(rows: Column, indexes: Column) -> Column:
    """The i-th array's element at the i-th 0-based index."""
    return F.zip_with(rows, indexes, lambda r, i: F.get(r, i))


def update(m: Column, other: Column) -> Column:
    """m with the non-null entries of other, which win."""
    news = F.map_filter(other, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(news, k)), news)


def flatten_struct(df: DataFrame, joiner: str = ".", drop: Sequence[str] = ()) -> DataFrame:
    """Nested structs as columns with joined names; fields named in drop go."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            if f.name in drop:
                continue
            out += leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, T.StructType) else [(*path, f.name)]
        return out

    def pick(path: tuple[str, ...]) -> Column:
        c = F.col(f"`{path[0]}`")
        for name in path[1:]:
            c = c.getField(name)
        return c.alias(joiner.join(path))

    return df.select(*[pick(p) for p in leaves(df.schema, ())])


def flatten_keys(m: Column) -> Column:
    """map<a, map<b, v>> as map<struct<a, b>, v>."""
    pairs = F.transform(
        F.map_entries(m), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.struct(e["key"].alias("a"), x["key"].alias("b")).alias("key"), x["value"].alias("value")))
    )
    return F.map_from_entries(F.flatten(pairs))


def deep_update(a: Column, b: Column) -> Column:
    """Two-level maps merged; b wins at the leaves."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(update(x, y)))


def case_variants(df: DataFrame, key: str, value: str) -> DataFrame:
    """Case-insensitive map: lower-case key to the map of its spellings."""
    return df.groupBy(F.lower(key).alias("key")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(key, value)))).alias("variants"))
