"""Connected components and prefix trees as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed


#: No more nodes than this are hubs, whose edges do not go through a shuffle by node.
HUBS = 10_000


def _with_least(edges: DataFrame, degrees: DataFrame, bound: int | None) -> DataFrame:
    """u, v, m (the least neighbour of u). With a bound, nodes of more edges than that, at most edges / bound of them, get their m by a broadcast and not by a join."""
    if bound is None:
        return edges.join(degrees.select("u", "m"), "u").select("u", "v", "m")
    hubs = F.broadcast(degrees.where(F.col("n") > bound).select("u", "m"))
    of_hubs = edges.join(hubs, "u").select("u", "v", "m")
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(degrees.where(F.col("n") <= bound).select("u", "m"), "u").select("u", "v", "m")
    return of_hubs.unionByName(rest)


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))


def contracted(edges: DataFrame, hubs: int = HUBS) -> DataFrame:
    """u, component (its smallest node) of every node but the smallest of each component; edges (u, v), u > v.

    Large-star and small-star contraction: every node's larger neighbours, and then its smaller ones, go to the least of them,
    until all edges are stars round the smallest node. Each round is written to the checkpoint folder; rounds grow with the
    logarithm of the number of nodes and end when nothing changes. A node with a large share of all edges is a hub: there are at most
    `hubs` of them by count, so what they need is broadcast, and no task gets all edges of a node.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = _degrees(both)
        row = degrees.agg(F.sum("n").alias("ends"), F.sum("h").alias("h"), F.max("n").alias("most")).first()
        if not row["ends"] or row == mark:
            return now.select("u", F.col("v").alias("component"))
        mark, bound = row, max(100, row["ends"] // hubs)
        bound = bound if row["most"] > bound else None  # later in the round no node has more edges than here
        least = degrees.select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, bound).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = checkpointed(large) if bound else large
        least = _degrees(large)
        small = _with_least(large, least, bound).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b", hubs: int = HUBS) -> DataFrame:
    """node, component (its smallest node) of an undirected edge table; edges with a null end are none, and a loop makes a component."""
    links = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"))
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = contracted(links, hubs).withColumnRenamed("u", "node")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def of_size(edges: DataFrame, least: int = 2, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of components with at least that many nodes."""
    found = components(edges, a, b)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return found.join(sizes, "component", "left_semi")


# ---- prefix trees: a table with an array column `keys` and a value


def prefixes(tree: DataFrame, keys: str = "keys") -> DataFrame:
    """Distinct prefixes (array `prefix`) of the stored sequences, the empty one left out."""
    return tree.select(F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size(keys)), lambda n: n > 0), lambda n: F.slice(keys, F.lit(1), n))).alias("prefix")).distinct()


def longest_prefix(queries: DataFrame, query: str, tree: DataFrame, keys: str = "keys", value: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    """ids, prefix, value: the longest stored sequence that a query begins with; rows without one have nulls."""
    cuts = queries.select(*ids, F.explode(F.transform(F.sequence(F.lit(0), F.size(query)), lambda n: F.slice(query, F.lit(1), n))).alias("prefix"))
    hits = cuts.join(tree.select(F.col(keys).alias("prefix"), F.col(value).alias("value")), "prefix")
    best = hits.groupBy(*ids).agg(F.max_by(F.struct("prefix", "value"), F.size("prefix")).alias("_b"))
    return queries.join(best, list(ids), "left").select(*ids, F.col("_b.prefix").alias("prefix"), F.col("_b.value").alias("value"))


def tree_statistics(tree: DataFrame, keys: str = "keys") -> DataFrame:
    """leaves (stored sequences), branches (sequences that no other continues) and depth, in one row."""
    stored = tree.select(F.col(keys).alias("k")).distinct()
    longer = stored.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("k") - 1), lambda n: F.slice("k", F.lit(1), n))).alias("k")).distinct()
    ends = stored.join(longer, "k", "left_anti").agg(F.count(F.lit(1)).alias("branches"))
    return stored.agg(F.count(F.lit(1)).alias("leaves"), F.max(F.size("k")).cast("long").alias("depth")).crossJoin(F.broadcast(ends)).select("leaves", "branches", "depth")
