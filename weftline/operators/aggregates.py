"""Aggregations: counts, means, distributions, sketches, quotas and text weights.

Everything is partial-aggregated before it is shuffled. Distributions divide by a total that is a one-row aggregate, broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.ordering import carried, running_sum, with_index
from weftline.session import written

Names = Sequence[str]
#: Shards of a category whose rows are chosen among first.
SHARDS = 64
#: Bins of the hashes by which rows are chosen; a power of two.
BINS = 4096


def count_distinct(c: Column) -> Column:
    """Distinct values; null is one of them."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))


def harmonic_mean(c: Column) -> Column:
    return F.count(c) / F.sum(1.0 / c)


def geometric_mean(c: Column) -> Column:
    """By logarithms, which does not overflow; for positive values."""
    return F.exp(F.avg(F.ln(c)))


def with_total(df: DataFrame, amount: str, name: str = "total") -> DataFrame:
    """Add the column's total to every row."""
    return df.crossJoin(F.broadcast(df.agg(F.sum(amount).alias(name))))


def distribution(df: DataFrame, key: str) -> DataFrame:
    """key, n, total: the histogram of a column."""
    return with_total(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "n")


def entropy(df: DataFrame, key: str, base: float = 2) -> DataFrame:
    """One row `entropy` of a column's values."""
    p = F.col("n") / F.col("total")
    return distribution(df, key).agg((-F.sum(p * F.ln(p)) / F.ln(F.lit(float(base)))).alias("entropy"))


def cdf(df: DataFrame, value: str, partition_by: Names = ()) -> DataFrame:
    """value, cdf: the empirical distribution function of distinct values.

    With partition_by: windows over each group's histogram. Without: positions of a range-partitioned sort, so that no
    task sees all values.
    """
    if not partition_by:
        last = with_index(df.select(value), [value], (), "_at").groupBy(value).agg((F.max("_at") + 1).alias("_upto"))
        return last.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))).select(value, (F.col("_upto") / F.col("_n")).alias("cdf"))
    counts = df.groupBy(*partition_by, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*partition_by)
    run = F.sum("n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return counts.select(*partition_by, value, (run / F.sum("n").over(w)).alias("cdf"))


def pmf_to_cdf(df: DataFrame, key: str, weight: str) -> DataFrame:
    """key, cdf: normalised running sums of weights."""
    summed = df.groupBy(key).agg(F.sum(weight).alias("_w"))
    total = df.agg(F.sum(weight).alias("_total"))
    return running_sum(summed, "_w", [key], "_upto").crossJoin(F.broadcast(total)).select(key, (F.col("_upto") / F.col("_total")).alias("cdf"))


def ks_from_cdfs(a: DataFrame, b: DataFrame, key: str, n1: int, n2: int, alpha: float = 0.05) -> DataFrame:
    """d, p, reject of the two-sample test over two distribution functions; gaps take the last value before."""
    both = a.select(key, F.col("cdf").alias("a"), F.lit(None).cast("double").alias("b")).unionByName(b.select(key, F.lit(None).cast("double").alias("a"), F.col("cdf").alias("b")))
    merged = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    filled = carried(merged, ["a", "b"], [key]).fillna(0.0, ["a", "b"])
    d = filled.agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"))
    p = F.exp(-2 * F.pow(F.col("d"), 2) * n1 * n2 / (n1 + n2))
    return d.withColumn("p", p).withColumn("reject", F.col("p") < alpha)


def ks_by_rank(a: DataFrame, b: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """The variant that compares the two empirical functions by rank, for samples of equal size."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        at = with_index(df.select(F.col(value).alias("_v")), ["_v"], (), "k")
        upto = at.groupBy("_v").agg((F.max("k") + 1).alias("_upto"))
        size = df.agg(F.count(F.lit(1)).alias(f"n_{name}"))
        return at.join(upto, "_v").crossJoin(F.broadcast(size)).select("k", (F.col("_upto") / F.col(f"n_{name}")).alias(name), f"n_{name}")

    d = ranked(a, "a").join(ranked(b, "b"), "k").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("d"), F.max("n_a").alias("n1"), F.max("n_b").alias("n2"))
    p = F.exp(-2 * F.pow(F.col("d"), 2) * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return d.select("d", p.alias("p"), (p < alpha).alias("reject"))


def bincount(values: Column, bins: int) -> Column:
    """Histogram array of non-negative integers below `bins`."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(values, lambda v: v == b)).cast("long"))


def center_of_mass(df: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    total = F.sum(weight)
    return df.agg((F.sum(F.col(weight) * F.col(x)) / total).alias("x"), (F.sum(F.col(weight) * F.col(y)) / total).alias("y"))


def block_histogram(df: DataFrame, x: str, y: str, level: str, bx: int, by: int) -> DataFrame:
    """bx, by, level, n per spatial block."""
    return df.groupBy(F.floor(F.col(x) / bx).alias("bx"), F.floor(F.col(y) / by).alias("by"), F.col(level).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def majority(df: DataFrame, key: str) -> DataFrame:
    """The value of more than half the rows, if there is one."""
    return distribution(df, key).where(F.col("n") * 2 > F.col("total")).select(key)


def nested_counts(df: DataFrame, name: str, item: str) -> DataFrame:
    return df.groupBy(name, item).agg(F.count(F.lit(1)).alias("n"))


def limit_balanced(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """key, quota: `total` shared over categories as evenly as their counts allow.

    The level L at which the sum of min(count, L) reaches the total follows from running sums over the sorted counts;
    what is left goes one by one to the categories above the level, largest first. One row per category is windowed.
    """
    ranked = counts.select(key, F.col(count).cast("long").alias("_c")).withColumn("_k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_c", key)))
    ordered = W.partitionBy(F.lit(0)).orderBy("_k")
    summed = ranked.withColumn("_below", F.coalesce(F.sum("_c").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    # With the k smallest filled, the others get (total - below) / others each.
    share = F.floor((F.greatest(F.lit(total) - F.col("_below"), F.lit(0))) / (F.col("_n") - F.col("_k") + 1))
    tried = summed.withColumn("_share", share)
    # The level is the share at the first category whose count it does not cover.
    first = tried.where(F.col("_c") > F.col("_share")).agg(F.min(F.struct("_k", "_share", "_below")).alias("f"))
    held = tried.crossJoin(F.broadcast(first))
    start, level = F.col("f._k"), F.col("f._share")
    left = F.lit(total) - F.col("f._below") - level * (F.col("_n") - start + 1)
    extra = (F.col("_n") - F.col("_k") < left).cast("long")
    quota = F.when(F.col("f").isNull() | (F.col("_k") < start), F.col("_c")).otherwise(F.least(F.col("_c"), level + extra))
    return held.select(key, quota.cast("long").alias("quota"))


def sample_balanced(df: DataFrame, keys: Names, total: int, order_by: Names, seed: int = 0) -> DataFrame:
    """As many rows of each category as limit_balanced allows; members by a seeded hash of order_by.

    The hashes of a category are counted in BINS equal bins first: rows beyond the bin at which its quota is reached can't be members, and
    go before anything is sorted. What is left is the quota and one bin's share of the rows. One row a category is broadcast.
    """
    label = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])
    chance = F.xxhash64(F.lit(seed), *order_by)
    held = df.withColumn("_cat", label).withColumn("_chance", chance).withColumn("_bin", F.shiftright("_chance", 64 - BINS.bit_length() + 1))
    bins = written(held.groupBy("_cat", "_bin").agg(F.count(F.lit(1)).alias("n")))
    quota = limit_balanced(bins.groupBy("_cat").agg(F.sum("n").alias("n")), "_cat", "n", total)
    before = F.coalesce(F.sum("n").over(W.partitionBy("_cat").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = bins.withColumn("_before", before).join(quota, "_cat").where(F.col("_before") < F.col("quota")).groupBy("_cat").agg(F.max("_bin").alias("_last"), F.first("quota").alias("quota"))
    held = held.join(F.broadcast(last), "_cat").where(F.col("_bin") <= F.col("_last")).withColumn("_shard", F.pmod(F.col("_chance"), F.lit(SHARDS)))
    # Twice the same choice: first among the rows of a shard of a category, then among what the shards kept.
    for w in (W.partitionBy("_cat", "_shard"), W.partitionBy("_cat")):
        held = held.withColumn("_rn", F.row_number().over(w.orderBy("_chance", *order_by))).where(F.col("_rn") <= F.col("quota"))
    return held.drop("_cat", "_rn", "quota", "_chance", "_shard", "_bin", "_last")


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, token rows: lower-cased words."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")).alias("token"))


def term_frequency(tok: DataFrame) -> DataFrame:
    """token, tf = -log2(corpus share)."""
    return with_total(tok.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "n").select("token", (-F.log2(F.col("n") / F.col("total"))).alias("tf"))


def inverse_document_frequency_of(docs: DataFrame, text_col: str) -> DataFrame:
    """token, idf = log2(documents / documents with the token); documents without words don't count, each row is a document."""
    words = docs.select(F.array_distinct(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")).alias("w"))
    total = words.agg(F.count_if(F.size("w") > 0).alias("m"))
    counts = words.select(F.explode("w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.crossJoin(F.broadcast(total)).select("token", F.log2(F.col("m") / F.col("df")).alias("idf"))


def inverse_document_frequency(tok: DataFrame) -> DataFrame:
    """The same of a table (doc, token)."""
    docs = tok.agg(F.count_distinct("doc").alias("m"))
    return tok.select("doc", "token").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs)).select("token", F.log2(F.col("m") / F.col("df")).alias("idf"))


def pointwise_information(tok: DataFrame) -> DataFrame:
    """doc, token, pmi = -log2(count in document / count in corpus), at least 0."""
    own = tok.groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n"))
    corpus = own.groupBy("token").agg(F.sum("n").alias("c"))
    return own.join(corpus, "token").select("doc", "token", F.greatest(F.log2(F.col("c") / F.col("n")), F.lit(0.0)).alias("pmi"))
