"""Structured Streaming over event tables: windows, sessions, late rows, duplicates, running state.

State is bounded by watermarks; keyed state lives in the state store, partitioned by key. A batch writes its result under
its number, so a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Names = Sequence[str]


def read_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files; files_per_batch bounds a batch, as rate limits and back-pressure do."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(df: DataFrame, ts: str, width: str, keys: Names, late: str, *aggregates: Column) -> DataFrame:
    """start, end, keys, aggregates per window; rows later than `late` are dropped by the watermark."""
    return sliding(df, ts, width, width, keys, late, *aggregates)


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: Names, late: str, *aggregates: Column) -> DataFrame:
    w = F.window(ts, width, step)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *_names(df, keys, aggregates))


def sessions(df: DataFrame, ts: str, gap: str, keys: Names, late: str, *aggregates: Column) -> DataFrame:
    """The same per session: rows of a key that follow each other within the gap."""
    w = F.session_window(ts, gap)
    return df.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *_names(df, keys, aggregates))


def _names(df: DataFrame, keys: Names, aggregates: Sequence[Column]) -> list[str]:
    return df.groupBy(*keys).agg(*aggregates).columns[len(keys) :]


def first_seen(df: DataFrame, keys: Names, ts: str, within: str) -> DataFrame:
    """Rows whose key was not seen before, as far back as the watermark reaches."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def running_counts(df: DataFrame, key: str, ts: str, late: str, idle_ms: int) -> DataFrame:
    """key, n, total: after each batch the number of rows and the sum of `value` of each key that had rows.

    A key is forgotten once the watermark has passed its last row by idle_ms, so state is bounded by active keys.
    """
    kind = dict(df.dtypes)[key]

    def step(k: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for f in frames:
            n, total, last = n + len(f), total + float(f["value"].sum()), max(last, int(f["_ms"].max()))
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    held = df.withWatermark(ts, late).withColumn("_ms", F.unix_millis(ts))
    return held.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n long, total double", "n long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)


def with_static(df: DataFrame, table: DataFrame, on: Names) -> DataFrame:
    """A stream joined to a table, read anew for each batch."""
    return df.join(table, list(on), "left")


def within(left: DataFrame, right: DataFrame, on: Names, left_ts: str, right_ts: str, before: str, late: str) -> DataFrame:
    """Pairs of two streams whose right row is at most `before` after the left; both watermarks bound the state."""
    a, b = left.withWatermark(left_ts, late).alias("a"), right.withWatermark(right_ts, late).alias("b")
    rule = (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}")) & (F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + F.expr(f"INTERVAL {before}"))
    for c in on:
        rule = rule & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, rule)


def run_to(df: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there, to Parquet below path; the written table.

    append: Spark's file sink, exactly once. complete: each batch replaces the table. update: one folder a batch, column `batch`.
    """
    spark = df.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        if each is not None:
            each(batch, number)
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/batch={number}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    query = writer.format("parquet").option("path", f"{path}/table").start() if mode == "append" else writer.foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/table")
