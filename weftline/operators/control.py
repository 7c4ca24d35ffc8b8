"""User functions over rows, retries, caches, counts and composition."""

from __future__ import annotations

import hashlib
import queue
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def parallel_map(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over Arrow batches of rows, in order inside each partition; partitions are the workers."""
    return df.mapInPandas(lambda frames: map(f, frames), schema)


def threaded_map(df: DataFrame, column: str, f: Callable[[Any], Any], kind: str, threads: int = 8, name: str = "result") -> DataFrame:
    """f over one column's values by threads in each task, for functions that wait; rows keep their order."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for x in frames:
                yield x.assign(**{name: list(pool.map(f, x[column]))})

    return df.mapInPandas(run, f"{fields}, `{name}` {kind}")


def first_finished(df: DataFrame) -> DataFrame:
    """Any one row."""
    return df.limit(1)


def wait_times(spark: SparkSession, wait: float, attempts: int, multiplier: float = 1, longest: float | None = None) -> DataFrame:
    """attempt, wait: the pauses after each attempt but the last; growing by the multiplier up to the longest."""
    grown = F.pow(F.lit(float(multiplier)), F.col("id")) * wait
    return spark.range(max(attempts - 1, 0)).select(F.col("id").alias("attempt"), (F.least(grown, F.lit(float(longest))) if longest else grown).alias("wait"))


def retry(f: Callable[[], Any], wait: float, attempts: int = 3, multiplier: float = 1, longest: float | None = None, on: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], Any] = time.sleep) -> Any:
    """f(), tried anew after the listed errors; the last error is raised."""
    pause = wait
    for k in range(attempts):
        try:
            return f()
        except on:
            if k == attempts - 1:
                raise
        sleep(min(pause, longest) if longest else pause)
        pause *= multiplier
    raise ValueError("attempts must be 1 or more")


def at_most_every(seconds: float, f: Callable[..., Any], clock: Callable[[], float] = time.monotonic) -> Callable[..., Any]:
    """f, called at most once in so many seconds; calls between give None."""
    last: list[float] = []

    def call(*args, **kw):
        now = clock()
        if last and now - last[0] < seconds:
            return None
        last[:] = [now]
        return f(*args, **kw)

    return call


@contextmanager
def lasting(seconds: float, sleep: Callable[[float], Any] = time.sleep, clock: Callable[[], float] = time.monotonic, on_error: bool = False) -> Iterator[None]:
    """What runs inside takes so many seconds at least: the rest is waited for, after an error only if asked."""
    began, ok = clock(), False
    try:
        yield
        ok = True
    finally:
        left = seconds - (clock() - began)
        if left > 0 and (ok or on_error):
            sleep(left)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The table and an observation of its rows, taken as they pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def cached(spark: SparkSession, root: str, key: Sequence, build: Callable[[], DataFrame], max_age: float | None = None, clock: Callable[[], float] = time.time) -> DataFrame:
    """build() written below root under its key, or what is there if it is young enough. A table counts once it is complete."""
    path = f"{root}/{hashlib.sha256(repr(tuple(key)).encode()).hexdigest()}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = fs.exists(fs_path) and (max_age is None or clock() - fs.getFileStatus(fs_path).getModificationTime() / 1000 <= max_age)
    if not fresh:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def compose(*functions: Callable) -> Callable:
    """The last function first."""

    def run(x):
        for f in reversed(functions):
            x = f(x)
        return x

    return run


def apply_all(functions: Sequence[Callable[[DataFrame], DataFrame]], df: DataFrame) -> DataFrame:
    """The functions one after the other, each on what the one before gave."""
    for f in functions:
        df = df.transform(f)
    return df


def default_on_error(expression: str, default: Column) -> Column:
    """A SQL expression whose function has a try_ form, with a default where it fails; null results take it too."""
    name, _, rest = expression.partition("(")
    return F.coalesce(F.expr(f"{name if name.startswith('try_') else 'try_' + name}({rest}"), default)


def good_and_bad(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows for quarantine); a test without answer is not passed."""
    ok = F.coalesce(test, F.lit(False))
    return df.where(ok), df.where(~ok)


def consume(df: DataFrame) -> int:
    """Compute every row and keep none; their number."""
    seen = Observation("consumed")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


def array_only(df: DataFrame, column: str) -> DataFrame:
    """df, if the column holds arrays; a text or bytes, which would be taken apart by mistake, is refused before anything runs."""
    kind = df.schema[column].dataType
    if not isinstance(kind, ArrayType):
        raise TypeError(f"{column} is {kind.simpleString()} and no array")
    return df


def prefetched(values: Iterator, size: int) -> Iterator:
    """The values, computed by a thread up to `size` ahead of who reads them; it waits when the buffer is full, and its error is raised in turn."""
    waiting: queue.Queue = queue.Queue(size)
    end, gone = object(), threading.Event()

    def put(x) -> bool:
        while not gone.is_set():
            try:
                waiting.put(x, timeout=0.1)
                return True
            except queue.Full:
                continue
        return False

    def work() -> None:
        try:
            for v in values:
                if not put((None, v)):
                    return
            put((None, end))
        except BaseException as e:  # handed to the reader
            put((e, end))

    threading.Thread(target=work, daemon=True).start()
    try:
        while True:
            error, v = waiting.get()
            if error is not None:
                raise error
            if v is end:
                return
            yield v
    finally:
        gone.set()


def frame_json(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """One row `json`: an object of column arrays, for small frames (it is one value)."""
    rows = df.agg(F.sort_array(F.collect_list(F.struct(F.struct(*order_by).alias("_k"), F.struct(*df.columns).alias("_v")))).alias("_l"))
    return rows.select(F.to_json(F.struct(*[F.col("_l._v").getField(c).alias(c) for c in df.columns])).alias("json"))
