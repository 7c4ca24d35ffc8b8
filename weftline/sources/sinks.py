"""Writers: JSON lines, CSV with a typed header, Parquet bytes, batches. Spark's committers make them atomic."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names of the second header row and the column types that they stand for.
TYPE_NAMES = {"str": "string", "datetime": "string", "int": "bigint", "decimal": "double"}


def write_json_lines(df: DataFrame, path: str, keep_nulls: bool = False) -> DataFrame:
    """Write one document a line and go on with what was written."""
    df.write.option("ignoreNullFields", not keep_nulls).json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON array per partition file, by the rows' text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def json_lines_to_csv(spark: SparkSession, source: str, path: str, schema: T.StructType, columns: Sequence[Column]) -> None:
    spark.read.schema(schema).json(source).select(*columns).write.csv(path)


def dump_csv(df: DataFrame, path: str, columns: dict[str, str] | Sequence[str] | None = None) -> int:
    """Write chosen (or renamed) columns with a header; the number of rows, counted while they are written."""
    from pyspark.sql import Observation

    out = df if columns is None else df.select(*[F.col(a).alias(b) for a, b in (columns.items() if isinstance(columns, dict) else zip(columns, columns, strict=True))])
    seen = Observation("rows")
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.option("header", True).csv(path)
    return seen.get["n"]


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "int"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "decimal"
    return "datetime" if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "str"


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose folder also holds `_header`: one file with the names, then the type names."""
    spark = df.sparkSession
    names = [f.name for f in df.schema.fields]
    kinds = [type_name(f.dataType) for f in df.schema.fields]
    head = spark.createDataFrame([(0, *names), (1, *kinds)], "_k int, " + ", ".join(f"c{i} string" for i in range(len(names))))
    df.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in names]).write.option("escape", '"').csv(path)
    head.coalesce(1).sortWithinPartitions("_k").drop("_k").write.option("escape", '"').csv(f"{path}/_header")


def import_csv(spark: SparkSession, path: str) -> DataFrame:
    """The table of export_csv, with its names and types; only the two header rows are read on the driver."""
    names, kinds = (list(r) for r in spark.read.csv(f"{path}/_header").limit(2).collect())
    if len(names) != len(kinds):
        raise ValueError("the two header rows differ in length")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("escape", '"').csv(path)
    return rows.select(*[F.col(f"`{n}`").cast(TYPE_NAMES[k]).alias(n) for n, k in zip(names, kinds, strict=True)])


def to_parquet_bytes(df: DataFrame) -> DataFrame:
    """part, data: each Arrow batch as the bytes of a Parquet file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(batches):
            out = io.BytesIO()
            pq.write_table(pa.Table.from_batches([b]), out)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([out.getvalue()], pa.binary())], names=["part", "data"])

    return df.mapInArrow(run, "part long, data binary")


def from_parquet_bytes(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield from pq.read_table(io.BytesIO(x.as_py())).to_batches()

    return df.select(column).mapInArrow(run, schema)


def schema_bytes(df: DataFrame) -> bytes:
    """A Parquet file without rows that carries the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = io.BytesIO()
    pq.write_table(to_arrow_schema(df.schema).empty_table(), out)
    return out.getvalue()


def run_batches(df: DataFrame, apply: Callable[[pd.DataFrame], None], size: int = 10_000, skip: tuple[type[Exception], ...] = ()) -> DataFrame:
    """partition, batch, rows, done: apply is called with each batch of at most `size` rows; the errors of `skip` fail their batch alone.

    A lost task is run again, so apply must be idempotent, as any sink under Spark must.
    """
    if size < 1:
        raise ValueError("size must be 1 or more")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for f in frames:
            for at in range(0, len(f), size):
                piece, done = f.iloc[at : at + size], True
                try:
                    apply(piece)
                except skip:
                    done = False
                yield pd.DataFrame({"partition": [part], "batch": [k], "rows": [len(piece)], "done": [done]})
                k += 1

    return df.mapInPandas(run, "partition int, batch long, rows long, done boolean")


def write_file(spark: SparkSession, lines: Sequence[str], path: str) -> None:
    spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k long, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)




def replace_table(df: DataFrame, path: str) -> None:
    """Write df to path, whole or not at all: it is written beside, and renamed when complete; a failure leaves what stood there as it was.

    Stores that rename folders do so at once; between the two renames a reader finds nothing, and never a half.
    """
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    fs = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new)
        there = fs.exists(jvm_path(path))
        if there and not fs.rename(jvm_path(path), jvm_path(old)):
            raise OSError(f"{path} could not be moved away")
        if not fs.rename(jvm_path(new), jvm_path(path)):
            if there:
                fs.rename(jvm_path(old), jvm_path(path))
            raise OSError(f"{path} could not be replaced")
        if there:
            fs.delete(jvm_path(old), True)
    finally:
        fs.delete(jvm_path(new), True)
