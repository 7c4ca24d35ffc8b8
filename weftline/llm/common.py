"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import checkpointed as cut
from weftline.session import scratch_dir, written

__all__ = ["BLANKS", "BLANK_RUN", "table", "shared_dir", "cut", "written", "parts", "with_columns_of"]

#: White space of the word rule: everything outside ``[^\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset in a local session (tests)."""
    return scratch_dir(spark)


def parts(spark: SparkSession) -> int:
    """How many partitions the session deals its shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def with_columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns of the input can't clash with computed ones."""
    return df.select(*[F.col(f"`{n}`") for n in names])
