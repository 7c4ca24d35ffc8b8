"""Instants from epoch numbers; nothing passes through a local-time string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_seconds(c: Column) -> Column:
    """Seconds, fractions and negative ones too, to a timestamp in microseconds."""
    return F.timestamp_micros(F.round(c * 1_000_000).cast("long"))


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def from_nanos(c: Column) -> Column:
    """Nanoseconds; what lies below a microsecond is cut off towards the past."""
    return F.timestamp_micros(F.floor(c.cast("decimal(20,0)") / F.lit(1000).cast("decimal(4,0)")).cast("long"))


def millis_column(df: DataFrame, name: str) -> DataFrame:
    """A column of epoch milliseconds replaced by its timestamp."""
    return df.withColumn(name, F.timestamp_millis(F.col(name)))


def is_aware(df: DataFrame, name: str) -> bool:
    """Whether a column holds instants, not wall-clock times."""
    return isinstance(df.schema[name].dataType, T.TimestampType)


def to_aware(c: Column, zone: str = "UTC") -> Column:
    """A wall-clock time read in a zone as an instant."""
    return F.to_utc_timestamp(c.cast("timestamp"), zone)


def now(zone: str | None = None) -> Column:
    return F.current_timestamp() if zone is None else F.from_utc_timestamp(F.current_timestamp(), zone)
