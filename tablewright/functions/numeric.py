"""Numeric helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES) or isinstance(dt, T.BooleanType)


def is_text(dt) -> bool:
    return isinstance(dt, T.StringType)


def is_temporal(dt) -> bool:
    return isinstance(dt, TEMPORAL_TYPES)


def as_double(c: str, dt) -> Column:
    """Column as DOUBLE with NaN mapped to NULL (NaN poisons min/max/avg)."""
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col.cast("double"))
    if isinstance(dt, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return col.cast("double")


def is_null_or_nan(c: str, dt) -> Column:
    col = F.col(c)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def round_half_up(c, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in IEEE doubles: bit-identical in Spark and
    DuckDB (``round`` differs between them on decimal half-way values)."""
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return (F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))
