"""Deterministic per-row pseudo-randomness from an md5 of (key, salt).

The same formula is expressible in DuckDB, so every operator driven by it has
an exact SQL oracle:

    Spark : conv(substr(md5(concat(cast(key as string), salt)), 1, 8), 16, 10) / 2^32
    DuckDB: ('0x' || substr(md5(key::varchar || salt), 1, 8))::BIGINT / 4294967296
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_hex(key, salt: str) -> Column:
    return F.md5(F.concat(_col(key).cast("string"), F.lit(salt)))


def uniform(key, salt: str) -> Column:
    """A fraction in [0, 1) from the first 32 bits of md5(key || salt)."""
    return F.conv(F.substring(md5_hex(key, salt), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def hash52(key, salt: str) -> Column:
    """A non-negative 52-bit integer from the first 13 hex digits of
    md5(key || salt); 52 bits keep it exact as a DOUBLE for rank selection."""
    return F.conv(F.substring(md5_hex(key, salt), 1, 13), 16, 10).cast("long")


def row_content_key(cols: list[str]) -> Column:
    """A string key of the full row content (nulls distinguished from text)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.concat_ws("\u0001", *parts)
