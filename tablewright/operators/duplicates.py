"""Duplicate rows without moving rows.

Grouping by every column shuffles every row whole.  Here a first pass counts 128-bit
fingerprints, 16 bytes a row whatever its width, and keeps those that repeat as a bitmap
of at most ``BITS`` bits.  Only rows whose bit is set are then grouped by their full
content, so a fingerprint that two different rows share changes no result: it only sends
both rows to the second pass.  Each frame reads its input in both passes; stage a derived
input before (``session.staged_if_derived``).

Equality is that of ``groupBy``: nulls are equal, NaN equals NaN, 0.0 equals -0.0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the bitmap: at most 2^20 words of 64 bits, 16 MB, go to every executor.
BITS = 1 << 26

#: Types whose equality is not that of the bytes that are hashed, or that cannot be hashed.
_UNHASHED = re.compile(r"\b(map|variant|void|interval)\b|collate")


def fingerprint(cols) -> list:
    """Two 64-bit hashes of a row with different seeds."""
    quoted = [F.col(f"`{c}`") for c in cols]
    return [F.xxhash64(*quoted).alias("__h1"), F.xxhash64(F.lit("second"), *quoted).alias("__h2")]


def _bit(h1="__h1", h2="__h2"):
    """The bit of a fingerprint in the bitmap."""
    return F.pmod(F.xxhash64(h1, h2), F.lit(BITS))


def flagged(df: DataFrame, cols, prints: DataFrame, name: str, hashes=fingerprint) -> DataFrame:
    """``df`` with a boolean ``name``: true for every row whose fingerprint of ``cols`` is among
    ``prints`` (``__h1``, ``__h2``), and for the few others that fall on a set bit.  Rows travel
    nowhere: the bitmap is broadcast."""
    bit, place = F.col("__bit"), (F.col("__bit") % 64).cast("int")
    word = F.shiftright(bit, 6)
    words = (prints.select(_bit().alias("__bit")).groupBy(word.alias("__word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("__set")))
    marked = df.select("*", *hashes(cols)).withColumn("__bit", _bit()).drop("__h1", "__h2")
    is_set = F.call_function("shiftrightunsigned", "__set", place).bitwiseAND(F.lit(1).cast("long")) == 1
    return marked.join(F.broadcast(words), word == F.col("__word"), "left") \
        .select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(is_set, F.lit(False)).alias(name))


def suspects(df: DataFrame, cols=None, hashes=fingerprint) -> DataFrame:
    """The rows of ``df`` that may have a copy in ``cols``: every row that has one, and the
    few others that ``flagged`` lets through.  Tables with columns that cannot be hashed come
    back whole."""
    cols = list(cols or df.columns)
    if not cols or _UNHASHED.search(df.select(*[F.col(f"`{c}`") for c in cols]).schema.simpleString().lower()):
        return df
    counted = df.select(*hashes(cols)).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__c"))
    return flagged(df, cols, counted.where("__c > 1"), "__maybe", hashes).where("__maybe").drop("__maybe")


def repeated_groups(df: DataFrame, cols=None, *aggs, hashes=fingerprint) -> DataFrame:
    """Every group of two or more rows that are equal in ``cols``, with its size ``__c`` and ``aggs``."""
    cols = list(cols or df.columns)
    near = suspects(df, cols, hashes)
    return near.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("__c"), *aggs).where("__c > 1")


def duplicate_rows(df: DataFrame, cols=None, hashes=fingerprint) -> DataFrame:
    """One row: ``n_rows``, ``n_distinct_rows`` and ``n_duplicate_rows`` (rows beyond the first of each group)."""
    extra = repeated_groups(df, cols, hashes=hashes).agg(F.sum(F.col("__c") - 1).alias("__d")).select(F.lit(0).alias("__n"), "__d")
    rows = df.agg(F.count(F.lit(1)).alias("__n")).select("__n", F.lit(0).cast("long").alias("__d"))
    both = rows.unionByName(extra).agg(F.sum("__n").alias("__n"), F.coalesce(F.sum("__d"), F.lit(0)).alias("__d"))
    return both.select(F.col("__n").alias("n_rows"), (F.col("__n") - F.col("__d")).alias("n_distinct_rows"),
                       F.col("__d").alias("n_duplicate_rows"))
