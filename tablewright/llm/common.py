"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_path

#: White space between words: blank and the five ASCII controls tab to return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space."""
    return F.filter(F.split(text, SPACE_RE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return let(F.btrim(text, F.lit(SPACES)),
               lambda t: F.when(t == "", 0).otherwise(F.size(F.split(t, SPACE_RE)))).cast("long")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back, so that a
    lost executor costs no recomputation and later passes read columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete the folder of a frame made by ``staged`` that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark: SparkSession = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named input columns cast to the given types, and nothing else, so that
    further columns of the input, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def hash_buckets(n: int, *columns: str) -> Column:
    """A bucket number below about sqrt(n) from a hash of ``columns``."""
    return F.pmod(F.xxhash64(F.lit(29), *[F.col(c) for c in columns]), F.lit(math.isqrt(n) + 1)).cast("long")


#: Copies of a row that one list holds.
_COPIES = 4096


def spread_copies(df: DataFrame, n: str, out: str) -> DataFrame:
    """Every row ``n`` times (a column, never null), numbered from 0 in ``out``; no list
    is longer than a fixed number of copies."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / _COPIES)))
    df = df.where(F.col(n) > 0).withColumn("_part", part)
    last = F.least((F.col("_part") + 1) * _COPIES, F.col(n)) - 1
    return df.withColumn(out, F.explode(F.sequence(F.col("_part") * _COPIES, last))).drop("_part")


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str,
            value: Column | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` (1: a 0-based rank, gapless) over the rows
    before, by ``bucket`` and then ``order``, among the rows of the same ``keys``
    (never null).  ``extra`` has one row for each of the keys, whose other
    columns are added too.

    A key may hold any share of the rows, as only a bucket's rows meet in a task;
    with sqrt(n) buckets of distinct rows neither these nor a key's list of buckets grow
    beyond sqrt(n).  Equal rows meet in one bucket, so callers whose rows may repeat
    count them first (``value`` times the count) and place the copies after.  The result is the same on every run if ``order`` tells rows apart,
    or leaves ties only between rows of equal value.
    """
    value = F.lit(1) if value is None else value
    df = df.withColumn("_v", value.cast("long")).withColumn("_b", bucket)
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    if extra is not None:
        sums = sums.join(extra, keys)
    here = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_w", F.coalesce(F.sum("_v").over(here), F.lit(0)))
    return (df.join(sums, [*keys, "_b"]).withColumn(out, (F.col("_before") + F.col("_w")).cast("long"))
            .drop("_v", "_b", "_w", "_before"))
