"""``value_freq``: the (column, value, freq, first_seen) table of text columns.

Samples, cardinality, top-k, mode, spelling clusters and one-hot vocabularies
all read this table, whose size is the number of distinct values rather than
the number of rows.  The group-by is a partial (map-side) aggregate, so a value
holding a third of all rows costs one row per map task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_text(df: DataFrame, cols, order_by: str | None = None) -> DataFrame:
    """Unpivot text columns to (column, value[, ord]) without nulls."""
    ids = [order_by] if order_by else []
    proj = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    long = proj.unpivot(ids, list(cols), "column", "value")
    return long.filter(F.col("value").isNotNull())


def value_freq(df: DataFrame, cols, order_by: str | None = None) -> DataFrame:
    """Frequency of every non-null value of every listed column.

    ``first_seen`` is the minimum of ``order_by`` (an explicit ordering key);
    without one it is NULL and "first" means "smallest value".
    """
    cols = list(cols)
    if not cols:
        spark = df.sparkSession
        return spark.createDataFrame([], "column string, value string, freq long, first_seen long")
    long = long_text(df, cols, order_by)
    first = F.min(order_by).cast("long") if order_by else F.lit(None).cast("long")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"),
                                                first.alias("first_seen"))


def value_freq_with_nulls(df: DataFrame, cols) -> DataFrame:
    """(column, value, freq) with one more row, of a null value, for a column that has nulls.

    Filling nulls, mapping and grouping values are functions of this table, so what a
    cleaned column will hold follows from it without another pass over the rows
    (``filled``, ``kept_or_other``)."""
    proj = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return proj.unpivot([], list(cols), "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))


def _by_column(values: dict):
    """The value a column maps to, from a small dictionary; null for other columns."""
    return F.lit(None).cast("string") if not values else F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("column")]


def filled(vf: DataFrame, fill: dict) -> DataFrame:
    """``vf`` after nulls became ``fill[column]``; columns without one keep their nulls."""
    given = {c: v for c, v in fill.items() if v is not None}
    value = F.coalesce("value", _by_column(given))
    return vf.select("column", value.alias("value"), "freq").groupBy("column", "value").agg(F.sum("freq").alias("freq"))


def kept_or_other(vf: DataFrame, keep: dict, other: str) -> DataFrame:
    """``vf`` after the values of the columns of ``keep`` that it does not list became ``other``."""
    value = F.col("value")
    for c, values in keep.items():
        value = F.when((F.col("column") == c) & F.col("value").isNotNull() & ~F.col("value").isin(list(values)), other).otherwise(value)
    return vf.select("column", value.alias("value"), "freq").groupBy("column", "value").agg(F.sum("freq").alias("freq"))


def topk(vf: DataFrame, k: int, cols=None) -> DataFrame:
    """Top-k values per column by frequency, ties broken by value, in one scan: the
    filter on the rank makes every task keep k values a column before the shuffle."""
    if cols is not None:
        vf = vf.filter(F.col("column").isin(list(cols)))
    w = Window.partitionBy("column").orderBy(F.desc("freq"), F.asc("value"))
    return vf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_values(vf: DataFrame, k: int = 8) -> DataFrame:
    """First k distinct values per column (by first_seen, then value)."""
    w = Window.partitionBy("column").orderBy(F.asc_nulls_last("first_seen"), F.asc("value"))
    return (vf.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select("column", "rank", "value"))


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Frequency table of one column, descending, ties by value; ``k`` caps
    the report (a top-k report is the feature here)."""
    out = (df.filter(F.col(col).isNotNull())
           .groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("freq"))
           .orderBy(F.desc("freq"), F.asc("value")))
    return out.limit(k) if k else out


def mode_per_column(vf: DataFrame) -> DataFrame:
    """Most frequent value per column, ties broken by the smallest value."""
    return vf.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("freq"), F.col("value"))).alias("mode"))
