"""Derived "messy" views of the driver tables.

The driver tables contain no nulls and no duplicate rows, so the data-quality
operators are exercised on views with injected defects.  Each view is a
composition of the ``operators.inject`` transforms over a real table, so its
size grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators import inject
from .tables import spread, table

# Spelling variants injected into o_orderpriority.
PRIORITY_VARIANTS = {
    "1-URGENT": ["1-URGENT", "1-urgent", "1 URGENT", "1-Urgent "],
    "2-HIGH": ["2-HIGH", "2-high", "2-High "],
    "3-MEDIUM": ["3-MEDIUM", "3-medium", "3_MEDIUM"],
    "4-NOT SPECIFIED": ["4-NOT SPECIFIED", "4-not specified"],
    "5-LOW": ["5-LOW", "5-low ", "5 low"],
}
# Literal missing markers written into text columns.
MISSING_MARKERS = ["NA", "N/A", "null", "None", "-"]

# Defect rates of the messy views.
NULL_RATE = 0.12
OUTLIER_RATE = 0.03
OUTLIER_FACTOR = 15.0
DUPLICATE_RATE = 0.02
SWAP_RATE = 0.05
MARKER_RATE = 0.06
JUNK_RATE = 0.02


def orders_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with the order date as text and a derived ship date 1..19 days later."""
    o = spread(table(spark, sf_dir, "orders"))
    lag = (F.floor(uniform("o_orderkey", "lag") * 19) + 1).cast("int")
    return o.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), lag), "yyyy-MM-dd").alias("ship_date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
    )


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan-table-like view: nulls, x15 outliers, spellings, missing
    markers, unparseable and swapped dates, 2% duplicate rows."""
    df = orders_dates(spark, sf_dir)
    k = "o_orderkey"
    df = inject.inject_spellings(df, "o_orderpriority", PRIORITY_VARIANTS, k)
    df = inject.inject_markers(df, "o_orderpriority", MARKER_RATE, MISSING_MARKERS, k)
    df = inject.inject_nulls(df, ["o_totalprice", "o_orderpriority"], NULL_RATE, k)
    df = inject.inject_outliers(df, "o_totalprice", OUTLIER_RATE, OUTLIER_FACTOR, k)
    df = inject.inject_date_swaps(df, "order_date", "ship_date", SWAP_RATE, k)
    df = inject.inject_junk(df, "ship_date", JUNK_RATE, "unknown", k)
    return inject.inject_duplicates(df, DUPLICATE_RATE, k)


def messy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with 12% nulls in value and event_type, x15 outliers in value
    and 2% duplicate rows."""
    df = spread(table(spark, sf_dir, "events"))
    k = "event_id"
    df = inject.inject_nulls(df, ["event_type", "value"], NULL_RATE, k)
    df = inject.inject_outliers(df, "value", OUTLIER_RATE, OUTLIER_FACTOR, k)
    return inject.inject_duplicates(df, DUPLICATE_RATE, k)


def spelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows an order, whose ``code`` is spelled in two ways (odd keys) or three:
    a text column with more distinct values than there are orders."""
    k = F.col("o_orderkey").cast("string")
    odd = F.col("o_orderkey") % 2 == 1
    spellings = F.array(F.concat(F.lit("Ref "), k), F.when(odd, F.concat(F.lit("Ref "), k)).otherwise(F.concat(F.lit("ref_"), k)),
                        F.concat(F.lit("REF-"), k))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.explode(spellings).alias("code"))


def mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with o_orderdate written in six ways, by o_orderkey; every seventh
    key has a text that is no date."""
    d, way = F.to_date("o_orderdate"), F.col("o_orderkey") % 7
    written = (F.when(way == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(way == 1, F.date_format(d, "MM/dd/yyyy"))
               .when(way == 2, F.date_format(d, "MMM d, yyyy")).when(way == 3, F.date_format(d, "yyyy-M-d"))
               .when(way == 4, F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit(" "))).when(way == 5, F.date_format(d, "yyyy-MM-dd HH:mm:ss.SSS"))
               .otherwise(F.lit("not known")))
    return table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))


#: How ``written_dates`` writes the column ``any``, by o_orderkey.
ANY_FORMS = ("yyyy-MM-dd HH:mm", "yyyyMMdd", "d MMMM yyyy", "dd-MMM-yyyy", "MMM d yyyy", "yyyy-MM-dd'T'HH:mm'Z'", "MMMM d, yyyy", "yyyy/M/d",
             "yyyy.MM.dd", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss.SSS", "d MMM yyyy", "yyyy-MMM-dd", "yyyy-MM-dd HH:mm:ss'+00:00'")


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with o_orderdate as text with the day first, the month first, in ISO order,
    and in any of many forms that name the month or start with the year; every
    eleventh key has ``iso`` text that is no date."""
    d = F.to_date("o_orderdate").cast("timestamp")
    way = F.col("o_orderkey") % len(ANY_FORMS)
    any_form = F.lit(None).cast("string")
    for i, form in enumerate(ANY_FORMS):
        any_form = F.when(way == i, F.date_format(d, form)).otherwise(any_form)
    return spread(table(spark, sf_dir, "orders")).select(
        "o_orderkey", F.date_format(d, "dd/MM/yyyy").alias("european"), F.date_format(d, "M-d-yyyy").alias("american"),
        F.when(F.col("o_orderkey") % 11 == 0, "13/13/2024").otherwise(F.date_format(d, "yyyy-MM-dd HH:mm")).alias("iso"), any_form.alias("any"))
