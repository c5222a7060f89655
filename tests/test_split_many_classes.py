"""The split beyond the number of classes that the driver takes, against the one on the driver."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablewright.operators import split as SP


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def table(spark):
    """A hot class, many small ones, a null class, repeated keys and repeated rows."""
    base = spark.range(900).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None))
                                   .otherwise(F.concat(F.lit("c"), (F.col("id") % 130).cast("string"))).alias("c"))
    return base.unionByName(base.where("k % 10 = 0")).unionByName(base.where("k = 3 OR k = 7"))


@pytest.mark.parametrize("key", ["k", None])
def test_tables_and_driver_agree(spark, monkeypatch, key):
    df = table(spark)
    for share in (0.2, 0.37):
        want = rows(SP.stratified_split(df, "c", share, 7, key=key))
        with monkeypatch.context() as m:
            m.setattr(SP, "MAX_CLASSES", 1)
            m.setattr(SP, "_driver_cuts", None)
            got = SP.stratified_split(df, "c", share, 7, key=key)
            assert got.columns == ["k", "c", "split"] and rows(got) == want


def test_quota_table_equals_largest_remainders(spark):
    counts = {f"c{i:05d}": 1 + i * i % 7 for i in range(3000)} | {None: 4, "hot": 5000}
    stored = spark.createDataFrame(list(counts.items()), "__cls string, __n long")
    got = {r[0]: r[1] for r in SP.quota_table(stored, 0.2).collect()}
    assert got == SP.test_quotas(counts, 0.2) and sum(got.values()) == math.ceil(Fraction("0.2") * sum(counts.values()))


def test_more_classes_than_the_driver_takes(spark):
    n = 12_000
    df = spark.range(3 * n).select("id", (F.col("id") % n).alias("c"))
    got = SP.stratified_split(df, "c", 0.3, 1, key="id").groupBy("c").agg(F.count_if(F.col("split") == "test").alias("t")) \
        .groupBy("t").count()
    # three rows a class, 0.9 test rows each: the first 10,800 classes give one
    assert {r["t"]: r["count"] for r in got.collect()} == {1: 10_800, 0: 1_200}
