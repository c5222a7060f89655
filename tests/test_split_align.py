"""Split, leakage and alignment cases (reference leakage-guard tests)."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import encode as E
from tablewright.operators import split as SP


def test_split_sizes_and_disjoint(spark):
    df = spark.createDataFrame([(float(i), float(i * 2), i % 2, i) for i in range(200)],
                               "feature_a double, feature_b double, target int, id int")
    sp = SP.stratified_split(df, "target", 0.2, 42, key="id")
    counts = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert counts == {"train": 160, "test": 40}
    assert SP.split_key_overlap(sp, "id").first()["n_keys_both_sides"] == 0
    per = {(r["split"], r["target"]): r["count"] for r in sp.groupBy("split", "target").count().collect()}
    assert per[("test", 0)] == 20 and per[("test", 1)] == 20


def test_split_quarter(spark):
    df = spark.createDataFrame([(float(i), float(i), i % 3 == 0 and 1 or 0) for i in range(200)],
                               "age double, income double, target int")
    sp = SP.stratified_split(df, "target", 0.25, 42)   # content hash as key
    assert sp.filter(F.col("split") == "test").count() == 50


def test_quotas_largest_remainder():
    assert SP.test_quotas({0: 58, 1: 341}, 0.2) == {0: 12, 1: 68}
    assert sum(SP.test_quotas({"a": 1, "b": 1, "c": 1}, 0.5).values()) == 2


def test_forged_leak_detected(spark):
    df = spark.createDataFrame([(30.0, 1.0, 0, "train"), (40.0, 2.0, 1, "train"), (30.0, 1.0, 0, "test")],
                               "age double, income double, target int, split string")
    r = SP.cross_split_duplicates(df).first()
    assert r["n_rows_cross_split"] == 2 and r["n_groups_cross_split"] == 1


def test_content_split_never_leaks(spark):
    rows = [(float(i % 50), float(i % 7), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, target int")
    sp = SP.stratified_split(df, "target", 0.2, 7)
    assert SP.cross_split_duplicates(sp, ["a", "b", "target"]).first()["n_rows_cross_split"] == 0


def test_align_union_zero_fill(spark):
    tr = spark.createDataFrame([(30.0, 1, 0, 1), (40.0, 0, 1, 0), (50.0, 1, 0, 1)],
                               "age double, region_US int, region_EU int, target int")
    te = spark.createDataFrame([(35.0, 1, 0, 0), (45.0, 0, 1, 1)],
                               "age double, region_US int, region_APAC int, target int")
    a, b = E.align_columns(tr, te, "target")
    assert a.columns == b.columns == sorted(a.columns)
    assert a.count() == 3 and b.count() == 2
    assert b.agg(F.sum("region_EU")).first()[0] == 0


def test_align_refuses_missing_target(spark):
    tr = spark.createDataFrame([(1.0, 1)], "age double, target int")
    te = spark.createDataFrame([(1.0,)], "age double")
    with pytest.raises(ValueError):
        E.align_columns(tr, te, "target")


def test_split_ties_on_boundary(spark):
    # 30 rows share one key: their hashes tie, so the boundary must rank them
    rows = [("k", i % 2, i) for i in range(30)] + [(f"u{i}", i % 2, i) for i in range(70)]
    df = spark.createDataFrame(rows, "key string, target int, payload int")
    sp = SP.stratified_split(df, "target", 0.2, 1, key="key")
    counts = {(r["split"], r["target"]): r["count"] for r in sp.groupBy("split", "target").count().collect()}
    assert counts[("test", 0)] == 10 and counts[("test", 1)] == 10
    assert sp.count() == 100
