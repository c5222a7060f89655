"""Duplicates by fingerprint: equal to grouping whole rows, with clashes, hot rows and odd columns;
no shuffle wider than the fingerprints but for suspects; ties of a split without one window."""

import re

from pyspark.sql import functions as F

from conftest import SF01
from tablewright.operators import duplicates as D
from tablewright.operators import gate as G
from tablewright.operators import split as SP


def _plain(df, cols=None):
    g = df.groupBy(*[F.col(f"`{c}`") for c in cols or df.columns]).agg(F.count(F.lit(1)).alias("c"))
    return tuple(g.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0))).first())


def _clashing(cols):
    """Seven fingerprints for all rows."""
    return [F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(7)).alias("__h1"), F.lit(0).cast("long").alias("__h2")]


def _odd(spark):
    nan = float("nan")
    rows = [(1, "a", 0.0, [1]), (1, "a", -0.0, [1]), (2, None, nan, None), (2, None, nan, None),
            (2, "", nan, None), (3, "x" * 100_000, 1.0, [])]
    rows += [(9, "hot", 2.0, [3])] * 500 + [(i, f"k{i % 40}", float(i % 3), [i]) for i in range(10, 300)]
    return spark.createDataFrame(rows, "a int, `b.c` string, `d` double, e array<int>")


def test_equal_to_grouping_whole_rows(spark):
    df = _odd(spark)
    for hashes in (D.fingerprint, _clashing):
        assert tuple(D.duplicate_rows(df, hashes=hashes).first()) == _plain(df)
        assert tuple(D.duplicate_rows(df, ["b.c", "d"], hashes=hashes).first()) == _plain(df, ["b.c", "d"])
        assert tuple(D.duplicate_rows(df.limit(0), hashes=hashes).first()) == (0, 0, 0)


def test_clashes_only_widen_the_suspects(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("x"))
    assert D.suspects(df).count() < 20                       # none repeats; a bit may be shared by chance
    assert D.suspects(df, hashes=_clashing).count() == 1000
    assert tuple(D.duplicate_rows(df, hashes=_clashing).first()) == (1000, 1000, 0)


def test_every_row_with_a_copy_is_a_suspect(spark):
    df = spark.range(20_000).select((F.col("id") % 15_000).alias("k"), F.lit("t").alias("t"))
    assert D.suspects(df).groupBy("k").count().where("count = 2").count() == 5000


def test_map_columns_go_whole(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1)), (1, map('a', 1)), (2, map('b', 1)) t(x, m)")
    assert tuple(D.duplicate_rows(df).first()) == (3, 2, 1)


def test_first_pass_shuffles_fingerprints_only(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    plan = D.suspects(li)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("l_" in k for k in keys) and "SortMergeJoin" not in plan


def test_leak_check_and_gate_with_copies(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_linenumber")
    split = li.withColumn("split", F.when(F.rand(3) < 0.2, "test").otherwise("train"))
    split = spark.createDataFrame(split.limit(3000).toPandas())
    g = split.groupBy(*li.columns).agg(F.count(F.lit(1)).alias("c"), F.countDistinct("split").alias("s"))
    want = g.selectExpr("sum(IF(s > 1, c, 0))", "count_if(s > 1)", "sum(IF(c > 1, c, 0))").first()
    assert tuple(SP.cross_split_duplicates(split).first()) == tuple(want) and want[0] > 0
    report = {r["check"]: r["observed"] for r in G.run_gate(split, split, None).collect() if r["check"] == "duplicates"}
    assert int(report["duplicates"]) == _plain(split)[2]


def _split_counts(sp):
    return {(r["split"], r["target"]): r["count"] for r in sp.groupBy("split", "target").count().collect()}


def test_hot_key_ties_are_split_by_content_and_rerun_alike(spark):
    rows = [("hot", 0, i) for i in range(300)] + [(f"u{i}", 0, i) for i in range(60)] + [("hot", 1, 5)] * 200 + [(None, 1, 5)] * 200
    df = spark.createDataFrame(rows, "key string, target int, payload int")
    seeds = [SP.stratified_split(df, "target", 0.25, seed, key="key") for seed in (1, 2, 3)]
    for sp in seeds:
        assert _split_counts(sp) == {("test", 0): 90, ("train", 0): 270, ("test", 1): 100, ("train", 1): 300}
    again = SP.stratified_split(df.repartition(7), "target", 0.25, 1, key="key")
    assert seeds[0].exceptAll(again).count() == 0 and again.exceptAll(seeds[0]).count() == 0


def test_hot_key_ties_with_any_number_of_classes(spark, monkeypatch):
    rows = [("hot", c, i % 3) for c in ("a", "b", None) for i in range(90)] + [(f"u{i}", "c", i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, target string, payload int")
    few = SP.stratified_split(df, "target", 0.2, 4, key="key")
    monkeypatch.setattr(SP, "MAX_CLASSES", 2)
    many = SP.stratified_split(df, "target", 0.2, 4, key="key")
    assert _split_counts(many)[("test", "a")] == 18 and _split_counts(many)[("test", None)] == 18
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
