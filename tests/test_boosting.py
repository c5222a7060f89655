"""Histogram boosting against a plain one in Python, and its missing values."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import boosting as BO
from tablewright.operators import model as MD
from tablewright.operators import trees as TR


def plain_boosting(rows, n_features, p):
    """Margins after all rounds: every cut at every threshold, missing rows on both sides."""
    points = []
    for f in range(n_features):
        v = sorted(x[f] for x, _ in rows if x[f] is not None)
        points.append(sorted({v[k * len(v) // p.max_bins] for k in range(1, p.max_bins)} | {v[-1]}) if v else [])
    margins = [0.0] * len(rows)

    def term(g, h):
        return g * g / (h + p.l2)

    for _ in range(p.rounds):
        prob = [1 / (1 + math.exp(-m)) for m in margins]
        g = [round((q - y) * BO.UNIT) / BO.UNIT for q, (_, y) in zip(prob, rows)]
        h = [round(q * (1 - q) * BO.UNIT) / BO.UNIT for q in prob]

        def grow(ids, depth):
            ga, ha = sum(g[i] for i in ids), sum(h[i] for i in ids)
            best = None
            for f in range(n_features) if depth < p.max_depth else ():
                for k, t in enumerate(points[f]):
                    here = [i for i in ids if rows[i][0][f] is not None and rows[i][0][f] <= t and (k == 0 or rows[i][0][f] > points[f][k - 1])]
                    for missing_low in (True, False) if here else ():
                        low = [i for i in ids if (missing_low if rows[i][0][f] is None else rows[i][0][f] <= t)]
                        gl, hl = sum(g[i] for i in low), sum(h[i] for i in low)
                        if hl < p.min_child or ha - hl < p.min_child:
                            continue
                        gain = term(gl, hl) + term(ga - gl, ha - hl) - term(ga, ha)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, low
            if best is None:
                for i in ids:
                    margins[i] += -ga / (ha + p.l2) * p.learning_rate
                return
            low = set(best[1])
            grow(best[1], depth + 1)
            grow([i for i in ids if i not in low], depth + 1)

        grow(list(range(len(rows))), 0)
    return margins


def odd_rows(n=400):
    out = []
    for i in range(n):
        a = None if i % 7 == 0 else float((i * 37) % 101)
        b = None if i % 11 < 3 else float((i * i) % 13)          # many ties
        y = int((i % 7 == 0) or (a is not None and a > 60) != (b is None))
        out.append(((a, b, None), y if i % 17 else 1 - y))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *x, y) for i, (x, y) in enumerate(rows)], "id int, a double, `b.c` double, never double, y int")


FEATURES = ["a", "b.c", "never"]


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_equal_to_plain_boosting(spark, missing):
    p = BO.BoostParams(rounds=3, max_depth=3, max_bins=8, refresh=2)
    rows = odd_rows()
    df = frame(spark, [(tuple(missing if v is None else v for v in x), y) for x, y in rows])
    model = BO.fit_boosted(df, "y", FEATURES, p)
    got = {r.id: r.m for r in df.select("id", TR.margin_column(model.trees).alias("m")).collect()}
    want = plain_boosting(rows, 3, p)
    assert [got[i] for i in range(len(rows))] == pytest.approx(want, abs=1e-9)
    assert "never" not in set().union(*[TR.features_of(t) for _, t in model.trees])
    per_round = {r: sum(n[5] for n in model.nodes if n[0] == r and n[6] is not None) for r in range(3)}
    assert per_round == dict.fromkeys(range(3), len(rows))      # every row ends in one leaf


def test_partitions_and_order_do_not_matter(spark):
    p = BO.BoostParams(rounds=4, max_depth=3, max_bins=8, refresh=1)
    df = frame(spark, odd_rows())
    one = BO.fit_boosted(df.coalesce(1), "y", FEATURES, p)
    many = BO.fit_boosted(df.orderBy(F.desc("id")).repartition(7), "y", FEATURES, p)
    assert one.nodes == many.nodes and one.trees == many.trees


def test_missing_values_alone_tell_the_class(spark):
    """Only whether the value is missing matters: a sentinel-free tree finds it, for every side."""
    for flip in (0, 1):
        df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("a"), ((F.col("id") % 3 == 0).cast("int") + flip).alias("y")) \
            .withColumn("y", F.col("y") % 2)
        model = BO.fit_boosted(df, "y", ["a"], BO.BoostParams(rounds=2, max_depth=1))
        s = MD.f1_accuracy(MD.predict(model, df), "y").first()
        assert s["accuracy"] == 1.0 and s["f1_score"] == 1.0


def test_defined_results_on_odd_tables(spark):
    df = frame(spark, odd_rows(40))
    with pytest.raises(ValueError, match="no feature"):
        BO.fit_boosted(df, "y", ["never"])
    with pytest.raises(ValueError, match="no feature"):
        BO.fit_boosted(df, "y", [])
    with pytest.raises(ValueError, match="labels 0 and 1"):
        BO.fit_boosted(df.limit(0), "y", FEATURES)
    with pytest.raises(ValueError, match="labels 0 and 1"):
        BO.fit_boosted(df.withColumn("y", F.lit(2)), "y", FEATURES)
    unlabelled = df.withColumn("y", F.when(F.col("id") < 30, F.col("y")))
    p = BO.BoostParams(rounds=2, max_depth=2, max_bins=4)
    assert BO.fit_boosted(unlabelled, "y", FEATURES, p).nodes == BO.fit_boosted(df.where("id < 30"), "y", FEATURES, p).nodes
    flat = BO.fit_boosted(df.withColumn("a", F.lit(float("inf"))), "y", ["a"], p)      # nothing to cut
    assert [n[1] for n in flat.nodes] == [1, 1] and flat.nodes[0][6] is not None
    assert MD.predict(flat, df).where("prediction IS NULL").count() == 0


def test_tree_as_sql_sends_missing_values_the_same_way(spark):
    import duckdb
    df = frame(spark, odd_rows())
    model = BO.fit_boosted(df, "y", FEATURES, BO.BoostParams(rounds=2, max_depth=3, max_bins=8))
    want = {r.id: r.m for r in df.select("id", TR.margin_column(model.trees).alias("m")).collect()}
    c = duckdb.connect()
    t = df.toPandas()  # noqa: F841 -- read by the SQL
    assert dict(c.execute(f"SELECT id, {TR.margin_sql(model.trees)} FROM t").fetchall()) == pytest.approx(want, abs=1e-12)
