"""The attempt loop computes its input once."""

from pyspark.sql import functions as F

from tablewright.operators import gate as G

from test_clean_scale import messy, plan_of


def test_every_attempt_reads_a_stored_input(spark):
    df, seen = messy(spark), []
    assert "Union" in plan_of(df)

    def step(d):
        seen.append(plan_of(d))
        return d.select("x", "target").where("x > 0") if len(seen) > 1 else d

    _, log = G.first_passing(df, [("as it is", step), ("numbers", step), ("again", lambda d: step(d).distinct())], "target")
    assert [r.passed for r in log.orderBy("attempt").collect()] == [False, False, True]
    assert len(seen) == 3 and not any("Union" in p for p in seen)
    broken = spark.range(3).select(F.assert_true(F.col("id") < 0).alias("v"), "id").distinct()
    _, log = G.first_passing(broken, [("one", lambda d: d)], None)
    assert log.first().passed is False
