"""What a cleaning run reads: dates parsed once, then stored."""

from tablewright.functions.dates import BY_SEPARATOR, DAY_FIRST, MONTH_FIRST, parse_timestamp
from tablewright.plans.cleaning import clean, fit_clean

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def values(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def messy(spark):
    texts = ["2024-01-05", " 2024-02-30 ", "Jan 7, 2024", "9 March 2024 10:30", "unknown", None, "0001-01-03", "2024/2/1"]
    rows = [(i, texts[i % 8] if i % 5 == 0 else f"2023-{i % 12 + 1:02d}-{i % 28 + 1:02d}", f"2023-{(i * 7) % 12 + 1:02d}-11", float(i % 9), "ab"[i % 2], i % 2)
            for i in range(200)]
    df = spark.createDataFrame(rows, "id long, sent string, paid string, x double, kind string, target int")
    return df.unionByName(df.where("id < 20"))


def test_cleaned_rows_read_no_date_text(spark):
    df, before = messy(spark), spark.conf.get(LIMIT)
    got = clean(df, "conservative_median", target="target", keep=["id"], date_min_rate=0.7)
    assert sorted(got.date_columns) == ["paid", "sent"]
    assert "regexp" not in plan_of(got.df).lower() and "rlike" not in plan_of(got.df).lower()
    assert spark.conf.get(LIMIT) == before
    assert values(got.df) == values(got.plan.transform(df))      # the fitted plan still reads text
    plan, out = fit_clean(df, "conservative_median", "target", ["id"], date_min_rate=0.7, checkpoint=False)
    assert values(out) == values(got.df) and plan.describe() == got.plan.describe()


def test_plain_iso_dates_are_read_alike_in_every_order(spark):
    texts = ["2024-01-05", "2024-02-30", "2024-13-01", "0000-01-01", "2024-01-05 ", "2024-1-5", "1-1-2024", "1/5/24", "123", "2024-01-05\n", "jan 5 24", "12 3 4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for order in (MONTH_FIRST, DAY_FIRST, BY_SEPARATOR):
        got = {r.t: r.d for r in df.select("t", parse_timestamp("t", order).cast("string").alias("d")).collect()}
        day = "2024-01-05 00:00:00"
        assert [got[t] for t in texts[:6]] == [day, None, None, got["0000-01-01"], day, day]
        assert got["1-1-2024"] == "2024-01-01 00:00:00" and got["123"] is got["jan 5 24"] is got["12 3 4"] is None
        assert got["1/5/24"] == ("2024-05-01 00:00:00" if order == DAY_FIRST else day) and got["2024-01-05\n"] == day
