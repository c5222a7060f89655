"""A plan fitted on a static table cleans a file stream, batch by batch."""

from pyspark.sql import functions as F

from tablewright.plans.cleaning import fit_clean
from tablewright.streaming.apply import start_gated_stream


def test_fitted_plan_cleans_stream(spark, tmp_path):
    schema = "age double, kind string, start string, stop string, target int"
    rows = [(20.0 + i % 30, ["a", "A ", "b", None][i % 4], f"2023-01-{1 + i % 27:02d}",
             f"2023-02-{1 + i % 27:02d}", i % 2) for i in range(120)]
    static = spark.createDataFrame(rows, schema)
    plan, cleaned = fit_clean(static, "conservative_median", target="target")
    src = tmp_path / "in"
    spark.createDataFrame(rows[:60], schema).write.parquet(str(src / "p1"))
    spark.createDataFrame(rows[60:], schema).write.parquet(str(src / "p2"))
    stream = spark.readStream.schema(schema).parquet(str(src / "*"))
    q = start_gated_stream(stream, plan, str(tmp_path / "out"), str(tmp_path / "gate"),
                           str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    gate = spark.read.parquet(str(tmp_path / "gate"))
    assert gate.filter(~F.col("passed")).count() == 0
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(c for c in out.columns if c != "batch_id") == sorted(cleaned.columns)
    assert out.filter(F.col("age").isNull()).count() == 0


def test_clean_stream_dedups_within_watermark(spark, tmp_path):
    import datetime as dt

    from tablewright.streaming.apply import clean_stream
    schema = "ts timestamp, kind string, v double, target int"
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=i), ["a", "b"][i % 2], float(i % 7), i % 2) for i in range(40)]
    static = spark.createDataFrame(rows, schema)
    plan, _ = fit_clean(static, "conservative_median", target="target")
    src = tmp_path / "in"
    spark.createDataFrame(rows + rows[:10], schema).write.parquet(str(src / "p1"))   # 10 exact copies
    stream = spark.readStream.schema(schema).parquet(str(src / "*"))
    out = clean_stream(stream, plan, event_time="ts", delay="1 day")
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    res = spark.read.parquet(str(tmp_path / "out"))
    assert res.count() == 40                      # copies dropped within the watermark
    assert res.filter(F.col("v").isNull()).count() == 0


def test_replayed_and_rejected_batches(spark, tmp_path):
    from tablewright.streaming.apply import gated_writer
    schema = "age double, kind string, target int"
    good = spark.createDataFrame([(20.0 + i % 7, "ab"[i % 2], i % 2) for i in range(40)], schema)
    plan, cleaned = fit_clean(good, "conservative_median", target="target")
    write = gated_writer(plan, str(tmp_path / "out"), str(tmp_path / "gate"))
    plan.steps = [s for s in plan.steps if s.name != "drop_duplicates_final" and s.name != "drop_duplicates"]
    single = good.dropDuplicates()
    for _ in range(2):
        write(single, 0)          # a replay writes the same folder again
    write(good, 1)                # duplicates stay, so the gate rejects it
    assert spark.read.parquet(str(tmp_path / "out")).count() == single.count()
    assert spark.read.parquet(str(tmp_path / "out-rejected")).where("batch_id = 1").count() == 40
    gate = spark.read.parquet(str(tmp_path / "gate"))
    assert gate.where("NOT passed").select("batch_id", "check").collect() == [(1, "duplicates")]
