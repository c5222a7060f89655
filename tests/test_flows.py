"""End-to-end flows: comparison run and the real-data probe."""

from tablewright.plans.orchestrate import probe, run_comparison
from pyspark.sql import functions as F

from tablewright.plans.strategies import get_strategy
from tablewright.plans.sweep import strategy_sweep


def test_run_comparison(spark, tmp_path):
    rows = [(float(i % 41), float((i * 13) % 97) if i % 9 else None, ["x", "y", "Y "][i % 3],
             (i % 41) > 20 and 1 or 0, i) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, k string, target int, id int")
    out = run_comparison(df, "target", str(tmp_path), key="id",
                         strategies=[get_strategy("conservative_median"), get_strategy("mean_wide_tolerance")])
    cmp = out["comparison"].first()
    assert cmp["strategies_attempted"] == 2 and cmp["strategies_succeeded"] == 2
    assert out["report"].first()["total_tests"] == 2
    assert spark.read.json(str(tmp_path / "runs")).count() == 2
    assert spark.read.json(str(tmp_path / "metrics")).first()["n_test_rows"] == 60


def test_stress_probe(spark, tmp_path):
    p = tmp_path / "adult.csv"
    lines = ["age,workclass,hours,signup,target"]
    for i in range(200):
        wc = ["Private", "private ", "Self-emp", "?", "NA"][i % 5]
        lines.append(f"{20 + i % 50},{wc},{30 + i % 20 if i % 13 else ''},2023-01-{1 + i % 28:02d},{i % 2}")
    lines.append("oops,Private,40,2023-01-01,1")
    p.write_text("\n".join(lines) + "\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("age", T.IntegerType()), T.StructField("workclass", T.StringType()),
                           T.StructField("hours", T.DoubleType()), T.StructField("signup", T.StringType()),
                           T.StructField("target", T.IntegerType())])
    rows = {(r["stage"], r["measure"]): r for r in probe(spark, str(p), "target", schema=schema).collect()}
    assert all(r["status"] == "ok" for r in rows.values()), rows
    assert rows["read", "rows"]["value"] == "200" and rows["read", "quarantined"]["value"] == "1"
    assert rows["clean", "duplicates"]["value"] == "0" and ("clean", "retention_pct") in rows
    broken = probe(spark, str(p), "label", schema=schema).collect()
    assert [(r["stage"], r["status"], r["measure"]) for r in broken] == [("read", "failed", "target_column_missing")]


def _sweep_input(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, k string, target int")


def test_sweep_turns_failures_into_rows(spark):
    three = _sweep_input(spark, [(i, float(i), "xyz"[i % 3], i % 3) for i in range(60)])
    one = [get_strategy("conservative_median")]
    row = strategy_sweep(three, "target", key="id", strategies=one).first()
    assert not row["succeeded"] and row["failure_reason"].startswith("Training failed: ")
    assert "Traceback" in row["failure_reason"] and row["agent_attempts_used"] == 2


def test_sweep_gates_both_sides(spark, monkeypatch):
    from tablewright.plans import sweep
    df = _sweep_input(spark, [(i, float(i), "xyz"[i % 3], i % 2) for i in range(60)])
    real = sweep.fit_clean

    class Spoiled:
        def transform(self, part, **_):
            return part.select("id", "target", F.lit(None).cast("double").alias("a"))

    def spoil_train(part, *args, **kw):
        plan, done = real(part, *args, **kw)
        return plan, done.union(done)

    one = [get_strategy("conservative_median")]
    monkeypatch.setattr(sweep, "fit_clean", spoil_train)
    row = sweep.strategy_sweep(df, "target", key="id", strategies=one).first()
    assert row["failure_reason"].startswith("Gate failed: train: duplicates") and row["agent_attempts_used"] == 1
    monkeypatch.setattr(sweep, "fit_clean", lambda *a, **k: (Spoiled(), real(*a, **k)[1]))
    row = sweep.strategy_sweep(df, "target", key="id", strategies=one).first()
    assert row["failure_reason"].startswith("Gate failed: test: nulls:a") and row["agent_attempts_used"] == 2
    assert sweep.category_of(row["failure_reason"]) == "agent_exhaustion"


def test_sweep_refuses_a_leaking_split(spark):
    from tablewright.plans import sweep
    df = _sweep_input(spark, [(i % 4, float(i), "x", i % 2) for i in range(40)])
    row = sweep.strategy_sweep(df, "target", key="id", strategies=[get_strategy("conservative_median")]).first()
    assert "keys on both sides" in row["failure_reason"] and row["agent_attempts_used"] == 0


def test_sweep_keeps_the_aligned_tables(spark, tmp_path):
    df = _sweep_input(spark, [(i, float(i % 17), "xyz"[i % 3], i % 2) for i in range(60)])
    row = strategy_sweep(df, "target", key="id", strategies=[get_strategy("conservative_median")], out_dir=str(tmp_path)).first()
    sides = [spark.read.parquet(str(tmp_path / "conservative_median" / side)) for side in ("train", "test")]
    assert row["succeeded"] and sides[0].columns == sides[1].columns
    assert [s.count() for s in sides] == [row["n_train_rows"], row["n_test_rows"]]
