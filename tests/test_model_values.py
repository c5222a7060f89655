"""Predictions, baseline and sweep by value, and histories that a retry leaves as they are."""

import duckdb
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tablewright import registry as R
from tablewright.operators import model as MD
from tablewright.operators import runlog as RL
from tablewright.operators import trees as TR
from tablewright.sources.features import doc_features


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def f1_and_accuracy(pairs):
    tp = sum(y == 1 and p == 1 for y, p in pairs)
    wrong = sum(y != p for y, p in pairs)
    return (2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0), 1 - wrong / len(pairs)


def test_predictions_equal_the_model_and_sql(spark):
    model, _, test, features = R._trained(spark, SF001)
    trees = TR.boosted_trees(model)
    assert len(trees) == 20 and set().union(*[TR.features_of(t) for _, t in trees]) <= set(features)
    ml = model.transform(test.withColumn("__label", F.lit(0.0))).select("doc_id", F.col("prediction").cast("int"), F.col("rawPrediction").cast("string"))
    want = {r[0]: r[1] for r in ml.collect()}
    got = R.QUERIES["predict_gbt"](spark, SF001)
    assert {r.doc_id: r.prediction for r in got.collect()} == want and got.columns == ["doc_id", "quality", "prediction"]
    c = duckdb.connect()
    c.register("t", test.select("doc_id", *features).toPandas())
    assert dict(c.execute(f"SELECT doc_id, CAST({TR.margin_sql(trees)} > 0 AS INTEGER) FROM t").fetchall()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan
    odd = test.limit(1).withColumns({f: F.lit(None).cast("double") for f in features})
    assert MD.predict(model, odd).first()["prediction"] is None


def test_baseline_metrics_are_the_scores_of_its_model(spark):
    df = doc_features(spark, SF001)
    metrics, split = MD.baseline_metrics(df, "quality", key="doc_id")
    m = metrics.first()
    features = [c for c in split.columns if c not in ("quality", "doc_id", "split")]
    model = MD.fit_boosted(split.where("split = 'train'"), "quality", features)
    c = duckdb.connect()
    c.register("t", split.where("split = 'test'").toPandas())
    ml = c.execute(f"SELECT quality, CAST({TR.margin_sql(model.trees)} > 0 AS INTEGER) FROM t").fetchall()
    f1, accuracy = f1_and_accuracy(ml)
    assert m.baseline_f1_score == pytest.approx(f1, abs=6e-5) and m.baseline_accuracy == pytest.approx(accuracy, abs=6e-5)
    n = df.count()
    assert (m.n_train_rows, m.n_test_rows) == (n - -(-n // 5), -(-n // 5)) and m.n_test_rows == len(ml)
    assert m.n_features_used == len([c for c, t in df.dtypes if t != "string" and c not in ("quality", "doc_id")])


def test_sweep_rows_agree_with_the_baseline(spark):
    got = R.QUERIES["strategy_sweep"](spark, SF001).collect()
    assert {r.strategy_name for r in got} == {"conservative_median", "mean_wide_tolerance", "tight_grouping_high_temp"}
    n = doc_features(spark, SF001).count()
    for r in got:
        assert r.succeeded and r.failure_reason is None
        assert 0 <= r.f1_score <= 1 and 0 <= r.accuracy <= 1 and r.n_test_rows <= -(-n // 5) and r.n_train_rows + r.n_test_rows <= n
        # accuracy is a share of the test rows, F1 one of small whole numbers
        assert abs(r.accuracy * r.n_test_rows - round(r.accuracy * r.n_test_rows)) < 1e-4 * r.n_test_rows


def test_a_retried_append_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    one = spark.createDataFrame([("a", "PASS", 1)], "test_id string, status string, attempts int")
    two = spark.createDataFrame([("b", "FAIL", 2)], one.schema)
    assert RL.read_history(spark, path, one.schema).count() == 0
    RL.append_history(one, path, "run-1")
    RL.append_history(two, path, "run-2")
    before = rows(RL.read_history(spark, path, one.schema))
    RL.append_history(one, path, "run-1")
    one.write.json(f"{path}/runs/run-3-000000000000")  # a try that died before its marker
    assert rows(RL.read_history(spark, path, one.schema)) == before == [("a", "PASS", 1, "run-1"), ("b", "FAIL", 2, "run-2")]
    RL.record_failures(spark, str(tmp_path / "f"), [RL.failure(test_name="x")], run_id="r")
    RL.record_failures(spark, str(tmp_path / "f"), [RL.failure(test_name="x")], run_id="r")
    assert RL.read_history(spark, str(tmp_path / "f"), RL.FAILURE_SCHEMA).count() == 1
    with pytest.raises(ValueError, match="run_id"):
        RL.append_history(one, path, "../x")
