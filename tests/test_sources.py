"""CSV sources and sinks (A1-A5)."""

import pytest
from pyspark.sql import types as T

from tablewright.sources import files as FL


def test_headerless_csv_with_leading_spaces(spark, tmp_path):
    p = tmp_path / "adult.data"
    p.write_text("39, State-gov, 77516, <=50K\n50, Self-emp-not-inc, 83311, >50K.\n38, ?, 215646, <=50K\n")
    schema = T.StructType([T.StructField("age", T.IntegerType()), T.StructField("workclass", T.StringType()),
                           T.StructField("fnlwgt", T.IntegerType()), T.StructField("income", T.StringType())])
    df = FL.read_table(spark, str(p), schema=schema, header=False, trim_leading=True)
    rows = df.orderBy("age").collect()
    assert [r["workclass"] for r in rows] == ["?", "State-gov", "Self-emp-not-inc"]  # '?' stays a category
    from tablewright.operators.clean import label_from_text
    lab = {r["age"]: r["target"] for r in label_from_text(df, "income", ">50K").collect()}
    assert lab == {39: 0, 50: 1, 38: 0}


def test_trailing_blanks_kept_and_quarantine(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("kind,x,target\nContract ,1.5,0\nfull-time,oops,1\nfull time ,2.5,1\n")
    schema = T.StructType([T.StructField("kind", T.StringType()), T.StructField("x", T.DoubleType()),
                           T.StructField("target", T.IntegerType())])
    good, bad, rec = FL.read_with_quarantine(spark, str(p), schema, target="target")
    assert sorted(r["kind"] for r in good.collect()) == ["Contract ", "full time "]
    assert bad.count() == 1 and good.count() == 2 and "stage_failed" not in rec
    _, _, rec2 = FL.read_with_quarantine(spark, str(p), schema, target="label")
    assert rec2["stage_failed"] == "target_column_missing"


def test_metrics_roundtrip_and_missing(spark, tmp_path):
    df = spark.createDataFrame([(0.5784, 0.5784)], "baseline_f1_score double, baseline_accuracy double")
    FL.write_metrics(df, str(tmp_path / "metrics"))
    assert FL.read_baseline(spark, str(tmp_path / "metrics")) == 0.5784
    with pytest.raises(FileNotFoundError):
        FL.read_baseline(spark, str(tmp_path / "nothing"))


def test_csv_as_other_programs_write_it(spark, tmp_path):
    from pyspark.sql import types as T

    from tablewright.sources.files import read_table, read_with_quarantine, write_table
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    f = tmp_path / "x.csv"
    f.write_text('b,a\n"say ""hi"", bob",1\n"two\nlines",2\n')
    want = [(1, 'say "hi", bob'), (2, "two\nlines")]
    assert sorted(map(tuple, read_table(spark, str(f), schema).collect())) == want
    good, bad, record = read_with_quarantine(spark, str(f), schema)
    assert sorted(map(tuple, good.collect())) == want and bad.count() == 0 and "stage_failed" not in record
    write_table(spark.createDataFrame(want, schema), str(tmp_path / "out"), "csv")
    assert sorted(map(tuple, read_table(spark, str(tmp_path / "out"), schema).collect())) == want


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from tablewright.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))
