"""Run, attempt and failure tables.

All are append-only tables in the shared folder; reports are aggregates.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Failure categories and remediation suggestions that apply here.
FAILURE_CATEGORIES = ("agent_exhaustion", "ambiguous_data", "profile_incomplete", "unknown")
REMEDIATIONS = ("lower_parse_threshold", "add_preprocessing_rule", "inspect_data",
                "escalate_to_ml_engineer", "document_as_known_limitation")

FAILURE_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("test_name", T.StringType()),
    T.StructField("dataset_name", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("attempts_used", T.IntegerType()),
    T.StructField("max_attempts", T.IntegerType()),
    T.StructField("failure_category", T.StringType()),
    T.StructField("final_error_type", T.StringType()),
    T.StructField("final_error_message", T.StringType()),
    T.StructField("last_traceback", T.StringType()),
    T.StructField("remediation_suggestions", T.ArrayType(T.StringType())),
    T.StructField("human_notes", T.StringType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("test_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("error_category", T.StringType()),
    T.StructField("notes", T.StringType()),
])


def failure(**fields) -> Row:
    """G1: a record of the failures table from ``fields`` named as in its schema.
    What is left out is null, the time now, the category ``unknown``."""
    record = dict.fromkeys(FAILURE_SCHEMA.fieldNames())
    if stray := fields.keys() - record.keys():
        raise ValueError(f"no such field: {sorted(stray)}")
    record.update({"timestamp": datetime.now(timezone.utc).isoformat(), "failure_category": "unknown", **fields})
    for name, allowed in (("failure_category", FAILURE_CATEGORIES), ("remediation_suggestions", REMEDIATIONS)):
        given = record[name] or ()
        if stray := {given} - set(allowed) if isinstance(given, str) else set(given) - set(allowed):
            raise ValueError(f"{name} takes {allowed}, not {sorted(stray)}")
    return Row(**record)


def record_failures(spark: SparkSession, path: str, rows, run_id: str | None = None) -> DataFrame:
    """G1: append failure rows to the JSON failures table at ``path``; with a ``run_id`` a
    repeated append counts once, as in ``append_history``."""
    df = spark.createDataFrame(list(rows), FAILURE_SCHEMA)
    append_history(df, path, run_id)
    return df


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def append_history(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append run rows (JSON lines) -- never rewrites earlier runs.

    With a ``run_id`` the append can be repeated: each try writes a folder of its own, and
    what counts is the one that the run's marker names.  The marker is written last and
    replaces an earlier one, so a try that dies leaves nothing, and a second try of the
    same run changes nothing but which copy is read (``read_history``)."""
    if run_id is None:
        df.write.mode("append").json(path)
        return
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"run_id {run_id!r} must be letters, digits, '_', '.' and '-'")
    folder = f"{run_id}-{uuid.uuid4().hex[:12]}"
    df.write.json(f"{path.rstrip('/')}/runs/{folder}")
    marker, files = _hadoop(df.sparkSession, f"{path.rstrip('/')}/commits/{run_id}")
    out = files.create(marker, True)
    out.writeBytes(folder)
    out.close()


def read_history(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of committed runs, with ``run_id``; a marker is one small file a run."""
    base, files = _hadoop(spark, f"{path.rstrip('/')}/commits")
    if not files.exists(base):
        return spark.createDataFrame([], schema).withColumn("run_id", F.lit(None).cast("string"))
    marks = spark.read.text(f"{path.rstrip('/')}/commits").select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("run_id")).collect()
    rows = spark.read.schema(schema).json([f"{path.rstrip('/')}/runs/{m.value}" for m in marks])
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return rows.withColumn("run_id", F.regexp_replace(folder, "-[0-9a-f]{12}$", ""))


def run_report(runs: DataFrame, status_col: str = "status") -> DataFrame:
    """Total, passed, failed and pass_rate (4 places; 0 when empty)."""
    passed = F.coalesce(F.sum((F.col(status_col) == "PASS").cast("long")), F.lit(0))
    total = F.count(F.lit(1))
    return runs.agg(total.alias("total_tests"), passed.alias("passed"),
                    (total - passed).alias("failed"),
                    F.when(total > 0, F.floor(passed / total * F.lit(10000.0) + F.lit(0.5)) / F.lit(10000.0))
                    .otherwise(F.lit(0.0)).cast("double").alias("pass_rate"))


def failures_by_category(failures: DataFrame, col: str = "failure_category") -> DataFrame:
    """Count per category, most frequent first (ties by category)."""
    return (failures.groupBy(F.col(col).alias("failure_category"))
            .agg(F.count(F.lit(1)).alias("n_failures"))
            .orderBy(F.desc("n_failures"), F.asc("failure_category")))


def last_attempts(attempts: DataFrame, run_col: str, attempt_col: str) -> DataFrame:
    """The last attempt of every run, as a ``max_by`` aggregate (no window
    over a possibly hot run)."""
    rest = [c for c in attempts.columns if c not in (run_col,)]
    agg = attempts.groupBy(run_col).agg(
        F.max_by(F.struct(*rest), F.col(attempt_col)).alias("__last"),
        F.count(F.lit(1)).alias("n_attempts"))
    return agg.select(run_col, *[F.col(f"__last.{c}").alias(c) for c in rest], "n_attempts")


def attempts_in_order(attempts: DataFrame, run_col: str, attempt_col: str) -> DataFrame:
    """Every attempt of a run with its position (sorted within the run)."""
    w = Window.partitionBy(run_col).orderBy(attempt_col)
    return attempts.withColumn("attempt_no", F.row_number().over(w))
