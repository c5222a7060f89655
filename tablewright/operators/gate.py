"""Validation gate.

Checks never trust a transform's own claim of success and never throw
mid-job: each returns rows ``(check, column, observed, passed)``.  The whole
gate is two passes over the result (nulls and count; fingerprints of repeated rows),
one count of the original and one anti-join of distinct labels.
"""

from __future__ import annotations

import traceback

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import is_null_or_nan, is_numeric
from ..session import compiled_methods, drop_staged, staged_if_derived
from . import duplicates as D

GATE_SCHEMA = T.StructType([
    T.StructField("check", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("observed", T.StringType()),
    T.StructField("passed", T.BooleanType()),
])


def gate_numeric(df: DataFrame, target: str | None) -> list:
    """V1: non-numeric, non-target columns (schema only; booleans count as numeric)."""
    return [f.name for f in df.schema.fields if f.name != target and not is_numeric(f.dataType)]


def gate_nulls(df: DataFrame, target: str | None = None) -> DataFrame:
    """V2: remaining NULL/NaN count per non-target column, only where > 0."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in df.columns if c != target]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, null_count long")
    agg = df.agg(*[F.sum(is_null_or_nan(c, dts[c]).cast("long")).alias(c) for c in cols])
    long = agg.unpivot([], cols, "column", "null_count")
    return long.select("column", F.coalesce("null_count", F.lit(0)).alias("null_count")) \
        .filter(F.col("null_count") > 0)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of fully equal rows (NULLs
    equal), with row and distinct-row counts.  A derived input is staged, as both
    passes over the fingerprints read it."""
    return D.duplicate_rows(staged_if_derived(df, "duplicates"))


def gate_target_values(original: DataFrame, result: DataFrame, target: str) -> DataFrame:
    """Label values in the result that the original never had (NULLs
    ignored)."""
    r = result.select(F.col(target).alias("value")).filter(F.col("value").isNotNull()).distinct()
    o = original.select(F.col(target).alias("value")).filter(F.col("value").isNotNull()).distinct()
    return r.join(o, "value", "left_anti")


def row_retention(original: DataFrame, result: DataFrame, warn_below: float = 90.0) -> DataFrame:
    """V7: round(100 * clean / raw, 1) and a warning flag below ``warn_below``;
    both counts in ONE aggregate over the tagged union of the two inputs."""
    tagged = (original.select(F.lit(1).alias("__o"), F.lit(0).alias("__r"))
              .unionByName(result.select(F.lit(0).alias("__o"), F.lit(1).alias("__r"))))
    counts = tagged.agg(F.coalesce(F.sum("__o"), F.lit(0)).cast("long").alias("raw_rows"),
                        F.coalesce(F.sum("__r"), F.lit(0)).cast("long").alias("clean_rows"))
    pct = F.when(F.col("raw_rows") > 0,
                 F.floor(F.lit(1000.0) * F.col("clean_rows") / F.col("raw_rows") + F.lit(0.5)) / F.lit(10.0)
                 ).otherwise(F.lit(0.0))
    return counts.select("raw_rows", "clean_rows", pct.cast("double").alias("retention_pct"),
                         (pct < F.lit(warn_below)).alias("below_threshold"))


def run_gate(original: DataFrame, result: DataFrame, target: str | None) -> DataFrame:
    """V8: every check as rows; ``passed`` false on any violation.

    Independent jobs, submitted together: the original's row count; how many
    labels only the result has (an anti-join, for any number of labels); the result's
    row count and nulls per column; and its rows that repeat, told by fingerprints, so
    that no whole row is shuffled but those that may be copies.
    """
    stored = staged_if_derived(result, "gated")   # several jobs read it, its plan runs once
    try:
        return _run_gate(original, stored, target)
    finally:
        if stored is not result:
            drop_staged(stored)


def _run_gate(original, result, target):
    spark = result.sparkSession
    rows = []
    for c in gate_numeric(result, target):
        rows.append(("numeric", c, "non-numeric", False))
    present = target is None or target in result.columns
    check_labels = target is not None and present and target in original.columns
    dts = {f.name: f.dataType for f in result.schema.fields}
    cols = list(result.columns)

    def original_job():
        return original.agg(F.count(F.lit(1)).alias("n")).first()["n"]

    def result_job():
        return result.agg(F.count(F.lit(1)).alias("__n"), *[
            F.count_if(is_null_or_nan(c, dts[c])).alias(f"n{i}") for i, c in enumerate(cols) if c != target]).first()

    def copies_job():
        extra = D.repeated_groups(result, cols).agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("__d"))
        return extra.first()["__d"] if cols else 0

    def labels_job():
        if not check_labels:
            return None
        was, now = original.schema[target].dataType, dts[target]
        if was == now or is_numeric(was) and is_numeric(now):
            return gate_target_values(original, result, target).count()
        return result.select(target).filter(F.col(target).isNotNull()).distinct().count()   # no label keeps its kind

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=4) as pool:
        futs = [pool.submit(f) for f in (original_job, result_job, copies_job, labels_job)]
        n_orig, g, dup, new_labels = [f.result() for f in futs]
    n_result = g["__n"]
    for i, c in enumerate(cols):
        if c != target and g[f"n{i}"] > 0:
            rows.append(("nulls", c, str(g[f"n{i}"]), False))
    rows.append(("duplicates", None, str(dup), dup == 0))
    rows.append(("not_empty", None, str(n_result), not (n_orig > 0 and n_result == 0)))
    rows.append(("target_present", target, str(present), present))
    if check_labels and n_result > 0:
        rows.append(("target_values", target, str(new_labels), new_labels == 0))
    return spark.createDataFrame(rows, GATE_SCHEMA)


def gate_passed(report: DataFrame) -> bool:
    return report.filter(~F.col("passed")).limit(1).count() == 0


def apply_step(df: DataFrame, fn, target: str | None):
    """Run any DataFrame -> DataFrame function under the gate.
    Returns (result or None, gate rows, error text or None); never raises."""
    try:
        out = fn(df)
        if not isinstance(out, DataFrame):
            raise TypeError("step did not return a DataFrame")
        report = run_gate(df, out, target)
        return out, report, None
    except Exception:  # noqa: BLE001 -- recorded, not raised
        return None, None, traceback.format_exc()


ATTEMPT_SCHEMA = T.StructType([
    T.StructField("attempt", T.IntegerType()),
    T.StructField("candidate", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("violations", T.StringType()),
])


def first_passing(df: DataFrame, candidates, target: str | None, max_attempts: int = 5):
    """V9: try candidate transforms in order until one passes the gate; every
    attempt is logged; never raises.  Returns (result or None, attempts df)."""
    spark = df.sparkSession
    log = []
    try:
        with compiled_methods(spark):
            df = staged_if_derived(df, "attempted")   # every candidate and gate reads it
    except Exception:  # noqa: BLE001 -- each attempt will record what breaks
        pass
    for i, (name, fn) in enumerate(candidates[:max_attempts], start=1):
        out, report, err = apply_step(df, fn, target)
        if err is not None:
            log.append((i, name, False, err.strip().splitlines()[-1]))
            continue
        bad = report.filter(~F.col("passed")).collect()
        if not bad:
            log.append((i, name, True, ""))
            return out, spark.createDataFrame(log, ATTEMPT_SCHEMA)
        log.append((i, name, False, "; ".join(f"{r['check']}:{r['column']}={r['observed']}" for r in bad)))
    return None, spark.createDataFrame(log, ATTEMPT_SCHEMA)
