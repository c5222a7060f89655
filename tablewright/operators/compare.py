"""Strategy comparison and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("strategy_name", T.StringType()),
    T.StructField("succeeded", T.BooleanType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("beat_baseline", T.BooleanType()),
    T.StructField("n_train_rows", T.LongType()),
    T.StructField("n_test_rows", T.LongType()),
    T.StructField("n_features", T.IntegerType()),
    T.StructField("agent_attempts_used", T.IntegerType()),
    T.StructField("failure_reason", T.StringType()),
])


def _r4(e):
    return F.floor(e * F.lit(10000.0) + F.lit(0.5)).cast("double") / F.lit(10000.0)


def compare_strategies(results: DataFrame, baseline_f1) -> DataFrame:
    """attempted, succeeded, best by F1 (first in run order wins ties),
    improvement over baseline rounded to 4 (NULL when nothing succeeded)."""
    ok = F.col("succeeded") & F.col("f1_score").isNotNull()
    base = F.lit(baseline_f1).cast("double") if not hasattr(baseline_f1, "_jc") else baseline_f1
    agg = results.agg(
        F.count(F.lit(1)).alias("strategies_attempted"),
        F.count(F.when(ok, F.lit(1))).alias("strategies_succeeded"),
        F.max_by(F.when(ok, F.col("strategy_name")),
                 F.when(ok, F.struct(F.col("f1_score"), -F.col("position")))).alias("best_strategy"),
        F.max(F.when(ok, F.col("f1_score"))).alias("best_f1"))
    return agg.select(base.alias("baseline_f1"), "strategies_attempted", "strategies_succeeded",
                      "best_strategy", "best_f1",
                      F.when(F.col("best_f1").isNotNull(), _r4(F.col("best_f1") - base))
                      .alias("improvement_over_baseline"))


def strategy_status(results: DataFrame, baseline_f1) -> DataFrame:
    """PASS (delta >= 0), RAN (below baseline) or FAIL; delta to 4
    places; failure reason defaults to 'Unknown failure'."""
    base = F.lit(baseline_f1).cast("double") if not hasattr(baseline_f1, "_jc") else baseline_f1
    ok = F.col("succeeded") & F.col("f1_score").isNotNull()
    delta = _r4(F.col("f1_score") - base)
    return results.select(
        "position", "strategy_name",
        F.when(~ok, F.lit("FAIL")).when(delta >= 0, F.lit("PASS"))
         .otherwise(F.lit("RAN (below baseline)")).alias("status"),
        F.when(ok, delta).alias("delta"),
        F.when(ok, F.col("f1_score") >= base).alias("beat_baseline"),
        F.when(~F.col("succeeded"), F.coalesce(F.col("failure_reason"), F.lit("Unknown failure")))
         .alias("failure_reason"))
