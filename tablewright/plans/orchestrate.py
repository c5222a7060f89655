"""End-to-end flows: the strategy comparison run and the real-data probe.

Both are compositions of the operators: every step is Spark jobs over the
input; only one-row results (metrics, records) cross to the driver.
"""

from __future__ import annotations

import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import compare as CP
from ..operators import gate as G
from ..operators import runlog as RL
from ..operators.issues import profile_issues, profile_size
from ..operators.model import baseline_metrics
from ..sources import files as FL
from .cleaning import clean
from .strategies import STRATEGY_LIBRARY
from .sweep import category_of, strategy_sweep


def run_comparison(df: DataFrame, target: str, out_dir: str, key: str | None = None,
                   strategies=STRATEGY_LIBRARY, mode: str = "fit_on_train") -> dict:
    """Baseline metrics (written, then read back as the bar to beat) -> sweep
    of every strategy -> comparison + per-strategy status -> run history
    appended -> failures recorded -> run report.  Tables land under
    ``out_dir`` (a shared folder); returns the small result frames."""
    spark = df.sparkSession
    metrics, _ = baseline_metrics(df, target, key=key)
    FL.write_metrics(metrics, f"{out_dir}/metrics")
    base = FL.read_baseline(spark, f"{out_dir}/metrics")
    results = strategy_sweep(df, target, key=key, strategies=strategies, baseline_f1=base, mode=mode)
    results = results.withColumn("beat_baseline", F.when(F.col("succeeded"), F.col("f1_score") >= F.lit(base)))
    comparison = CP.compare_strategies(results, base)
    status = CP.strategy_status(results, base)
    FL.write_metrics(comparison, f"{out_dir}/comparison")
    RL.append_history(results, f"{out_dir}/runs")
    failed = [r for r in results.collect() if not r["succeeded"]]   # one row per strategy
    if failed:
        RL.record_failures(spark, f"{out_dir}/failures", [RL.failure(
            test_name=f"strategy: {r['strategy_name']}", dataset_name="comparison", attempts_used=r["agent_attempts_used"],
            failure_category=category_of(r["failure_reason"]), final_error_type=r["failure_reason"].split(":")[0],
            final_error_message=r["failure_reason"]) for r in failed])
    runs = results.select(F.col("strategy_name").alias("test_id"),
                          F.when(F.col("succeeded"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"))
    return {"metrics": metrics, "results": results, "comparison": comparison, "status": status,
            "report": RL.run_report(runs)}


PROBE_SCHEMA = "stage string, status string, measure string, value string"


def probe(spark: SparkSession, path: str, target: str, schema: T.StructType | None = None,
          strategy: str = "conservative_median", header: bool = True, wide_limit: int = 15,
          warn_below: float = 90.0) -> DataFrame:
    """How far a CSV file gets: (stage, status, measure, value) rows of the stages
    read, profile and clean.

    Measures of a finished stage have status ``ok`` (``bad`` when a check fails).
    A stage that breaks gives one ``failed`` row, whose measure says why and whose
    value is the whole traceback, and ends the probe.
    """
    rows: list[tuple] = []
    tables: dict[str, DataFrame] = {}

    def read():
        fields = schema or FL.read_table(spark, path, header=header).schema
        tables["good"], bad, record = FL.read_with_quarantine(spark, path, fields, target=target, header=header)
        if "stage_failed" in record:
            return [("failed", record["stage_failed"], record.get("error"))]
        return [("ok", "rows", tables["good"].count()), ("ok", "quarantined", bad.count())]

    def describe():
        size = profile_size(profile_issues(tables["good"], target=target), len(tables["good"].columns), wide_limit)
        return [("ok", measure, value) for measure, value in size.first().asDict().items()]

    def tidy():
        tables["clean"] = clean(tables["good"], strategy, target=target).df
        checks = G.run_gate(tables["good"], tables["clean"], target).collect()
        kept = next(int(c["observed"]) for c in checks if c["check"] == "not_empty")
        raw = next(int(value) for stage, _, measure, value in rows if (stage, measure) == ("read", "rows"))
        share = 100.0 * kept / raw if raw else 100.0
        found = [("ok" if c["passed"] else "bad", ":".join(filter(None, (c["check"], c["column"]))), c["observed"]) for c in checks]
        return [*found, ("ok" if share >= warn_below else "bad", "retention_pct", round(share, 1))]

    for name, stage in (("read", read), ("profile", describe), ("clean", tidy)):
        try:
            got = stage()
        except Exception as exc:  # noqa: BLE001 -- the probe reports what broke
            got = [("failed", type(exc).__name__, traceback.format_exc())]
        rows += [(name, status, measure, None if value is None else str(value)) for status, measure, value in got]
        if any(status == "failed" for status, *_ in got):
            break
    return spark.createDataFrame(rows, PROBE_SCHEMA)
