"""Issue table (B13) and profile size (B14): the profile's findings as rows.

Re-aims the reference's prompt text as data: one row per (issue, column) with
a count; the target column is never reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fuzzy import FUZZY_THRESHOLD, clusters
from .profile import profile

ISSUE_SCHEMA = T.StructType([
    T.StructField("issue", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("n", T.LongType()),
])


def profile_issues(df: DataFrame, target: str | None = None, threshold: float = FUZZY_THRESHOLD,
                   **kw) -> DataFrame:
    prof = profile(df, target=target, **kw)
    try:
        rows = []
        if prof.n_duplicate_rows:
            rows.append(("duplicates", "*", prof.n_duplicate_rows))
        for d in prof.date_conflicts:
            rows.append(("date_order", f"{d['col_a']},{d['col_b']}", min(d["a_after_b"], d["b_after_a"])))
        for c in prof.columns:
            if c == target:
                continue
            s = prof.stats[c]
            if s["null_count"] > 0:
                rows.append(("missing", c, s["null_count"]))
            if s.get("outliers"):
                rows.append(("outliers", c, s["outliers"]))
        fuzzy_cols = [c for c in prof.text_columns if c != target]
        if fuzzy_cols:
            vf = prof.value_freq.filter(F.col("column").isin(fuzzy_cols))
            counts = (clusters(vf, threshold)
                      .groupBy("column").agg(F.countDistinct("seed").alias("k")).collect())
            rows += [("fuzzy_groups", r["column"], r["k"]) for r in counts if r["k"] > 0]
    finally:
        prof.unpersist()
    return df.sparkSession.createDataFrame(rows, ISSUE_SCHEMA)


def profile_size(issues: DataFrame, n_columns: int, wide_limit: int = 15) -> DataFrame:
    """Characters of the rendered issue lines ("issue column n" + newline),
    a rough token estimate (chars // 4) and a wide-table flag."""
    line = F.concat_ws(" ", F.col("issue"), F.col("column"), F.col("n").cast("string"))
    agg = issues.agg(F.coalesce(F.sum(F.length(line) + 1), F.lit(0)).cast("long").alias("n_chars"),
                     F.count(F.lit(1)).alias("n_issues"))
    return agg.select("n_chars", (F.col("n_chars") / 4).cast("long").alias("n_tokens_est"), "n_issues",
                      F.lit(n_columns).alias("n_columns"), F.lit(n_columns > wide_limit).alias("wide_table"))
