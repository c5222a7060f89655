"""Profiling (B1-B15) in a constant number of passes over the table.

Pass 1 is one aggregate for every column at once (row count, nulls, min, max,
mean, approximate cardinality, date-parse counts).  Exact quartiles use the
histogram-refinement selector (a few narrow scans), outliers are one more
aggregate, exact distinct counts one grouped aggregate over the unpivoted
numeric columns, and text columns go through ``value_freq`` once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import BY_COLUMN, DEFAULT_DATE_FORMATS, date_orders, decided, order_evidence, parse_timestamp
from ..functions.numeric import (as_double, is_null_or_nan, is_numeric, is_temporal,
                                 is_text, round_half_up)
from ..functions.quantiles import approx_quantiles, exact_quantiles
from ..session import drop_staged, staged_if_derived
from .duplicates import duplicate_rows
from .freq import first_values, value_freq

# Reference defaults.
IQR_MULTIPLIER = 1.5
MAX_SAMPLE_VALUES = 8
DATE_MIN_PARSE_RATE = 0.9

COLUMN_PROFILE_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("is_text", T.BooleanType()),
    T.StructField("is_target", T.BooleanType()),
    T.StructField("is_date", T.BooleanType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_pct", T.DoubleType()),
    T.StructField("n_unique", T.LongType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("mean_value", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
    T.StructField("outlier_count", T.LongType()),
    T.StructField("distinct_approx", T.BooleanType()),
])


def require_target(df: DataFrame, target: str | None) -> None:
    """P5: fail loudly when the label column is absent (schema only, no job)."""
    if target is not None and target not in df.columns:
        raise ValueError(f"target column {target!r} not found in columns: {df.columns}")


@dataclass
class Profile:
    n_rows: int
    columns: list
    dtypes: dict
    target: str | None
    stats: dict                      # column -> dict of statistics
    date_columns: list
    text_columns: list               # non-date text columns
    n_duplicate_rows: int | None
    date_conflicts: list = field(default_factory=list)
    value_freq: DataFrame | None = None
    date_formats: dict = field(default_factory=dict)   # date column -> formats to read it by
    source: DataFrame | None = None                    # what was profiled, if staged for it

    def numeric_columns(self):
        return [c for c in self.columns if self.stats[c]["kind"] == "numeric"]

    def column_table(self, spark) -> DataFrame:
        rows = []
        for i, c in enumerate(self.columns):
            s = self.stats[c]
            rows.append((c, i, self.dtypes[c], s["kind"] == "text", c == self.target,
                         c in self.date_columns, s["null_count"], s["null_pct"], s["n_unique"],
                         s.get("min"), s.get("max"), s.get("mean"), s.get("q1"), s.get("q3"),
                         s.get("lower"), s.get("upper"), s.get("outliers"),
                         s.get("distinct_approx", False)))
        return spark.createDataFrame(rows, COLUMN_PROFILE_SCHEMA)

    def unpersist(self):
        if self.value_freq is not None:
            self.value_freq.unpersist()
        if self.source is not None:
            drop_staged(self.source)


def _kind(dt) -> str:
    if is_text(dt):
        return "text"
    if is_temporal(dt):
        return "temporal"
    if is_numeric(dt):
        return "numeric"
    return "other"


def numeric_long(df: DataFrame, cols) -> DataFrame:
    """Unpivot numeric columns to (column, v DOUBLE) with NaN as NULL."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    proj = df.select(*[as_double(c, dts[c]).alias(c) for c in cols])
    return proj.unpivot([], list(cols), "column", "v")


def ranks(df: DataFrame, cols, probs, mode: str = "exact") -> dict:
    """{column: values at ``probs``} of numeric columns, in one rank search."""
    if not cols:
        return {}
    find = approx_quantiles if mode == "approx" else exact_quantiles
    qs = find(numeric_long(df, cols), "column", "v", list(probs))
    return {c: tuple(qs.get(c, [None] * len(probs))) for c in cols}


def quartiles(df: DataFrame, cols, mode: str = "exact", bounds: dict | None = None) -> dict:
    """{column: (q1, q3)} for numeric columns."""
    if not cols:
        return {}
    long = numeric_long(df, cols)
    if mode == "approx":
        qs = approx_quantiles(long, "column", "v", [0.25, 0.75])
    else:
        qs = exact_quantiles(long, "column", "v", [0.25, 0.75], bounds=bounds)
    return {c: tuple(qs.get(c, [None, None])) for c in cols}


def medians(df: DataFrame, cols, mode: str = "exact") -> dict:
    if not cols:
        return {}
    long = numeric_long(df, cols)
    if mode == "approx":
        qs = approx_quantiles(long, "column", "v", [0.5])
    else:
        qs = exact_quantiles(long, "column", "v", [0.5])
    return {c: qs.get(c, [None])[0] for c in cols}


def iqr_bounds(q1, q3, mult):
    if q1 is None or q3 is None:
        return None, None
    iqr = q3 - q1
    return q1 - mult * iqr, q3 + mult * iqr


def profile(df: DataFrame, target: str | None = None, iqr_mult: float = IQR_MULTIPLIER,
            quantile_mode: str = "exact", distinct_mode: str = "exact",
            date_formats=DEFAULT_DATE_FORMATS,
            date_min_rate: float = DATE_MIN_PARSE_RATE, order_by: str | None = None,
            with_duplicates: bool = True, persist_freq: bool = True,
            with_quantiles: bool = True, with_conflicts: bool = True) -> Profile:
    """Profile every column of ``df``; ``order_by`` (optional) is an explicit
    row-order key used for "first seen" samples.

    ``distinct_mode``: "exact"; "approx" (marked ``distinct_approx``); or "few", which
    shuffles no values and says 0, 1, 2 (two or more, for text) or 3 (three or more)."""
    require_target(df, target)
    source = staged_if_derived(df, "profiled")      # several passes follow
    prof = _profile(source, target, iqr_mult, quantile_mode, distinct_mode, date_formats,
                    date_min_rate, order_by, with_duplicates, persist_freq, with_quantiles, with_conflicts)
    prof.source = source if source is not df else None
    return prof


def _profile(df, target, iqr_mult, quantile_mode, distinct_mode, date_formats,
             date_min_rate, order_by, with_duplicates, persist_freq, with_quantiles, with_conflicts) -> Profile:
    cols = [c for c in df.columns if c != order_by]
    dts = {f.name: f.dataType for f in df.schema.fields}
    kinds = {c: _kind(dts[c]) for c in cols}
    numeric = [c for c in cols if kinds[c] == "numeric"]
    text = [c for c in cols if kinds[c] == "text"]
    temporal = [c for c in cols if kinds[c] == "temporal"]

    # ---- pass 1: one aggregate for everything cheap ----
    exprs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        exprs.append(F.sum(is_null_or_nan(c, dts[c]).cast("long")).alias(f"nul{i}"))
        if kinds[c] == "numeric":
            v = as_double(c, dts[c])
            exprs += [F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
                      F.avg(v).alias(f"avg{i}"), F.count(v).alias(f"cnt{i}")]
        if kinds[c] == "text":
            if distinct_mode == "few":
                exprs += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
            exprs.append(F.count(parse_timestamp(c, date_formats)).alias(f"dat{i}"))
            if date_formats == BY_COLUMN:
                exprs += [F.count_if(e).alias(f"{k}{i}") for k, e in zip(("dayf", "monf"), order_evidence(c), strict=True)]
        if distinct_mode == "approx" and kinds[c] != "other":
            exprs.append(F.approx_count_distinct(c).alias(f"acd{i}"))
    row = df.agg(*exprs).first()
    n = row["__n"]

    stats: dict = {}
    for i, c in enumerate(cols):
        nulls = row[f"nul{i}"] or 0
        s = {"kind": kinds[c], "null_count": int(nulls),
             "null_pct": (round(100.0 * nulls / n, 2) if n else 0.0)}
        if kinds[c] == "numeric":
            s.update(min=row[f"min{i}"], max=row[f"max{i}"], mean=row[f"avg{i}"],
                     count=row[f"cnt{i}"])
        stats[c] = s

    # ---- date columns: parse rate over all rows (reference semantics) ----
    date_cols = []
    for i, c in enumerate(cols):
        if kinds[c] == "temporal":
            date_cols.append(c)
        elif kinds[c] == "text" and n and row[f"dat{i}"] / n >= date_min_rate:
            date_cols.append(c)

    read_by = dict.fromkeys(date_cols, date_formats)
    if date_formats == BY_COLUMN:
        read_by |= {c: decided(row[f"dayf{i}"], row[f"monf{i}"]) for i, c in enumerate(cols) if c in date_cols and kinds[c] == "text"}

    # The remaining passes are independent Spark jobs: submit them together so
    # the scheduler overlaps them (each is a scan + partial aggregate).
    nt = numeric + temporal
    if distinct_mode == "approx":
        for i, c in enumerate(cols):
            if kinds[c] != "other":
                stats[c].update(n_unique=int(row[f"acd{i}"]), distinct_approx=True)

    def distinct_job():
        if not nt or distinct_mode == "approx":
            return {}
        if distinct_mode == "few":
            ends = {c: (stats[c]["min"], stats[c]["max"]) for c in numeric if stats[c]["count"]}
            inner = [F.max((as_double(c, dts[c]) > lo) & (as_double(c, dts[c]) < hi)).alias(c) for c, (lo, hi) in ends.items()]
            got = df.agg(*inner).first() if inner else {}
            return {c: 1 + (lo != hi) + bool(got[c]) for c, (lo, hi) in ends.items()}
        # DOUBLE is exact below 2^53; decimals and wider integral values are counted as text
        wide = [c for c in numeric if isinstance(dts[c], T.DecimalType) or isinstance(dts[c], T.LongType) and
                max(abs(stats[c]["min"] or 0), abs(stats[c]["max"] or 0)) >= 2.0 ** 53]
        narrow = [c for c in nt if c not in wide]
        parts = []
        if narrow:
            parts.append(numeric_long(df, narrow).select("column", (F.col("v") + F.lit(0.0)).cast("string").alias("v")))
        if wide:
            proj = df.select(*[F.col(c).cast("string").alias(c) for c in wide])
            parts.append(proj.unpivot([], wide, "column", "v"))
        long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return {r["column"]: r["d"] for r in long.filter(F.col("v").isNotNull()).groupBy("column")
                .agg(F.countDistinct("v").alias("d")).collect()}

    def freq_job():
        if not text:
            return None, {}
        if distinct_mode == "few":
            ends = [(row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(cols) if kinds[c] == "text"]
            return None, {c: (lo is not None) + (lo != hi) for c, (lo, hi) in zip(text, ends, strict=True)}
        vf = value_freq(df, text, order_by)
        if distinct_mode == "approx":
            return vf, {}
        if persist_freq:
            vf = vf.persist()
        got = {r["column"]: r["d"] for r in vf.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
        return vf, got

    def quartile_job():
        if not (numeric and with_quantiles):
            return {}
        bounds = {c: (stats[c]["count"], stats[c]["min"], stats[c]["max"]) for c in numeric}
        qs = quartiles(df, numeric, quantile_mode, bounds=bounds)
        out, exprs = {}, []
        for c in numeric:
            q1, q3 = qs[c]
            lo, hi = iqr_bounds(q1, q3, iqr_mult)
            out[c] = dict(q1=q1, q3=q3, lower=lo, upper=hi)
            if lo is not None:
                v = as_double(c, dts[c])
                exprs.append(F.sum(((v < F.lit(lo)) | (v > F.lit(hi))).cast("long")).alias(c))
        if exprs:
            orow = df.agg(*exprs).first()
            for c in numeric:
                if out[c]["lower"] is not None:
                    out[c]["outliers"] = int(orow[c] or 0)
        return out

    def duplicate_job():
        if not with_duplicates:
            return None
        return duplicate_rows(df, cols).first()["n_duplicate_rows"] if n and cols else 0

    def conflict_job():
        return date_order_conflicts(df, date_cols, read_by, dts) if with_conflicts else []

    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=5) as pool:
        futs = [pool.submit(f) for f in (distinct_job, freq_job, quartile_job, duplicate_job, conflict_job)]
        distinct, (vf, text_counts), qstats, n_dup, conflicts = [f.result() for f in futs]
    if distinct_mode != "approx":
        for c in nt:
            stats[c]["n_unique"] = int(distinct.get(c, 0))
        for c in text:
            stats[c]["n_unique"] = int(text_counts.get(c, 0))
    for c, d in qstats.items():
        stats[c].update(d)

    return Profile(n_rows=n, columns=cols, dtypes={c: dts[c].simpleString() for c in cols},
                   target=target, stats=stats, date_columns=date_cols,
                   text_columns=[c for c in text if c not in date_cols],
                   n_duplicate_rows=n_dup, value_freq=vf,
                   date_conflicts=conflicts, date_formats=read_by)


def date_order_conflicts(df: DataFrame, date_cols, date_formats=DEFAULT_DATE_FORMATS,
                         dts: dict | None = None) -> list:
    """For each unordered pair of date columns, rows where a > b and rows
    where b > a (both parsed); reported only when both directions occur.
    All pairs in one aggregate, each column parsed once."""
    if len(date_cols) < 2:
        return []
    dts = dts or {f.name: f.dataType for f in df.schema.fields}
    by = date_orders(df, date_cols, date_formats)
    parsed = df.select(*[(parse_timestamp(c, by[c]) if is_text(dts[c])
                          else F.col(c).cast("timestamp")).alias(c) for c in date_cols])
    exprs, pairs = [], list(combinations(date_cols, 2))
    for j, (a, b) in enumerate(pairs):
        exprs += [F.sum((F.col(a) > F.col(b)).cast("long")).alias(f"ab{j}"),
                  F.sum((F.col(b) > F.col(a)).cast("long")).alias(f"ba{j}")]
    row = parsed.agg(*exprs).first()
    out = []
    for j, (a, b) in enumerate(pairs):
        ab, ba = row[f"ab{j}"] or 0, row[f"ba{j}"] or 0
        if ab > 0 and ba > 0:
            out.append({"col_a": a, "col_b": b, "a_after_b": int(ab), "b_after_a": int(ba)})
    return out


def column_profile(df: DataFrame, target: str | None = None, **kw) -> DataFrame:
    """One row per column (target row kept and marked), rounded for reports."""
    prof = profile(df, target=target, **kw)
    try:
        t = prof.column_table(df.sparkSession)
    finally:
        prof.unpersist()
    return t.select(
        "column", "position", "dtype", "is_text", "is_target", "is_date", "null_count",
        round_half_up(F.lit(100.0) * F.col("null_count") /
                      F.greatest(F.lit(prof.n_rows), F.lit(1)).cast("double"), 2).alias("null_pct"),
        "n_unique",
        *[round_half_up(c, 2).alias(c) for c in ("min_value", "max_value", "mean_value")],
        *[round_half_up(c, 4).alias(c) for c in ("q1", "q3", "lower_bound", "upper_bound")],
        "outlier_count", *(["distinct_approx"] if kw.get("distinct_mode") == "approx" else []))


def sample_values(prof: Profile, k: int = MAX_SAMPLE_VALUES) -> DataFrame:
    """First k distinct values of each text column."""
    return first_values(prof.value_freq, k)


# ------------------------------------------------------------------------
# Lazy single-purpose reports (each one plan, no driver round trip unless a
# fitted statistic is needed).

def dataset_shape(df: DataFrame) -> DataFrame:
    """B1: n_rows, n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def null_profile(df: DataFrame) -> DataFrame:
    """B2: null count and percentage (2 places; 0.0 on an empty table) per
    column, from one aggregate unpivoted with ``stack``."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    cols = list(df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(is_null_or_nan(c, dts[c]).cast("long")).alias(c) for c in cols])
    long = agg.unpivot(["__n"], cols, "column", "null_count")
    return long.select(
        "column", F.coalesce("null_count", F.lit(0)).cast("long").alias("null_count"),
        F.when(F.col("__n") > 0, round_half_up(F.lit(100.0) * F.col("null_count") / F.col("__n").cast("double"), 2))
         .otherwise(F.lit(0.0)).alias("null_pct"))


def distinct_profile(df: DataFrame) -> DataFrame:
    """Exact distinct count per column of the values that are neither null nor
    NaN (0.0 and -0.0 are one value): every column unpivoted to text, then ONE distinct aggregate keyed by (column, value) -- instead of N
    count-distincts, which plan an Expand xN."""
    cols = list(df.columns)
    dts = {f.name: f.dataType for f in df.schema.fields}

    def text(c):
        if isinstance(dts[c], (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), (as_double(c, dts[c]) + F.lit(0.0)).cast("string"))
        return F.col(c).cast("string")

    proj = df.select(*[text(c).alias(c) for c in cols])
    long = proj.unpivot([], cols, "column", "value").filter(F.col("value").isNotNull())
    got = long.groupBy("column").agg(F.countDistinct("value").alias("n_unique"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(got, "column", "left").select(
        "column", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"))


def numeric_summary(df: DataFrame, cols=None, digits: int = 2) -> DataFrame:
    """Min, max, mean of the non-null values, rounded; NULL when empty."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or df.columns) if is_numeric(dts[c])]
    exprs = []
    for i, c in enumerate(cols):
        v = as_double(c, dts[c])
        exprs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.avg(v).alias(f"m{i}")]
    agg = df.agg(*exprs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("min_value"),
                              F.col(f"b{i}").alias("max_value"), F.col(f"m{i}").alias("mean_value"))
                     for i, c in enumerate(cols)])
    return agg.select(F.explode(rows).alias("s")).select(
        "s.column", *[round_half_up(f"s.{k}", digits).alias(k) for k in ("min_value", "max_value", "mean_value")])


def iqr_outliers(df: DataFrame, cols=None, mult: float = IQR_MULTIPLIER,
                 quantile_mode: str = "exact") -> DataFrame:
    """Exact linear-interpolated Q1/Q3 and the count of values strictly
    outside [Q1 - m*IQR, Q3 + m*IQR]."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (cols or df.columns) if is_numeric(dts[c])]
    qs = quartiles(df, cols, quantile_mode)
    bounds = {c: iqr_bounds(*qs[c], mult) for c in cols}
    exprs = [F.sum(((as_double(c, dts[c]) < F.lit(bounds[c][0])) |
                    (as_double(c, dts[c]) > F.lit(bounds[c][1]))).cast("long")).alias(f"o{i}")
             for i, c in enumerate(cols) if bounds[c][0] is not None]
    row = df.agg(*exprs).first() if exprs else None
    out = []
    for i, c in enumerate(cols):
        q1, q3 = qs[c]
        lo, hi = bounds[c]
        n_out = int(row[f"o{i}"] or 0) if (row is not None and lo is not None) else None
        out.append((c, q1, q3, lo, hi, n_out))
    res = df.sparkSession.createDataFrame(
        out, "column string, q1 double, q3 double, lower_bound double, upper_bound double, outlier_count long")
    return res.select("column", *[round_half_up(k, 4).alias(k) for k in
                                  ("q1", "q3", "lower_bound", "upper_bound")], "outlier_count")


def detect_date_columns(df: DataFrame, formats=DEFAULT_DATE_FORMATS,
                        min_rate: float = DATE_MIN_PARSE_RATE) -> DataFrame:
    """Parse rate over ALL rows (nulls count against) of every text
    column, and whether it reaches ``min_rate``; one aggregate."""
    cols = [f.name for f in df.schema.fields if is_text(f.dataType)]
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.count(parse_timestamp(c, formats)).alias(c) for c in cols])
    long = agg.unpivot(["__n"], cols, "column", "parsed")
    rate = F.when(F.col("__n") > 0, F.col("parsed") / F.col("__n").cast("double"))
    return long.select("column", round_half_up(rate, 4).alias("parse_rate"),
                       F.coalesce(rate >= F.lit(min_rate), F.lit(False)).alias("is_date"))


def date_order_conflicts_df(df: DataFrame, date_cols, formats=DEFAULT_DATE_FORMATS) -> DataFrame:
    """B10 as one lazy aggregate: pairs where both directions occur."""
    dts = {f.name: f.dataType for f in df.schema.fields}
    by = date_orders(df, date_cols, formats)
    parsed = df.select(*[(parse_timestamp(c, by[c]) if is_text(dts[c])
                          else F.col(c).cast("timestamp")).alias(c) for c in date_cols])
    pairs = list(combinations(date_cols, 2))
    exprs = []
    for j, (a, b) in enumerate(pairs):
        exprs += [F.coalesce(F.sum((F.col(a) > F.col(b)).cast("long")), F.lit(0)).alias(f"ab{j}"),
                  F.coalesce(F.sum((F.col(b) > F.col(a)).cast("long")), F.lit(0)).alias(f"ba{j}")]
    agg = parsed.agg(*exprs)
    rows = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                              F.col(f"ab{j}").alias("a_after_b"), F.col(f"ba{j}").alias("b_after_a"))
                     for j, (a, b) in enumerate(pairs)])
    return (agg.select(F.explode(rows).alias("s")).select("s.*")
            .filter((F.col("a_after_b") > 0) & (F.col("b_after_a") > 0)))


def impute_statistics(df: DataFrame, cols, quantile_mode: str = "exact") -> DataFrame:
    """Mean and exact median of numeric columns, mode (ties: smallest
    value) of text columns -- the statistics imputation uses."""
    from .freq import mode_per_column
    dts = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in cols if is_numeric(dts[c])]
    txt = [c for c in cols if is_text(dts[c])]
    out = {}
    if num:
        row = df.agg(*[F.avg(as_double(c, dts[c])).alias(f"m{i}") for i, c in enumerate(num)]).first()
        med = medians(df, num, quantile_mode)
        for i, c in enumerate(num):
            out[c] = (row[f"m{i}"], med.get(c), None)
    if txt:
        modes = {r["column"]: r["mode"] for r in mode_per_column(value_freq(df, txt)).collect()}
        for c in txt:
            out[c] = (None, None, modes.get(c))
    res = df.sparkSession.createDataFrame(
        [(c, *out[c]) for c in cols], "column string, mean_value double, median_value double, mode_value string")
    return res.select("column", round_half_up("mean_value", 4).alias("mean_value"),
                      round_half_up("median_value", 4).alias("median_value"), "mode_value")
