"""Row-level cleaning operators.

Each operator is fit-then-transform: the fit is one small aggregate (or the
exact quantile selector), the transform a single projection that stays in
whole-stage codegen.  Fitted statistics enter the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_DATE_FORMATS, date_orders, parse_timestamp, to_epoch_seconds
from ..functions.numeric import as_double, is_numeric, is_text
from ..functions.text import (DEFAULT_MISSING_LITERALS, normalize_missing_expr,
                              normalize_text_expr, spelling_key_expr)
from ..session import shared_path
from .freq import mode_per_column, topk, value_freq
from .profile import iqr_bounds, medians, quartiles

# The label used for grouped rare categories.
OTHER = "other"


def _types(df):
    return {f.name: f.dataType for f in df.schema.fields}


def text_columns(df, exclude=()):
    return [c for c, t in _types(df).items() if is_text(t) and c not in exclude]


def numeric_columns(df, exclude=()):
    return [c for c, t in _types(df).items() if is_numeric(t) and c not in exclude]


# ------------------------------------------------------------- projections
def drop_string_columns(df: DataFrame, target: str | None = None):
    """Keep numeric columns and the target; return (df, dropped)."""
    dts = _types(df)
    dropped = [c for c in df.columns if c != target and not is_numeric(dts[c])]
    return df.drop(*dropped), dropped


def all_null_columns(df: DataFrame, exclude=()) -> list:
    cols = [c for c in df.columns if c not in exclude]
    if not cols:
        return []
    dts = _types(df)
    row = df.agg(*[F.count(as_double(c, dts[c]) if is_numeric(dts[c]) else F.col(c)).alias(f"c{i}")
                   for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]


def drop_all_null_columns(df: DataFrame, exclude=()):
    """Drop columns with no non-null value (median of nothing is null)."""
    dropped = all_null_columns(df, exclude)
    return df.drop(*dropped), dropped


def constant_text_columns(df: DataFrame, exclude=()) -> list:
    cols = text_columns(df, exclude)
    if not cols:
        return []
    row = df.agg(*[F.approx_count_distinct(c).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    maybe = [c for i, c in enumerate(cols) if row[f"a{i}"] <= 3]
    if not maybe:
        return []
    row = df.agg(*[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(maybe)]).first()
    return [c for i, c in enumerate(maybe) if row[f"d{i}"] <= 1]


def drop_constant_columns(df: DataFrame, exclude=()):
    """Drop text columns with at most one distinct value (numeric
    constants stay, so a one-row table keeps its features)."""
    dropped = constant_text_columns(df, exclude)
    return df.drop(*dropped), dropped


def normalize_missing(df: DataFrame, cols=None, literals=DEFAULT_MISSING_LITERALS) -> DataFrame:
    """Listed literal strings become NULL in text columns; NaN becomes
    NULL in floating columns."""
    from pyspark.sql import types as T
    dts = _types(df)
    cols = text_columns(df) if cols is None else list(cols)
    repl = {c: normalize_missing_expr(c, literals) for c in cols}
    for c, t in dts.items():
        if isinstance(t, (T.FloatType, T.DoubleType)):
            repl[c] = F.when(F.isnan(c), F.lit(None).cast(t)).otherwise(F.col(c))
    return df.withColumns(repl) if repl else df


def date_violation_expr(df: DataFrame, before: str, after: str, formats=DEFAULT_DATE_FORMATS):
    """Text sides are parsed; the others are dates or timestamps already."""
    dts = _types(df)
    by = date_orders(df, (before, after), formats)
    b, a = (parse_timestamp(c, by[c]) if is_text(dts[c]) else F.col(c).cast("timestamp") for c in (before, after))
    return F.coalesce(b > a, F.lit(False))


def drop_date_violations(df: DataFrame, before: str, after: str, mode: str = "drop",
                         formats=DEFAULT_DATE_FORMATS, flag_col: str = "date_order_violation") -> DataFrame:
    """Rows where ``before`` is after ``after`` are dropped (or flagged);
    rows with either side missing or unparseable are kept."""
    bad = date_violation_expr(df, before, after, formats)
    if mode == "drop":
        return df.filter(~bad)
    if mode == "flag":
        return df.withColumn(flag_col, bad.cast("int"))
    raise ValueError(f"mode must be 'drop' or 'flag', got {mode!r}")


def label_from_text(df: DataFrame, col: str, positive: str, out: str = "target") -> DataFrame:
    """Strip blanks and trailing dots, compare with the positive label,
    0/1 integer, source column dropped."""
    clean = F.regexp_replace(F.trim(F.col(col)), r"\.+$", "")
    return df.withColumn(out, (clean == F.lit(positive)).cast("int")).drop(*([col] if col != out else []))


# ------------------------------------------------------------------- dedup
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row dedup; equal rows are interchangeable, so "keep first"
    needs no order.  Planned as a partial + final hash aggregate, so a group of
    copies holding a third of all rows is collapsed map-side."""
    return df.dropDuplicates()


def drop_duplicates_by_key(df: DataFrame, keys, order_by: str) -> DataFrame:
    """Keep the first row (smallest ``order_by``) per key, as a ``min_by``
    aggregate (partial aggregation; no sort, no window over a hot key)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order_by)).alias("__first"))
    return agg.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)


# ------------------------------------------------------------------- text
def normalize_text(df: DataFrame, cols) -> DataFrame:
    """Strip + lower on the given (non-date) text columns."""
    return df.withColumns({c: normalize_text_expr(c) for c in cols}) if cols else df


def canonical_map(vf: DataFrame, mode: str = "exact") -> DataFrame:
    """Map (column, value) -> canonical for spellings that mean the same:
    values sharing a spelling key map to the key's most frequent value, ties
    broken by the smallest value."""
    if mode != "exact":
        raise ValueError("only mode='exact' builds a map here; fuzzy maps come from fuzzy.cluster_map")
    keyed = vf.withColumn("key", spelling_key_expr("value"))
    canon = keyed.groupBy("column", "key").agg(
        F.min_by("value", F.struct(-F.col("freq"), F.col("value"))).alias("canonical"))
    return (keyed.join(canon, ["column", "key"])
            .filter(F.col("value") != F.col("canonical"))
            .select("column", "value", "canonical"))


def stored_map(mapping: DataFrame) -> DataFrame:
    """``mapping`` written to the shared folder by column, so that the planner knows
    the size of each column's part and broadcasts it only below its threshold."""
    spark = mapping.sparkSession
    path = shared_path(spark, "spellings")
    mapping.select("column", "value", "canonical").write.partitionBy("column").parquet(path)
    return spark.read.schema("value string, canonical string, column string").parquet(path)


def apply_map(df: DataFrame, mapping: DataFrame, cols) -> DataFrame:
    """Replace values by their canonical form with a left join per column
    against the mapping table, whose size the planner judges."""
    out = df
    for c in cols:
        m = mapping.filter(F.col("column") == c).select(F.col("value").alias("__v"), F.col("canonical").alias("__canon"))
        out = (out.join(m, out[c] == m["__v"], "left")
               .withColumn(c, F.coalesce(F.col("__canon"), F.col(c))).drop("__v", "__canon"))
    return out


def merge_spellings(df: DataFrame, cols, mode: str = "exact") -> DataFrame:
    """C4: map spelling variants to one canonical value."""
    return apply_map(df, canonical_map(value_freq(df, cols), mode), cols) if cols else df


# ------------------------------------------------------- numeric statistics
def fit_numeric_stats(df: DataFrame, cols, policy: str, quantile_mode: str = "exact") -> dict:
    if not cols:
        return {}
    if policy == "median":
        return medians(df, cols, quantile_mode)
    if policy == "mean":
        dts = _types(df)
        row = df.agg(*[F.avg(as_double(c, dts[c])).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(cols)}
    raise ValueError(f"policy must be 'median' or 'mean', got {policy!r}")


def impute_numeric(df: DataFrame, cols, policy: str = "median", stats: dict | None = None,
                   quantile_mode: str = "exact") -> DataFrame:
    """NULL -> column median or mean (fitted here unless ``stats`` given)."""
    stats = fit_numeric_stats(df, cols, policy, quantile_mode) if stats is None else stats
    repl = {c: F.coalesce(F.col(c).cast("double"), F.lit(stats[c]))
            for c in cols if stats.get(c) is not None}
    return df.withColumns(repl) if repl else df


def fit_modes(df: DataFrame, cols) -> dict:
    if not cols:
        return {}
    return {r["column"]: r["mode"] for r in mode_per_column(value_freq(df, cols)).collect()}


def impute_categorical(df: DataFrame, cols, modes: dict | None = None) -> DataFrame:
    """NULL -> most frequent value (ties: smallest value)."""
    modes = fit_modes(df, cols) if modes is None else modes
    repl = {c: F.coalesce(F.col(c), F.lit(modes[c])) for c in cols if modes.get(c) is not None}
    return df.withColumns(repl) if repl else df


def fit_clip_bounds(df: DataFrame, cols, mult: float, quantile_mode: str = "exact") -> dict:
    qs = quartiles(df, cols, quantile_mode)
    return {c: iqr_bounds(q1, q3, mult) for c, (q1, q3) in qs.items()}


def clip_outliers(df: DataFrame, cols, mult: float | None = 1.5, bounds: dict | None = None,
                  quantile_mode: str = "exact") -> DataFrame:
    """Winsorize to [Q1 - m*IQR, Q3 + m*IQR]; NULLs stay NULL; ``mult``
    None disables clipping."""
    if mult is None or not cols:
        return df
    bounds = fit_clip_bounds(df, cols, mult, quantile_mode) if bounds is None else bounds
    repl = {}
    for c in cols:
        lo, hi = bounds.get(c, (None, None))
        if lo is None:
            continue
        v = F.col(c).cast("double")
        repl[c] = F.when(v.isNull(), v).otherwise(F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))
    return df.withColumns(repl) if repl else df


def dates_to_epoch(df: DataFrame, cols, formats=DEFAULT_DATE_FORMATS, fill: str | None = "median",
                   quantile_mode: str = "exact") -> DataFrame:
    """Parse (or NULL) -> seconds since 1970-01-01 -> NULLs filled with the
    column median."""
    if not cols:
        return df
    dts = _types(df)
    by = date_orders(df, cols, formats)
    out = df.withColumns({c: to_epoch_seconds(c, by[c], is_text=is_text(dts[c])) for c in cols})
    if fill == "median":
        out = impute_numeric(out, cols, "median", quantile_mode=quantile_mode)
    return out


def fit_group_rare(df: DataFrame, cols, threshold: int, k: int, vf: DataFrame | None = None) -> dict:
    """Columns with more than ``threshold`` distinct values -> their top ``k``
    values (ties by value)."""
    if not cols:
        return {}
    vf = value_freq(df, cols) if vf is None else vf.filter(F.col("column").isin(list(cols)))
    counts = {r["column"]: r["d"] for r in vf.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
    wide = [c for c in cols if counts.get(c, 0) > threshold]
    keep: dict = {c: [] for c in wide}
    if wide:
        for r in topk(vf, k, wide).collect():
            keep[r["column"]].append(r["value"])
    return keep


def apply_group_rare(df: DataFrame, keep: dict) -> DataFrame:
    if not keep:
        return df
    return df.withColumns({c: F.when(F.col(c).isNull(), F.col(c))
                           .when(F.col(c).isin(vals), F.col(c))
                           .otherwise(F.lit(OTHER)) for c, vals in keep.items()})


def group_rare(df: DataFrame, cols, threshold: int, k: int, vf: DataFrame | None = None) -> DataFrame:
    """For text columns with more than ``threshold`` distinct values keep
    the ``k`` most frequent (ties by value) and map the rest to 'other'."""
    return apply_group_rare(df, fit_group_rare(df, cols, threshold, k, vf))
