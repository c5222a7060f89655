"""The cleaning plan (C11) and ``clean``.

Fixed step order: missing literals -> dedup -> drop all-null columns -> drop
constant text columns -> normalize and merge spellings -> date-order
violations -> dates to epoch -> clip -> impute -> group rare -> one-hot ->
dedup again.

``fit_clean`` fits every step's statistics on the output of the step before
it (small jobs over a checkpoint of the deduplicated input) and returns a
``FittedPlan``: a list of transforms whose statistics are literals (or a
small broadcast mapping).  The plan applies unchanged to any DataFrame with
the same schema -- the training split, a test split (``fit_on_train``), or a
streaming DataFrame.  ``clean`` is fit + transform of the same table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_DATE_FORMATS, parse_timestamp
from ..functions.numeric import is_text
from ..functions.text import DEFAULT_MISSING_LITERALS
from ..operators import clean as C
from ..operators import encode as E
from ..operators.freq import filled, kept_or_other, mode_per_column, value_freq_with_nulls
from ..operators.profile import date_order_conflicts, iqr_bounds, profile, ranks, require_target
from ..session import compiled_methods, cut_lineage, drop_staged, staged, storable
from .strategies import CleaningStrategy, get_strategy


@dataclass
class FittedStep:
    name: str
    detail: object
    fn: Callable[[DataFrame], DataFrame]
    stateful: bool = False          # needs state when applied to a stream


@dataclass
class FittedPlan:
    steps: list = field(default_factory=list)
    target: str | None = None
    date_columns: list = field(default_factory=list)
    vocabulary: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, streaming: bool = False, keep_violations: bool = False) -> DataFrame:
        """Apply every fitted step.  On a stream, stateful steps (dedup) are
        left to the caller (e.g. ``dropDuplicatesWithinWatermark``);
        ``keep_violations`` keeps date-order violating rows (for a test split,
        whose rows should not be dropped by cleaning)."""
        for s in self.steps:
            if streaming and s.stateful:
                continue
            if keep_violations and s.name == "date_violations":
                continue
            df = s.fn(df)
        return df

    def describe(self):
        return [(s.name, s.detail) for s in self.steps]


@dataclass
class CleanResult:
    df: DataFrame
    plan: FittedPlan
    steps: list = field(default_factory=list)     # (step, detail) in order
    date_columns: list = field(default_factory=list)
    vocabulary: dict = field(default_factory=dict)


def _dates_read(df: DataFrame, cols, formats) -> DataFrame:
    """``df`` written once with its date texts parsed, in microseconds, which hold every time exactly."""
    texts = [c for c in cols if is_text(df.schema[c].dataType)]
    if not texts or not storable(df):
        return df
    parsed = staged(df.withColumns({c: F.unix_micros(parse_timestamp(c, formats[c])) for c in texts}), "dates")
    return parsed.withColumns({c: F.timestamp_micros(c) for c in texts})


def fit_clean(df: DataFrame, strategy: CleaningStrategy | str = "conservative_median",
              target: str | None = "target", keep=(), date_formats=DEFAULT_DATE_FORMATS,
              missing_literals=DEFAULT_MISSING_LITERALS, violation_mode: str = "drop",
              quantile_mode: str = "exact", date_min_rate: float = 0.9,
              checkpoint: bool = True, merge: str = "exact", fuzzy_threshold: float = 80.0):
    """Fit the plan on ``df``; returns (FittedPlan, df transformed by it).

    ``merge``: "exact" maps spellings that share a spelling key (lower-case,
    blanks, '-' and '_' removed) -- never merges opposites such as
    active/inactive; "fuzzy" maps every member of a greedy similarity cluster
    (ratio >= ``fuzzy_threshold``) to the cluster's most frequent value."""
    strategy = get_strategy(strategy) if isinstance(strategy, str) else strategy
    require_target(df, target)
    with compiled_methods(df.sparkSession):
        return _fit_clean(df, strategy, target, keep, date_formats, missing_literals, violation_mode,
                          quantile_mode, date_min_rate, checkpoint, merge, fuzzy_threshold)


def _fit_clean(df, strategy, target, keep, date_formats, missing_literals, violation_mode,
               quantile_mode, date_min_rate, checkpoint, merge, fuzzy_threshold):
    skip = set(keep) | ({target} if target else set())
    plan = FittedPlan(target=target)

    def add(name, detail, fn, stateful=False):
        nonlocal out
        plan.steps.append(FittedStep(name, detail, fn, stateful))
        out = fn(out)

    out = df
    # 1. literal missing markers -> NULL (before any null handling), 2. dedup
    add("normalize_missing", list(missing_literals), lambda d: C.normalize_missing(d, literals=missing_literals))
    add("drop_duplicates", None, C.drop_duplicates, stateful=True)
    if checkpoint:
        # every later fit reads this instead of re-running scan + dedup shuffle
        out = staged(out, "deduplicated") if storable(out) else cut_lineage(out)

    # light profile of the deduplicated table (no quartiles, no duplicate count)
    prof = profile(out.drop(*[k for k in keep if k in out.columns]), target=target,
                   with_duplicates=False, with_quantiles=False, with_conflicts=False, distinct_mode="few", date_formats=date_formats,
                   date_min_rate=date_min_rate, persist_freq=False)
    dead = [c for c in prof.columns if c not in skip and prof.n_rows > 0
            and prof.stats[c]["null_count"] == prof.n_rows]
    const = [c for c in prof.text_columns if c not in skip and c not in dead
             and prof.stats[c]["n_unique"] <= 1]
    add("drop_all_null_columns", dead, lambda d: d.drop(*dead))
    add("drop_constant_columns", const, lambda d: d.drop(*const))

    text_cols = [c for c in prof.text_columns if c not in skip and c not in dead + const]
    add("normalize_text", text_cols, lambda d: C.normalize_text(d, text_cols))
    if text_cols:
        vf = C.value_freq(out, text_cols)
        if merge == "exact":
            mapping_df = C.canonical_map(vf)
        elif merge == "fuzzy":
            from ..operators.fuzzy import cluster_map, clusters
            mapping_df = cluster_map(clusters(vf, fuzzy_threshold), vf)
        else:
            raise ValueError(f"merge must be 'exact' or 'fuzzy', got {merge!r}")
        mapping = C.stored_map(mapping_df)
        add("merge_spellings", mapping.count(), lambda d: C.apply_map(d, mapping, text_cols))

    date_cols = [c for c in prof.date_columns if c not in skip and c not in dead]
    date_formats = prof.date_formats   # fitted here, so that the plan reads other tables alike
    if checkpoint:
        # every later fit, and the transform of ``df``, read the times that the texts tell
        out = _dates_read(out, date_cols, date_formats)
    for d in date_order_conflicts(out, date_cols, date_formats):
        # the majority direction is the logical order; the minority rows violate it
        before, after = ((d["col_a"], d["col_b"]) if d["b_after_a"] >= d["a_after_b"]
                         else (d["col_b"], d["col_a"]))
        add("date_violations", (before, after, violation_mode),
            lambda x, b=before, a=after: C.drop_date_violations(
                x, b, a, mode=violation_mode, formats=date_formats, flag_col=f"{b}_after_{a}"))
    num_cols = [c for c in prof.numeric_columns() if c not in skip and c not in dead
                and prof.stats[c].get("n_unique", 0) > 2]
    impute_num = [c for c in prof.numeric_columns() if c not in skip and c not in dead]
    clip = num_cols if strategy.iqr_multiplier is not None else []
    by_median = impute_num if strategy.numeric_impute_policy == "median" else []
    # What is left to fit depends on these rows alone.  One rank search has all quartiles and
    # medians (clipping outside the quartiles moves no median), one count of the values the
    # modes, the rare values and the vocabulary.
    told = C.dates_to_epoch(out, date_cols, date_formats, fill=None)
    if checkpoint and date_cols and storable(told):
        told = staged(told, "epochs")
        out = told
    with ThreadPoolExecutor(max_workers=2) as pool:
        f_ranks = pool.submit(ranks, told, [*date_cols, *dict.fromkeys([*clip, *by_median])], (0.25, 0.5, 0.75), quantile_mode)
        f_freq = pool.submit(staged, value_freq_with_nulls(out, text_cols), "values") if text_cols else None
        found, vf = f_ranks.result(), f_freq.result() if f_freq else None
    if date_cols:
        meds = {c: found[c][1] for c in date_cols}
        plan.steps.append(FittedStep("dates_to_epoch", meds, lambda d: C.impute_numeric(
            C.dates_to_epoch(d, date_cols, date_formats, fill=None), date_cols, stats=meds)))
        out = C.impute_numeric(told, date_cols, stats=meds)
    if clip:
        bounds = {c: iqr_bounds(found[c][0], found[c][2], strategy.iqr_multiplier) for c in clip}
        add("clip_outliers", bounds, lambda d: C.clip_outliers(d, num_cols, strategy.iqr_multiplier, bounds=bounds))

    stats = {c: found[c][1] for c in by_median} or C.fit_numeric_stats(out, impute_num, strategy.numeric_impute_policy, quantile_mode)
    modes, keep_top, vocab = {}, {}, {}
    if text_cols:
        modes = {r["column"]: r["mode"] for r in mode_per_column(vf.where("value IS NOT NULL")).collect()}
    add("impute", (stats, modes), lambda d: C.impute_categorical(
        C.impute_numeric(d, impute_num, stats=stats), text_cols, modes=modes))
    if text_cols:
        full = filled(vf, modes)
        keep_top = C.fit_group_rare(None, text_cols, strategy.high_cardinality_threshold, strategy.high_cardinality_top_k, vf=full.where("value IS NOT NULL"))
        vocab = E.fit_one_hot(None, text_cols, vf=kept_or_other(full, keep_top, C.OTHER))
        drop_staged(vf)
    add("group_rare", keep_top, lambda d: C.apply_group_rare(d, keep_top))
    add("one_hot", vocab, lambda d: E.one_hot(d, vocab, drop_first=True))
    add("drop_duplicates_final", None, C.drop_duplicates, stateful=True)
    plan.date_columns, plan.vocabulary = date_cols, vocab
    return plan, out


def clean(df: DataFrame, strategy: CleaningStrategy | str = "conservative_median",
          target: str | None = "target", keep=(), **kw) -> CleanResult:
    """Fit the plan on ``df`` and return ``df`` cleaned by it."""
    plan, out = fit_clean(df, strategy, target, keep, **kw)
    return CleanResult(out, plan, plan.describe(), plan.date_columns, plan.vocabulary)


def plan_cleaning(df: DataFrame, strategy: CleaningStrategy | str, target: str | None, keep=(), **kw):
    """The ordered step list (names and fitted parameters) for ``df``."""
    plan, _ = fit_clean(df, strategy, target, keep, **kw)
    return plan.describe()
