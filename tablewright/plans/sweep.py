"""Strategy sweep (F8): dedup -> exact split -> clean train and test
independently under every strategy -> align -> boosting -> scores.

Every strategy runs even after a win; a failed gate, or a failure in cleaning,
alignment or training, becomes a result row instead of an exception.  A split that
loses rows or shares them between its sides is not trained on.  The split is written
once to the shared checkpoint folder and reused by all strategies.
"""

from __future__ import annotations

import traceback

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators.boosting import fit_boosted
from ..operators.clean import drop_duplicates
from ..operators.compare import RESULT_SCHEMA
from ..operators.gate import run_gate
from ..operators.model import f1_accuracy, predict
from ..operators.split import cross_split_duplicates, split_key_overlap, split_reconcile, stratified_split
from ..session import cut_lineage
from .cleaning import fit_clean
from .strategies import STRATEGY_LIBRARY


def _row(position: int, strategy, attempts: int, **fields) -> Row:
    """A result row by field name; what is left out is null."""
    names = dict.fromkeys(RESULT_SCHEMA.fieldNames())
    return Row(**{**names, "position": position, "strategy_name": strategy.name, "succeeded": False,
                  "agent_attempts_used": attempts, **fields})


#: The failures table's category for each way a strategy can fail.
_CATEGORIES = {"Cleaning failed": "unknown", "Gate failed": "agent_exhaustion", "Split check failed": "ambiguous_data",
               "Column alignment failed": "profile_incomplete", "Training failed": "unknown"}


def category_of(reason: str | None) -> str:
    return _CATEGORIES.get((reason or "").split(":")[0], "unknown")


def violations(original: DataFrame, result: DataFrame, target: str, keep=()) -> list[str]:
    """What the gate finds wrong with ``result``; kept key columns need not be numeric."""
    bad = run_gate(original, result, target).where(~F.col("passed")).collect()
    return [f"{r['check']}:{r['column']}={r['observed']}" for r in bad if not (r["check"] == "numeric" and r["column"] in keep)]


def split_problem(original: DataFrame, split: DataFrame, key: str | None, split_col: str = "split") -> str | None:
    """Why the split must not be trained on: rows lost, content or keys on both sides."""
    if not split_reconcile(original, split, split_col).first()["complete"]:
        return "train and test do not add up to the table"
    if shared := cross_split_duplicates(split, split_col=split_col).first()["n_rows_cross_split"]:
        return f"{shared} equal rows on both sides"
    if key and (shared := split_key_overlap(split, key, split_col).first()["n_keys_both_sides"]):
        return f"{shared} keys on both sides"
    return None


def run_strategy(position: int, strategy, train: DataFrame, test: DataFrame, target: str,
                 key: str | None, seed: int = 42, mode: str = "fit_on_train", out_dir: str | None = None) -> Row:
    """``mode``: "independent" cleans train and test separately (vocabularies and
    statistics may differ per split); "fit_on_train" fits one plan on train and
    applies it to test, keeping the test rows that violate date order.

    Both results pass the gate before they are aligned and trained on.  ``out_dir``
    keeps the aligned tables as ``<strategy>/train`` and ``<strategy>/test``."""
    keep = [key] if key else []
    if mode not in ("independent", "fit_on_train"):
        raise ValueError(f"mode must be 'independent' or 'fit_on_train', got {mode!r}")
    attempts, plan = 0, None
    results = []
    for name, part in (("train", train), ("test", test)):
        attempts += 1
        try:
            if plan is not None:
                done = plan.transform(part, keep_violations=True)
            else:
                fitted, done = fit_clean(part, strategy, target=target, keep=keep)
                plan = fitted if mode == "fit_on_train" else None
            wrong = violations(part, done, target, keep)
        except Exception:  # noqa: BLE001 -- becomes a result row
            return _row(position, strategy, attempts, failure_reason=f"Cleaning failed: {name}: {traceback.format_exc()}")
        if wrong:
            return _row(position, strategy, attempts, failure_reason=f"Gate failed: {name}: {'; '.join(wrong)}")
        results.append(done)
    try:
        tr, te = E.align_columns(*results, target)
    except ValueError as exc:
        return _row(position, strategy, attempts, failure_reason=f"Column alignment failed: {exc}")
    if out_dir is not None:
        paths = [f"{out_dir}/{strategy.name}/{name}" for name in ("train", "test")]
        for frame, path in zip((tr, te), paths, strict=True):
            frame.write.mode("overwrite").parquet(path)
        tr, te = (df.sparkSession.read.parquet(path) for df, path in zip((tr, te), paths, strict=True))
    feats = [c for c in tr.columns if c != target and c not in keep]
    try:
        model = fit_boosted(tr, target, feats)
        s = f1_accuracy(predict(model, te), target).first()
    except Exception:  # noqa: BLE001
        return _row(position, strategy, attempts, n_features=len(feats), failure_reason=f"Training failed: {traceback.format_exc()}")
    return _row(position, strategy, attempts, succeeded=True, f1_score=s["f1_score"], accuracy=s["accuracy"],
                n_train_rows=tr.count(), n_test_rows=te.count(), n_features=len(feats))


def strategy_sweep(df: DataFrame, target: str, key: str | None = None, strategies=STRATEGY_LIBRARY,
                   test_size: float = 0.2, seed: int = 42, baseline_f1: float | None = None,
                   mode: str = "fit_on_train", out_dir: str | None = None) -> DataFrame:
    """Result rows (one per strategy, in run order)."""
    raw = cut_lineage(drop_duplicates(df))
    split = cut_lineage(stratified_split(raw, target, test_size, seed, key=key))
    leak = split_problem(raw, split, key)
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    rows = []
    for i, s in enumerate(strategies, start=1):
        if leak:
            rows.append(_row(i, s, 0, failure_reason=f"Split check failed: {leak}"))
            continue
        row = run_strategy(i, s, train, test, target, key, seed, mode, out_dir).asDict()
        if row["succeeded"] and baseline_f1 is not None:
            row["beat_baseline"] = row["f1_score"] >= baseline_f1
        rows.append(Row(**row))
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)
