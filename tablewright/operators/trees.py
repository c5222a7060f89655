"""Boosted trees as expressions (F2): no vector, no Python and no ML transform to predict.

A fitted tree is a nested choice of thresholds, so it is written as nested CASE
expressions over the feature columns, for Spark and as SQL text for any other engine; the
sum of the weighted trees is the margin, and a positive margin is class 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Choice:
    """``low`` where the feature is at most ``threshold``, else ``high``; ``missing_low`` tells the
    side of null and NaN, None that the tree knows no missing values."""
    feature: str
    threshold: float
    low: Choice | Leaf
    high: Choice | Leaf
    missing_low: bool | None = None


def _node(node, features: list[str]) -> Choice | Leaf:
    if node.subtreeDepth() == 0:
        return Leaf(float(node.prediction()))
    split = node.split()
    return Choice(features[split.featureIndex()], float(split.threshold()), _node(node.leftChild(), features), _node(node.rightChild(), features))


def boosted_trees(model) -> list[tuple[float, Choice | Leaf]]:
    """(weight, tree) of a fitted pipeline of an assembler and a boosted classifier."""
    assembler, gbt = model.stages[0], model.stages[-1]
    features = list(assembler.getInputCols())
    return [(float(w), _node(t._java_obj.rootNode(), features)) for w, t in zip(gbt.treeWeights, gbt.trees, strict=True)]


def features_of(tree: Choice | Leaf) -> set[str]:
    return set() if isinstance(tree, Leaf) else {tree.feature} | features_of(tree.low) | features_of(tree.high)


def needed_by(tree: Choice | Leaf) -> set[str]:
    """The features without which the tree has no answer."""
    if isinstance(tree, Leaf):
        return set()
    return ({tree.feature} if tree.missing_low is None else set()) | needed_by(tree.low) | needed_by(tree.high)


def tree_column(tree: Choice | Leaf) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.value)
    v = F.col(f"`{tree.feature}`").cast("double")
    low = v <= F.lit(tree.threshold)            # null and NaN: not low
    if tree.missing_low:
        low = v.isNull() | F.isnan(v) | low
    return F.when(low, tree_column(tree.low)).otherwise(tree_column(tree.high))


def tree_sql(tree: Choice | Leaf) -> str:
    if isinstance(tree, Leaf):
        return f"CAST('{tree.value!r}' AS DOUBLE)"
    name = tree.feature.replace('"', '""')
    value = f"CAST(\"{name}\" AS DOUBLE)"
    low = f"{value} <= CAST('{tree.threshold!r}' AS DOUBLE)"
    if tree.missing_low:
        low = f"({value} IS NULL OR isnan({value}) OR {low})"
    return f"CASE WHEN {low} THEN {tree_sql(tree.low)} ELSE {tree_sql(tree.high)} END"


def margin_column(trees) -> Column:
    """The weighted sum of the trees; null where a feature is null or NaN that a tree without a
    side for missing values uses."""
    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + F.lit(weight) * tree_column(tree)
    used = [F.col(f"`{f}`").cast("double") for f in sorted(set().union(*[needed_by(t) for _, t in trees]))]
    missing = F.lit(False)
    for v in used:
        missing = missing | v.isNull() | F.isnan(v)
    return F.when(~missing, total)


def margin_sql(trees) -> str:
    return " + ".join(["CAST(0 AS DOUBLE)", *(f"CAST('{w!r}' AS DOUBLE) * {tree_sql(t)}" for w, t in trees)])


def prediction_column(trees) -> Column:
    m = margin_column(trees)
    return F.when(m.isNotNull(), (m > 0).cast("int"))
