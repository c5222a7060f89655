"""Modelling (F1-F5): boosted trees and exact scores.

The baseline and the sweep train the library's histogram boosting, which learns for every cut
the side of missing values, so the naive baseline (fail-safe string drop, no cleaning) takes
its table as it is.  Spark ML's boosted trees are there for complete tables.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedModel, BoostParams, fit_boosted
from .clean import drop_string_columns
from .split import stratified_split
from .trees import boosted_trees, prediction_column

def feature_columns(df: DataFrame, target: str, exclude=()) -> list:
    return [c for c in df.columns if c != target and c not in exclude]


def train_classifier(train: DataFrame, target: str, features=None, seed: int = 42,
                     max_iter: int = 20, max_depth: int = 5):
    """F1 on Spark ML: VectorAssembler + GBTClassifier (log-loss), fixed seed; a missing value in a
    feature is an error (``fit_boosted`` takes them)."""
    features = features or feature_columns(train, target)
    data = train.withColumn("__label", F.col(target).cast("double"))
    asm = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="error")
    gbt = GBTClassifier(labelCol="__label", featuresCol="__features", predictionCol="prediction",
                        maxIter=max_iter, maxDepth=max_depth, seed=seed, lossType="logistic")
    return Pipeline(stages=[asm, gbt]).fit(data)


def predict(model, df: DataFrame) -> DataFrame:
    """adds ``prediction`` (0/1 integer), by the model's trees as expressions.  Trees of Spark
    ML give null where a feature they use is missing."""
    trees = model.trees if isinstance(model, BoostedModel) else boosted_trees(model)
    return df.withColumn("prediction", prediction_column(trees))


def f1_accuracy(pred: DataFrame, label: str, prediction: str = "prediction", digits: int = 4) -> DataFrame:
    """positive-class F1 and accuracy from confusion counts in one
    aggregate; rounded half-up to ``digits``."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    c = pred.agg(F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
                 F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
                 F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
                 F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"))
    tp, fp, fn, tn = [F.coalesce(F.col(x), F.lit(0)) for x in ("tp", "fp", "fn", "tn")]
    n = tp + fp + fn + tn
    scale = float(10 ** digits)
    f1 = F.when(2 * tp + fp + fn > 0, F.lit(2.0) * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    acc = F.when(n > 0, tp.cast("double") + tn.cast("double")).otherwise(F.lit(0.0)) / \
        F.greatest(n, F.lit(1)).cast("double")
    rnd = lambda e: F.floor(e * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return c.select(rnd(f1).alias("f1_score"), rnd(acc).alias("accuracy"),
                    tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))


def baseline_metrics(df: DataFrame, target: str, test_size: float = 0.2, seed: int = 42,
                     key: str | None = None, exclude=(), params: BoostParams = BoostParams()):
    """fail-safe string drop -> exact split -> boosting with missing values -> scores.
    Returns (metrics DataFrame, split DataFrame)."""
    work, dropped = drop_string_columns(df.drop(*exclude), target)
    if key and key not in work.columns:
        work = work.withColumn(key, df[key]) if key in df.columns else work
    split = stratified_split(work, target, test_size, seed, key=key)
    feats = feature_columns(work, target, exclude=[key] if key else [])
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    model = fit_boosted(train, target, feats, params)
    s = f1_accuracy(predict(model, test), target).first()
    c = split.agg(F.sum((F.col("split") == "train").cast("long")).alias("tr"),
                  F.sum((F.col("split") == "test").cast("long")).alias("te")).first()
    metrics = df.sparkSession.createDataFrame(
        [(s["f1_score"], s["accuracy"], c["tr"], c["te"], len(feats), ",".join(dropped))],
        "baseline_f1_score double, baseline_accuracy double, n_train_rows long, n_test_rows long, "
        "n_features_used int, columns_dropped_by_failsafe string")
    return metrics, split
