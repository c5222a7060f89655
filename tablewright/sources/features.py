"""Model-ready views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with whole-text counts: (doc_id, n_chars, n_lines,
    n_words, lang, source, quality)."""
    docs = spread(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    feats = docs.select(
        "doc_id", "n_chars",
        F.size(F.split(F.col("text"), "\n")).cast("long").alias("n_lines"),
        F.size(F.split(F.trim(F.col("text")), r"\s+")).cast("long").alias("n_words"),
        "lang", "source")
    return feats.join(labels, "doc_id")
