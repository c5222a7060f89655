"""The driver-generated parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; valid: {list(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small input across the cluster before CPU-heavy per-row
    work (hashing, text parsing) -- only when it arrives in fewer partitions
    than there are task slots (e.g. one small parquet file).  Large inputs
    already arrive in many splits and are returned untouched (no shuffle)."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()          # planning only, no job
    except Exception:  # noqa: BLE001 -- e.g. Spark Connect: no RDD view; leave as is
        return df
    return df.repartition(slots) if parts < slots else df
