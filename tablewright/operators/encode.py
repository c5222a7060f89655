"""One-hot encoding (C10) and train/test column alignment (E5, S3).

The output schema depends on the data, so encoding is fit (collect the sorted
vocabulary -- bounded by the rare-grouping threshold) then transform (all
indicator columns in ONE select, never a withColumn loop).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .freq import value_freq


def feature_name(col: str, value: str) -> str:
    """``col_value`` with every character outside [0-9A-Za-z_] replaced by '_'."""
    return re.sub(r"[^0-9A-Za-z_]", "_", f"{col}_{value}")


#: One column a category: more than this is no table to train on, and no list for the driver.
MAX_CATEGORIES = 10_000


def fit_one_hot(df: DataFrame, cols, max_categories: int | None = MAX_CATEGORIES, vf: DataFrame | None = None) -> dict:
    """Sorted non-null vocabulary of every column, from ``vf`` if the values are counted
    already; a column with more than ``max_categories`` is an error."""
    if not cols:
        return {}
    vf = value_freq(df, cols) if vf is None else vf.where("value IS NOT NULL")
    counts = {r["column"]: r["d"] for r in vf.groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
    too_wide = {c: n for c, n in counts.items() if max_categories is not None and n > max_categories}
    if too_wide:
        raise ValueError(f"too many categories to one-hot (group rare values first): {too_wide}")
    vocab: dict = {c: [] for c in cols}
    for r in vf.select("column", "value").collect():
        vocab[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in vocab.items()}


def one_hot(df: DataFrame, vocab: dict, drop_first: bool = True) -> DataFrame:
    """Replace each column by 0/1 integer indicators ``col_value`` for its
    sorted categories (first dropped); NULL gives all zeros."""
    taken = set(c for c in df.columns if c not in vocab)
    out_cols = []
    for c in df.columns:
        if c not in vocab:
            out_cols.append(F.col(c))
            continue
        values = vocab[c][1:] if drop_first else vocab[c]
        for v in values:
            name = feature_name(c, v)
            base, i = name, 2
            while name in taken:
                name, i = f"{base}_{i}", i + 1
            taken.add(name)
            out_cols.append(F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int").alias(name))
    return df.select(*out_cols)


def align_columns(train: DataFrame, test: DataFrame, target: str):
    """E5: union of both column sets, missing columns filled with 0, columns in
    sorted order; refuses when the target is missing on either side."""
    if target not in train.columns or target not in test.columns:
        raise ValueError(f"target column {target!r} missing from train and/or test; refusing to align")
    cols = sorted(set(train.columns) | set(test.columns))

    def fill(df, other):
        types = {f.name: f.dataType for f in other.schema.fields}
        return df.select(*[F.col(c) if c in df.columns else F.lit(0).cast(types[c]).alias(c)
                           for c in cols])
    return fill(train, test), fill(test, train)


def melt(df: DataFrame, ids, value_type: str = "double") -> DataFrame:
    """Long (id..., feature, value) view of a wide feature table."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    vals = [c for c in df.columns if c not in ids]
    proj = df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in vals])
    return proj.unpivot(ids, vals, "feature", "value")
