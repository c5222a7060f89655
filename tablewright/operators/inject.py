"""Defect injection as transforms on any keyed table (H1-H6).

Every defect is driven by ``uniform(key, salt)`` so it is reproducible and has
an exact SQL twin.  Rates are per-row Bernoulli fractions, not exact counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.quantiles import exact_quantiles


def inject_nulls(df: DataFrame, cols, rate: float, key: str, salt: str = "null") -> DataFrame:
    """H1: each listed column becomes NULL where uniform(key, salt:col) < rate."""
    return df.withColumns({
        c: F.when(uniform(key, f"{salt}:{c}") < rate, F.lit(None).cast(df.schema[c].dataType))
            .otherwise(F.col(c))
        for c in cols})


def inject_outliers(df: DataFrame, col: str, rate: float, factor: float, key: str,
                    salt: str = "outlier") -> DataFrame:
    """H2: multiply a numeric column by ``factor`` on a fraction of rows."""
    return df.withColumn(col, F.when(uniform(key, f"{salt}:{col}") < rate,
                                     F.col(col) * F.lit(float(factor))).otherwise(F.col(col)))


def inject_duplicates(df: DataFrame, rate: float, key: str, salt: str = "dup") -> DataFrame:
    """H3: append exact copies of a fraction of rows."""
    return df.unionByName(df.filter(uniform(key, salt) < rate))


def inject_spellings(df: DataFrame, col: str, variants: dict, key: str,
                     salt: str = "spell") -> DataFrame:
    """H4: replace each known category by one of its spelling variants."""
    u = uniform(key, f"{salt}:{col}")
    expr = None
    for value, spellings in variants.items():
        pick = F.element_at(F.array(*[F.lit(s) for s in spellings]),
                            (F.floor(u * len(spellings)) + 1).cast("int"))
        expr = (F.when(F.col(col) == value, pick) if expr is None
                else expr.when(F.col(col) == value, pick))
    return df.withColumn(col, expr.otherwise(F.col(col)))


def inject_markers(df: DataFrame, col: str, rate: float, markers, key: str,
                   salt: str = "marker") -> DataFrame:
    """Write literal missing-value markers (``NA``, ``-`` ...) into a text column."""
    pick = F.element_at(F.array(*[F.lit(m) for m in markers]),
                        (F.floor(uniform(key, f"{salt}_pick:{col}") * len(markers)) + 1).cast("int"))
    return df.withColumn(col, F.when(uniform(key, f"{salt}:{col}") < rate, pick)
                         .otherwise(F.col(col)))


def inject_junk(df: DataFrame, col: str, rate: float, junk: str, key: str,
                salt: str = "junk") -> DataFrame:
    """Overwrite a fraction of a text column with an unparseable token."""
    return df.withColumn(col, F.when(uniform(key, f"{salt}:{col}") < rate, F.lit(junk))
                         .otherwise(F.col(col)))


def inject_date_swaps(df: DataFrame, before: str, after: str, rate: float, key: str,
                      salt: str = "swap", max_days: int = 9,
                      fmt: str = "yyyy-MM-dd") -> DataFrame:
    """H5: on a fraction of rows set ``after`` 1..max_days days before ``before``
    (both text dates in ``fmt``)."""
    days = (F.floor(uniform(key, f"{salt}_days") * max_days) + 1).cast("int")
    swapped = F.date_format(F.date_sub(F.to_date(F.col(before), fmt), days), fmt)
    return df.withColumn(after, F.when(uniform(key, salt) < rate, swapped).otherwise(F.col(after)))


def label_from_score(df: DataFrame, weights: dict, key: str, noise_scale: float = 1.5,
                     salt: str = "noise", label: str = "label") -> DataFrame:
    """H6: sigmoid of a mean-centred linear score plus deterministic noise;
    1 where the probability is above its exact median, else 0."""
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
                 for c, w in weights.items()), F.lit(0.0))
    noise = (uniform(key, salt) - F.lit(0.5)) * F.lit(2.0 * noise_scale)
    scored = df.withColumn("__score", score)
    mean = scored.agg(F.avg("__score")).first()[0] or 0.0
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("__score") - F.lit(mean) + noise)))
    with_p = scored.withColumn("__p", prob)
    med = exact_quantiles(with_p.select(F.lit(0).alias("g"), "__p"), "g", "__p", [0.5])[0][0]
    return with_p.withColumn(label, (F.col("__p") > F.lit(med)).cast("int")).drop("__score", "__p")
