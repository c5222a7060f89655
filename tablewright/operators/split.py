"""Exact stratified train/test split and leakage checks.

``row_number() over (partition by class)`` puts a whole class in one task.
Instead each row gets a 52-bit hash of (key, seed); per class the test rows
are the ``quota`` smallest hashes.  The quota-th hash is found with the
histogram-refinement selector, so no task ever holds a whole class; rows tied
on the boundary hash (copies of one key) are split by a hash of the whole row.

Beyond ``MAX_CLASSES`` classes quotas and boundaries stay tables: the remainders are ranked
by a range partition, and the boundary hash of every class is found digit by digit with
joins, so nothing per class reaches the driver.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash52, row_content_key
from ..functions.quantiles import select_ranks
from ..session import drop_staged, staged, staged_if_derived
from .duplicates import repeated_groups

# Up to this many classes, quotas and boundary hashes live on the driver.
MAX_CLASSES = 10_000

#: Bits below each digit of a 52-bit hash, high digit first: a class has at most 2^18 cells a round.
DIGIT_SHIFTS = (34, 17, 0)


def test_quotas(class_counts: dict, test_size: float) -> dict:
    """ceil(test_size * n) test rows in total, allotted proportionally with
    largest remainders (ties: smaller class value first)."""
    n = sum(class_counts.values())
    if n == 0:
        return {}
    total = math.ceil(Fraction(str(test_size)) * n)
    base = {c: (total * k) // n for c, k in class_counts.items()}
    rem = {c: (total * k) % n for c, k in class_counts.items()}
    extra = total - sum(base.values())
    order = sorted(class_counts, key=lambda c: (-rem[c], c is None, c))
    for c in order[:extra]:
        base[c] += 1
    return base


def quota_table(classes: DataFrame, test_size: float) -> DataFrame:
    """``test_quotas`` for any number of classes: (``__cls``, ``__n``) -> (``__cls``, ``__quota``), as a
    stored table.  The remainders are ranked within the parts of a range partition; only one
    count a part comes to the driver."""
    n = classes.agg(F.sum("__n")).first()[0] or 0
    total = math.ceil(Fraction(str(test_size)) * n)
    share, whole = f"(CAST({total} AS DECIMAL(19,0)) * CAST(__n AS DECIMAL(18,0)))", f"CAST({max(n, 1)} AS DECIMAL(19,0))"
    order = [F.desc("__rem"), F.asc_nulls_last("__cls")]
    shares = classes.selectExpr("__cls", f"CAST({share} div {whole} AS BIGINT) AS __base", f"CAST({share} % {whole} AS BIGINT) AS __rem")
    parts = staged(shares.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "split-shares")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__base").alias("base")).orderBy("__part").collect()
    extra, before, offsets = total - sum(r["base"] for r in sizes), 0, []
    for r in sizes:
        offsets.append((r["__part"], before))
        before += r["n"]
    starts = classes.sparkSession.createDataFrame(offsets, "__part int, __start long")      # one row a part
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__start")
    quotas = staged(parts.join(F.broadcast(starts), "__part").select(
        "__cls", (F.col("__base") + (rank <= extra).cast("long")).alias("__quota")), "split-quotas")
    drop_staged(parts)
    return quotas


def boundary_table(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per class with a quota the hash of its quota-th row: (``__cls``, ``__h``, ``__quota``, ``__less``,
    ``__equal``), as a stored table.  ``counts``: (``__cls``, ``__h``, ``__c``).  One round a digit: cells of
    the rows that share the digits found so far are counted, the cell that holds the quota is kept."""
    state = quotas.where("__quota > 0").selectExpr("__cls AS __k", "__quota", "0L AS __prefix", "0L AS __less")
    held, above = None, 52
    for shift in DIGIT_SHIFTS:
        near = counts.join(state, F.col("__cls").eqNullSafe(F.col("__k"))).where(F.shiftright("__h", above) == F.col("__prefix"))
        cells = near.groupBy("__cls", "__quota", "__less", F.shiftright("__h", shift).alias("__p")).agg(F.sum("__c").alias("__equal"))
        upto = F.col("__less") + F.sum("__equal").over(Window.partitionBy("__cls").orderBy("__p"))
        found = cells.withColumn("__upto", upto).where("__upto >= __quota AND __upto - __equal < __quota")
        fresh = staged(found.selectExpr("__cls AS __k", "__quota", "__p AS __prefix", "__upto - __equal AS __less", "__equal"), "split-digits")
        if held is not None:
            drop_staged(held)
        held, above = fresh, shift
        state = fresh.drop("__equal")
    return held.withColumnsRenamed({"__k": "__cls", "__prefix": "__h"})


def _cut_table(hashed: DataFrame, target: str, test_size: float, keyed: bool) -> DataFrame:
    """The cut of every class with test rows, for any number of classes."""
    counts = staged(hashed.groupBy(F.col(target).alias("__cls"), "__h").agg(F.count(F.lit(1)).alias("__c")), "split-hashes")
    quotas = quota_table(counts.groupBy("__cls").agg(F.sum("__c").alias("__n")), test_size)
    found = boundary_table(counts, quotas).withColumn("__need", F.expr("__quota - __less"))
    drop_staged(counts)
    drop_staged(quotas)
    if keyed:
        return found.selectExpr("__cls", "__h AS __cut", "__need", "__need < __equal AS __rank_ties")
    return found.selectExpr("__cls", "IF(__equal - __need <= __need, __h, __h - 1) AS __cut", "__need", "false AS __rank_ties")


def _driver_cuts(hashed: DataFrame, target: str, test_size: float, stats: list, keyed: bool) -> tuple[list, bool]:
    """The cuts of at most ``MAX_CLASSES`` classes as rows, and whether any of them splits a tie."""
    counts = {r[0]: r["n"] for r in stats}
    bounds = {r[0]: (r["n"], float(r["lo"]), float(r["hi"])) for r in stats}
    quotas = test_quotas(counts, test_size)
    targets = {c: [q - 1] for c, q in quotas.items() if q > 0}
    cut = select_ranks(hashed.select(F.col(target).alias("__cls"), "__h"), "__cls", "__h", targets,
                       bounds=bounds, detail=True)
    rows, tied = [], False
    for c, q in quotas.items():
        if q <= 0:
            rows.append((c, -1, 0, False))
            continue
        value, n_less, n_equal = cut[(c, q - 1)]
        need = q - n_less                       # rows to take among those equal to the cut
        if not keyed:
            rows.append((c, int(value) if n_equal - need <= need else int(value) - 1, need, False))
            continue
        rank_ties = need < n_equal
        tied = tied or rank_ties
        rows.append((c, int(value), need, rank_ties))
    return rows, tied


def _split_ties(ties: DataFrame, cols: list) -> DataFrame:
    """Rows of the classes ``__cls`` that tie on the boundary hash, of which ``__need`` a class
    go to the test side (``__t``): those with the least hash of the whole row, found like the
    boundary itself.  What ties again, equal rows, is numbered within the parts of the stored
    ties, each part taking what the parts before it left.  No window holds more than a part or
    2^18 cells, however many rows share one key."""
    ties = ties.withColumn("__x", hash52(row_content_key(cols), "tie")).withColumn("__part", F.spark_partition_id())
    ties = staged(ties.select(*cols, "__cls", "__need", "__x", "__part"), "split-ties")
    counts = staged(ties.groupBy("__cls", F.col("__x").alias("__h")).agg(F.count(F.lit(1)).alias("__c")), "split-tie-hashes")
    found = boundary_table(counts, ties.groupBy("__cls").agg(F.max("__need").alias("__quota")))
    drop_staged(counts)
    cut = found.selectExpr("__cls AS __k", "__h AS __x_cut", "__quota - __less AS __take")
    j = ties.join(cut, F.col("__cls").eqNullSafe(F.col("__k")))
    equal = j.where("__x = __x_cut")
    sizes = equal.groupBy(F.col("__cls").alias("__c"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__size"))
    upto = F.sum("__size").over(Window.partitionBy("__c").orderBy("__p"))
    starts = sizes.select("__c", "__p", (upto - F.col("__size")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__cls", "__part").orderBy(F.lit(1))) + F.col("__start")
    shared = equal.join(starts, F.col("__cls").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p"))) \
        .withColumn("__t", place <= F.col("__take"))
    return j.where("__x <> __x_cut").withColumn("__t", F.col("__x") < F.col("__x_cut")).select(*cols, "__t") \
        .unionByName(shared.select(*cols, "__t"))


def stratified_split(df: DataFrame, target: str, test_size: float = 0.2, seed: int = 42,
                     key: str | None = None, split_col: str = "split") -> DataFrame:
    """Adds ``split`` ('train' | 'test').  ``key`` is a row key; without
    one the row content is the key, and equal rows always land on the same side:
    the group at a class's boundary goes whole to the side that brings the number
    of test rows nearer to its quota (ties: test).  Otherwise test rows of a class
    are exactly its ``quota`` smallest (hash of the key, hash of the row) pairs."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found in columns: {df.columns}")
    key_expr = F.col(key) if key else row_content_key(df.columns)
    hashed = df.withColumn("__h", hash52(key_expr, str(seed)))
    stats = (hashed.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.min("__h").alias("lo"),
                                        F.max("__h").alias("hi"))
             .limit(MAX_CLASSES + 1).collect())
    if len(stats) > MAX_CLASSES:
        cuts = _cut_table(hashed, target, test_size, key is not None)
        tied = not cuts.where("__rank_ties").isEmpty()
    else:
        rows, tied = _driver_cuts(hashed, target, test_size, stats, key is not None)
        cuts = F.broadcast(df.sparkSession.createDataFrame(
            rows, f"__cls {df.schema[target].dataType.simpleString()}, __cut long, __need long, __rank_ties boolean"))
    j = hashed.join(cuts, hashed[target].eqNullSafe(cuts["__cls"]), "left")
    simple = (F.col("__h") < F.col("__cut")) | ((F.col("__h") == F.col("__cut")) & ~F.col("__rank_ties"))
    if not tied:
        out = j.withColumn("__t", F.coalesce(simple, F.lit(False)))
    else:
        boundary = (F.col("__h") == F.col("__cut")) & F.col("__rank_ties")
        rest = j.filter(~F.coalesce(boundary, F.lit(False))) \
            .withColumn("__t", F.coalesce(simple, F.lit(False))).select(*df.columns, "__t")
        out = _split_ties(j.filter(boundary), df.columns).unionByName(rest)
    return out.withColumn(split_col, F.when(F.col("__t"), F.lit("test")).otherwise(F.lit("train"))) \
        .select(*df.columns, split_col)


def split_reconcile(original: DataFrame, split_df: DataFrame, split_col: str = "split") -> DataFrame:
    """Train + test must equal the original row count (one aggregate over
    the tagged union of both inputs)."""
    tagged = (original.select(F.lit(1).alias("__o"), F.lit(None).cast("string").alias("__s"))
              .unionByName(split_df.select(F.lit(0).alias("__o"), F.col(split_col).alias("__s"))))
    c = tagged.agg(F.coalesce(F.sum("__o"), F.lit(0)).cast("long").alias("n_original"),
                   F.coalesce(F.sum((F.col("__s") == "train").cast("long")), F.lit(0)).alias("n_train"),
                   F.coalesce(F.sum((F.col("__s") == "test").cast("long")), F.lit(0)).alias("n_test"))
    return c.select("n_original", "n_train", "n_test",
                    (F.col("n_original") == F.col("n_train") + F.col("n_test")).alias("complete"))


def cross_split_duplicates(split_df: DataFrame, cols=None, split_col: str = "split") -> DataFrame:
    """Content groups (NULL-safe) seen on both sides (true leak) and the
    reference's stricter count of every row with a duplicate anywhere.  Only rows whose
    fingerprint repeats are grouped by content."""
    cols = [c for c in (cols or split_df.columns) if c != split_col]
    rows = staged_if_derived(split_df.select(*cols, split_col), "leak-check")
    g = repeated_groups(rows, cols, (F.min(split_col) != F.max(split_col)).alias("__s"))
    return g.agg(
        F.coalesce(F.sum(F.when(F.col("__s"), F.col("__c"))), F.lit(0)).cast("long").alias("n_rows_cross_split"),
        F.coalesce(F.sum(F.col("__s").cast("long")), F.lit(0)).cast("long").alias("n_groups_cross_split"),
        F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("n_rows_duplicated_any"))


def split_key_overlap(split_df: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """Keys present on both sides (must be 0)."""
    per_key = split_df.groupBy(key).agg((F.min(split_col) != F.max(split_col)).alias("__s"))
    return per_key.agg(F.coalesce(F.sum(F.col("__s").cast("long")), F.lit(0)).cast("long")
                       .alias("n_keys_both_sides"),
                       F.count(F.lit(1)).cast("long").alias("n_keys"))
