"""Exact order statistics without putting a whole column in one task.

``percentile`` (exact) keeps every distinct value of a group in one aggregation
buffer and merges them in one task; at 100 TB that is a single-task OOM.
``select_ranks`` instead narrows each requested rank by equal-width histogram
rounds: every round is one scan + a partial aggregate whose output is at most
``bins`` rows per open range, of which Spark picks the bins that hold a rank, so
the driver gets one row a rank.  When
the bin that holds a rank has at most ``final_limit`` values, those values are
sorted inside one (bounded) group and the exact element is picked there.

Linear interpolation between the two ranks around ``(n - 1) * q`` is computed
as ``lo + (hi - lo) * frac`` -- the same arithmetic as DuckDB's
``quantile_cont`` and Spark's ``percentile``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


@dataclass
class _Range:
    rid: int
    group: object
    lo: float
    hi: float
    below: int                      # number of group values strictly before this range
    ranks: list = field(default_factory=list)
    size: int = 0                   # number of group values inside the range
    linear: bool = True             # equal-width bins (else binade bins)


def _binade(x):
    """floor(log2(|x|)) -- monotone (non-strict) in |x|."""
    return F.floor(F.log2(F.abs(x))).cast("int")


def _bin_expr(bins: int):
    """Bin of ``v`` inside its open range [lo, hi] (monotone in v).

    Ranges start with equal-width bins.  A range whose linear round did not
    shrink it at least 4x (and that spans several binades) is next binned by
    a monotone (sign, exponent) code, so exponentially spaced data cannot
    stall; inside one binade doubles are evenly spaced and equal-width bins
    shrink the range 1024x per round, so at most ~6 rounds remain."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    scaled = F.floor((v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5) * F.lit(float(bins))).cast("int")
    linear_bin = F.least(F.greatest(scaled, F.lit(0)), F.lit(bins - 1))
    code = (F.when(v == F.lit(-INF), F.lit(0))
            .when(v == F.lit(INF), F.lit(9999))
            .when(v < 0, F.lit(1100) - _binade(v))
            .when(v == 0, F.lit(2200))
            .otherwise(F.lit(3300) + _binade(v)))
    return (F.when(hi == lo, F.lit(0))
            .when(F.col("linear"), F.when(v == hi, F.lit(bins - 1)).otherwise(linear_bin))
            .otherwise(code))


def _same_binade(lo: float, hi: float) -> bool:
    if lo == hi:
        return True
    if not (math.isfinite(lo) and math.isfinite(hi)) or lo == 0 or hi == 0 or (lo < 0) != (hi < 0):
        return False
    return math.frexp(abs(lo))[1] == math.frexp(abs(hi))[1]


def _ranges_df(spark, ranges, group_type):
    schema = T.StructType([
        T.StructField("rid", T.IntegerType()),
        T.StructField("g", group_type),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("linear", T.BooleanType()),
    ])
    return spark.createDataFrame([(r.rid, r.group, float(r.lo), float(r.hi), r.linear)
                                  for r in ranges], schema)


def group_bounds(long_df: DataFrame, group_col: str, value_col: str) -> dict:
    """count / min / max of the non-null values of every group (one job)."""
    base = _base(long_df, group_col, value_col)
    rows = base.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"),
                                 F.max("v").alias("hi")).collect()
    return {r["g"]: (r["n"], r["lo"], r["hi"]) for r in rows}


def _base(long_df, group_col, value_col):
    v = F.col(value_col).cast("double")
    return (long_df.select(F.col(group_col).alias("g"), v.alias("v"))
            .filter(F.col("v").isNotNull() & ~F.isnan(F.col("v"))))


def select_ranks(long_df: DataFrame, group_col: str, value_col: str, targets: dict,
                 bounds: dict | None = None, bins: int = 1024,
                 final_limit: int = 1_000_000, max_rounds: int = 40, detail: bool = False) -> dict:
    """Exact values at 0-based ``ranks`` (ascending order) of each group.

    targets: {group: iterable of ranks}.  Returns {(group, rank): value}, or
    with ``detail`` {(group, rank): (value, n_less, n_equal)} where n_less /
    n_equal count the group's values below / equal to the value.
    """
    spark = long_df.sparkSession
    base = _base(long_df, group_col, value_col)
    group_type = long_df.schema[group_col].dataType
    if bounds is None:
        bounds = group_bounds(long_df, group_col, value_col)
    result: dict = {}
    open_ranges: list[_Range] = []
    final: list[_Range] = []
    for g, ranks in targets.items():
        ranks = sorted(set(int(r) for r in ranks))
        if not ranks or g not in bounds:
            continue
        n, lo, hi = bounds[g]
        if n == 0:
            continue
        if lo == hi:
            for r in ranks:
                result[(g, r)] = (lo, 0, n)
            continue
        if n <= final_limit:
            final.append(_Range(0, g, lo, hi, 0, ranks, n))
        else:
            open_ranges.append(_Range(len(open_ranges), g, lo, hi, 0, ranks, n))

    rounds = 0
    while open_ranges:
        rounds += 1
        if rounds > max_rounds:   # cannot happen: binade + linear binning needs ~8 rounds
            raise RuntimeError("rank selection did not converge; refusing to sort an unbounded group")
        rdf = F.broadcast(_ranges_df(spark, open_ranges, group_type))
        joined = base.join(rdf, base.g.eqNullSafe(rdf.g) & (base.v >= rdf.lo) & (base.v <= rdf.hi))
        cells = (joined.select("rid", _bin_expr(bins).alias("bin"), "v")
                 .groupBy("rid", "bin")
                 .agg(F.count("v").alias("cnt"), F.min("v").alias("bmin"), F.max("v").alias("bmax")))
        # the bin of each rank is picked in Spark: one row a (range, rank) comes back, not every bin
        upto = F.sum("cnt").over(Window.partitionBy("rid").orderBy("bin"))
        cells = cells.select("rid", "cnt", "bmin", "bmax", (upto - F.col("cnt")).alias("before"))
        local = spark.createDataFrame([(r.rid, rank, rank - r.below) for r in open_ranges for rank in r.ranks],
                                      "of int, rank long, local long")
        picked = cells.join(F.broadcast(local), (F.col("rid") == F.col("of")) & (F.col("local") >= F.col("before")) &
                            (F.col("local") < F.col("before") + F.col("cnt"))).collect()
        nxt: dict[tuple, _Range] = {}
        sizes: dict[tuple, int] = {}
        for row in picked:
            rng, r, bmin, bmax = open_ranges[row["rid"]], row["rank"], row["bmin"], row["bmax"]
            if bmin == bmax:
                result[(rng.group, r)] = (bmin, rng.below + row["before"], row["cnt"])
                continue
            key = (rng.group, bmin, bmax, rng.below + row["before"])
            if key not in nxt:
                # a linear round that did not shrink the range 4x
                # switches it to binade bins (bounded rounds)
                stalled = rng.linear and row["cnt"] * 4 > rng.size
                linear = _same_binade(bmin, bmax) or not stalled
                nxt[key] = _Range(0, rng.group, bmin, bmax, rng.below + row["before"], [], row["cnt"], linear)
                sizes[key] = row["cnt"]
            nxt[key].ranks.append(r)
        open_ranges = []
        for key, rng in nxt.items():
            if sizes[key] <= final_limit:
                final.append(rng)
            else:
                rng.rid = len(open_ranges)
                open_ranges.append(rng)

    if final:
        # each final range holds <= final_limit values: one bounded sort per range
        for i, rng in enumerate(final):
            rng.rid = i
        rdf = F.broadcast(_ranges_df(spark, final, group_type))
        joined = base.join(rdf, base.g.eqNullSafe(rdf.g) & (base.v >= rdf.lo) & (base.v <= rdf.hi)) \
            .select("rid", "v")
        w = Window.partitionBy("rid").orderBy("v")
        ranked = (joined.withColumn("pos", F.row_number().over(w))
                  .withColumn("first", F.rank().over(w))
                  .withColumn("n_eq", F.count(F.lit(1)).over(Window.partitionBy("rid", "v"))))
        picks = [(rng.rid, r, r - rng.below + 1) for rng in final for r in rng.ranks]
        pdf = F.broadcast(spark.createDataFrame(picks, "rid int, rank long, pos int"))
        rows = ranked.join(pdf, ["rid", "pos"]).select("rid", "rank", "v", "first", "n_eq").collect()
        by_rid = {rng.rid: rng for rng in final}
        for row in rows:
            rng = by_rid[row["rid"]]
            result[(rng.group, row["rank"])] = (row["v"], rng.below + row["first"] - 1, row["n_eq"])
    if detail:
        return result
    return {k: v[0] for k, v in result.items()}


def exact_quantiles(long_df: DataFrame, group_col: str, value_col: str, probs,
                    bounds: dict | None = None, **kw) -> dict:
    """{group: [quantile for each prob]} with linear interpolation."""
    if bounds is None:
        bounds = group_bounds(long_df, group_col, value_col)
    targets, plan = {}, {}
    for g, (n, lo, hi) in bounds.items():
        if not n:
            continue
        for q in probs:
            h = (n - 1) * q
            k = int(math.floor(h))
            k2 = min(k + 1, n - 1)
            targets.setdefault(g, set()).update({k, k2})
            plan[(g, q)] = (k, k2, h - k)
    vals = select_ranks(long_df, group_col, value_col, targets, bounds=bounds, **kw)
    out = {}
    for g, (n, lo, hi) in bounds.items():
        if not n:
            out[g] = [None for _ in probs]
            continue
        row = []
        for q in probs:
            k, k2, frac = plan[(g, q)]
            a, b = vals[(g, k)], vals[(g, k2)]
            row.append(a if k2 == k or frac == 0 else a + (b - a) * frac)
        out[g] = row
    return out


def approx_quantiles(long_df: DataFrame, group_col: str, value_col: str, probs,
                     accuracy: int = 10000) -> dict:
    """One-pass approximate alternative (``percentile_approx``)."""
    base = _base(long_df, group_col, value_col)
    rows = base.groupBy("g").agg(
        F.percentile_approx("v", list(probs), accuracy).alias("qs")).collect()
    return {r["g"]: list(r["qs"]) for r in rows}
