"""Histogram boosting with a learned direction for missing values.

Features are cut once at exact ranks, so a row becomes a label, a margin and one small bin
number per feature (null where the value is missing), written to the shared folder.  A
level of a tree is one grouped aggregate of the gradient sums by (node, feature, bin); the
best cut of every node by every feature is picked in Spark, trying the missing rows on both
sides, and one row a node and feature comes back.  The sums are whole numbers (gradients in units of 2^-20), so the
trees do not depend on partitions, task order or retries.

Missing values (null, NaN) go to the side where the loss falls more; with none in the
node, or on a tie, to the low side.  Ties between cuts: earlier feature, lower threshold.
Rows without a label take no part; labels are 0 and 1.  A feature without any value is
never cut.  A table without rows, or without any value, is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import group_bounds, select_ranks
from ..session import drop_staged, staged
from .trees import Choice, Leaf

#: Gradients are summed in these units.
UNIT = float(1 << 20)

NODES_SCHEMA = ("round int, node int, feature string, threshold double, missing_low boolean, "
                "n_rows long, value double")


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 10
    max_depth: int = 5
    learning_rate: float = 0.3
    max_bins: int = 64
    l2: float = 1.0
    min_child: float = 1.0      # least sum of second derivatives on a side of a cut
    refresh: int = 1            # rounds after which the margins are written anew

    def __post_init__(self):
        if not (self.rounds >= 1 and 1 <= self.max_depth <= 12 and 2 <= self.max_bins <= 4096 and self.refresh >= 1):
            raise ValueError(f"boosting parameters out of range: {self}")


@dataclass
class BoostedModel:
    """``trees``: (weight, tree) as ``trees.margin_column`` takes them; ``nodes``: one row per
    node in NODES_SCHEMA (root 1, the sides of node i are 2i and 2i + 1; leaves have a value)."""
    features: list
    trees: list = field(default_factory=list)
    nodes: list = field(default_factory=list)


@dataclass(frozen=True)
class _Sums:
    g: int
    h: int
    n: int

    def minus(self, other: _Sums) -> _Sums:
        return _Sums(self.g - other.g, self.h - other.h, self.n - other.n)


@dataclass(frozen=True)
class _Cut:
    feature: int
    bin: int
    missing_low: bool


def cut_points(train: DataFrame, features: Sequence[str], max_bins: int) -> dict[int, list[float]]:
    """Thresholds by position of the feature: the values at ranks floor(k * n / max_bins)
    and the largest one, of the values that are neither null nor NaN."""
    values = train.select(F.posexplode(F.array(*[F.col(f"`{f}`").cast("double") for f in features])).alias("f", "v"))
    bounds = group_bounds(values, "f", "v")
    ranks = {f: {k * n // max_bins for k in range(1, max_bins)} | {n - 1} for f, (n, _, _) in bounds.items() if n}
    points: dict[int, set] = {}
    for (f, _), value in select_ranks(values, "f", "v", ranks, bounds=bounds).items():
        points.setdefault(f, set()).add(value)
    return {f: sorted(p) for f, p in points.items()}


def _double_sql(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _bin_sql(value: str, points: list[float]) -> str:
    """The position of the first threshold that is not below ``value``; null if missing."""
    def find(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {value} <= {_double_sql(points[mid])} THEN {find(lo, mid)} ELSE {find(mid + 1, hi)} END"
    return f"CAST(CASE WHEN {value} IS NULL OR isnan({value}) THEN NULL ELSE {find(0, len(points) - 1)} END AS SMALLINT)"


def _binned(train: DataFrame, target: str, features: Sequence[str], points: dict[int, list[float]]) -> DataFrame:
    values = train.where(F.col(f"`{target}`").isNotNull()).select(
        F.col(f"`{target}`").cast("double").alias("y"),
        *[F.col(f"`{features[f]}`").cast("double").alias(f"v{f}") for f in sorted(points)])
    return values.select("y", F.lit(0.0).alias("m"), *[F.expr(_bin_sql(f"v{f}", points[f])).alias(f"b{f}") for f in sorted(points)])


def _walk_sql(cuts: dict[int, _Cut], end, node: int = 1) -> str:
    """Where a binned row ends: ``end(node)`` of the uncut node that it reaches."""
    cut = cuts.get(node)
    if cut is None:
        return end(node)
    missing = -1 if cut.missing_low else 32767
    return (f"CASE WHEN coalesce(b{cut.feature}, {missing}) <= {cut.bin} THEN {_walk_sql(cuts, end, 2 * node)} "
            f"ELSE {_walk_sql(cuts, end, 2 * node + 1)} END")


def best_cuts(data: DataFrame, features: Sequence[int], node_sql: str, params: BoostParams) -> DataFrame:
    """One row per open node and feature: the node's sums and the feature's best cut (gain not
    above 0: none).  Two shuffles: cells of (node, feature, bin), then at most ``max_bins`` + 1
    cells a (node, feature)."""
    unit, l2, least = _double_sql(UNIT), _double_sql(float(params.l2)), _double_sql(float(params.min_child))

    def gain(g_low: str, h_low: str) -> str:
        gl, hl, ga, ha = (f"(CAST({c} AS DOUBLE) / {unit})" for c in (g_low, h_low, "g_all", "h_all"))
        return (f"CASE WHEN bin IS NOT NULL AND {hl} >= {least} AND {ha} - {hl} >= {least} THEN {gl} * {gl} / ({hl} + {l2}) + "
                f"({ga} - {gl}) * ({ga} - {gl}) / ({ha} - {hl} + {l2}) - {ga} * {ga} / ({ha} + {l2}) ELSE -1D END")

    sums = ", ".join(f"sum({s}) OVER side AS {s}_all, sum({s}) OVER upto AS {s}_low, first_value(IF(bin IS NULL, {s}, 0)) OVER upto AS {s}_missing"
                     for s in "ghn")                                    # the missing rows come first, so they count as low
    taken = ", ".join(f"IF(gain_low >= gain_high, {s}_low, {s}_low - {s}_missing) AS {s}_side" for s in "ghn")
    return data.sparkSession.sql(f"""
        WITH r AS (SELECT {node_sql} AS node, array({", ".join(f"b{f}" for f in features)}) AS bins,
            CAST(rint((p - y) * {unit}) AS BIGINT) AS g, CAST(rint(p * (1D - p) * {unit}) AS BIGINT) AS h
          FROM (SELECT *, 1D / (1D + exp(-m)) AS p FROM {{data}})),
        c AS (SELECT node, i, bin, sum(g) AS g, sum(h) AS h, count(1) AS n
          FROM (SELECT * FROM r WHERE node IS NOT NULL) LATERAL VIEW posexplode(bins) AS i, bin GROUP BY node, i, bin),
        w AS (SELECT node, i, bin, {sums} FROM c WINDOW side AS (PARTITION BY node, i),
          upto AS (PARTITION BY node, i ORDER BY bin NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        t AS (SELECT *, {gain("g_low", "h_low")} AS gain_low, {gain("g_low - g_missing", "h_low - h_missing")} AS gain_high FROM w),
        u AS (SELECT *, greatest(gain_low, gain_high) AS gain, gain_low >= gain_high AS missing_low, {taken} FROM t)
        SELECT node, i, best.* FROM (SELECT node, i, max_by(struct(gain, bin, missing_low, g_side, h_side, n_side, g_all, h_all, n_all),
          struct(gain, -bin)) AS best FROM u GROUP BY node, i)""", data=data)


def _grow(data: DataFrame, features: Sequence[int], params: BoostParams) -> tuple[dict[int, _Cut], dict[int, _Sums]]:
    """A tree's cuts and the sums of its nodes, a level per job."""
    cuts: dict[int, _Cut] = {}
    sums: dict[int, _Sums] = {}
    open_nodes = {1}
    for _ in range(params.max_depth):
        if not open_nodes:
            break
        where = _walk_sql(cuts, lambda n: str(n) if n in open_nodes else "NULL")  # noqa: B023 -- used at once
        best: dict = {}
        for r in best_cuts(data, features, where, params).collect():              # a row per node and feature
            held = best.get(r["node"])
            if held is None or (r["gain"], -r["i"]) > (held["gain"], -held["i"]):
                best[r["node"]] = r
        open_nodes = set()
        for node, r in best.items():
            total = sums[node] = _Sums(r["g_all"], r["h_all"], r["n_all"])
            if r["gain"] <= 0:
                continue
            cuts[node] = _Cut(features[r["i"]], r["bin"], r["missing_low"])
            low = _Sums(r["g_side"], r["h_side"], r["n_side"])
            for child, part in ((2 * node, low), (2 * node + 1, total.minus(low))):
                sums[child] = part
                if part.h >= 2 * params.min_child * UNIT:                         # else no cut leaves enough on both sides
                    open_nodes.add(child)
    return cuts, sums


def fit_boosted(train: DataFrame, target: str, features: Sequence[str], params: BoostParams = BoostParams()) -> BoostedModel:
    """Boosted trees with log-loss from margin 0.  Per level one scan of the binned table and a
    shuffle of at most nodes x features x bins rows a task."""
    features = list(features)
    labels = train.agg(F.count(F.col(f"`{target}`")).alias("n"),
                       F.coalesce(F.sum((~F.col(f"`{target}`").cast("double").isin(0.0, 1.0)).cast("long")), F.lit(0)).alias("odd")).first()
    if not labels["n"] or labels["odd"]:
        raise ValueError(f"{target!r} needs labels 0 and 1: {labels['n']} labels, {labels['odd']} of them others")
    points = cut_points(train.where(F.col(f"`{target}`").isNotNull()), features, params.max_bins) if features else {}
    if not points:
        raise ValueError("no feature has a value")
    used = sorted(points)
    model = BoostedModel(features)
    stored = data = staged(_binned(train, target, features, points), "boosting")
    try:
        for number in range(params.rounds):
            cuts, sums = _grow(data, used, params)
            value = {n: -(s.g / UNIT) / (s.h / UNIT + params.l2) * params.learning_rate for n, s in sums.items()}

            def tree(n, cuts=cuts, value=value):
                if n not in cuts:
                    return Leaf(value[n])
                c = cuts[n]
                return Choice(features[c.feature], points[c.feature][c.bin], tree(2 * n, cuts, value), tree(2 * n + 1, cuts, value), c.missing_low)

            model.trees.append((1.0, tree(1)))
            for n in sorted(sums):
                c = cuts.get(n)
                model.nodes.append((number, n, c and features[c.feature], c and points[c.feature][c.bin], c and c.missing_low,
                                    sums[n].n, None if c else value[n]))
            if number + 1 == params.rounds:
                break
            data = data.withColumn("m", F.col("m") + F.expr(_walk_sql(cuts, lambda n: _double_sql(value[n]))))  # noqa: B023
            if (number + 1) % params.refresh == 0:
                fresh = staged(data, "boosting")
                drop_staged(stored)
                stored = data = fresh
    finally:
        drop_staged(stored)
    return model
