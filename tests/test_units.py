"""Operator units: strategies, quantiles, fuzzy greedy vs brute force,
comparison table, gate loop, run/failure tables, plan shape."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions.quantiles import exact_quantiles
from tablewright.operators import clean as C
from tablewright.operators import compare as CP
from tablewright.operators import fuzzy as FZ
from tablewright.operators import gate as G
from tablewright.operators import runlog as RL
from tablewright.operators import split as SP
from tablewright.operators.freq import value_freq
from tablewright.plans.strategies import STRATEGY_LIBRARY, get_strategy


def test_strategy_names_unique_and_lookup():
    names = [s.name for s in STRATEGY_LIBRARY]
    assert len(names) == len(set(names)) == 3
    assert get_strategy("mean_wide_tolerance").iqr_multiplier == 3.0
    with pytest.raises(ValueError, match="valid options"):
        get_strategy("nope")


def test_exact_quantiles_multi_round(spark):
    random.seed(3)
    vals = [random.expovariate(1.0) ** 6 for _ in range(3000)] + [None]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    got = exact_quantiles(df, "g", "v", [0.25, 0.5, 0.75], bins=8, final_limit=50)["g"]
    s = sorted(v for v in vals if v is not None)

    def q(p):
        h = (len(s) - 1) * p
        k = int(h)
        return s[k] + (s[min(k + 1, len(s) - 1)] - s[k]) * (h - k)
    assert got == [q(0.25), q(0.5), q(0.75)]


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if ca == cb else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def _alike(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return 200 * _lcs(a, b) >= 80 * (len(a) + len(b))


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_clusters_meet_their_definition(spark, seed):
    random.seed(seed)
    base = ["full-time", "part-time", "self-employed", "unemployed", "contract", "active", "inactive"]
    vals = sorted({random.choice(base) + random.choice(["", " ", "s", "-x", "e"]) for _ in range(60)}
                  | {b.upper() for b in base})
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = FZ.greedy_clusters(FZ.similar_pairs(value_freq(df, ["c"]), 80)).collect()
    seed_of = {r["member"]: r["seed"] for r in got}
    seeds = [v for v in vals if seed_of.get(v, v) == v]
    assert not any(_alike(x, y) for x, y in itertools.combinations(seeds, 2))
    for v in vals:
        near = [x for x in seeds if x <= v and (x == v or _alike(x, v))]
        assert near and seed_of.get(v, v) == near[0]
    sizes = collections.Counter(seed_of.values())
    assert set(seed_of) == {v for v in vals if sizes[seed_of.get(v, v)] > 1} and 1 not in sizes.values()


def test_compare_and_status(spark):
    res = spark.createDataFrame([(1, "a", True, 0.70, 0.7, None, 10, 5, 3, 2, None),
                                 (2, "b", True, 0.60, 0.6, None, 10, 5, 3, 2, None),
                                 (3, "c", False, None, None, None, None, None, None, 5, None)],
                                CP.RESULT_SCHEMA)
    c = CP.compare_strategies(res, 0.65).first()
    assert (c["strategies_attempted"], c["strategies_succeeded"], c["best_strategy"]) == (3, 2, "a")
    assert c["improvement_over_baseline"] == 0.05
    st = {r["strategy_name"]: (r["status"], r["failure_reason"]) for r in CP.strategy_status(res, 0.65).collect()}
    assert st == {"a": ("PASS", None), "b": ("RAN (below baseline)", None), "c": ("FAIL", "Unknown failure")}


def test_first_passing_logs_attempts(spark):
    df = spark.createDataFrame([(1.0, None, 0), (2.0, 3.0, 1)], "a double, b double, target int")
    cands = [("keep nulls", lambda d: d), ("boom", lambda d: 1 / 0), ("fill", lambda d: d.fillna(0.0))]
    out, log = G.first_passing(df, cands, "target")
    rows = log.orderBy("attempt").collect()
    assert [r["passed"] for r in rows] == [False, False, True]
    assert "ZeroDivisionError" in rows[1]["violations"]
    assert out is not None and out.filter(F.col("b").isNull()).count() == 0


def test_run_report_and_failures(spark, tmp_path):
    runs = spark.createDataFrame([("t1", "PASS", 1, 1.0, None, None, None), ("t2", "FAIL", 5, 2.0, "x", "unknown", None),
                                  ("t3", "PASS", 2, 1.5, None, None, None)], RL.RUN_SCHEMA)
    r = RL.run_report(runs).first()
    assert (r["total_tests"], r["passed"], r["failed"], r["pass_rate"]) == (3, 2, 1, 0.6667)
    empty = RL.run_report(runs.limit(0)).first()
    assert empty["pass_rate"] == 0.0
    path = str(tmp_path / "failures")
    RL.record_failures(spark, path, [
        RL.failure(test_name="t2", failure_category="agent_exhaustion", n_rows=10),
        RL.failure(test_name="t4", failure_category="ambiguous_data", remediation_suggestions=["inspect_data"]),
        RL.failure(test_name="t5", failure_category="agent_exhaustion")])
    back = spark.read.schema(RL.FAILURE_SCHEMA).json(path)
    cats = [(r["failure_category"], r["n_failures"]) for r in RL.failures_by_category(back).collect()]
    assert cats == [("agent_exhaustion", 2), ("ambiguous_data", 1)]
    with pytest.raises(ValueError):
        RL.failure(failure_category="nonsense")
    with pytest.raises(ValueError):
        RL.failure(test="t")


def test_flagship_plan_shape(spark):
    """No cartesian product, no Python UDF in the hot path."""
    from tablewright.registry import QUERIES
    from conftest import SF001
    for name in ("column_profile", "null_profile", "dedup_full_row", "clip_iqr", "fuzzy_pairs", "stratified_split"):
        plan = QUERIES[name](__import__("conftest").spark.__wrapped__ if False else spark, SF001)._jdf \
            .queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name


def test_exact_quantiles_exponential_spacing(spark):
    """Equal-width bins alone stall on 2^-k; binade binning must converge."""
    vals = [2.0 ** -k for k in range(0, 1000)] + [-(2.0 ** k) for k in range(0, 300)] + [0.0, 0.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    got = exact_quantiles(df, "g", "v", [0.1, 0.5, 0.9], bins=16, final_limit=8)["g"]
    s = sorted(vals)

    def q(p):
        h = (len(s) - 1) * p
        k = int(h)
        return s[k] + (s[min(k + 1, len(s) - 1)] - s[k]) * (h - k)
    assert got == [q(0.1), q(0.5), q(0.9)]


@pytest.mark.parametrize("t", [60.0, 80.0, 92.0])
def test_similar_pairs_lossless_vs_brute_force(spark, t):
    random.seed(int(t))
    alpha = "aab cde-"
    vals = sorted({"".join(random.choice(alpha) for _ in range(random.randint(0, 9))) for _ in range(150)})
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    got = sorted((r["value_a"], r["value_b"]) for r in FZ.similar_pairs(value_freq(df, ["c"]), t).collect())

    def ratio(a, b):
        a, b = a.strip().lower(), b.strip().lower()
        return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))
    exp = sorted((a, b) for i, a in enumerate(vals) for b in vals[i + 1:] if ratio(a, b) >= t)
    assert got == exp


def test_scans_are_pruned_and_filters_pushed(spark):
    from conftest import SF001
    from tablewright.registry import QUERIES

    def scans(name):
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        return plan
    p = scans("inject_spellings")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in p
    from tablewright.operators.clean import drop_constant_columns
    some = spark.read.parquet(f"{SF001}/customer.parquet").filter("c_mktsegment = 'BUILDING'")
    p = drop_constant_columns(some)[0]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in p
    p = scans("value_counts_topk")
    assert "ReadSchema: struct<p_name:string>" in p
    for name in ("topk_per_column", "sample_values", "fuzzy_pairs", "fuzzy_clusters", "stratified_split",
                 "attempt_log_last", "dedup_keep_first"):
        assert _unpartitioned_windows(scans(name)) == 0, name


def _unpartitioned_windows(plan: str) -> int:
    """Window operators without PARTITION BY print two top-level [..] groups."""
    n = 0
    for line in plan.splitlines():
        i = line.find("Window [")
        if i < 0:
            continue
        depth = groups = 0
        for ch in line[i + len("Window "):]:
            if ch == "[":
                groups += depth == 0
                depth += 1
            elif ch == "]":
                depth -= 1
        n += groups < 3
    return n


def test_hot_key_third_of_rows(spark):
    """One key / value / class holds a third of all rows: results stay exact and
    the heavy operators are partial aggregates (map-side combine)."""
    from tablewright.operators.clean import drop_duplicates_by_key
    from tablewright.operators.split import stratified_split
    rows = [("hot", i, i % 2) for i in range(600)] + [(f"k{i}", i, i % 2) for i in range(1200)]
    df = spark.createDataFrame(rows, "key string, ord int, target int")
    first = drop_duplicates_by_key(df, "key", "ord")
    assert first.count() == 1201 and first.filter(F.col("key") == "hot").first()["ord"] == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan or "partial_" in plan
    vf = value_freq(df, ["key"])
    assert vf.filter(F.col("value") == "hot").first()["freq"] == 600
    big = spark.createDataFrame([(i, 0 if i % 3 else 1) for i in range(3000)], "id int, target int")
    sp = stratified_split(big, "target", 0.2, 42, key="id")
    assert sp.filter(F.col("split") == "test").count() == 600
    assert "Window" not in sp._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_merge_opt_in(spark):
    from tablewright.plans.cleaning import clean
    rows = [("full-time", 1.0, 0)] * 5 + [("fulltime", 2.0, 1)] * 2 + [("Full-Time ", 3.0, 0)] + \
           [("contract", 4.0, 1)] * 3 + [("part-time", 5.0, 0)] * 2
    df = spark.createDataFrame(rows, "kind string, x double, target int")
    exact = clean(df, target="target").df.columns
    fuzzy = clean(df, target="target", merge="fuzzy").df.columns
    # the exact spelling key already unifies full-time / fulltime / Full-Time
    assert "kind_fulltime" not in exact
    assert "kind_part_time" in fuzzy and "kind_fulltime" not in fuzzy


def test_approx_quantile_mode_runs(spark):
    from tablewright.operators.profile import column_profile
    df = spark.createDataFrame([(float(i), i % 5) for i in range(1000)], "v double, target int")
    rows = {r["column"]: r for r in column_profile(df, target="target", quantile_mode="approx").collect()}
    assert abs(rows["v"]["q1"] - 249.75) <= 2.0


def test_distinct_exact_for_wide_longs(spark):
    from tablewright.operators.profile import profile
    base = 2 ** 60
    df = spark.createDataFrame([(base + i, i % 2) for i in range(50)], "k long, target int")
    prof = profile(df, target="target")
    assert prof.stats["k"]["n_unique"] == 50      # as DOUBLE these collapse to a few values


def test_samples_follow_explicit_order(spark):
    """Q9: "first seen" needs an explicit ordering key; without one, values sort."""
    from tablewright.operators.freq import first_values
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["zeta", "alpha", "zeta", "mid", "beta", "alpha"])],
                               "pos int, c string")
    by_pos = [r["value"] for r in first_values(value_freq(df, ["c"], order_by="pos"), 3).orderBy("rank").collect()]
    by_val = [r["value"] for r in first_values(value_freq(df, ["c"]), 3).orderBy("rank").collect()]
    assert by_pos == ["zeta", "alpha", "mid"]
    assert by_val == ["alpha", "beta", "mid"]


def test_scale_conf_sizes_partitions():
    from tablewright.session import scale_conf
    conf = scale_conf(100 * 2 ** 40, cores=8000)          # 100 TB on 1000 x 8 cores
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_conf(10 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_injection_rates_and_label_balance(spark):
    from conftest import SF01
    from tablewright.operators import inject as I
    from tablewright.sources.tables import table
    o = table(spark, SF01, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    n = o.count()
    nulls = I.inject_nulls(o, ["o_totalprice"], 0.12, "o_orderkey").filter(F.col("o_totalprice").isNull()).count()
    assert abs(nulls / n - 0.12) < 0.02
    dup = I.inject_duplicates(o, 0.02, "o_orderkey").count() - n
    assert abs(dup / n - 0.02) < 0.01
    lab = I.label_from_score(o, {"o_totalprice": 0.00003, "o_custkey": 0.001}, "o_orderkey")
    ones = lab.filter(F.col("label") == 1).count()
    assert abs(ones - n / 2) <= 1                          # strictly above the exact median


def test_dates_are_read_each_by_its_own_format(spark):
    from tablewright.functions.dates import DAY_FIRST, parse_timestamp
    told = {"2024-01-05": "2024-01-05 00:00:00", "2024-1-5": "2024-01-05 00:00:00", " 2024/01/05 ": "2024-01-05 00:00:00",
            "05-01-2024": "2024-01-05 00:00:00", "2024-01-05T10:00:00": "2024-01-05 10:00:00",
            "2024-01-05T10:00:00+02:00": "2024-01-05 08:00:00", "2024-01-05 10:00:00.5": "2024-01-05 10:00:00.5",
            "01/05/2024": "2024-01-05 00:00:00", "Jan 5, 2024": "2024-01-05 00:00:00", "january 5, 2024": "2024-01-05 00:00:00",
            "5 JAN 2024": "2024-01-05 00:00:00", "13/05/2024": "2024-05-13 00:00:00", "2024": None, "2024-01": None, "2024-02-30": None,
            "Janch 5, 2024": None, "12:30:00": None, "": None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in told] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", parse_timestamp("t").cast("string")).collect()}
    assert got == {**told, None: None}
    day = df.where("t = '13/05/2024'").select(parse_timestamp("t", DAY_FIRST).cast("string"), parse_timestamp("t", ["dd/MM/yyyy"]).cast("string"))
    assert tuple(day.first()) == ("2024-05-13 00:00:00",) * 2


def test_date_violations_with_a_kind_per_side(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 1, 5), "2024-01-04"), (dt.date(2024, 1, 5), "unknown"), (dt.date(2024, 1, 5), "Jan 6, 2024")], "a date, b string")
    assert C.drop_date_violations(df, "a", "b").count() == 2 and C.drop_date_violations(df, "b", "a").count() == 2


def test_distinct_counts_of_zeros_nans_and_decimals(spark):
    from decimal import Decimal
    from tablewright.operators.profile import distinct_profile, profile
    rows = [(0.0, Decimal("1234567890123456789.00000000001")), (-0.0, Decimal("1234567890123456789.00000000002")), (float("nan"), None), (None, None)]
    df = spark.createDataFrame(rows, "x double, d decimal(30,11)")
    assert {r["column"]: r["n_unique"] for r in distinct_profile(df).collect()} == {"x": 1, "d": 2}
    assert {c: s["n_unique"] for c, s in profile(df).stats.items()} == {"x": 1, "d": 2}


def test_keyless_split_keeps_equal_rows_together(spark):
    df = spark.createDataFrame([(1, "a")] * 10 + [(i, "a") for i in range(2, 42)] + [(7, "b")] * 9, "v int, target string")
    out = SP.stratified_split(df, "target", 0.2, 42)
    assert out.count() == 59
    assert out.groupBy("v", "target").agg(F.countDistinct("split").alias("s")).where("s > 1").count() == 0


def test_gate_with_very_many_labels(spark):
    df = spark.range(25000).select(F.col("id").alias("target"), F.col("id").cast("double").alias("x"))
    rows = {r["check"]: r for r in G.run_gate(df, df.withColumn("target", F.col("target") + 100), "target").collect()}
    assert rows["target_values"]["observed"] == "100" and not rows["target_values"]["passed"]
    assert {r["check"]: r for r in G.run_gate(df, df, "target").collect()}["target_values"]["passed"]


def test_profile_counts_distincts_exactly_unless_told_otherwise(spark):
    from tablewright.operators.profile import column_profile
    df = spark.range(30000).select(F.concat(F.lit("v"), F.col("id")).alias("t"))
    exact = column_profile(df).first()
    assert exact["n_unique"] == 30000 and "distinct_approx" not in exact
    assert column_profile(df, distinct_mode="approx").first()["distinct_approx"]


def test_few_distinct_values_are_told_apart(spark):
    from tablewright.operators.profile import profile
    rows = [(float(i % 2), float(i % 3), 5, "x", "xy"[i % 2], None) for i in range(9)] + [(None, float("nan"), None, None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d string, e string, f string")
    got = {c: s["n_unique"] for c, s in profile(df, distinct_mode="few").stats.items()}
    assert got == {"a": 2, "b": 3, "c": 1, "d": 1, "e": 2, "f": 0}


def test_ranks_of_many_groups_over_rounds(spark):
    from tablewright.functions.quantiles import select_ranks
    rows = [(g, float((i * 37 + g * 11) % (5 + 13 * g)) ** (1 + g % 3)) for g in range(60) for i in range(120)]
    by = {g: sorted(v for h, v in rows if h == g) for g in range(60)}
    df = spark.createDataFrame([*rows, *[(3, None)] * 9, *[(4, float("nan"))] * 9], "g int, v double")
    targets = {g: [0, 17, 59, 60, 119] for g in range(60)}
    got = select_ranks(df, "g", "v", targets, bins=4, final_limit=10, detail=True)
    assert got == {(g, r): (by[g][r], sum(x < by[g][r] for x in by[g]), by[g].count(by[g][r])) for g in targets for r in targets[g]}
