"""DuckDB SQL twin of every registered query that SQL can express."""

from __future__ import annotations

from . import sqlgen as S
from .sources import messy as M

ORACLE: dict[str, str] = {}

MESSY_EVENTS_COLUMNS = [
    ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "temporal"),
    ("user_id", "bigint", "numeric"), ("event_type", "string", "text"),
    ("value", "double", "numeric"), ("props", "string", "text"),
]

ORACLE["column_profile"] = S.column_profile_sql(S.messy_events_sql(), MESSY_EVENTS_COLUMNS)

MO = S.messy_orders_sql()
MO_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice", "target"]
MO_TEXT = ["o_orderpriority", "order_date", "ship_date"]

ORACLE["dataset_shape"] = f"SELECT count(*) AS n_rows, 7 AS n_columns FROM {MO}"

ORACLE["null_profile"] = f"WITH m AS (SELECT * FROM {MO}) " + S.union_per_column(
    S.MO_COLS, lambda i, c: f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS null_count,
    CASE WHEN count(*) > 0 THEN {S.rhu(f'CAST(100 AS DOUBLE) * (count(*) - count({c})) / CAST(count(*) AS DOUBLE)', 2)} ELSE 0.0 END AS null_pct FROM m""")

ORACLE["distinct_profile"] = f"WITH m AS (SELECT * FROM {MO}) " + S.union_per_column(
    S.MO_COLS, lambda i, c: f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM m""")

ORACLE["sample_values"] = f"""WITH m AS (SELECT * FROM {MO}),
v AS ({S.union_per_column(MO_TEXT, lambda i, c: f"SELECT DISTINCT '{c}' AS col, {c} AS value FROM m WHERE {c} IS NOT NULL")})
SELECT col AS "column", CAST(rn AS INTEGER) AS rank, value FROM (
  SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) AS rn FROM v) WHERE rn <= 8"""

ORACLE["numeric_summary"] = f"WITH m AS (SELECT * FROM {MO}) " + S.union_per_column(
    MO_NUMERIC, lambda i, c: f"""SELECT '{c}' AS "column", {S.rhu(f'min(CAST({c} AS DOUBLE))', 2)} AS min_value,
    {S.rhu(f'max(CAST({c} AS DOUBLE))', 2)} AS max_value, {S.rhu(f'avg(CAST({c} AS DOUBLE))', 2)} AS mean_value FROM m""")


def _iqr_sql(view: str, cols, mult: float = 1.5) -> str:
    qs = S.union_per_column(cols, lambda i, c: f"""SELECT '{c}' AS col, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM m""")
    outs = S.union_per_column(cols, lambda i, c: f"""SELECT '{c}' AS col, count(*) FILTER (WHERE CAST({c} AS DOUBLE) < b.lo OR CAST({c} AS DOUBLE) > b.hi) AS n
        FROM m, (SELECT lo, hi FROM b WHERE col = '{c}') b""")
    return f"""WITH m AS (SELECT * FROM {view}), q AS ({qs}),
b AS (SELECT col, q1, q3, q1 - {mult} * (q3 - q1) AS lo, q3 + {mult} * (q3 - q1) AS hi FROM q),
o AS ({outs})
SELECT b.col AS "column", {S.rhu('b.q1', 4)} AS q1, {S.rhu('b.q3', 4)} AS q3, {S.rhu('b.lo', 4)} AS lower_bound,
  {S.rhu('b.hi', 4)} AS upper_bound, CAST(o.n AS BIGINT) AS outlier_count FROM b JOIN o ON b.col = o.col"""


ORACLE["iqr_outliers"] = _iqr_sql(MO, MO_NUMERIC)

ORACLE["duplicate_row_count"] = f"""SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_distinct_rows,
  CAST(sum(c - 1) AS BIGINT) AS n_duplicate_rows
FROM (SELECT {', '.join(S.MO_COLS)}, count(*) AS c FROM {MO} GROUP BY ALL)"""

_DD_COLS = MO_TEXT + ["promised_date"]
ORACLE["detect_date_columns"] = f"""WITH m AS (SELECT *, CASE WHEN {S.u('o_orderkey', 'junk:promised_date')} < 0.15 THEN 'n/a'
  ELSE order_date END AS promised_date FROM {MO}) """ + S.union_per_column(
    _DD_COLS, lambda i, c: f"""SELECT '{c}' AS "column",
    CASE WHEN count(*) > 0 THEN {S.rhu(f'CAST(count({S.parse_ts(c)}) AS DOUBLE) / count(*)', 4)} END AS parse_rate,
    coalesce(CAST(count({S.parse_ts(c)}) AS DOUBLE) / count(*) >= 0.9, false) AS is_date FROM m""")

ORACLE["date_order_conflicts"] = """SELECT * FROM (
  SELECT 'o_orderdate' AS col_a, 'l_shipdate' AS col_b,
    CAST(coalesce(sum(CASE WHEN o_orderdate > l_shipdate THEN 1 ELSE 0 END), 0) AS BIGINT) AS a_after_b,
    CAST(coalesce(sum(CASE WHEN l_shipdate > o_orderdate THEN 1 ELSE 0 END), 0) AS BIGINT) AS b_after_a
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE a_after_b > 0 AND b_after_a > 0"""

ORACLE["value_counts_topk"] = """SELECT p_name AS value, count(*) AS freq FROM part WHERE p_name IS NOT NULL
GROUP BY p_name ORDER BY freq DESC, value LIMIT 10"""

ORACLE["topk_per_column"] = """WITH v AS (
  SELECT 'p_name' AS col, p_name AS value, count(*) AS freq FROM part WHERE p_name IS NOT NULL GROUP BY p_name
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand
  UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_type IS NOT NULL GROUP BY p_type)
SELECT col AS "column", CAST(rn AS INTEGER) AS rank, value, freq FROM (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY freq DESC, value) AS rn FROM v) WHERE rn <= 5"""

MO_NORM = f"(SELECT * REPLACE ({S.missing_case('o_orderpriority')} AS o_orderpriority, {S.missing_case('order_date')} AS order_date, {S.missing_case('ship_date')} AS ship_date) FROM {MO})"

ORACLE["impute_statistics"] = f"""WITH m AS (SELECT * FROM {MO_NORM})
SELECT 'o_custkey' AS "column", {S.rhu('avg(CAST(o_custkey AS DOUBLE))', 4)} AS mean_value,
  {S.rhu('quantile_cont(CAST(o_custkey AS DOUBLE), 0.5)', 4)} AS median_value, CAST(NULL AS VARCHAR) AS mode_value FROM m
UNION ALL SELECT 'o_totalprice', {S.rhu('avg(o_totalprice)', 4)}, {S.rhu('quantile_cont(o_totalprice, 0.5)', 4)}, NULL FROM m
UNION ALL SELECT 'o_orderpriority', NULL, NULL, (SELECT o_orderpriority FROM m WHERE o_orderpriority IS NOT NULL
  GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)"""

# ------------------------------------------------------------------ cleaning
ORACLE["failsafe_drop_strings"] = f"SELECT o_orderkey, o_custkey, o_totalprice, target FROM {MO}"
ORACLE["drop_all_null_cols"] = f"SELECT o_orderkey, o_totalprice, o_orderpriority, order_date, ship_date, target FROM {MO}"
ORACLE["drop_constant_cols"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["normalize_missing_literals"] = f"SELECT * FROM {MO_NORM}"

_VIOL = f"coalesce({S.parse_ts('order_date')} > {S.parse_ts('ship_date')}, false)"
ORACLE["drop_date_order_violations"] = f"SELECT * FROM {MO} WHERE NOT {_VIOL}"
ORACLE["flag_date_order_violations"] = f"SELECT *, CAST({_VIOL} AS INTEGER) AS date_order_violation FROM {MO}"

_DEC = S.u("o_orderkey", "decorate")
ORACLE["binary_label_from_text"] = f"""SELECT o_orderkey, CAST(regexp_replace(trim(status_text), '\\.+$', '') = 'F' AS INTEGER) AS target
FROM (SELECT o_orderkey, CASE WHEN {_DEC} < 0.3 THEN o_orderstatus || '.' WHEN {_DEC} < 0.5 THEN ' ' || o_orderstatus || ' '
  ELSE o_orderstatus END AS status_text FROM orders)"""

ORACLE["dedup_full_row"] = f"SELECT DISTINCT * FROM {MO}"
ORACLE["dedup_keep_first"] = """SELECT doc_id, lang, source, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)"""
ORACLE["normalize_categories"] = f"SELECT o_orderkey, lower(trim(o_orderpriority)) AS o_orderpriority FROM {MO}"

MO_NORM_TEXT = f"(SELECT * REPLACE (lower(trim(o_orderpriority)) AS o_orderpriority) FROM {MO_NORM})"


def canonical_sql(view: str, col: str) -> str:
    """Spelling-key canonical map applied to one column of a view."""
    return f"""(WITH cm_src AS (SELECT * FROM {view}),
cm_vf AS (SELECT {col} AS value, count(*) AS freq FROM cm_src WHERE {col} IS NOT NULL GROUP BY {col}),
cm_k AS (SELECT value, freq, regexp_replace(lower(trim(value)), '[\\s_\\-]+', '', 'g') AS k FROM cm_vf),
cm_c AS (SELECT k, value AS canonical FROM (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY freq DESC, value) AS rn FROM cm_k) WHERE rn = 1),
cm_map AS (SELECT cm_k.value, cm_c.canonical FROM cm_k JOIN cm_c USING (k))
SELECT cm_src.* REPLACE (coalesce(cm_map.canonical, cm_src.{col}) AS {col}) FROM cm_src LEFT JOIN cm_map ON cm_src.{col} = cm_map.value)"""


ORACLE["apply_canonical_map"] = f"SELECT o_orderkey, o_orderpriority FROM {canonical_sql(MO_NORM_TEXT, 'o_orderpriority')}"

ORACLE["impute_median"] = f"""WITH m AS (SELECT * FROM {MO})
SELECT o_orderkey, {S.rhu('coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM m))', 4)} AS o_custkey,
  {S.rhu('coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM m))', 4)} AS o_totalprice FROM m"""
ORACLE["impute_mean"] = f"""WITH m AS (SELECT * FROM {MO})
SELECT o_orderkey, {S.rhu('coalesce(CAST(o_custkey AS DOUBLE), (SELECT avg(CAST(o_custkey AS DOUBLE)) FROM m))', 4)} AS o_custkey,
  {S.rhu('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM m))', 4)} AS o_totalprice FROM m"""
ORACLE["impute_mode"] = f"""WITH m AS (SELECT * FROM {MO_NORM_TEXT})
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM m WHERE o_orderpriority IS NOT NULL
  GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority FROM m"""


def clip_sql(c: str, mult: float, src: str = "m") -> str:
    v = f"CAST({c} AS DOUBLE)"
    q1 = f"(SELECT quantile_cont({v}, 0.25) FROM {src})"
    q3 = f"(SELECT quantile_cont({v}, 0.75) FROM {src})"
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({v}, {q1} - {mult} * ({q3} - {q1})), "
            f"{q3} + {mult} * ({q3} - {q1})) END")


ORACLE["clip_iqr"] = f"""WITH m AS (SELECT * FROM {MO})
SELECT o_orderkey, {S.rhu(clip_sql('o_custkey', 1.5), 4)} AS o_custkey, {S.rhu(clip_sql('o_totalprice', 1.5), 4)} AS o_totalprice FROM m"""


def epoch_sql(col: str) -> str:
    ts = S.parse_ts(col)
    return (f"(CAST(CAST({ts} AS DATE) - DATE '1970-01-01' AS DOUBLE) * 86400.0 + "
            f"CAST(hour({ts}) * 3600 + minute({ts}) * 60 + second({ts}) AS DOUBLE))")


ORACLE["date_to_epoch"] = f"""WITH m AS (SELECT o_orderkey, {epoch_sql('order_date')} AS order_date, {epoch_sql('ship_date')} AS ship_date FROM {MO_NORM})
SELECT o_orderkey, coalesce(order_date, (SELECT quantile_cont(order_date, 0.5) FROM m)) AS order_date,
  coalesce(ship_date, (SELECT quantile_cont(ship_date, 0.5) FROM m)) AS ship_date FROM m"""

ORACLE["rare_category_grouping"] = """WITH vf AS (SELECT p_name, count(*) AS freq FROM part WHERE p_name IS NOT NULL GROUP BY p_name),
top AS (SELECT p_name FROM vf ORDER BY freq DESC, p_name LIMIT 10)
SELECT p_partkey, CASE WHEN p_name IS NULL THEN NULL WHEN (SELECT count(*) FROM vf) <= 50 THEN p_name
  WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'other' END AS p_name FROM part"""

ORACLE["one_hot_encode"] = """SELECT c_custkey,
  CAST(coalesce(c_mktsegment = 'BUILDING', false) AS INTEGER) AS c_mktsegment_BUILDING,
  CAST(coalesce(c_mktsegment = 'FURNITURE', false) AS INTEGER) AS c_mktsegment_FURNITURE,
  CAST(coalesce(c_mktsegment = 'HOUSEHOLD', false) AS INTEGER) AS c_mktsegment_HOUSEHOLD,
  CAST(coalesce(c_mktsegment = 'MACHINERY', false) AS INTEGER) AS c_mktsegment_MACHINERY FROM customer"""

# ---------------------------------------------------------------------- gate
ORACLE["gate_nulls"] = f"""WITH m AS (SELECT * FROM {MO_NORM}) SELECT * FROM (
  SELECT 'o_orderpriority' AS "column", CAST(count(*) - count(o_orderpriority) AS BIGINT) AS null_count FROM m
  UNION ALL SELECT 'order_date', CAST(count(*) - count(order_date) AS BIGINT) FROM m
  UNION ALL SELECT 'ship_date', CAST(count(*) - count(ship_date) AS BIGINT) FROM m
  UNION ALL SELECT 'o_orderkey', CAST(count(*) - count(o_orderkey) AS BIGINT) FROM m) WHERE null_count > 0"""

ORACLE["gate_duplicates"] = f"""SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_distinct_rows,
  CAST(sum(c - 1) AS BIGINT) AS n_duplicate_rows
FROM (SELECT o_orderkey, o_custkey, o_totalprice, lower(trim(o_orderpriority)) AS p, order_date, ship_date, target,
  count(*) AS c FROM {MO} GROUP BY ALL)"""

_DROPV = f"(SELECT * FROM {MO} WHERE NOT {_VIOL})"
ORACLE["gate_target_values"] = f"""SELECT (SELECT count(DISTINCT target) FROM {MO}) AS n_original_values,
  (SELECT count(DISTINCT target) FROM {_DROPV}) AS n_result_values,
  (SELECT count(*) FROM (SELECT DISTINCT target FROM {_DROPV} WHERE target IS NOT NULL
     EXCEPT SELECT DISTINCT target FROM {MO} WHERE target IS NOT NULL)) AS n_unexpected_values"""

ORACLE["row_retention"] = f"""WITH r AS (SELECT (SELECT count(*) FROM {MO}) AS raw_rows,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DROPV})) AS clean_rows)
SELECT raw_rows, clean_rows,
  CASE WHEN raw_rows > 0 THEN CAST(floor(1000.0 * clean_rows / raw_rows + 0.5) AS DOUBLE) / 10.0 ELSE 0.0 END AS retention_pct,
  (CASE WHEN raw_rows > 0 THEN CAST(floor(1000.0 * clean_rows / raw_rows + 0.5) AS DOUBLE) / 10.0 ELSE 0.0 END) < 90.0 AS below_threshold
FROM r"""

_GATE_RES = f"""(SELECT DISTINCT * FROM (SELECT o_orderkey,
  coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM {MO_NORM})) AS o_custkey,
  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM {MO_NORM})) AS o_totalprice,
  o_orderpriority, order_date, ship_date, target FROM {MO_NORM}) WHERE NOT {_VIOL})"""
ORACLE["gate_report"] = f"""WITH r AS (SELECT * FROM {_GATE_RES})
SELECT 'numeric' AS "check", 'o_orderpriority' AS "column", 'non-numeric' AS observed, false AS passed
UNION ALL SELECT 'numeric', 'order_date', 'non-numeric', false
UNION ALL SELECT 'numeric', 'ship_date', 'non-numeric', false
UNION ALL SELECT * FROM (
  SELECT 'nulls' AS "check", 'o_orderpriority' AS "column", CAST(count(*) - count(o_orderpriority) AS VARCHAR) AS observed, false AS passed FROM r
  UNION ALL SELECT 'nulls', 'order_date', CAST(count(*) - count(order_date) AS VARCHAR), false FROM r
  UNION ALL SELECT 'nulls', 'ship_date', CAST(count(*) - count(ship_date) AS VARCHAR), false FROM r
  UNION ALL SELECT 'nulls', 'o_totalprice', CAST(count(*) - count(o_totalprice) AS VARCHAR), false FROM r
  UNION ALL SELECT 'nulls', 'o_custkey', CAST(count(*) - count(o_custkey) AS VARCHAR), false FROM r
  UNION ALL SELECT 'nulls', 'o_orderkey', CAST(count(*) - count(o_orderkey) AS VARCHAR), false FROM r) WHERE observed <> '0'
UNION ALL SELECT 'duplicates', NULL, '0', true
UNION ALL SELECT 'not_empty', NULL, CAST(count(*) AS VARCHAR), true FROM r
UNION ALL SELECT 'target_present', 'target', 'True', true
UNION ALL SELECT 'target_values', 'target', '0', true"""

# --------------------------------------------------------------------- split
LABELS_SPLIT = S.split_sql("labels", "doc_id", "quality")
ORACLE["stratified_split"] = f"SELECT * FROM {LABELS_SPLIT}"
ORACLE["split_row_reconcile"] = f"""SELECT (SELECT count(*) FROM labels) AS n_original,
  CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS n_test,
  (SELECT count(*) FROM labels) = count(*) AS complete FROM {LABELS_SPLIT}"""
_LI = ("(SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)"
       " || '-' || CAST(l_suppkey AS VARCHAR) || '-' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS lkey,"
       " l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)")
ORACLE["cross_split_duplicates"] = f"""SELECT
  CAST(coalesce(sum(CASE WHEN s > 1 THEN c END), 0) AS BIGINT) AS n_rows_cross_split,
  CAST(coalesce(sum(CASE WHEN s > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_groups_cross_split,
  CAST(coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS BIGINT) AS n_rows_duplicated_any
FROM (SELECT l_returnflag, l_linestatus, l_quantity, l_discount, count(*) AS c, count(DISTINCT split) AS s
  FROM {S.split_sql(_LI, 'lkey', 'l_returnflag')} GROUP BY ALL)"""
ORACLE["split_key_overlap"] = f"""SELECT CAST(coalesce(sum(CASE WHEN s > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_keys_both_sides,
  CAST(count(*) AS BIGINT) AS n_keys FROM (SELECT doc_id, count(DISTINCT split) AS s FROM {LABELS_SPLIT} GROUP BY doc_id)"""

# ----------------------------------------------------------------- injection
ORACLE["inject_nulls"] = f"""SELECT event_id,
  CASE WHEN {S.u('event_id', 'null:event_type')} < 0.12 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN {S.u('event_id', 'null:value')} < 0.12 THEN NULL ELSE value END AS value FROM events"""
ORACLE["inject_outliers"] = f"""SELECT event_id, CASE WHEN {S.u('event_id', 'outlier:value')} < 0.03
  THEN value * CAST(15 AS DOUBLE) ELSE value END AS value FROM events"""
ORACLE["inject_duplicates"] = f"""SELECT event_id, user_id, event_type, value FROM events
UNION ALL SELECT event_id, user_id, event_type, value FROM events WHERE {S.u('event_id', 'dup')} < 0.02"""
ORACLE["inject_spellings"] = f"""SELECT o_orderkey, {S.spellings_case('o_orderpriority', M.PRIORITY_VARIANTS, 'o_orderkey')} AS o_orderpriority FROM orders"""
_SWAPD = f"CAST(floor({S.u('o_orderkey', 'swap_days')} * 9) + 1 AS INTEGER)"
ORACLE["inject_date_swaps"] = f"""SELECT o_orderkey, order_date, CASE WHEN {S.u('o_orderkey', 'swap')} < 0.05
  THEN strftime(CAST(strptime(order_date, '%Y-%m-%d') AS DATE) - {_SWAPD}, '%Y-%m-%d') ELSE ship_date END AS ship_date
FROM ({S.orders_dates_sql()})"""
ORACLE["label_from_score"] = f"""WITH s AS (SELECT o_orderkey,
    (CAST(0.0 AS DOUBLE) + coalesce(CAST(o_totalprice AS DOUBLE), 0.0) * CAST('3e-05' AS DOUBLE))
      + coalesce(CAST(o_custkey AS DOUBLE), 0.0) * CAST('0.001' AS DOUBLE) AS score,
    ({S.u('o_orderkey', 'noise')} - 0.5) * CAST(3.0 AS DOUBLE) AS noise FROM orders),
p AS (SELECT o_orderkey, 1.0 / (1.0 + exp(-(score - (SELECT avg(score) FROM s) + noise))) AS p FROM s)
SELECT o_orderkey, CAST(p > (SELECT quantile_cont(p, 0.5) FROM p) AS INTEGER) AS label FROM p"""

# ------------------------------------------------------------------- sources
ORACLE["scan_csv_roundtrip"] = f"SELECT * FROM {MO}"
ORACLE["quarantine_bad_rows"] = f"""SELECT event_id, event_type,
  CASE WHEN {S.u('event_id', 'corrupt')} < 0.05 THEN NULL ELSE value END AS value,
  {S.u('event_id', 'corrupt')} < 0.05 AS quarantined FROM events"""

# ---------------------------------------------------------------------- runs
_RUNS = """(SELECT source AS test_id,
  CASE WHEN count(*) = count(DISTINCT text) AND count(l.doc_id) = count(*) THEN 'PASS' ELSE 'FAIL' END AS status,
  1 AS attempts, count(*) - count(DISTINCT text) AS n_duplicate_texts, count(*) - count(l.doc_id) AS n_unlabelled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)"""
ORACLE["run_report"] = f"""SELECT count(*) AS total_tests, CAST(count(*) FILTER (WHERE status = 'PASS') AS BIGINT) AS passed,
  CAST(count(*) FILTER (WHERE status <> 'PASS') AS BIGINT) AS failed,
  CASE WHEN count(*) > 0 THEN CAST(floor(count(*) FILTER (WHERE status = 'PASS') / count(*) * 10000.0 + 0.5) AS DOUBLE) / 10000.0 ELSE 0.0 END AS pass_rate
FROM {_RUNS}"""
ORACLE["failures_by_category"] = f"""SELECT failure_category, count(*) AS n_failures FROM (
  SELECT test_id, 'duplicate_text' AS failure_category FROM {_RUNS} WHERE n_duplicate_texts > 0
  UNION ALL SELECT test_id, 'unlabelled_documents' FROM {_RUNS} WHERE n_unlabelled > 0)
GROUP BY failure_category ORDER BY n_failures DESC, failure_category"""
ORACLE["attempt_log_last"] = """SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS n_chars, n_attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n_attempts
  FROM conversations) WHERE rn = 1"""
ORACLE["run_history_rollup"] = f"""SELECT status, count(*) AS n_runs, CAST(sum(n_duplicate_texts) AS BIGINT) AS n_duplicate_texts,
  CAST(sum(n_unlabelled) AS BIGINT) AS n_unlabelled FROM {_RUNS} GROUP BY status"""

# --------------------------------------------------------------------- fuzzy
def lcs_sql(a: str, b: str) -> str:
    return f"""(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_reduce(string_split({a}, ''),
  lambda prev, ch: list_reduce(range(1, length({b}) + 1), lambda cur, j: list_append(cur,
      CASE WHEN substr({b}, CAST(j AS INTEGER), 1) = ch THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]),
  list_transform(range(0, length({b}) + 1), lambda x: 0))[-1] END)"""


def ratio_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE CAST(200 AS DOUBLE) * {lcs_sql(a, b)}"
            f" / CAST(length({a}) + length({b}) AS DOUBLE) END)")


def pairs_sql(view: str, col: str, threshold: float = 80) -> str:
    """Similar pairs over the distinct values of one column, ranked by value."""
    return f"""(WITH fz_v AS (SELECT value, row_number() OVER (ORDER BY value) AS r, lower(trim(value)) AS n
  FROM (SELECT DISTINCT {col} AS value FROM {view} WHERE {col} IS NOT NULL)),
fz_p AS (SELECT x.value AS a, y.value AS b, x.r AS ra, y.r AS rb, {ratio_sql('x.n', 'y.n')} AS ratio
  FROM fz_v x JOIN fz_v y ON x.r < y.r)
SELECT * FROM fz_p WHERE ratio >= {threshold})"""


def clusters_sql(view: str, col: str, threshold: float = 80) -> str:
    """Reference greedy clustering as a recursive walk over the values in order."""
    return f"""(WITH RECURSIVE fc_v AS (SELECT value, row_number() OVER (ORDER BY value) AS r
  FROM (SELECT DISTINCT {col} AS value FROM {view} WHERE {col} IS NOT NULL)),
fc_p AS (SELECT * FROM {pairs_sql(view, col, threshold)}),
fc_walk(step, seeds) AS (
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT w.step + 1, CASE WHEN EXISTS (SELECT 1 FROM fc_p p WHERE p.b = v.value AND list_contains(w.seeds, p.a))
    THEN w.seeds ELSE list_append(w.seeds, v.value) END
  FROM fc_walk w JOIN fc_v v ON v.r = w.step + 1),
fc_seeds AS (SELECT unnest(seeds) AS s FROM (SELECT seeds FROM fc_walk ORDER BY step DESC LIMIT 1)),
fc_m AS (SELECT p.b AS member, arg_min(p.a, p.ra) AS seed FROM fc_p p JOIN fc_seeds ON p.a = fc_seeds.s
  WHERE p.b NOT IN (SELECT s FROM fc_seeds) GROUP BY p.b)
SELECT '{col}' AS "column", seed, member FROM fc_m
UNION SELECT '{col}', seed, seed FROM fc_m)"""


ORACLE["fuzzy_pairs"] = f"""SELECT 'p_name' AS "column", a AS value_a, b AS value_b, {S.rhu('ratio', 4)} AS ratio
FROM {pairs_sql('part', 'p_name')}"""
ORACLE["fuzzy_clusters"] = f"SELECT * FROM {clusters_sql('part', 'p_name')}"
ORACLE["fuzzy_clusters_wide"] = f"SELECT * FROM {clusters_sql('supplier', 's_name')}"


def _issues_sql() -> str:
    m = "mi"
    nulls = " UNION ALL ".join(
        f"SELECT 'missing', '{c}', count(*) - count({c}) FROM {m}"
        for c in ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "order_date", "ship_date"])
    outs = " UNION ALL ".join(
        f"SELECT 'outliers', col, outlier_count FROM ({_iqr_sql(m, [c])}) x(col, q1, q3, lo, hi, outlier_count)"
        for c in ["o_orderkey", "o_custkey", "o_totalprice"])
    viol = (f"SELECT 'date_order', 'order_date,ship_date', least(sum(CASE WHEN a > b THEN 1 ELSE 0 END), "
            f"sum(CASE WHEN b > a THEN 1 ELSE 0 END)) FROM (SELECT {S.parse_ts('order_date')} AS a, "
            f"{S.parse_ts('ship_date')} AS b FROM {m})")
    dups = (f"SELECT 'duplicates' AS issue, '*' AS \"column\", sum(c - 1) AS n FROM (SELECT {', '.join(S.MO_COLS)}, count(*) AS c "
            f"FROM {m} GROUP BY ALL)")
    fz = f"SELECT 'fuzzy_groups', 'o_orderpriority', count(DISTINCT seed) FROM {clusters_sql(m, 'o_orderpriority')}"
    return (f"WITH {m} AS (SELECT * FROM {MO}) SELECT issue, \"column\", CAST(n AS BIGINT) AS n FROM ("
            f"{dups} UNION ALL {viol} UNION ALL {nulls} UNION ALL {outs} UNION ALL {fz}) WHERE n > 0")


ORACLE["profile_issues"] = _issues_sql()
ORACLE["profile_size"] = f"""SELECT CAST(coalesce(sum(length(issue || ' ' || "column" || ' ' || CAST(n AS VARCHAR)) + 1), 0) AS BIGINT) AS n_chars,
  CAST(coalesce(sum(length(issue || ' ' || "column" || ' ' || CAST(n AS VARCHAR)) + 1), 0) // 4 AS BIGINT) AS n_tokens_est,
  count(*) AS n_issues, 7 AS n_columns, false AS wide_table FROM ({_issues_sql()})"""

# ------------------------------------------------------------ encode / align
ORACLE["align_columns"] = f"""WITH base AS (SELECT c_custkey, c_acctbal, n_name, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS target,
    CASE WHEN c_nationkey < 10 THEN 'train' WHEN c_nationkey > 14 THEN 'test'
      WHEN {S.u('c_custkey', 'side')} < 0.5 THEN 'train' ELSE 'test' END AS side
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
firsts AS (SELECT side, min(n_name) AS first FROM base GROUP BY side),
vocab AS (SELECT DISTINCT b.side, b.n_name FROM base b JOIN firsts f ON b.side = f.side WHERE b.n_name <> f.first),
feats AS (SELECT DISTINCT n_name, 'n_name_' || regexp_replace(n_name, '[^0-9A-Za-z_]', '_', 'g') AS feature FROM vocab)
SELECT c_custkey, side AS split, 'c_acctbal' AS feature, CAST(c_acctbal AS DOUBLE) AS value FROM base
UNION ALL SELECT c_custkey, side, 'target', CAST(target AS DOUBLE) FROM base
UNION ALL SELECT b.c_custkey, b.side, f.feature,
  CASE WHEN b.n_name = f.n_name AND EXISTS (SELECT 1 FROM vocab v WHERE v.side = b.side AND v.n_name = f.n_name)
    THEN 1.0 ELSE 0.0 END FROM base b CROSS JOIN feats f"""


# --------------------------------------------------------------------- clean
def clean_sql(policy: str, mult, threshold: int, k: int) -> str:
    """SQL twin of plans.cleaning.clean on the messy orders view (decisions a
    profile makes there -- no all-null or constant columns, both dates are
    date columns, order_date precedes ship_date -- are checked by their own
    queries)."""
    stat = (lambda c, src: f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {src})") if policy == "median" \
        else (lambda c, src: f"(SELECT avg(CAST({c} AS DOUBLE)) FROM {src})")
    clip = ("SELECT * FROM k6" if mult is None else
            f"SELECT * REPLACE ({clip_sql('o_custkey', mult, 'k6')} AS o_custkey, "
            f"{clip_sql('o_totalprice', mult, 'k6')} AS o_totalprice) FROM k6")
    return f"""WITH k2 AS (SELECT DISTINCT * FROM {MO_NORM}),
k3 AS (SELECT * REPLACE (lower(trim(o_orderpriority)) AS o_orderpriority) FROM k2),
k4 AS (SELECT * FROM {canonical_sql('k3', 'o_orderpriority')}),
k5 AS (SELECT * FROM k4 WHERE NOT {_VIOL}),
k6a AS (SELECT * REPLACE ({epoch_sql('order_date')} AS order_date, {epoch_sql('ship_date')} AS ship_date) FROM k5),
k6 AS (SELECT * REPLACE (coalesce(order_date, (SELECT quantile_cont(order_date, 0.5) FROM k6a)) AS order_date,
  coalesce(ship_date, (SELECT quantile_cont(ship_date, 0.5) FROM k6a)) AS ship_date) FROM k6a),
k7 AS ({clip}),
k8 AS (SELECT * REPLACE (coalesce(CAST(o_custkey AS DOUBLE), {stat('o_custkey', 'k7')}) AS o_custkey,
  coalesce(CAST(o_totalprice AS DOUBLE), {stat('o_totalprice', 'k7')}) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM k7 WHERE o_orderpriority IS NOT NULL
    GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority) FROM k7),
k8vf AS (SELECT o_orderpriority AS value, count(*) AS freq FROM k8 WHERE o_orderpriority IS NOT NULL GROUP BY 1),
k8top AS (SELECT value FROM k8vf ORDER BY freq DESC, value LIMIT {k}),
k9 AS (SELECT * REPLACE (CASE WHEN o_orderpriority IS NULL THEN NULL WHEN (SELECT count(*) FROM k8vf) <= {threshold}
  THEN o_orderpriority WHEN o_orderpriority IN (SELECT value FROM k8top) THEN o_orderpriority ELSE 'other' END
  AS o_orderpriority) FROM k8),
k10 AS (SELECT DISTINCT * FROM k9),
feats AS (SELECT value, 'o_orderpriority_' || regexp_replace(value, '[^0-9A-Za-z_]', '_', 'g') AS feature
  FROM (SELECT DISTINCT o_orderpriority AS value FROM k9 WHERE o_orderpriority IS NOT NULL)
  WHERE value <> (SELECT min(o_orderpriority) FROM k9))
SELECT o_orderkey, 'o_custkey' AS feature, {S.rhu('o_custkey', 4)} AS value FROM k10
UNION ALL SELECT o_orderkey, 'o_totalprice', {S.rhu('o_totalprice', 4)} FROM k10
UNION ALL SELECT o_orderkey, 'order_date', {S.rhu('order_date', 4)} FROM k10
UNION ALL SELECT o_orderkey, 'ship_date', {S.rhu('ship_date', 4)} FROM k10
UNION ALL SELECT o_orderkey, 'target', CAST(target AS DOUBLE) FROM k10
UNION ALL SELECT o_orderkey, f.feature, CASE WHEN k10.o_orderpriority = f.value THEN 1.0 ELSE 0.0 END
  FROM k10 CROSS JOIN feats f"""


ORACLE["clean_conservative_median"] = clean_sql("median", 1.5, 50, 10)
ORACLE["clean_mean_wide_tolerance"] = clean_sql("mean", 3.0, 50, 20)
ORACLE["clean_tight_grouping_high_temp"] = clean_sql("median", 1.5, 30, 5)

# --------------------------------------------------------------------- model
DOCF = """(SELECT d.doc_id, d.n_chars, lang, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _r4(e: str) -> str:
    return f"(CAST(floor(({e}) * 10000.0 + 0.5) AS DOUBLE) / 10000.0)"


def _f1(tp: str, fp: str, fn: str) -> str:
    return f"(CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN CAST(2.0 AS DOUBLE) * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END)"


ORACLE["f1_accuracy"] = f"""WITH d AS (SELECT * FROM {DOCF}), p AS (SELECT quality,
  CAST(n_chars >= (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.5) FROM d) AS INTEGER) AS prediction FROM d),
c AS (SELECT CAST(sum(CASE WHEN quality = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN quality = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN quality = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN quality = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM p)
SELECT {_r4(_f1('tp', 'fp', 'fn'))} AS f1_score,
  {_r4('CAST(tp + tn AS DOUBLE) / CAST(greatest(tp + fp + fn + tn, 1) AS DOUBLE)')} AS accuracy, tp, fp, fn, tn FROM c"""

_RULES = [(1, "n_chars_q25", 0.25), (2, "n_chars_median", 0.5), (3, "n_chars_q75", 0.75)]
_RULE_RESULTS = "(" + " UNION ALL ".join(f"""SELECT {pos} AS position, '{name}' AS strategy_name, true AS succeeded,
  {_r4(_f1('tp', 'fp', 'fn'))} AS f1_score, {_r4('CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE)')} AS accuracy,
  CAST(NULL AS VARCHAR) AS failure_reason FROM (SELECT
    sum(CASE WHEN quality = 1 AND n_chars >= t THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND n_chars >= t THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN quality = 1 AND n_chars < t THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN quality = 0 AND n_chars < t THEN 1 ELSE 0 END) AS tn
  FROM {DOCF}, (SELECT quantile_cont(CAST(n_chars AS DOUBLE), {q}) AS t FROM {DOCF}))""" for pos, name, q in _RULES) + ")"
_BASE = f"(SELECT {_r4(_f1('pos', 'neg', '0'))} FROM (SELECT sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS neg FROM {DOCF}))"

ORACLE["compare_strategies"] = f"""WITH r AS (SELECT * FROM {_RULE_RESULTS}), b AS (SELECT {_BASE} AS base)
SELECT b.base AS baseline_f1, count(*) AS strategies_attempted,
  count(*) FILTER (WHERE succeeded AND f1_score IS NOT NULL) AS strategies_succeeded,
  arg_max(strategy_name, struct_pack(f1 := f1_score, p := -position)) FILTER (WHERE succeeded AND f1_score IS NOT NULL) AS best_strategy,
  max(f1_score) FILTER (WHERE succeeded) AS best_f1,
  CASE WHEN max(f1_score) FILTER (WHERE succeeded) IS NOT NULL THEN {_r4('max(f1_score) FILTER (WHERE succeeded) - b.base')} END AS improvement_over_baseline
FROM r, b GROUP BY b.base"""

ORACLE["strategy_status"] = f"""WITH r AS (SELECT * FROM {_RULE_RESULTS}), b AS (SELECT {_BASE} AS base)
SELECT position, strategy_name,
  CASE WHEN NOT (succeeded AND f1_score IS NOT NULL) THEN 'FAIL' WHEN {_r4('f1_score - b.base')} >= 0 THEN 'PASS'
    ELSE 'RAN (below baseline)' END AS status,
  CASE WHEN succeeded AND f1_score IS NOT NULL THEN {_r4('f1_score - b.base')} END AS delta,
  CASE WHEN succeeded AND f1_score IS NOT NULL THEN f1_score >= b.base END AS beat_baseline,
  CASE WHEN NOT succeeded THEN coalesce(failure_reason, 'Unknown failure') END AS failure_reason
FROM r, b"""

# ------------------------------------------- wide text, content split, mixed dates
ORACLE["merge_spellings_wide"] = f"SELECT o_orderkey, code FROM {canonical_sql(S.spelled_orders_sql(), 'code')}"
ORACLE["column_profile_wide"] = S.column_profile_sql(S.spelled_orders_sql(), [
    ("o_orderkey", "bigint", "numeric"), ("o_totalprice", "double", "numeric"), ("code", "string", "text")])
ORACLE["split_by_content"] = f"SELECT * FROM {S.content_split_sql('events', ['event_type', 'user_id'], 'event_type')}"
ORACLE["detect_mixed_dates"] = f"""SELECT 'written' AS "column", {S.rhu('count(told) / CAST(count(*) AS DOUBLE)', 4)} AS parse_rate,
  count(told) / CAST(count(*) AS DOUBLE) >= 0.9 AS is_date FROM {S.mixed_dates_sql()}"""
ORACLE["mixed_dates_to_epoch"] = f"SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', told) AS DOUBLE) * 86400 AS written FROM {S.mixed_dates_sql()}"

# ------------------------------------------------------- dates by column grammar
_WD = "(SELECT *, CAST(o_orderdate AS DATE) AS d, day(o_orderdate) AS dd, month(o_orderdate) AS mm, o_orderkey % 11 = 0 AS junk FROM orders)"
ORACLE["date_grammar"] = f"""WITH w AS {_WD}, g AS (
  SELECT 'european' AS "column", count(d) AS n_dates, count(*) FILTER (dd > 12) AS n_day_first, 0 AS n_month_first FROM w
  UNION ALL SELECT 'american', count(d), 0, count(*) FILTER (dd > 12) FROM w
  UNION ALL SELECT 'iso', count(*) FILTER (NOT junk), 0, 0 FROM w
  UNION ALL SELECT 'any', count(d), 0, 0 FROM w)
SELECT "column", n_dates, CAST(n_day_first AS BIGINT) AS n_day_first, CAST(n_month_first AS BIGINT) AS n_month_first,
  CASE WHEN n_day_first > n_month_first THEN 'day first' WHEN n_month_first > n_day_first THEN 'month first' ELSE 'by separator' END AS date_order FROM g"""
ORACLE["date_signatures"] = f"""WITH w AS {_WD}
SELECT 'european' AS "column", '99/99/9999' AS signature, count(*) AS n, count(*) AS n_dates FROM w
UNION ALL SELECT 'american', CASE WHEN mm > 9 THEN '99' ELSE '9' END || '-' || CASE WHEN dd > 9 THEN '99' ELSE '9' END || '-9999', count(*), count(*) FROM w GROUP BY 2
UNION ALL SELECT 'iso', CASE WHEN junk THEN '' ELSE '9999-99-99 99:99' END, count(*), count(*) FILTER (NOT junk) FROM w GROUP BY junk"""
ORACLE["written_dates_to_epoch"] = f"""WITH w AS (SELECT *, CAST(date_diff('day', DATE '1970-01-01', d) AS DOUBLE) * 86400 AS t FROM {_WD})
SELECT o_orderkey, t AS european, t AS american, CASE WHEN NOT junk THEN t END AS iso, t AS "any" FROM w"""

# ------------------------------------------------------- CSV in splits, encodings
ORACLE["scan_csv_multiline"] = "SELECT doc_id, text, lang FROM documents"
_LINES = r"(SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS wide FROM documents WHERE NOT regexp_matches(text, '[^\x{00}-\x{FF}]'))"
ORACLE["csv_encodings"] = f"""WITH d AS {_LINES}, n AS (
  SELECT 'utf8' AS written, count(*) AS n_lines, count(*) FILTER (wide) AS n_wide, 0 AS n_bad FROM d
  UNION ALL SELECT 'latin1', count(*), 0, count(*) FILTER (wide) FROM d
  UNION ALL SELECT 'mixed', count(*), count(*) FILTER (wide AND doc_id % 2 = 0), count(*) FILTER (wide AND doc_id % 2 <> 0) FROM d)
SELECT written, n_lines, n_wide, CAST(n_bad AS BIGINT) AS n_bad, n_bad > 0 AND n_bad >= 0.9 * (n_bad + n_wide) AS wrong_encoding FROM n"""

# ------------------------------------ deterministic columns of gate and model runs
ORACLE["first_passing_attempts"] = f"""WITH m AS (SELECT * FROM {MO}),
i AS (SELECT * REPLACE (coalesce(CAST(o_custkey AS DOUBLE), (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM m)) AS o_custkey,
  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM m)) AS o_totalprice) FROM m),
d AS (SELECT DISTINCT * FROM i),
t AS (SELECT 1 AS attempt, 'impute_only' AS candidate, * FROM i UNION ALL SELECT 2, 'dedup_and_impute', * FROM d),
n AS (SELECT attempt, candidate, count(*) - count(o_orderpriority) AS p, count(*) - count(order_date) AS o, count(*) - count(ship_date) AS s,
  count(*) - (SELECT count(*) FROM d) AS dup FROM t GROUP BY 1, 2)
SELECT attempt, candidate, false AS passed, concat_ws('; ', 'numeric:o_orderpriority=non-numeric', 'numeric:order_date=non-numeric',
  'numeric:ship_date=non-numeric', CASE WHEN p > 0 THEN 'nulls:o_orderpriority=' || p END, CASE WHEN o > 0 THEN 'nulls:order_date=' || o END,
  CASE WHEN s > 0 THEN 'nulls:ship_date=' || s END, CASE WHEN dup > 0 THEN 'duplicates:None=' || dup END) AS violations FROM n
UNION ALL SELECT 3, 'clean_conservative_median', true, ''"""
_LABELLED = "(SELECT doc_id, quality, lang, source FROM documents JOIN labels USING (doc_id))"
ORACLE["train_gbt"] = f"""WITH s AS (SELECT * FROM {S.split_sql(_LABELLED, 'doc_id', 'quality')}),
v AS (SELECT DISTINCT split, 'lang' AS c, lower(trim(lang)) AS v FROM s UNION SELECT DISTINCT split, 'source', lower(trim(source)) FROM s),
f AS (SELECT DISTINCT c, v FROM (SELECT *, min(v) OVER (PARTITION BY split, c) AS first FROM v) WHERE v > first)
SELECT 20 AS n_trees, CAST(3 + (SELECT count(*) FROM f) AS INTEGER) AS n_features, count(*) AS n_train_rows FROM s WHERE split = 'train'"""

# ---------------------------------------- one round of boosting, two levels of sixteen bins
def _boosting_level(level: int) -> str:
    """The best cut of every node of ``n{level}``, and the rows one level down."""
    return f"""
s{level} AS (SELECT node, f, thr, ml, count(*) FILTER (low) AS nl, sum(g) FILTER (low) AS gl, sum(h) FILTER (low) AS hl,
    count(*) AS na, sum(g) AS ga, sum(h) AS ha, count(*) FILTER (v <= thr AND (prev IS NULL OR v > prev)) AS here
  FROM (SELECT n.*, e.f, e.x AS thr, e.prev, m.ml, CASE e.f WHEN 0 THEN x0 ELSE x1 END AS v, coalesce(v <= thr, ml) AS low
    FROM n{level} n CROSS JOIN e CROSS JOIN (SELECT unnest([true, false]) AS ml) m)
  GROUP BY node, f, thr, ml),
k{level} AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain
  FROM s{level} WHERE here > 0 AND hl >= 1 AND ha - hl >= 1),
c{level} AS (SELECT * FROM k{level} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, thr, ml DESC) = 1),
n{level + 1} AS (SELECT n.* REPLACE (CASE WHEN coalesce(CASE c.f WHEN 0 THEN x0 ELSE x1 END <= c.thr, c.ml) THEN 2 * node ELSE 2 * node + 1 END AS node)
  FROM n{level} n JOIN c{level} c USING (node))"""


_FIRST_TREE = f"""WITH n0 AS (SELECT 1 AS node, CAST(o_custkey AS DOUBLE) AS x0, o_totalprice AS x1, target,
    CAST(0.5 AS DOUBLE) - target AS g, CAST(0.25 AS DOUBLE) AS h FROM {MO} WHERE target IS NOT NULL),
r AS (SELECT f, x, row_number() OVER (PARTITION BY f ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY f) AS n
  FROM (SELECT 0 AS f, x0 AS x FROM n0 UNION ALL SELECT 1, x1 FROM n0) WHERE x IS NOT NULL),
e AS (SELECT *, lag(x) OVER (PARTITION BY f ORDER BY x) AS prev FROM (
  SELECT f, x FROM r WHERE i = n - 1 UNION SELECT f, x FROM r JOIN (SELECT unnest(range(1, 16)) AS k) ON i = k * n // 16)),
{_boosting_level(0)}, {_boosting_level(1)},
l AS (SELECT * FROM n0 WHERE node NOT IN (SELECT node FROM c0) UNION ALL SELECT * FROM n1 WHERE node NOT IN (SELECT node FROM c1) UNION ALL SELECT * FROM n2),
w AS (SELECT node, count(*) AS n_rows, -sum(g) / (sum(h) + 1) * CAST(0.3 AS DOUBLE) AS value FROM l GROUP BY node)"""
ORACLE["boosting_first_tree"] = f"""{_FIRST_TREE}
SELECT node, CASE f WHEN 0 THEN 'o_custkey' ELSE 'o_totalprice' END AS feature, thr AS threshold, ml AS missing_low, na AS n_rows, CAST(NULL AS DOUBLE) AS value
FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1)
UNION ALL SELECT node, NULL, NULL, NULL, n_rows, value FROM w"""
ORACLE["boosting_margins"] = f"""{_FIRST_TREE}
SELECT value AS margin, count(*) AS n_rows, CAST(sum(target) AS BIGINT) AS n_positive, count(*) - count(x1) AS n_price_missing
FROM l JOIN w USING (node) GROUP BY value"""

ORACLE["split_many_classes"] = "SELECT * FROM " + S.split_sql(
    "(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS lkey, l_orderkey FROM lineitem)", "lkey", "l_orderkey")
