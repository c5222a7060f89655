"""DuckDB SQL twins of the derived views and of generic profile queries.

These strings are the correctness oracle: the same semantics written as plain
SQL over the driver's tables, evaluated by DuckDB.
"""

from __future__ import annotations

from .sources import messy as M


def u(key: str, salt: str) -> str:
    """SQL twin of functions.hashing.uniform."""
    return (f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8)) AS BIGINT)"
            f" / CAST(4294967296 AS DOUBLE))")


def h52(key: str, salt: str) -> str:
    """SQL twin of functions.hashing.hash52."""
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 13)) AS BIGINT)"


def rhu(expr: str, digits: int) -> str:
    """SQL twin of functions.numeric.round_half_up."""
    scale = 10 ** digits
    return f"(CAST(floor(({expr}) * CAST({scale} AS DOUBLE) + 0.5) AS DOUBLE) / CAST({scale} AS DOUBLE))"


def lit_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def spellings_case(col: str, variants: dict, key: str, salt: str = "spell") -> str:
    uu = u(key, f"{salt}:{col}")
    parts = [f"WHEN {col} = '{v}' THEN {lit_list(s)}[CAST(floor({uu} * {len(s)}) AS INTEGER) + 1]"
             for v, s in variants.items()]
    return "CASE " + " ".join(parts) + f" ELSE {col} END"


def orders_dates_sql() -> str:
    lag = f"CAST(floor({u('o_orderkey', 'lag')} * 19) + 1 AS INTEGER)"
    return ("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, "
            "strftime(o_orderdate, '%Y-%m-%d') AS order_date, "
            f"strftime(CAST(o_orderdate AS DATE) + {lag}, '%Y-%m-%d') AS ship_date, "
            "CAST(o_orderstatus = 'F' AS INTEGER) AS target FROM orders")


def messy_orders_sql() -> str:
    k = "o_orderkey"
    markers = (f"CASE WHEN {u(k, 'marker:o_orderpriority')} < {M.MARKER_RATE} THEN "
               f"{lit_list(M.MISSING_MARKERS)}[CAST(floor({u(k, 'marker_pick:o_orderpriority')} * "
               f"{len(M.MISSING_MARKERS)}) AS INTEGER) + 1] ELSE o_orderpriority END")
    swap_days = f"CAST(floor({u(k, 'swap_days')} * 9) + 1 AS INTEGER)"
    return f"""(WITH mo0 AS ({orders_dates_sql()}),
mo1 AS (SELECT * REPLACE ({spellings_case('o_orderpriority', M.PRIORITY_VARIANTS, k)} AS o_orderpriority) FROM mo0),
mo2 AS (SELECT * REPLACE ({markers} AS o_orderpriority) FROM mo1),
mo3 AS (SELECT * REPLACE (
    CASE WHEN {u(k, 'null:o_totalprice')} < {M.NULL_RATE} THEN NULL ELSE o_totalprice END AS o_totalprice,
    CASE WHEN {u(k, 'null:o_orderpriority')} < {M.NULL_RATE} THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM mo2),
mo4 AS (SELECT * REPLACE (CASE WHEN {u(k, 'outlier:o_totalprice')} < {M.OUTLIER_RATE}
    THEN o_totalprice * CAST({M.OUTLIER_FACTOR} AS DOUBLE) ELSE o_totalprice END AS o_totalprice) FROM mo3),
mo5 AS (SELECT * REPLACE (CASE WHEN {u(k, 'swap')} < {M.SWAP_RATE}
    THEN strftime(CAST(strptime(order_date, '%Y-%m-%d') AS DATE) - {swap_days}, '%Y-%m-%d')
    ELSE ship_date END AS ship_date) FROM mo4),
mo6 AS (SELECT * REPLACE (CASE WHEN {u(k, 'junk:ship_date')} < {M.JUNK_RATE} THEN 'unknown'
    ELSE ship_date END AS ship_date) FROM mo5)
SELECT * FROM mo6 UNION ALL SELECT * FROM mo6 WHERE {u(k, 'dup')} < {M.DUPLICATE_RATE})"""


def messy_events_sql() -> str:
    k = "event_id"
    return f"""(WITH me1 AS (SELECT event_id, ts, user_id,
    CASE WHEN {u(k, 'null:event_type')} < {M.NULL_RATE} THEN NULL ELSE event_type END AS event_type,
    CASE WHEN {u(k, 'null:value')} < {M.NULL_RATE} THEN NULL ELSE value END AS value,
    props FROM events),
me2 AS (SELECT * REPLACE (CASE WHEN {u(k, 'outlier:value')} < {M.OUTLIER_RATE}
    THEN value * CAST({M.OUTLIER_FACTOR} AS DOUBLE) ELSE value END AS value) FROM me1)
SELECT * FROM me2 UNION ALL SELECT * FROM me2 WHERE {u(k, 'dup')} < {M.DUPLICATE_RATE})"""


# SQL twin of functions.dates.DEFAULT_DATE_FORMATS.
SQL_DATE_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S")


def parse_ts(col: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({col}, '{f}')" for f in SQL_DATE_FORMATS) + ")"


def column_profile_sql(view_sql: str, columns: list, target: str | None = None,
                       mult: float = 1.5, min_rate: float = 0.9) -> str:
    """columns: list of (name, spark_dtype_string, kind) with kind in
    numeric | text | temporal."""
    parts = []
    for i, (c, dtype, kind) in enumerate(columns):
        is_t = "true" if c == target else "false"
        nul = f"(count(*) - count({c}))"
        pct = rhu(f"CAST(100 AS DOUBLE) * {nul} / CAST(greatest(count(*), 1) AS DOUBLE)", 2)
        if kind == "numeric":
            v = f"CAST({c} AS DOUBLE)"
            parts.append(f"""SELECT '{c}' AS "column", {i} AS position, '{dtype}' AS dtype,
  false AS is_text, {is_t} AS is_target, false AS is_date, CAST({nul} AS BIGINT) AS null_count,
  {pct} AS null_pct, CAST(count(DISTINCT {v}) AS BIGINT) AS n_unique,
  {rhu(f'min({v})', 2)} AS min_value, {rhu(f'max({v})', 2)} AS max_value, {rhu(f'avg({v})', 2)} AS mean_value,
  {rhu(f'quantile_cont({v}, 0.25)', 4)} AS q1, {rhu(f'quantile_cont({v}, 0.75)', 4)} AS q3,
  {rhu(f'quantile_cont({v}, 0.25) - {mult} * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25))', 4)} AS lower_bound,
  {rhu(f'quantile_cont({v}, 0.75) + {mult} * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25))', 4)} AS upper_bound,
  CAST((SELECT count(*) FROM src s2, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM src) q
        WHERE CAST(s2.{c} AS DOUBLE) < q.a - {mult} * (q.b - q.a) OR CAST(s2.{c} AS DOUBLE) > q.b + {mult} * (q.b - q.a)) AS BIGINT) AS outlier_count
FROM src""")
        else:
            if kind == "temporal":
                is_date = "true"
            else:
                is_date = f"(count(*) > 0 AND CAST(count({parse_ts(c)}) AS DOUBLE) / count(*) >= {min_rate})"
            parts.append(f"""SELECT '{c}' AS "column", {i} AS position, '{dtype}' AS dtype,
  {'true' if kind == 'text' else 'false'} AS is_text, {is_t} AS is_target, {is_date} AS is_date,
  CAST({nul} AS BIGINT) AS null_count, {pct} AS null_pct, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique,
  CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean_value,
  CAST(NULL AS DOUBLE) AS q1, CAST(NULL AS DOUBLE) AS q3, CAST(NULL AS DOUBLE) AS lower_bound,
  CAST(NULL AS DOUBLE) AS upper_bound, CAST(NULL AS BIGINT) AS outlier_count
FROM src""")
    return f"WITH src AS (SELECT * FROM {view_sql}) " + "\nUNION ALL\n".join(parts)


MO_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "order_date", "ship_date", "target"]


def missing_case(col: str, literals=("NA", "N/A", "null", "None", "-")) -> str:
    return f"CASE WHEN {col} IN ({', '.join(repr(x) for x in literals)}) THEN NULL ELSE {col} END"


def union_per_column(cols, template) -> str:
    return "\nUNION ALL\n".join(template(i, c) for i, c in enumerate(cols))


def split_sql(view: str, key_expr: str, target: str, seed: int = 42, test_size: float = 0.2) -> str:
    """SQL twin of operators.split.stratified_split: row_number over the class
    ordered by (hash, key) against largest-remainder quotas."""
    return f"""(WITH sp_src AS (SELECT * FROM {view}),
sp_h AS (SELECT *, {h52(key_expr, str(seed))} AS __h, CAST({key_expr} AS VARCHAR) AS __k FROM sp_src),
sp_cnt AS (SELECT {target} AS cls, count(*) AS n_c FROM sp_src GROUP BY {target}),
sp_tot AS (SELECT sum(n_c) AS n, CAST(ceil({test_size} * sum(n_c)) AS BIGINT) AS t FROM sp_cnt),
sp_base AS (SELECT cls, (t * n_c) // n AS base, (t * n_c) % n AS rem, t FROM sp_cnt, sp_tot),
sp_extra AS (SELECT cls, base, row_number() OVER (ORDER BY rem DESC, cls NULLS LAST) AS rk,
  t - sum(base) OVER () AS extra FROM sp_base),
sp_q AS (SELECT cls, base + CASE WHEN rk <= extra THEN 1 ELSE 0 END AS quota FROM sp_extra),
sp_rn AS (SELECT sp_h.*, row_number() OVER (PARTITION BY {target} ORDER BY __h, __k) AS __rn FROM sp_h)
SELECT sp_rn.* EXCLUDE (__h, __k, __rn), CASE WHEN __rn <= quota THEN 'test' ELSE 'train' END AS split
FROM sp_rn JOIN sp_q ON sp_rn.{target} IS NOT DISTINCT FROM sp_q.cls)"""


def spelled_orders_sql() -> str:
    """SQL twin of sources.messy.spelled_orders."""
    return """(SELECT o_orderkey, o_totalprice, unnest(['Ref ' || o_orderkey,
  CASE WHEN o_orderkey % 2 = 1 THEN 'Ref ' || o_orderkey ELSE 'ref_' || o_orderkey END, 'REF-' || o_orderkey]) AS code FROM orders)"""


def content_split_sql(view: str, cols: list, target: str, seed: int = 42, test_size: float = 0.2) -> str:
    """SQL twin of operators.split.stratified_split without a key, for columns that
    are never null: groups of equal rows in hash order, the one at the quota going
    to the nearer side."""
    key = " || chr(1) || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"""(WITH g AS (SELECT {', '.join(cols)}, count(*) AS n, {h52('(' + key + ')', str(seed))} AS h FROM {view} GROUP BY {', '.join(cols)}),
c AS (SELECT {target} AS cls, sum(n) AS n_c FROM g GROUP BY {target}),
t AS (SELECT sum(n_c) AS n, CAST(ceil({test_size} * sum(n_c)) AS BIGINT) AS t FROM c),
b AS (SELECT cls, (t * n_c) // n AS base, (t * n_c) % n AS rem, t FROM c, t),
q AS (SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= t - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
p AS (SELECT g.*, quota, sum(n) OVER (PARTITION BY {target} ORDER BY h) AS upto FROM g JOIN q ON g.{target} = q.cls),
s AS (SELECT *, upto <= quota OR (upto - n < quota AND upto - quota <= quota - (upto - n)) AS is_test FROM p)
SELECT {', '.join('v.' + c for c in cols)}, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split
FROM {view} v JOIN s ON {' AND '.join(f'v.{c} = s.{c}' for c in cols)})"""


def mixed_dates_sql() -> str:
    """SQL twin of sources.messy.mixed_dates, with the date the text tells."""
    d = "CAST(o_orderdate AS DATE)"
    return f"""(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE {d} END AS told FROM orders)"""
