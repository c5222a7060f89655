"""Text expressions: missing-literal normalization, canonical keys and the
insert/delete similarity ratio used for near-duplicate spellings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal strings the reference treats as missing (rule 13).
DEFAULT_MISSING_LITERALS = ("NA", "N/A", "null", "None", "-")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_missing_expr(c, literals=DEFAULT_MISSING_LITERALS) -> Column:
    """Listed literals (compared exactly, as the reference does) become NULL."""
    col = _col(c)
    return F.when(col.isin(list(literals)), F.lit(None).cast("string")).otherwise(col)


def normalize_text_expr(c) -> Column:
    """strip + lower."""
    return F.lower(F.trim(_col(c)))


def spelling_key_expr(c) -> Column:
    """Key under which spellings count as the same category: lower-cased,
    blanks, '-' and '_' removed."""
    return F.regexp_replace(F.lower(F.trim(_col(c))), r"[\s_\-]+", "")


def chars(c) -> Column:
    """Array of the characters of a string (empty array for '')."""
    col = _col(c)
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.substring(col, i, 1)))


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two strings, as a native
    expression: a row-by-row DP where each row is an array over b's positions."""
    a, b = _col(a), _col(b)
    lb = F.length(b)
    init = F.array_repeat(F.lit(0), lb + 1)

    def next_row(prev, ca):
        # cur[j] for j = 0..lb, built left to right; cur[0] = 0
        def step(cur, j):
            diag = F.element_at(prev, j) + 1                      # prev[j-1] + 1 (1-based element_at)
            up = F.element_at(prev, j + 1)                        # prev[j]
            left = F.element_at(cur, j)                           # cur[j-1]
            val = F.when(F.substring(b, j, 1) == ca, diag).otherwise(F.greatest(up, left))
            return F.concat(cur, F.array(val))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(lb, F.lit(1))), F.array(F.lit(0)),
                           lambda cur, j: F.when(lb == 0, cur).otherwise(step(cur, j)))

    final = F.aggregate(chars(a), init, next_row)
    return F.when((F.length(a) == 0) | (lb == 0), F.lit(0)).otherwise(F.element_at(final, -1))


def similarity_ratio(a, b) -> Column:
    """Normalized insert/delete similarity on 0..100:
    200 * LCS(a, b) / (|a| + |b|); two empty strings score 100."""
    a, b = _col(a), _col(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        F.lit(200.0) * lcs_length(a, b) / total.cast("double"))


def char_bag_overlap(a, b) -> Column:
    """Size of the multiset intersection of the characters of a and b; an
    upper bound of LCS(a, b), cheap enough to filter candidate pairs."""
    a, b = _col(a), _col(b)
    ca = F.array_sort(chars(a))
    cb = F.array_sort(chars(b))
    # multiset intersection size = sum over distinct chars of min(count_a, count_b)
    da = F.array_distinct(ca)
    return F.aggregate(
        da, F.lit(0),
        lambda acc, ch: acc + F.least(F.size(F.filter(ca, lambda x: x == ch)),
                                      F.size(F.filter(cb, lambda x: x == ch))))
