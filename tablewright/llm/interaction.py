"""Filter interaction audit over all orders of the filters.

A document's mask is the set of filters it fails.  In an order, the document is removed
by the first filter of its mask, so for one mask the orders in which filter f removes it
at step s are those that begin with s - 1 filters outside the mask and then f.  In
lexicographic (Lehmer) rank the orders with a common beginning are one interval, of
length (filters - s)!.  Each mask's count is added where such an interval starts and
taken off where it ends; one running sum over the ranks gives what every step of every
order removes.  Work on the documents ends with one count for each mask.

Defined results: a null text is empty and a null lang the empty string; a null doc_id is
smaller than none and has none smaller; rows of one doc_id and text are no copies of each
other; a document's labels are the largest of its label rows, none without a row; labels
of no document are ignored; a table without documents has no parts and no rows; texts of
any length are measured a row at a time; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, staged

FILTERS = "ABCDE"
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_LATER_BYTES = bytes(range(128, 192))  # bytes of a code point after its first


def text_mask(text: bytes) -> int:
    """The filters A to D (bits 0 to 3) that a UTF-8 text fails."""
    words = text.split()  # of bytes: at blanks and tab to return
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _LATER_BYTES))
    symbols = len(text) != len(text.translate(None, _SYMBOLS))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | symbols << 3


def _measured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("part"), pa.array([text_mask(t) for t in texts], pa.int32()),
                                   pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "part", "mask", "key"])

    rows = only(docs, doc_id="long", lang="string", text="string").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, mask int, key binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit 4 for E.

    Of equal texts all but those of the smallest doc_id fail E.  Copies are counted, not
    joined: a text's rows are summed by (part, labels) in every task before they move."""
    rows = staged(_measured(docs), "measured")
    marks = only(labels, doc_id="long", quality="int", toxic="int").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    judged = rows.join(staged(marks, "labels"), "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    by = ["key", "mask", "part", "good", "toxic"]
    each = judged.groupBy(*by, "doc_id").agg(F.count("*").alias("n"))
    least = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
                                  F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    smallest = F.min("first.doc_id").over(W.partitionBy("key"))
    passing = F.col("n_null") + F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    halves = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
                     F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    split = least.withColumn("passing", passing).select("part", "good", "toxic", F.explode(halves).alias("h"))
    return split.where("h.n > 0").groupBy("part", F.col("h.mask").alias("mask")).agg(
        F.sum("h.n").alias("n"), F.sum(F.when(F.col("good"), F.col("h.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("h.n")).otherwise(0)).alias("toxic"))


def intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first, end): the ranks first to end - 1 of the orders of k filters in
    which a document of ``mask`` is removed at ``step``."""
    out = []

    def extend(start: int, used: tuple[int, ...], mask: int):
        step = len(used) + 1
        span = factorial(k - step)
        for i, f in enumerate(x for x in range(k) if x not in used):
            first = start + i * span
            if mask >> f & 1:
                out.append((mask, step, first, first + span))
            else:
                extend(first, (*used, f), mask)

    for mask in range(1, 1 << k):
        extend(0, (), mask)
    return out


def _fixed(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table whose size depends on the number of filters alone."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from the (part, mask, n, good, toxic) of ``mask_counts``."""
    spark, k = counts.sparkSession, len(filters)
    counts = staged(counts, "masks")  # at most 2^filters rows a part
    values = ("n", "good", "toxic")
    ends = _fixed(spark, [(m, s, r, sign) for m, s, a, z in intervals(k) for r, sign in ((a, 1), (z, -1))], "mask int, step int, rank int, sign int")
    steps = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(v) * F.col("sign")).alias(v) for v in values])
    orders = [("".join(p), r, s + 1, p[s]) for r, p in enumerate(permutations(filters)) for s in range(k)]
    cells = _fixed(spark, [(i, *x, filters.index(x[3])) for i, x in enumerate(orders)],
                   "cell int, filter_order string, rank int, step int, filter string, bit int")
    grid = counts.groupBy("part").agg(F.sum("n").alias("total")).withColumn(
        "cell", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1)))).join(cells, "cell")
    along = W.partitionBy("part", "step").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    filled = grid.join(steps, ["part", "step", "rank"], "left")
    removed = filled.select("part", "total", "filter_order", "rank", "step", "filter", "bit",
                            *[F.sum(F.coalesce(v, F.lit(0))).over(along).alias(v) for v in values])
    fails = counts.withColumn("bit", F.explode(F.array(*[F.lit(i) for i in range(k)]))).where("shiftright(mask, bit) & 1 = 1").groupBy("part", "bit").agg(
        F.sum("n").alias("fails"), F.sum(F.when(F.col("mask") == F.expr("shiftleft(1, bit)"), F.col("n")).otherwise(0)).alias("unique_fails"))
    removed = removed.join(fails, ["part", "bit"], "left")
    down = W.partitionBy("part", "rank").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    out = removed.withColumn("kept", F.col("total") - F.sum("n").over(down)).withColumn("shapley", F.sum("n").over(W.partitionBy("part", "bit")))
    return out.select("part", "filter_order", "step", F.col("kept").cast("long"), F.col("n").alias("removed"),
                      (F.coalesce("fails", F.lit(0)) - F.col("n")).alias("redundant"), F.coalesce("unique_fails", F.lit(0)).alias("unique_fails"),
                      F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def interaction_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(mask_counts(docs, labels))


#: The same for DuckDB, order by order.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || g.c || h.c || i.c AS o FROM x a, x b, x g, x h, x i
  WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5
), k AS (
  SELECT part, fails, n, good, toxic, o, list_min(list_filter([1, 2, 3, 4, 5], lambda i: contains(fails, substr(o, i, 1)))) AS k FROM c, o
), r AS (
  SELECT part, o AS filter_order, s AS step, substr(o, s, 1) AS f,
    sum(CASE WHEN k IS NULL OR k > s THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN k = s THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(fails, substr(o, s, 1)) AND k < s THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = substr(o, s, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN k = s THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN k = s THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM k, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS s) GROUP BY part, o, s
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""
