"""Mixing sources to target weights by a low-discrepancy schedule.

Sources get targets by weight, none above ``max_repeat`` times its size (the excess
goes to the others by weight until it fits).  A source's documents, shuffled by a
hash, form a stream of words that is cut into blocks of equal length and read again
from its start when the target exceeds it.  Slot i of the schedule has the point
frac(i / golden ratio + 1/2); mapped through the cumulative block counts of the
sources it names a source, and its rank among that source's slots names the block.
Any stretch of slots thus holds each source near its weight.  Blocks that the
points leave over (their number grows with the logarithm of the slots) come last,
so every source gives exactly its rounded target.

Nothing depends on how many rows one source holds: positions and ranks are running
sums in hash or slot buckets, and points meet sources over grid cells.

Defined results: a null text has size 0; a document without words takes part in no
block and is taken 0 times; null is a source of its own, last in order; repeated
rows are counted once with their number and then stand one after the other; an empty table gives an empty result; other
columns are ignored by ``taken`` and passed through by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_buckets, n_words, only, running, spread_copies, staged, text_or_empty

#: 1 / golden ratio to 20 places.
GOLDEN = "0.61803398874989484820"


def _key(source: Column) -> Column:
    """The source as a key that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _rows(docs: DataFrame) -> DataFrame:
    """(skey, doc_id, size, h, n): rows that agree in source, doc_id, size and the hash of
    their text, as one row with their number."""
    rows = only(docs, doc_id="long", source="string", text="string").select(
        _key(F.col("source")).alias("skey"), "doc_id", n_words(text_or_empty()).alias("size"), F.xxhash64(text_or_empty()).alias("h"))
    return rows.groupBy("skey", "doc_id", "size", "h").agg(F.count("*").alias("n"))


def targets(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """One row a source: skey, idx (order), weight, source_size, target, quota (the
    target in whole words), from rows of ``size`` words that stand ``n`` times.  Windows
    here hold one row for each source."""
    per = rows.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    everything = W.partitionBy(F.lit(0))
    per = per.withColumn("idx", F.row_number().over(everything.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    per = per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
    earlier = everything.orderBy(F.col("cap") / F.col("weight"), "idx").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    per = per.withColumn("left", left).withColumn(
        "wleft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    # sources in order of cap / weight: each is full as long as its share of what the ones before leave is above its cap
    per = per.withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("wleft"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    wrest = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    per = per.withColumn("rest", rest).withColumn("wrest", wrest)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.try_divide(F.col("rest") * F.col("weight"), F.col("wrest")))
    return per.withColumn("target", target).select(
        "skey", "idx", "weight", "source_size", "target", F.round("target").cast("long").alias("quota"))


def _placed(rows: DataFrame, per: DataFrame, n: int, seed: int) -> DataFrame:
    """Each of the ``n`` copies of ``rows`` with the columns of ``per`` and pos: words
    before it in the stream, in which copies follow each other."""
    named = ["doc_id", "size", "h"]
    order = [F.xxhash64(F.lit(seed), *[F.col(c) for c in named]), *[F.col(c) for c in named]]
    placed = running(rows, ["skey"], hash_buckets(n, *named), order, "pos", F.col("size") * F.col("n"), per)
    return spread_copies(placed, "n", "copy").withColumn("pos", F.col("pos") + F.col("copy") * F.col("size"))


def schedule(spark, per: DataFrame, block: int) -> DataFrame:
    """(idx, block, slot): which block of which source each scheduled slot holds."""
    per = per.select("idx", F.ceil(F.col("quota") / F.lit(block)).alias("blocks")).where("blocks > 0")
    total = per.agg(F.sum("blocks").alias("n"), F.count("*").alias("k")).first()
    n, cells = total.n or 0, max(1024, total.k)
    earlier = W.partitionBy(F.lit(0)).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("blocks").over(earlier), F.lit(0))
    spans = per.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("blocks"))

    def cell(x):
        return F.floor(x * F.lit(cells).cast("decimal(12,0)") / F.lit(max(n, 1)).cast("decimal(18,0)")).cast("long")

    dec = "decimal(18,0)"
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lo").cast(dec)), cell((F.col("hi") - 1).cast(dec)) + 1)))
    frac = F.col("id").cast(dec) * F.lit(GOLDEN).cast("decimal(20,20)") + F.lit("0.5").cast("decimal(2,1)")
    frac = frac - F.floor(frac)
    at = F.floor(frac.cast("decimal(19,18)") * F.lit(n).cast(dec)).cast("long")
    slots = spark.range(n).select(F.col("id").alias("slot"), at.alias("at")).withColumn("cell", cell(F.col("at").cast(dec)))
    named = slots.join(spans, "cell").where("at >= lo AND at < hi").select("idx", "blocks", "slot")
    ranked = running(named, ["idx"], F.floor(F.col("slot") / F.lit(math.isqrt(n) + 1)), [F.col("slot")], "block")
    return ranked.where("block < blocks").select("idx", "block", "slot")


def segments(placed: DataFrame, per: DataFrame, block: int = 1024, max_repeat: int = 2) -> DataFrame:
    """The mix: (slot, idx, skey, pos, doc_id, first, last) where words first to last - 1 of
    the document at ``pos`` stand in ``slot``."""
    spark = placed.sparkSession
    n = per.agg(F.sum(F.ceil(F.col("quota") / F.lit(block)))).first()[0] or 0
    turn = F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))
    reads = placed.where("size > 0").select("*", turn.alias("turn")).withColumn("at", F.col("pos") + F.col("turn") * F.col("source_size"))
    reads = reads.where("at < quota").withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota")))
    b = F.lit(block)
    last = F.floor((F.col("end") - 1) / b)
    cut = reads.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), last)))
    cut = cut.select("idx", "block", "skey", "pos", "doc_id", (F.greatest(F.col("block") * b, F.col("at")) - F.col("at")).alias("first"),
                     (F.least((F.col("block") + 1) * b, F.col("end")) - F.col("at")).alias("last"))
    slots = schedule(spark, per, block)
    rest = F.lit(n) + F.col("block") * F.lit(per.count()) + F.col("idx")
    return cut.join(slots, ["idx", "block"], "left").withColumn("slot", F.coalesce("slot", rest))


def _taken(rows: DataFrame, per: DataFrame, n: int, block: int, max_repeat: int, seed: int) -> DataFrame:
    found = segments(_placed(rows, per, n, seed), per, block, max_repeat)
    return found.groupBy("skey", "pos").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))


def taken(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeat: int = 2, block: int = 1024, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) for every row of ``docs``."""
    rows = staged(_rows(docs), "sized")
    per = staged(targets(rows, weights, share, max_repeat), "targets")
    n = rows.count()
    mine = _taken(rows, per, n, block, max_repeat, seed).withColumn("some", F.lit(True))
    placed = _placed(rows, per, n, seed).withColumn("some", F.col("size") > 0)  # a row without words takes nothing
    return placed.join(mine, ["skey", "pos", "some"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeat: int = 2, block: int = 1024, seed: int = 11) -> DataFrame:
    """``docs`` in the mix as whole documents: each row as many times as the mix takes
    it, a part of a document counting from one half on; rows without words stay once.
    Rows that agree in source, doc_id and text share their copies, as evenly as whole
    rows allow; which of them get one more follows a hash of their other columns."""
    rows = staged(_rows(docs), "sized")
    per = staged(targets(rows, weights, share, max_repeat), "targets")
    n = rows.count()
    mine = _taken(rows, per, n, block, max_repeat, seed).withColumn("some", F.lit(True))
    placed = _placed(rows, per, n, seed).withColumn("some", F.col("size") > 0).join(mine, ["skey", "pos", "some"], "left")
    copies = F.when(F.col("some"), F.floor(F.try_divide(2 * F.coalesce("taken", F.lit(0)) + F.col("size"), 2 * F.col("size")))).otherwise(1)
    # from here on narrow rows: how often each distinct row stands in the mix
    times = staged(placed.groupBy("skey", "doc_id", "h").agg(F.sum(copies).alias("times"), F.count("*").alias("rows")).where("times > 0"), "times")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", F.col("_row.doc_id").cast("long").alias("_doc"), _key(F.col("_row.source").cast("string")).alias("_source"),
        F.xxhash64(F.coalesce(F.col("_row.text").cast("string"), F.lit(""))).alias("_hash"))
    same = (F.col("_source") == F.col("skey")) & F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("h"))
    each = whole.join(times.where("rows = 1"), same).withColumn("_n", F.col("times")).select("_row", "_n")
    if times.where("rows > 1").limit(1).count():
        again = whole.join(times.where("rows > 1"), same).withColumn("_other", F.xxhash64(F.to_json(F.col("_row").dropFields("text"))))
        kinds = again.groupBy("_source", "_doc", "_hash", "_other").agg(F.first("_row").alias("_row"), F.count("*").alias("_same"), F.first("times").alias("times"), F.first("rows").alias("rows"))
        kinds = staged(kinds, "repeated")
        before = running(kinds.select("_source", F.coalesce("_doc", F.lit(0)).alias("_doc0"), F.col("_doc").isNull().alias("_none"), "_hash", "_other", "_same", "times", "rows"),
                         ["_source", "_doc0", "_none", "_hash"], F.floor(F.col("_other") / (1 << 48)).cast("long"), [F.col("_other")], "_at", F.col("_same"))
        # rows are numbered through; those before (times mod rows) get one more
        extra = F.greatest(F.lit(0), F.least(F.col("times") % F.col("rows") - F.col("_at"), F.col("_same")))
        before = before.select("_source", F.when(~F.col("_none"), F.col("_doc0")).alias("_doc"), "_hash", "_other", (F.floor(F.col("times") / F.col("rows")) * F.col("_same") + extra).alias("_n"))
        both = kinds.alias("a").join(before.alias("b"), (F.col("a._source") == F.col("b._source")) & F.col("a._doc").eqNullSafe(F.col("b._doc")) &
                                     (F.col("a._hash") == F.col("b._hash")) & (F.col("a._other") == F.col("b._other")))
        each = each.unionByName(both.select("a._row", "b._n"))
    return spread_copies(each.withColumn("_n", F.col("_n").cast("long")), "_n", "_copy").select("_row.*")
