"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's word
shingles.  For a radius r every bit position i gets a nonzero vector c(i) of
r + 1 bits, and each of the 2^(r+1) - 1 nonzero vectors v gives one table whose
mask keeps the positions with an odd inner product <c(i), v>.  r differing
positions span at most r dimensions, so some v is orthogonal to all of them:
that table masks every differing bit, and the pair collides in it.  Nothing
within the radius is lost.

Only distinct fingerprints are linked.  A bucket of few fingerprints is compared
pair by pair; the members of larger ones name every centre within r // 2 bits of
themselves and meet there, so work stays linear in them.  For even r two members
within the radius share a centre, and members that share one are within the
radius of each other, so a star per centre connects exactly what all pairs would.

Defined results: a null or blank text has no shingle and fingerprint zero, and
is linked like any other; fewer words than the shingle length make one shingle;
repeated rows link to each other; a null doc_id is kept and counts as no
representative; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, staged, text_or_empty
from .graph import connected_components

_WORD = re.compile("[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Shingles hashed at a time, which bounds memory for texts of any length.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    w = _WORD.findall((text or "").translate(_LOWER))
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        hashes = np.fromiter((digest(" ".join(w[i:i + shingle]).encode("utf-8", "surrogatepass"), seed) for i in range(start, stop)),
                             dtype=np.uint64, count=stop - start)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, rid, fp): rid a hash of the text, fp the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("rid"), pa.array(fps, pa.int64())], names=["doc_id", "rid", "fp"])

    rows = only(docs, doc_id="long", text="string").withColumn("rid", F.xxhash64(text_or_empty()))
    return rows.mapInArrow(run, "doc_id long, rid long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """Signed 64-bit masks; any ``radius`` positions are all outside some mask."""
    dims = radius + 1
    vectors = [1 + i % (2 ** dims - 1) for i in range(bits)]
    masks = []
    for v in range(1, 2 ** dims):
        m = sum(1 << i for i, c in enumerate(vectors) if (c & v).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _ball(radius: int) -> list[int]:
    """Signed patterns of at most ``radius // 2`` set bits."""
    found = {0}
    for _ in range(radius // 2):
        found |= {x ^ (1 << i) for x in found for i in range(64)}
    return sorted(x - (1 << 64) if x >> 63 else x for x in found)


def links(fps: DataFrame, radius: int = 2, small: int = 16) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of ``fps`` such that
    two of them are connected if and only if pairs within ``radius`` connect them.
    Buckets of at most ``small`` members are compared pairwise."""
    if radius % 2 and radius > 0:
        raise ValueError("buckets split by balls need an even radius")
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)]))
    keyed = fps.select("fp", table.alias("tk")).select("fp", "tk.t", "tk.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(keyed.join(sizes, ["t", "k"]).select("fp", "t", "k", "n"), "buckets")
    few = met.where(F.col("n") <= small).groupBy("t", "k").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = few.select("m", F.posexplode("m").alias("i", "a")).select(
        "a", F.explode(F.filter(F.slice("m", F.col("i") + 2, small),
                                lambda b: F.bit_count(F.col("a").bitwiseXOR(b)) <= radius)).alias("b"))
    crowded = met.where(F.col("n") > small).select("fp").distinct()
    ball = crowded.select("fp", F.explode(F.array(*[F.lit(x) for x in _ball(radius)])).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("c"))
    # a ball holds at most one fingerprint per pattern, so its list is bounded
    star = (ball.groupBy("c").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
            .select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b"))
    return pairs.unionByName(star).distinct()


def _grouped(fps: DataFrame, radius: int, small: int) -> DataFrame:
    """``fps`` with label, the same for all rows of a component, and component_id."""
    smallest = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    parts = connected_components(links(smallest.select("fp"), radius, small))
    of = smallest.join(parts.toDF("fp", "label"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = staged(of.join(least, "label").select("fp", "label", "component_id"), "components")
    return fps.join(ids, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, small: int = 16) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    rows = _grouped(staged(fingerprints(docs, shingle), "fingerprints"), radius, small)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = 3, radius: int = 2, small: int = 16) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id (null last);
    of rows with one doc_id and text any columns may differ, and one of them stays."""
    rows = _grouped(staged(fingerprints(docs, shingle), "fingerprints"), radius, small)
    kept = staged(rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("k"))
                  .select(F.col("k.doc_id").alias("_d"), F.col("k.rid").alias("_r")), "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mine = docs.select(row.alias("_row")).withColumn("_id", F.col("_row.doc_id").cast("long")).withColumn(
        "_rid", F.xxhash64(F.coalesce(F.col("_row.text").cast("string"), F.lit(""))))
    left = mine.join(kept, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_rid") == F.col("_r")), "left_semi")
    twice = rows.groupBy("doc_id", "rid").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:  # rows of one doc_id and text: one of them by a hash of all its columns, whatever their types
        order = F.struct(F.xxhash64(F.to_json("_row")), F.to_json(F.col("_row").dropFields("text")))
        left = left.groupBy("_id", "_rid").agg(F.min_by("_row", order).alias("_row"))
    return left.select("_row.*")
