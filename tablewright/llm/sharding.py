"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups (rows of equal text) are ordered by a 64-bit hash of the text and cut into
contiguous shards so that the largest shard is as small as it can be.  A capacity
is feasible when filling shards greedily, each up to the capacity, reaches the last
group; the smallest feasible one is found by binary search, then cut there.

The search runs on sums per hash range, never on rows.  Ranges near a cut are
halved again and again by Spark until each holds one group: cuts move right as the
capacity grows, so the cuts at the bounds of the search enclose all that matter.
Large groups are ranges of their own from the start, as else a range could be larger
than a shard and the bounds would enclose everything behind it.
The driver holds some thousand range sums whatever the input's size; rows get their
shard by comparing their hash with the cuts, so no text is moved or joined.

Defined results: a null text has no bytes and counts like an empty one; texts with
equal hash count as one group; repeated rows get a slot each; fewer groups than
shards leave the last shards empty; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_buckets, only, running, staged, text_or_empty

_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _cells(groups: DataFrame, ranges: list[tuple[int, int]], bits: int, coarse: int) -> list[tuple[int, int, int, int, int]]:
    """Sums of the non-empty cells that split each range [lo, hi] into cells of
    2^bits hashes: (lo, hi, bytes, number of groups, largest group), in order.
    No range reaches over a multiple of 2^coarse, by which rows find their range."""
    table = json.dumps([{"k": lo >> coarse, "lo": lo, "hi": hi} for lo, hi in ranges])
    table = groups.sparkSession.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<k:bigint,lo:bigint,hi:bigint>>")))
    inside = groups.withColumn("k", F.shiftright("h", coarse)).join(F.broadcast(table), "k").where(F.col("h").between(F.col("lo"), F.col("hi")))
    cell = F.shiftright("h", bits) if bits else F.col("h")
    rows = (inside.groupBy("lo", "hi", cell.alias("c"))
            .agg(F.sum("bytes").alias("s"), F.count("*").alias("n"), F.max("bytes").alias("m")).collect())
    return sorted((max(r.lo, r.c << bits), min(r.hi, (r.c << bits) + (1 << bits) - 1), r.s, r.n, r.m) for r in rows)


def _aligned(ranges: list[tuple[int, int]], coarse: int) -> list[tuple[int, int]]:
    """``ranges`` cut at the multiples of 2^coarse."""
    return [(max(lo, k << coarse), min(hi, ((k + 1) << coarse) - 1)) for lo, hi in ranges for k in range(lo >> coarse, (hi >> coarse) + 1)]


class _Fill:
    """Greedy filling of shards over ordered cells (lo, hi, bytes, groups, largest)."""

    def __init__(self, cells: list[tuple[int, int, int, int, int]]):
        self.cells, self.ends = cells, list(accumulate(c[2] for c in cells))

    def least(self, at: int, capacity: int) -> int:
        """A cut is not before: the first group left out is one of the cell that does
        not fit, and would have gone beyond the capacity."""
        k = bisect_right(self.ends, at + capacity)
        whole = self.ends[k - 1] if k else 0
        return whole if k == len(self.ends) else max(whole, at + capacity + 1 - self.cells[k][4])

    def most(self, at: int, capacity: int) -> int:
        """A cut is not behind: anywhere in a cell of several groups, never in one group."""
        k = bisect_right(self.ends, at + capacity)
        whole = self.ends[k - 1] if k else 0
        return whole if k == len(self.ends) or self.cells[k][3] == 1 else at + capacity

    def whole(self, at: int, capacity: int) -> int:
        k = bisect_right(self.ends, at + capacity)
        return max(at, self.ends[k - 1] if k else 0)

    def cuts(self, step, capacity: int, shards: int) -> list[int]:
        """Places where shards are cut, as sums of all before."""
        return list(accumulate(range(shards), lambda at, _: step(at, capacity), initial=0))[1:]

    def open(self, low: int, high: int | None, shards: int, most: int | None = None) -> set[int]:
        """Numbers of the cells of several groups in which cuts of the capacities from
        ``low`` to ``high`` (None: of ``low`` only) may be.  The first cut of one capacity
        can be in one such cell only; what follows after more than ``most`` is left out."""
        out = set()
        for a, b in zip(self.cuts(self.least, low, shards), self.cuts(self.most, low if high is None else high, shards), strict=True):
            first = i = bisect_right(self.ends, a)
            while i < len(self.ends) and self.ends[i] - self.cells[i][2] <= b:
                if self.cells[i][3] > 1:
                    out.add(i)
                i += 1
                if most is not None and i - first > most:
                    return out
        return out

    def smallest(self, step, low: int, high: int, shards: int) -> int:
        while low < high:
            mid = (low + high) // 2
            if self.cuts(step, mid, shards)[-1] >= self.ends[-1]:
                high = mid
            else:
                low = mid + 1
        return low


#: Groups above this part of the mean shard are cells of their own from the start.
_PART = 128
#: Open cells above which only those of some capacities are refined.
_WIDE = 128
_PROBES = 8
#: Cells that one round of refinement may make.
_MOST_CELLS = 1 << 16


def minimax_cuts(groups: DataFrame, shards: int, first_bits: int = 10, step_bits: int = 8) -> list[int]:
    """Upper hash bounds (inclusive) of the first ``shards - 1`` shards, for
    ``groups`` of one row per hash (h, bytes)."""
    coarse = bits = 64 - first_bits
    total, largest = groups.agg(F.sum("bytes"), F.max("bytes")).first()
    if total is None:
        return [_MAX] * (shards - 1)
    # fewer than shards * _PART rows
    heavy = sorted((r.h, r.h, r.bytes, 1, r.bytes) for r in groups.where(F.col("bytes") > F.lit(total // (shards * _PART))).select("h", "bytes").collect())
    edges = [_MIN - 1, *[c[0] for c in heavy], _MAX + 1]
    ranges = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if a + 1 < b]
    cells = sorted(heavy + _cells(groups, _aligned(ranges, coarse), bits, coarse))
    while True:
        fill = _Fill(cells)
        low = max(largest, fill.smallest(fill.most, -(-total // shards), total, shards))
        high = max(low, fill.smallest(fill.least, low, total, shards))
        # cuts move right as the capacity grows
        split = fill.open(low, high, shards)
        if len(split) > _WIDE:  # a group fits or not, and moves all later cuts: decide some capacities
            split = set()
            for i in range(_PROBES + 1):
                split |= fill.open(low + (high - low) * i // _PROBES, None, shards, 16)
        split = sorted(split)
        if not split:
            break
        # as fine as the bound on a round's cells allows, for the widest cells
        top = max((cells[i][1] - cells[i][0]).bit_length() for i in split)
        step = max(1, min(step_bits, (_MOST_CELLS // len(split)).bit_length() - 1))
        bits = max(0, top - step)
        split = [i for i in split if (cells[i][1] - cells[i][0]).bit_length() > bits]
        ranges = []
        for i in split:  # neighbours make one range
            if ranges and ranges[-1][2] == i - 1 and ranges[-1][1] + 1 == cells[i][0]:
                ranges[-1] = (ranges[-1][0], cells[i][1], i)
            else:
                ranges.append((*cells[i][:2], i))
        fine = _cells(groups, _aligned([r[:2] for r in ranges], coarse), bits, coarse)
        gone = set(split)
        cells = sorted([c for i, c in enumerate(cells) if i not in gone] + fine)
    capacity = fill.smallest(fill.whole, low, total, shards)
    bounds = []
    for cut in fill.cuts(fill.whole, capacity, shards)[:-1]:
        k = bisect_right(fill.ends, cut)
        bounds.append(cells[k - 1][1] if k else _MIN)
    return bounds


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row: shards
    of near equal bytes that keep equal texts together."""
    rows = only(docs, doc_id="long", text="string")
    text = text_or_empty()
    rows = rows.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), text_key(text).alias("h"))
    rows = staged(rows, "sized")
    groups = staged(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    number = F.lit(0)
    for bound in minimax_cuts(groups, shards):
        number = number + (F.col("h") > F.lit(bound)).cast("int")
    placed = rows.withColumn("shard", number.cast("int"))
    ranked = running(placed, ["shard"], hash_buckets(placed.count(), "doc_id", "h"),
                     [F.col("doc_id"), F.col("h"), F.col("size")], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
