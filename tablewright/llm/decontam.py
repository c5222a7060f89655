"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every item gives its windows of ``window`` consecutive words (an item of fewer words is
one window).  Windows of one length k are searched together: a block of the last two
words at a place looks up how far the search may move on, which is k - 1 words for a
block that stands in no window; a block that ends some window names a bucket, and the
windows of the bucket are compared with the text word by word.  Places are skipped, never
dropped: a shift is the least distance from the block to the end of any window.

The windows are dealt into blocks of bounded bytes, so the tables that travel to the
tasks stay bounded however long the benchmark grows; each block is one pass over the
documents.  The passes meet by a hash of the text, one row for each distinct text.

Defined results: a null or blank text has no words and is not contaminated; an item
without words has no window; an item_id that is null marks words but is no item; rows of
one item_id are one item; repeated documents are judged alike and a null doc_id is kept;
texts of any length are searched a chunk at a time; empty tables give an empty result, or
documents without hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, running, staged

#: Bytes of a lower-cased text with a blank for every ASCII character that is neither a
#: letter nor a digit; bytes of other characters all belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of a text that are split into words at a time.
_CHUNK = 1 << 22


def _chunks(text: bytes | None):
    """The words of a text in lists of bounded size."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + _CHUNK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class WuManber:
    """Search for windows that all have ``k`` words; ``windows`` maps each to its items."""

    def __init__(self, windows: dict[tuple, set], k: int, block: int = 2):
        self.k, self.block = k, min(block, k)
        self.most = k - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set]] = {}
        for w, items in windows.items():
            for end in range(self.block, k + 1):
                b = w[end - self.block:end]
                self.shift[b] = min(k - end, self.shift.get(b, self.most))
            self.buckets.setdefault(w[k - self.block:], {})[w] = items

    def search(self, words: list[bytes], start: int):
        """(place of the last word, items) of every occurrence that ends at ``start`` or later."""
        k, size, most, shift = self.k, self.block, self.most, self.shift.get
        i, n = max(k - 1, start), len(words)
        while i < n:
            b = tuple(words[i - size + 1:i + 1])
            step = shift(b, most)
            if step:
                i += step
                continue
            items = self.buckets[b].get(tuple(words[i - k + 1:i + 1]))
            if items is not None:
                yield i, items
            i += 1


def _searchers(pieces: list[tuple], block: int = 2) -> list[WuManber]:
    """One searcher for each window length among ``pieces`` of (item, k, words)."""
    by_length: dict[int, dict[tuple, set]] = {}
    for item, k, text in pieces:
        words = text.split(b" ")
        for i in range(len(words) - k + 1):
            items = by_length.setdefault(k, {}).setdefault(tuple(words[i:i + k]), set())
            if item is not None:
                items.add(item)
    return [WuManber(windows, k, block) for k, windows in sorted(by_length.items())]


def occurrences(text: bytes | None, searchers: list[WuManber], window: int) -> tuple[int, list[list[int]], set]:
    """(number of words, merged spans [first, last] of hit words, items found)."""
    ends: list[tuple[int, int]] = []
    items: set = set()
    tail: list[bytes] = []
    done = 0  # words before the tail
    for fresh in _chunks(text):
        words = tail + fresh if tail else fresh
        for s in searchers:
            for last, found in s.search(words, len(tail)):
                ends.append((done + last - s.k + 1, done + last))
                items |= found
        keep = min(window - 1, len(words))
        done += len(words) - keep
        tail = words[len(words) - keep:]
    spans: list[list[int]] = []
    for first, last in sorted(ends):
        if spans and first <= spans[-1][1] + 1:
            spans[-1][1] = max(last, spans[-1][1])
        else:
            spans.append([first, last])
    return done + len(tail), spans, items


def item_pieces(items: DataFrame, window: int, piece_words: int = 4096) -> DataFrame:
    """(item, k, words): the words of each item, blank between them, in overlapping pieces
    that hold all its windows of k words."""
    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = [w for part in _chunks(text) for w in part]
                k = min(window, len(words))
                out += [(item, k, b" ".join(words[i:i + piece_words + k - 1])) for i in range(0, len(words) - k + 1, piece_words) if k]
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
                                  names=["item", "k", "words"])

    rows = only(items, item_id="long", text="string").withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, "item long, k int, words binary")


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FOUND = "doc_id long, key binary, n_words long, spans array<struct<first:bigint,last:bigint>>, items array<bigint>"


def _pass(docs: DataFrame, pieces: list[tuple], window: int, block: int, all_rows: bool) -> DataFrame:
    """What one block of pieces finds; rows without hits only if ``all_rows``."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        searchers = _searchers(sent.value, block)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                n, spans, items = occurrences(text, searchers, window)
                if spans or all_rows:
                    out.append((doc_id, hashlib.sha256(text or b"").digest(), n, [{"first": a, "last": z} for a, z in spans], sorted(items)))
            types = (pa.int64(), pa.binary(), pa.int64(), _SPANS, pa.list_(pa.int64()))
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["doc_id", "key", "n_words", "spans", "items"])

    rows = only(docs, doc_id="long", text="string").withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, _FOUND)


def _covered(spans):
    """How many words the spans cover together."""
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, s: F.struct(
        F.greatest(a["end"], s["last"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, a["end"]))).alias("n")))["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 4 << 20, block: int = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, items_sha256, contaminated) for every
    row of ``docs``; ``spans`` are 0-based first and last hit words."""
    pieces = item_pieces(items, window).distinct().withColumn("one", F.lit(0)).withColumn("size", F.length("words") + 64)
    bucket = F.pmod(F.xxhash64("words", "item"), F.lit(1024)).cast("long")
    pieces = staged(running(pieces, ["one"], bucket, [F.col("words"), F.col("item"), F.col("k")], "at", F.col("size"))
                    .withColumn("block", F.floor(F.col("at") / F.lit(block_bytes)).cast("long")), "benchmark-pieces")
    blocks = (pieces.agg(F.max("block")).first()[0] or 0) + 1

    def of(i):
        """The pieces of block i: at most ``block_bytes`` and one piece."""
        return [(r.item, r.k, bytes(r.words)) for r in pieces.where(F.col("block") == i).select("item", "k", "words").collect()]

    found = _pass(docs, of(0), window, block, True)
    if blocks > 1:
        more = [_pass(docs, of(i), window, block, False).groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
                for i in range(1, blocks)]
        # a text has at most one row from each block
        more = reduce(DataFrame.unionByName, [staged(m, "benchmark-hits") for m in more])
        more = staged(more.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i")), "benchmark-texts")
        found = staged(found, "benchmark-first").join(more, "key", "left").select(
            "doc_id", "n_words", F.when(F.col("s").isNull(), F.col("spans")).otherwise(F.concat("spans", "s")).alias("spans"),
            F.when(F.col("i").isNull(), F.col("items")).otherwise(F.array_distinct(F.concat("items", "i"))).alias("items"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = _covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
                        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def contamination_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The same for DuckDB, by joining all windows.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))
), dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hit AS (
  SELECT rid, i, k, item_id FROM dw JOIN bw USING (k, t)
), n AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY rid
), it AS (
  SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
