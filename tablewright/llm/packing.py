"""Best-fit packing of tokenized documents into sequences, after dominance reduction.

A piece matters to packing only by its length, and there are at most ``limit``
lengths.  Spark counts the pieces of each length; the plan is made from these counts
on the driver, whatever the number of documents:

* reduction (after Martello and Toth): a set of one, two or three pieces that fills
  a sequence at least as well as every other set holding its largest piece is fixed,
  for as many sequences as the counts allow; dominance outlives the removal of other
  pieces, so fixing many at once is as safe as one by one;
* the rest goes longest first into the open sequence it fits most tightly.

A plan is a list of runs: pieces number r0, r0 + 1, ... of one length go m by m into
sequences s0, s0 + 1, ... at one offset.  Pieces are numbered within their length by
running counts in hash buckets and meet their run in an ordinary join.

Defined results: a null text is empty, an empty one is the end id alone; only
documents above ``limit`` are cut, at its multiples; a text of one endless word is
tokenized like any other; repeated rows are packed one by one; a null doc_id is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_buckets, only, running, staged

#: Entries a task remembers.
_KNOWN, _LONG = 1 << 19, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_LETTERS = "a-z\u00e0-\u00f6\u00f8-\u00ff"
#: Chunks of these characters are split here, all others by the tokenizer itself: within
#: them lower case and letters mean the same to both, and composition changes nothing.
_PLAIN = re.compile(f"[!-~A-Z{_LETTERS}\u00c0-\u00d6\u00d8-\u00de]+")
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_names() -> dict[int, str]:
    """How a byte-level vocabulary spells the UTF-8 bytes of the plain characters: a
    printable byte is itself, the others follow in order from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return {c: "".join(others.get(b, chr(b)) for b in chr(c).encode()) for c in range(33, 256)}


class _Chunks(dict):
    """Packed ids by chunk, filled on demand and emptied when full."""

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.tokenizer, self.model, self.parts, self.names = tokenizer, tokenizer.model, {}, _byte_names()

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part.translate(self.names))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= _LONG:
            if len(self.parts) >= _KNOWN:
                self.parts.clear()
            self.parts[part] = packed
        return packed

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk) and "<|" not in chunk:
            parts = self.parts
            packed = b"".join([parts.get(p) or self._part(p) for p in _PART.findall(chunk.lower())])
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= _LONG:
            if len(self) >= _KNOWN:
                self.clear()
                self[""] = b""
            self[chunk] = packed
        return packed


def token_encoder(definition: str):
    """A function from a text to its ids as little-endian 32-bit bytes, for a lower-casing
    byte-level tokenizer definition (JSON) with word ends.  It never joins over white
    space, so the ids of chunks and their parts can be remembered."""
    from tokenizers import Tokenizer

    chunks = _Chunks(Tokenizer.from_str(definition))

    def encode(text: str) -> bytes:
        for c in "\t\n\x0b\x0c\r":
            if c in text:
                text = text.replace(c, " ")
        return b"".join(map(chunks.__getitem__, text.split(" ")))

    return encode


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """One row a piece (columns ``PIECES``): pieces of ``limit`` ids, the last shorter."""
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver; tasks get the text
        definition = f.read()

    def run(batches):
        encode = token_encoder(definition)
        end = struct.pack("<I", end_id)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, PIECES)


class _Plan:
    """Counts still to pack and the runs made so far."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit, self.left, self.used = limit, {w: n for w, n in counts.items() if n}, {}
        self.sizes, self.sequences, self.runs = sorted(self.left), 0, []

    def take(self, length: int, first: int, sequences: int, each: int, offset: int) -> None:
        """Put ``each`` pieces of ``length`` into each of ``sequences`` from ``first``."""
        n = sequences * each
        rank = self.used.get(length, 0)
        self.runs.append((length, rank, n, first, each, offset))
        self.used[length] = rank + n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            del self.sizes[bisect_left(self.sizes, length)]

    def fix(self, lengths: list[int], sequences: int) -> None:
        offset = 0
        for w in lengths:
            self.take(w, self.sequences, sequences, 1, offset)
            offset += w
        self.sequences += sequences

    def smallest(self, n: int, without: int) -> list[int]:
        """The ``n`` smallest pieces left besides one of length ``without``."""
        out = []
        for w in self.sizes:
            out += [w] * min(n - len(out), self.left[w] - (w == without))
            if len(out) == n:
                break
        return out

    def count(self, w: int, without: tuple[int, ...]) -> int:
        return self.left.get(w, 0) - without.count(w)

    def largest(self, most: int, without: tuple[int, ...]) -> int:
        """The largest length up to ``most`` with a piece besides ``without``, or 0."""
        for k in range(bisect_right(self.sizes, most) - 1, -1, -1):
            if self.count(self.sizes[k], without) > 0:
                return self.sizes[k]
        return 0

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum up to ``room`` of two pieces besides one of length ``without``."""
        best, j = 0, len(self.sizes) - 1
        for i, x in enumerate(self.sizes):
            while j >= i and x + self.sizes[j] > room:
                j -= 1
            if j < i:
                break
            for y in self.sizes[max(i, j - 1):j + 1]:
                need = {x: 1, y: 1} if x != y else {x: 2}
                if all(self.count(w, (without,)) >= c for w, c in need.items()):
                    best = max(best, x + y)
        return best

    def dominating(self, w: int) -> list[int] | None:
        """A set with ``w`` that dominates all others with it, if one is proven.

        A set dominates another if the other's pieces can be split among its own, each
        share no longer than the piece that receives it: exchanging them then never
        costs a sequence.
        """
        room = self.limit - w
        few = self.smallest(3, w)
        if not few or few[0] > room:
            return [w]  # nothing fits beside it
        k = self.largest(room, (w,))
        if k == room or len(few) < 2 or few[0] + few[1] > room:
            return [w, k]  # one piece fits at most, and none better than k
        if len(few) == 3 and sum(few) <= room:
            return None
        # two pieces fit at most
        if self.best_pair(room, w) <= k:
            return [w, k]
        b = self.largest(room - k, (w, k))
        if not b:
            return None
        # k and b take any pair whose smaller piece is at most b, or that fits in k whole
        at = bisect_right(self.sizes, b)
        for y in self.sizes[at:]:
            if 2 * y > room:
                break
            x = self.largest(room - y, (w, y))
            if x >= y and x + y > k:
                return None
        return [w, k, b]

    def reduce(self) -> None:
        for w in sorted(self.sizes, reverse=True):
            while self.left.get(w):
                found = self.dominating(w)
                if not found:
                    break
                self.fix(found, min(self.left[x] // found.count(x) for x in set(found)))

    def best_fit(self) -> None:
        rooms: list[int] = []  # of open sequences, sorted
        open_: dict[int, list[tuple[int, int]]] = {}  # room: runs of sequences (first, number)

        def add(room, first, n):
            if room and n:
                if room not in open_:
                    insort(rooms, room)
                    open_[room] = []
                open_[room].append((first, n))

        for w in sorted(self.sizes, reverse=True):
            while need := self.left.get(w, 0):
                i = bisect_left(rooms, w)
                if i < len(rooms):
                    room = rooms[i]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[i]
                else:
                    room, first, n = self.limit, self.sequences, -(-need // (self.limit // w))
                    self.sequences += n
                each = room // w
                full = min(n, need // each)
                if full:
                    self.take(w, first, full, each, self.limit - room)
                    add(room - each * w, first, full)
                part = need - full * each if full < n else 0
                if part:
                    self.take(w, first + full, 1, part, self.limit - room)
                    add(room - part * w, first + full, 1)
                add(room, first + full + bool(part), n - full - bool(part))


def plan(counts: dict[int, int], limit: int) -> tuple[list[tuple], int]:
    """Runs (length, rank, pieces, first sequence, pieces a sequence, offset) that pack
    ``counts`` pieces of each length, and the number of sequences."""
    p = _Plan(counts, limit)
    p.reduce()
    p.best_fit()
    return p.runs, p.sequences


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "r0", "n", "s0", "each", "off")])


def pack(pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row a length
    total = sum(counts.values())
    runs, _ = plan(counts, limit)
    wide = F.lit(math.isqrt(total) + 1)
    numbered = running(pieces, ["length"], hash_buckets(total, "doc_id", "piece"), [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")
    numbered = numbered.withColumn("cell", F.floor(F.col("rank") / wide))
    spans = spark.createDataFrame(runs, RUN).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("r0") / wide), F.floor((F.col("r0") + F.col("n") - 1) / wide))))
    met = numbered.join(spans, ["length", "cell"]).where("rank >= r0 AND rank < r0 + n").withColumn("j", F.col("rank") - F.col("r0"))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("s0") + F.floor(F.col("j") / F.col("each"))).alias("sequence_id"),
                      (F.col("off") + (F.col("j") % F.col("each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize ``docs`` whole, cut what is longer than ``limit``, and pack."""
    return pack(staged(tokenized_pieces(docs, tokenizer_path, limit, end_id), "pieces"), limit)
