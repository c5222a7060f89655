"""Personal data: fixed base patterns, and bootstrapped contextual extraction.

Base matches (e-mail, IP, card, phone) are the seeds.  Whatever else is shaped like an
identifier, over blanks and inside long tokens too, is an instance.  The one or two words
before it are lexical patterns; inside a token these are what stands before it there, and
the last word and marks of that.  Spark builds the graph of patterns and instances and scores it iteratively:

* a pattern's confidence for a kind is the share of its occurrences in the whole corpus,
  whatever word follows, that introduce an instance of this kind, each weighing its
  score; tokens that have the kind's shape but no score yet weigh a quarter of a
  miss; it counts only with ``min_support`` distinct scored instances;
* an instance's score is 1 for a seed, else the noisy-or of its patterns' confidences.

Scores only rise, so patterns only join; learning ends when a round adds none.  Instances after a pattern of at least ``min_confidence`` in the last round are added
as spans of the pattern's kind.  Base spans always stay.

Defined results: a null text is empty; an empty one has no spans; long texts and long
runs of one character are searched in linear time; equal rows get equal results; a null
doc_id is kept; an empty table gives an empty result; ``redact`` passes all other
columns through.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match always starts where a run of digits does, so inner digits need no try.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile("[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]|[\[(]at[\])]", re.IGNORECASE)


def _emails(text: str):
    """Leftmost non-overlapping e-mail matches, found from each @ so that long runs cost
    no more than their length."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        # the part before an @ cannot reach over an earlier one
        floor = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", floor)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in ``KINDS``, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: What else may be an identifier; a match always starts where a run of digits does.
_SHAPES = {
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9]++(?:\.[0-9]++){3,}+|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Za-z:]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])(?<![0-9][-. ])[0-9](?:[-. ]?[0-9]){12,18}(?![0-9A-Za-z]|[-. ][0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?<![0-9][-./() ])[(]?[0-9](?:[-./() ]{0,2}[0-9]){6,14}(?![0-9A-Za-z]|[-./() ][0-9])"),
}
_AT = re.compile(r"@|[ ]?[\[(][ ]?at[ ]?[\])][ ]?", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_EDGES = ".,;!?'\"<>{}"
_OPENS = frozenset(" \t\n\x0b\x0c\r\"'([{<:=,;")
_SHUTS = frozenset(" \t\n\x0b\x0c\r\"')]}>.,;:!?")
#: Longer context words are known by a digest, longer glued contexts by their end alone.
_LONG = 48
#: Characters in a word after which an identifier glued to them may start.
_GLUES = (_OPENS | set(_EDGES)) - set(" \t\n\x0b\x0c\r")
_GLUE = re.compile("[" + re.escape("".join(sorted(_GLUES))) + "](?![\x20\x09-\x0D]|\\Z)")


def _short(word: str) -> str:
    return word if len(word) <= _LONG else "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _fold(word: str) -> str:
    return _DIGIT.sub("0", word.lower())


def _norm(word: str) -> str:
    return _short(_fold(word))


def _glued(text: str, start: int, at: int, before: str | None) -> list[str]:
    """Patterns of the place ``at`` inside the word from ``start`` that follows the word ``before``."""
    out = []
    if at - start <= _LONG:
        out.append(_fold(text[start:at]))
        if before is not None:
            out.append(f"{before} {out[0]}")
    marks = at
    while marks > start and at - marks < 8 and not text[marks - 1].isalnum():
        marks -= 1
    word = marks
    while word > start and text[word - 1].isalnum():
        word -= 1
    if word < marks:
        out.append(_norm(text[word:marks]) + text[marks:at])
    return list(dict.fromkeys(out))


def _shaped(text: str):
    """(kind, start, end) of whatever has the shape of an identifier."""
    floor = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, m.end()) if start < m.start() else None
        floor = host.end() if host else m.end()
        if host:
            yield "email", start, host.end()
    for kind, shape in _SHAPES.items():
        for m in shape.finditer(text):
            yield kind, m.start(), m.end()


def instances(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, bool, list[str]]]:
    """(kind, start, end, value, seed, patterns): the base spans that stand alone, and
    whatever else has the shape of a kind."""
    if not _HINT.search(text):
        return []
    starts = array("q", (m.start() for m in _WORD.finditer(text)))

    def word(i):
        return _WORD.match(text, starts[i])

    def before(start):
        i = bisect_left(starts, start)
        if not i:
            return []
        last = word(i - 1)
        if last.end() > start:
            return _glued(text, last.start(), start, _norm(word(i - 2)[0]) if i > 1 else None)
        name = _norm(last[0])
        return [name] + ([f"{_norm(word(i - 2)[0])} {name}"] if i > 1 else [])

    def alone(a, b):
        return (a == 0 or text[a - 1] in _OPENS or text[a - 1] in _GLUES) and (b == len(text) or text[b] in _SHUTS)

    found = []
    for kind, a, b in spans:
        if (a == 0 or text[a - 1] in _OPENS) and (b == len(text) or text[b] in _SHUTS):
            found.append((kind, a, b, _short(text[a:b].lower()), True, before(a)))
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    ends = [b for _, b in covered]
    for kind, a, b in _shaped(text):
        k = bisect_right(ends, a)
        if b - a >= 5 and alone(a, b) and not (k < len(covered) and covered[k][0] < b):
            found.append((kind, a, b, _short(text[a:b].lower()), False, before(a)))
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_INSTANCE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("seed", pa.bool_()),
                       ("patterns", pa.list_(pa.string()))])
_SCAN = ("doc_id long, rid long, base array<struct<kind:string,start:bigint,end:bigint>>, "
         "found array<struct<kind:string,start:bigint,end:bigint,value:string,seed:boolean,patterns:array<string>>>")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that tells texts of one doc_id apart."""
    return only(docs, doc_id="long", text="string").select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("rid"))


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and instances of every row."""
    def run(batches):
        for b in batches:
            base = [base_spans(t.as_py()) for t in b.column("text")]
            found = [instances(t.as_py(), s) for t, s in zip(b.column("text"), base, strict=True)]
            spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in base]
            rows = [[dict(zip(("kind", "start", "end", "value", "seed", "patterns"), x, strict=True)) for x in f] for f in found]
            yield pa.record_batch([b.column("doc_id"), b.column("rid"), pa.array(spans, pa.list_(_SPAN)), pa.array(rows, pa.list_(_INSTANCE))],
                                  names=["doc_id", "rid", "base", "found"])

    return _keyed(docs).mapInArrow(run, _SCAN)


#: Bits of the filter that the counting pass carries; its size never changes.
_FILTER_BITS = 1 << 23


def _filter(patterns: DataFrame) -> bytes:
    """A bitmap of the CRC-32 of all ``patterns``, put together from at most 2^17 words."""
    words = (patterns.select((F.crc32(F.col("pattern").cast("binary")) % _FILTER_BITS).alias("b"))
             .groupBy(F.floor(F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect())
    out = bytearray(_FILTER_BITS // 8)
    for r in words:
        out[8 * r.w:8 * r.w + 8] = (r.v & (1 << 64) - 1).to_bytes(8, "little")
    return bytes(out)


def followers(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n_all): in how many places of the corpus a word, or the rest of the word
    behind a place where an instance may start, follows each of ``patterns``."""
    bits = _filter(patterns)

    def run(batches):
        counts: dict[str, int] = {}
        crc, get = zlib.crc32, counts.get

        def flush():
            names = list(counts)
            out = pa.record_batch([pa.array(names, pa.string()), pa.array([counts[n] for n in names], pa.int64())], names=["pattern", "n"])
            counts.clear()
            return out

        for b in batches:
            for t in b.column("text"):
                text = t.as_py()
                starts, w = [], []
                for m in _WORD.finditer(text):
                    starts.append(m.start())
                    w.append(_norm(m[0]))
                inner = []
                for m in _GLUE.finditer(text):
                    i = bisect_left(starts, m.end()) - 1
                    inner += _glued(text, starts[i], m.end(), w[i - 1] if i else None)
                w.pop() if w else None  # nothing follows the last word
                for p in (*w, *map(" ".join, zip(w, w[1:])), *inner):
                    x = crc(p.encode("utf-8", "surrogatepass")) & _FILTER_BITS - 1
                    if bits[x >> 3] >> (x & 7) & 1:
                        counts[p] = get(p, 0) + 1
                if len(counts) > 1 << 16:
                    yield flush()
        yield flush()

    found = _keyed(docs).select("text").mapInArrow(run, "pattern string, n long")
    return found.groupBy("pattern").agg(F.sum("n").alias("n_all")).join(patterns, "pattern", "left_semi")


def learn(docs: DataFrame, scanned: DataFrame, rounds: int | None = None, min_confidence: float = 0.8, min_support: int = 3,
          unknown: float = 0.25) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that may discover identifiers, after the
    first round that adds no pattern, or after ``rounds``."""
    each = scanned.select(F.explode("found").alias("x")).select("x.kind", "x.value", "x.seed", F.explode("x.patterns").alias("pattern"))
    edges = staged(each.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    eligible = edges.groupBy("pattern", "kind").agg(F.count("*").alias("v")).where(F.col("v") >= min_support).select("pattern").distinct()
    eligible = staged(eligible, "eligible")
    graph = staged(edges.join(followers(docs, eligible), "pattern"), "graph")
    scores = graph.where("seed").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    known, done = 0, 0
    while True:
        weighed = graph.join(scores, ["value", "kind"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        patterns = weighed.groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("n").alias("shaped"), F.max("n_all").alias("n_all"),
            F.sum((F.col("score") >= min_confidence).cast("int")).alias("support"))
        misses = F.col("n_all") - F.col("shaped") + F.lit(unknown) * (F.col("shaped") - F.col("hits"))
        patterns = staged(patterns.withColumn("confidence", F.col("hits") / (F.col("hits") + misses + 1))
                          .where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support))
                          .select("pattern", "kind", "confidence"), "patterns")
        found, done = patterns.count(), done + 1
        if found == known or done == rounds:
            return patterns
        known = found
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        heard = graph.join(patterns, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - miss).alias("score"), F.max("seed").alias("seed"))
        learned = heard.where("NOT seed").select("value", "kind", "score")
        scores = graph.where("seed").select("value", "kind", F.lit(1.0).alias("score")).distinct().unionByName(learned)
        scores = staged(scores, "scores")


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, rid, more): the spans that ``patterns`` add to each row that has any."""
    places = scanned.select("doc_id", "rid", F.explode("found").alias("x")).where("NOT x.seed").select(
        "doc_id", "rid", "x.kind", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    hits = places.join(patterns, ["pattern", "kind"]).groupBy("doc_id", "rid", "start", "end").agg(
        F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    return hits.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))


def _with_more(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Equal rows share their spans; ``more`` has one row for each (doc_id, rid)."""
    m = more.select(F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), "more")
    return rows.join(m, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rid") == F.col("_r")), "left").drop("_d", "_r")


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, more) for every row: arrays of (kind, start, end)."""
    scanned = staged(scan(docs), "scan")
    more = discovered(scanned, learn(docs, scanned, **options))
    return _with_more(scanned.select("doc_id", "rid", "base"), more).drop("rid")


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind):
    return lambda span: span["kind"] == kind


def _ordered(spans):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(kinds, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def pii_query(docs: DataFrame, **options) -> DataFrame:
    found = find(docs, **options)
    more = F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _joined(_ordered(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_added"))


def masked(text: str, spans) -> str:
    """``text`` with every span, or run of overlapping ones, replaced by its first kind."""
    out, at = [], 0
    merged = []
    for start, end, kind in sorted((s["start"], s["end"], s["kind"]) for s in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the spans of every text masked; null texts stay null."""
    scanned = staged(scan(docs), "scan")
    more = staged(discovered(scanned, learn(docs, scanned, **options)), "discovered")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select(
        "_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.text").cast("string").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64(text_or_empty()))
    joined = _with_more(rows, more)

    @F.pandas_udf("string")
    def mask(text: pd.Series, extra: pd.Series) -> pd.Series:
        def one(t, added):
            base = [dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(t)]
            return masked(t, base + list(added if added is not None else ()))

        return pd.Series([None if t is None else one(t, m) for t, m in zip(text, extra, strict=True)], dtype=object)

    columns = [mask("text", "more").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*columns)
