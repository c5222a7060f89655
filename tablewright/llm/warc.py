"""WARC archives of pages: a deduplicating writer and a salvaging reader.

The writer makes each record one gzip member and hands the members to Spark's own
text writer, whose committer lets jobs survive lost executors; an empty gzip
member separates them, so every file is a plain sequence of members.  Records of
equal payload of at least ``least`` bytes become revisits of the one with the
smallest page_id.

The reader takes members and uncompressed records.  Every record's length, end and
block digest are checked; after a failed check it searches for the next member or
version line at which a whole valid record stands, goes on there, and logs the bytes
between as a quarantined gap.  A member of several records is searched in the same
way, as far as it can be inflated.  No damage stops it.

Defined results: a null html is an empty payload; a null page_id makes a response
that no revisit names; a null url is left out, and control characters of a url
are percent-encoded; repeated rows of the smallest page_id are all responses; an
empty table makes an archive without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.duplicates import fingerprint, flagged
from ..session import shared_path
from .common import only, staged

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 16


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def build_record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) has an empty block."""
    block = b"" if refers_to is not None else payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit")]
    if page_id is not None:
        head.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    head += [("WARC-Date", DATE), ("Content-Type", "text/html; charset=utf-8"), ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _digest_holds(block: bytes, digest: str) -> bool | None:
    """Whether ``digest`` (algorithm:value, in hexadecimal digits or base 32) is that of
    ``block``; None if there is none or its algorithm is not known."""
    name, _, want = digest.partition(":")
    name, want = name.strip().lower().replace("-", ""), want.strip()
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return None
    have = hashlib.new(name, block, usedforsecurity=False)
    if len(want) == 2 * have.digest_size:
        return have.hexdigest() == want.lower()
    return base64.b32encode(have.digest()).decode().rstrip("=") == want.upper().rstrip("=")


def _parse(data: bytes, at: int):
    """The record whose version line is at ``at``: (headers, block, end, whether a block
    digest was checked), or the reason why there is no valid one."""
    if data[at:at + 7] != b"WARC/1.":
        return "no version line"
    head, p = {}, data.find(b"\r\n", at) + 2
    while p > 1:
        stop = data.find(b"\r\n", p)
        if stop <= p:
            break
        name, colon, value = bytes(data[p:stop]).partition(b":")
        if not colon:
            return "bad header line"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        p = stop + 2
    if p < 2 or stop < 0:
        return "headers do not end"
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16):
        return "bad content length"
    begin, end = stop + 2, stop + 2 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return "record is cut or its length is wrong"
    block = bytes(data[begin:end])
    holds = _digest_holds(block, head.get("warc-block-digest", ""))
    return "block digest differs" if holds is False else (head, block, end + 4, bool(holds))


def _inflate(data: bytes, at: int):
    """The gzip member at ``at``: (content, end, None), or (what can be inflated, where
    that stops, the reason why it is not whole)."""
    z, out, p = zlib.decompressobj(31), [], at
    view = memoryview(data)
    while not z.eof and p < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(view[p:p + _CHUNK]))
        except zlib.error as e:
            try:  # what stands before the error, byte by byte
                while True:
                    out.append(before.decompress(view[p:p + 1]))
                    p += 1
            except zlib.error:
                return b"".join(out), p, f"bad member: {e}"
        p += _CHUNK
    p = min(p, len(data))
    return b"".join(out), p - len(z.unused_data), None if z.eof else "member is cut"


def _next_line(data: bytes, at: int) -> int:
    """The first place from ``at`` on with a version line, or -1."""
    line = data.find(b"WARC/1.", at)
    while line > 0 and data[line - 1] != 10:
        line = data.find(b"WARC/1.", line + 1)
    return line


def _next_start(data: bytes, at: int) -> int:
    """The first place from ``at`` on with a member's magic or a version line."""
    return min((x for x in (data.find(MAGIC, at), _next_line(data, at)) if x >= 0), default=len(data))


def _within(content: bytes, sure: bool):
    """Records and gaps of the content of a member, as ``salvage`` gives them.  Unless
    ``sure`` of the content, only records with a checked digest are valid."""
    at = 0
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        start, reason = at, None
        while True:
            got = _parse(content, at)
            if not isinstance(got, str) and not (sure or got[3]):
                got = "no digest to check in a bad member"
            if not isinstance(got, str):
                break
            reason = reason or got
            at = _next_line(content, at + 1)
            if at < 0:
                yield "gap", start, len(content) - start, reason, None
                return
        if reason:
            yield "gap", start, at - start, reason, None
        yield "record", at, got[2] - at, got[0], got[1]
        at = got[2]


def _at(data: bytes, at: int):
    """What starts at ``at``: (records and gaps, end, reason why it is not whole)."""
    if data[at:at + 3] == MAGIC:
        content, end, reason = _inflate(data, at)
        return list(_within(content, reason is None or reason == "member is cut")), end, reason
    got = _parse(data, at)
    return ([], at, got) if isinstance(got, str) else ([("record", at, got[2] - at, *got[:2])], got[2], None)


def salvage(data: bytes):
    """Everything in one archive file, in order: ("record", start, length, headers,
    block) for whole valid records, ("gap", start, length, reason, None) for the
    bytes between.  For records and gaps in a member these are its own start and length;
    a bad member's records come before the gap that begins with it."""
    at, gap = 0, None
    while at < len(data):
        if gap is None and data[at] in b"\r\n":
            at += 1
            continue
        found, end, reason = _at(data, at)
        if any(x[0] == "record" for x in found):
            if gap:
                yield "gap", gap[0], at - gap[0], gap[1], None
                gap = None
            for kind, start, length, what, block in found:
                if kind == "gap" and reason is None:
                    yield "gap", at, end - at, f"{length} bytes from {start} of the member's content: {what}", None
                elif kind == "record":
                    yield "record", at, end - at, what, block
        elif gap is None and found and reason is None:
            gap = (at, found[0][3])
        if reason is None:
            at = end if gap is None else _next_start(data, end)  # an empty member ends no gap
            continue
        gap = gap or (at, reason)
        at = _next_start(data, at + 1)
    if gap:
        yield "gap", gap[0], len(data) - gap[0], gap[1], None


def write_archive(pages: DataFrame, path: str, least: int = 100, records_per_file: int = 4000) -> None:
    """Write ``pages`` (page_id, url, html) as gzip member WARC files under ``path``."""
    rows = only(pages, page_id="long", url="string", html="string")
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = rows.select("page_id", "url", payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    repeated = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = staged(repeated.where("n > 1").drop("n"), "warc-repeated")
    # the html of a page travels only if its digest may be a repeated one
    pages = flagged(rows, ["digest"], first.select(*fingerprint(["digest"])), "repeats")
    columns = ["page_id", "url", "html", "digest"]
    many = pages.where("repeats").join(first, "digest", "left").select(
        *columns, F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))
    joined = pages.where("NOT repeats").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(many)

    def run(batches):
        for b in batches:
            members = [gzip_member(build_record(i.as_py(), u.as_py(), h.as_py().encode("utf-8", "surrogatepass"), d.as_py(), r.as_py()))
                       for i, u, h, d, r in zip(*b.columns, strict=True)]
            yield pa.record_batch([pa.array(members, pa.binary())], names=["member"])

    separator = gzip_member(b"").decode("latin-1")
    (joined.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path))


RECORDS = ("kind string, file string, start long, length long, reason string, record_type string, page_id long, url string, "
           "payload_bytes long, payload_digest string, refers_to long, payload binary")


def _number(urn: str | None):
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() and digits.isascii() else None


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archive files under ``path`` (columns ``RECORDS``)."""
    def row(file, kind, start, length, head, block):
        if kind == "gap":
            return (kind, file, start, length, head, None, None, None, None, None, None, None)
        revisit = head.get("warc-type") == "revisit"
        digest = head.get("warc-payload-digest", "").rpartition(":")[2] if revisit else hashlib.sha256(block).hexdigest()
        n = int(head.get("x-payload-length", 0)) if revisit else len(block)
        return (kind, file, start, length, None, head.get("warc-type"), _number(head.get("warc-record-id")), head.get("warc-target-uri"),
                n, digest, _number(head.get("warc-refers-to")), block if payloads and not revisit else None)

    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches):
        for b in batches:
            for name, content in zip(*b.columns, strict=True):
                rows = []
                for found in salvage(content.as_py()):
                    rows.append(row(name.as_py(), *found))
                    if len(rows) == 256:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def warc_query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path, payloads=False).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
