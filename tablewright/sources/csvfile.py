"""CSV files of any size read in splits, line breaks inside quotes included.

Lines are read in splits that any task can take.  Whether a line begins inside quotes
depends on all lines before it, but only through one bit, so a line maps the state before
it to the state after it: one of four functions, which compose.  A first pass composes the
lines of each split (and looks at its bytes); a prefix scan over the splits, a few numbers
each, gives every split the state it starts in.  The second pass joins the lines of a
split into records on its own; records that cross splits are put together from their
pieces, at most two a split.  Records are parsed by Spark's own CSV expression.

The rules of quoting are those of the one-task reader: a quote opens a field only at the
field's start, is doubled inside, and what follows the closing quote belongs to the field.
A line ends at a line feed, a carriage return before it belongs to the line's end; inside
quotes both stay as they are.  Encodings must keep ASCII as it is (UTF-8, ISO-8859-1,
windows-125x and the like); others are read by the one-task reader.
"""

from __future__ import annotations

import csv
import io
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

# Functions that run in tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORRUPT = "_corrupt_record"
#: Encodings whose bytes below 128 are ASCII characters and nothing else.
SPLITTABLE = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859-", "latin1", "latin-1", "windows-125", "cp125")
#: How Spark's parser is to read a record that quotes line breaks and doubles quotes.
QUOTING = {"quote": '"', "escape": '"', "multiLine": "true"}

_SPLIT = "file long, block long, open0 boolean, open1 boolean, bytes long, lines long, n_bad long, n_wide long, bad_at long, header binary, whole_header boolean"
_RECORD = "file long, block long, kind int, first boolean, record binary"
_WHOLE, _HEAD, _REST = 0, 1, 2


def is_splittable(encoding: str) -> bool:
    return encoding.lower().startswith(SPLITTABLE)


def _line_patterns(sep: str) -> tuple[str, str]:
    """Whether a line that begins outside (inside) quotes leaves them open."""
    s = "\\" + sep if sep in r"\^]-|.$*+?()[{" else sep
    inner, tail = '(?:[^"]|"")*', f'(?:[^"{s}][^{s}]*)?'
    fields = f'(?:(?:"{inner}"{tail}|[^"{s}][^{s}]*)?{s})*'
    return f'^{fields}"{inner}$', f'^{inner}(?:"{tail}{s}{fields}"{inner})?$'


class _Lines:
    """The lines of one batch that lie in one split, with the state before each."""

    def __init__(self, sep: str):
        self.outside, self.inside = _line_patterns(sep)

    def functions(self, values: pa.Array) -> list[tuple[int, bool, bool]]:
        """(line, open after it if outside before, if inside) of the lines with quotes."""
        at = np.flatnonzero(pc.match_substring(values, b'"').to_numpy(zero_copy_only=False))
        if not len(at):
            return []
        some = values.take(pa.array(at))
        from0 = pc.match_substring_regex(some, self.outside.encode()).to_pylist()
        from1 = pc.match_substring_regex(some, self.inside.encode()).to_pylist()
        return list(zip(at.tolist(), from0, from1, strict=True))


def _runs(batch: pa.RecordBatch):
    """((file, block), lines) of the splits in a batch, in order."""
    file, block = (batch.column(n).to_numpy() for n in ("file", "block"))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
        if z > a:
            yield (int(file[a]), int(block[a])), batch.column("value").slice(a, z - a)


def _bad_lines(values: pa.Array, at: int) -> tuple[int, int, int | None]:
    """(lines that are not UTF-8, other lines beyond ASCII, byte offset of the first bad one)."""
    bad, wide, first = 0, 0, None
    try:
        values.cast(pa.string()).validate(full=True)
        ok = True
    except pa.ArrowInvalid:
        ok = False
    for line in values.to_pylist():
        if not line.isascii():
            try:
                if not ok:
                    line.decode("utf-8")
                wide += 1
            except UnicodeDecodeError:
                bad += 1
                first = at if first is None else first
        at += len(line) + 1
    return bad, wide, first


def _scan_splits(sep: str):
    """What each split does to the state, and its bytes."""
    def run(batches):
        lines, key, s = _Lines(sep), None, {}

        def done():
            return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], **s}], schema=_arrow(_SPLIT))

        for b in batches:
            for found, values in _runs(b):
                if found != key:
                    if key is not None:
                        yield done()
                    key = found
                    s = dict(open0=False, open1=True, bytes=0, lines=0, n_bad=0, n_wide=0, bad_at=None, header=None, whole_header=False)
                functions = lines.functions(values)
                if key[1] == 0 and not s["whole_header"]:
                    opens = {i: (a, z) for i, a, z in functions}
                    state = s["open0"]
                    for i, line in enumerate(values.to_pylist()):
                        s["header"] = line if s["header"] is None else s["header"] + b"\n" + line
                        state = opens.get(i, (False, True))[state]
                        if not state and s["header"] not in (b"", b"\r"):
                            s["whole_header"] = True
                            break
                        s["header"] = s["header"] if state else None
                for _, from0, from1 in functions:
                    s["open0"], s["open1"] = (from1 if x else from0 for x in (s["open0"], s["open1"]))
                size = int(pc.sum(pc.binary_length(values)).as_py()) + len(values)
                if not _is_ascii(values):
                    bad, wide, at = _bad_lines(values, s["bytes"])
                    s["n_bad"], s["n_wide"] = s["n_bad"] + bad, s["n_wide"] + wide
                    s["bad_at"] = at if s["bad_at"] is None else s["bad_at"]
                s["bytes"], s["lines"] = s["bytes"] + size, s["lines"] + len(values)
        if key is not None:
            yield done()
    return run


def _is_ascii(values: pa.Array) -> bool:
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    return data is None or not (np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] >= 128).any()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _join_records(sep: str, starts):
    """Records and pieces of records; ``starts`` says in which splits quotes are open at the start."""
    schema = _arrow(_RECORD)

    def run(batches):
        lines, key = _Lines(sep), None
        state, pending, kind, first = False, [], _WHOLE, False

        def piece(kind, first):
            return pa.RecordBatch.from_pylist([{"file": key[0], "block": key[1], "kind": kind, "first": first, "record": b"\n".join(pending)}], schema=schema)

        for b in batches:
            for found, values in _runs(b):
                if found != key:
                    if pending:  # the record goes on in the next split
                        yield piece(_REST if kind == _REST else _HEAD, first)
                    key, state, pending, first = found, found in starts.value, [], found[1] == 0
                    kind = _REST if state else _WHOLE
                before = np.zeros(len(values), dtype=bool)
                at = 0
                for i, from0, from1 in lines.functions(values):
                    before[at:i + 1] = state
                    state, at = (from1 if state else from0), i + 1
                before[at:] = state
                begins = np.flatnonzero(~before)
                lead = int(begins[0]) if len(begins) else len(values)
                if lead:
                    pending += values.slice(0, lead).to_pylist()
                if not len(begins):
                    continue
                if pending:
                    yield piece(kind, first)
                    first = first and kind != _WHOLE
                    pending, kind = [], _WHOLE
                last = int(begins[-1])  # is open, or may go on in the next batch
                if len(begins) > 1:
                    offsets = pa.array((begins - lead).astype(np.int32))
                    texts = values.slice(lead, last - lead)
                    texts = pa.concat_arrays([texts]) if texts.offset == 0 else texts.take(pa.array(np.arange(len(texts))))
                    records = pc.binary_join(pa.ListArray.from_arrays(offsets, texts), b"\n")
                    n = len(records)
                    firsts = np.zeros(n, dtype=bool)
                    if first:
                        filled = np.flatnonzero(~pc.is_in(records, pa.array([b"", b"\r"], pa.binary())).to_numpy(zero_copy_only=False))
                        if len(filled):
                            firsts[filled[0]], first = True, False
                    yield pa.record_batch([pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(np.zeros(n, np.int32)), pa.array(firsts),
                                           records], schema=schema)
                pending = values.slice(last).to_pylist()
                kind = _WHOLE
                if not state:
                    yield piece(_WHOLE, first and pending != [b""] and pending != [b"\r"])
                    first = first and pending in ([b""], [b"\r"])
                    pending = []
        if pending:
            yield piece(_REST if kind == _REST else _HEAD, first)
    return run


def _lines(spark: SparkSession, path) -> DataFrame:
    """(value, file, block): every line of every file, in order within its split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


class CsvFiles:
    """The records of the CSV file or folder at ``path``."""

    def __init__(self, spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8"):
        if not is_splittable(encoding):
            raise ValueError(f"{encoding} does not keep ASCII bytes")
        self.spark, self.path, self.sep, self.encoding = spark, path, sep, encoding
        names = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"))
        self._names = names
        found = _lines(spark, path).mapInArrow(_scan_splits(sep), _SPLIT).orderBy("file", "block")
        self.splits = found.toPandas().to_dict("records")  # a few numbers for each split
        self.open: set[tuple[int, int]] = set()
        state, file = False, None
        for s in self.splits:
            state = state if s["file"] == file else False
            file = s["file"]
            if state:
                self.open.add((file, s["block"]))
            state = bool(s["open1"] if state else s["open0"])

    def records(self) -> DataFrame:
        """(file, first, text): every record, empty ones aside, decoded; ``first`` is its file's first."""
        sent = self.spark.sparkContext.broadcast(frozenset(self.open))
        found = _lines(self.spark, self.path).mapInArrow(_join_records(self.sep, sent), _RECORD)
        out = found.where(F.col("kind") == _WHOLE).select("file", "first", "record")
        if self.open:
            parts = staged(found.where(F.col("kind") != _WHOLE), "csv-pieces")  # at most two a split
            order = ["block", F.when(F.col("kind") == _HEAD, 1).otherwise(0)]
            along = W.partitionBy("file").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
            numbered = parts.withColumn("n", F.sum((F.col("kind") == _HEAD).cast("int")).over(along))
            each = numbered.groupBy("file", "n").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("p"))
            whole = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["record"])), "0A"))
            out = out.unionByName(each.select("file", "first", whole.alias("record")))
        ended = F.when(F.endswith("record", F.lit(b"\r")), F.substring("record", F.lit(1), F.length("record") - 1)).otherwise(F.col("record"))
        # bytes that are no UTF-8 pass the cast as they are
        text = ended.cast("string") if self.encoding.lower().replace("-", "") == "utf8" else F.decode(ended, self.encoding)
        return out.select("file", "first", text.alias("text")).where("text <> ''")

    def headers(self) -> dict[tuple[str, ...], list[int]]:
        """The files by the names in their first record; nothing is read but headers that cross splits."""
        out: dict[tuple[str, ...], list[int]] = {}
        firsts = {s["file"]: s["header"] for s in self.splits if s["block"] == 0 and s["whole_header"]}
        late = {s["file"] for s in self.splits} - set(firsts)
        if late:
            firsts |= {r.file: r.text.encode() for r in self.records().where("first").where(F.col("file").isin(*late)).collect()}
        for file, header in sorted(firsts.items()):
            text = bytes(header).decode("utf-8" if self.encoding.lower().startswith("utf") else self.encoding).removeprefix("\ufeff").rstrip("\r")
            out.setdefault(tuple(next(csv.reader(io.StringIO(text, newline=""), delimiter=self.sep), ())), []).append(file)
        return out

    def encoding_report(self, most_bad: float = 0.9) -> DataFrame:
        """(path, n_lines, n_wide, n_bad, bad_share, first_bad, wrong_encoding) for each file:
        lines beyond ASCII that are (are not) UTF-8, the byte where the first bad line
        starts, and whether so many are bad that the file has another encoding."""
        files: dict[int, dict] = {}
        for s in self.splits:
            f = files.setdefault(s["file"], {"lines": 0, "wide": 0, "bad": 0, "bytes": 0, "at": None})
            if s["bad_at"] is not None and s["bad_at"] == s["bad_at"] and f["at"] is None:
                f["at"] = int(f["bytes"] + s["bad_at"])
            for k, v in (("lines", "lines"), ("wide", "n_wide"), ("bad", "n_bad"), ("bytes", "bytes")):
                f[k] += int(s[v])
        rows = [(file, f["lines"], f["wide"], f["bad"], round(f["bad"] / (f["bad"] + f["wide"]), 4) if f["bad"] else 0.0, f["at"],
                 f["bad"] > 0 and f["bad"] >= most_bad * (f["bad"] + f["wide"])) for file, f in files.items()]
        schema = "file long, n_lines long, n_wide long, n_bad long, bad_share double, first_bad long, wrong_encoding boolean"
        return self._names.distinct().join(self.spark.createDataFrame(rows, schema), "file").drop("file")


def read_records(files: CsvFiles, schema: T.StructType, header: bool = True, corrupt: bool = False, **options) -> DataFrame:
    """The records parsed by ``schema``; with a header each file's columns are bound by name.
    ``corrupt`` adds the text of records that do not fit or are no UTF-8; without it these
    give nulls."""
    found = files.records()
    if header:
        found = found.where("NOT first")
        orders = files.headers() or {tuple(schema.fieldNames()): []}
    else:
        orders = {tuple(schema.fieldNames()): []}
    for names in orders:
        if sorted(names) != sorted(schema.fieldNames()):
            raise ValueError(f"header {list(names)} does not name the columns {schema.fieldNames()}")
    given = {**QUOTING, "sep": files.sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    out = None
    for names, in_files in orders.items():
        rows = found if len(orders) == 1 else found.where(F.col("file").isin(*in_files))
        full = T.StructType([*[T.StructField(f"c{i}", schema[n].dataType) for i, n in enumerate(names)], T.StructField(CORRUPT, T.StringType())])
        parsed = rows.select("text", F.from_csv("text", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full), given).alias("r"))
        bad = F.when(~F.is_valid_utf8("text"), F.make_valid_utf8("text")).otherwise(F.col(f"r.{CORRUPT}"))
        place = {n: f"c{i}" for i, n in enumerate(names)}
        part = parsed.select(*[F.col(f"r.{place[n]}").alias(n) for n in schema.fieldNames()], *([bad.alias(CORRUPT)] if corrupt else []))
        out = part if out is None else out.unionByName(part)
    return out


#: Types that texts may have, narrowest first, and the shape a text needs for each.
_KINDS = (("int", r"^[+-]?[0-9]+$"), ("bigint", r"^[+-]?[0-9]+$"), ("double", r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"),
          ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}"), ("boolean", r"(?i)^(?:true|false)$"))


def infer_schema(rows: DataFrame) -> T.StructType:
    """The narrowest type of each text column that all its values have; one aggregate."""
    aggs = []
    for i, c in enumerate(rows.columns):
        v = F.col(f"`{c}`")
        aggs.append(F.count(v).alias(f"n{i}"))
        aggs += [F.count(F.when(v.rlike(shape), v.try_cast(kind))).alias(f"{kind}{i}") for kind, shape in _KINDS]
    r = rows.agg(*aggs).first()
    fields = []
    for i, c in enumerate(rows.columns):
        kind = next((k for k, _ in _KINDS if r[f"n{i}"] and r[f"{k}{i}"] == r[f"n{i}"]), "string")
        fields.append(T.StructField(c, T._parse_datatype_string(kind)))
    return T.StructType(fields)
