"""CSV / JSON / parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path
from .csvfile import CORRUPT, QUOTING, CsvFiles, infer_schema, is_splittable, read_records

# The stages at which a read can fail.
WRONG_ENCODING, READ_FAILED, NO_TARGET = "csv_read_encoding", "csv_read_other", "target_column_missing"


def _one_task_csv(spark: SparkSession, path: str, schema: T.StructType | None, header: bool, options: dict) -> DataFrame:
    """Files of encodings that cannot be split, one task a file."""
    reader = spark.read.options(header=str(header).lower(), **QUOTING, **options)
    if schema is None:
        return reader.option("inferSchema", "true").csv(path)
    if not header:
        return reader.schema(schema).csv(path)
    names = [n for n in spark.read.options(header="true", **QUOTING, **options).csv(path).columns]
    if sorted(names) != sorted(n for n in schema.fieldNames() if n != CORRUPT):
        raise ValueError(f"header {names} does not name the columns {schema.fieldNames()}")
    ordered = T.StructType([*[schema[n] for n in names], *[f for f in schema if f.name == CORRUPT]])
    return reader.schema(ordered).csv(path).select(*schema.fieldNames())


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               header: bool = True, null_value: str | None = None,
               trim_leading: bool = False, fmt: str = "csv", **options) -> DataFrame:
    """A1/A2: CSV with header (or a given schema for headerless files), read in splits
    whatever its line breaks.  An explicit schema is preferred: inference turns ISO date
    text into DATE.  Each file's columns are bound by the names in its own header."""
    if fmt != "csv":
        reader = spark.read.format(fmt).options(**options)
        return (reader.schema(schema) if schema is not None else reader).load(path)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    given["ignoreLeadingWhiteSpace"] = str(trim_leading).lower()
    if null_value is not None:
        given["nullValue"] = null_value
    encoding = given.pop("encoding", "UTF-8")
    if not is_splittable(encoding):
        return _one_task_csv(spark, path, schema, header, {**given, "encoding": encoding})
    files = CsvFiles(spark, path, given.pop("sep", given.pop("delimiter", ",")), encoding)
    if schema is None:
        names = next(iter(files.headers()), ())
        if not header:
            names = tuple(f"_c{i}" for i in range(len(names)))
        texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
        schema = infer_schema(read_records(files, texts, header, **given))
    return read_records(files, schema, header, **given)


def read_with_quarantine(spark: SparkSession, path: str, schema: T.StructType,
                         target: str | None = None, encoding: str = "UTF-8", header: bool = True,
                         stage_path: str | None = None):
    """A3: PERMISSIVE read that tags failures instead of raising.

    The CSV is parsed ONCE, in splits, and staged as parquet (parsed columns plus the
    corrupt-record text) under the shared checkpoint folder, or ``stage_path``.
    Good and quarantined rows are then plain columnar scans of the staged
    table: later passes never re-parse the text, and queries that need only
    the corrupt-record column (such as a count) are allowed.

    Returns (good rows, quarantined rows, record) where ``record`` carries
    ``stage_failed`` ('csv_read_encoding' | 'csv_read_other' | 'target_column_missing') when
    the whole read cannot proceed.  A file most of whose lines beyond ASCII are no UTF-8 has
    another encoding, and its numbers stand in ``record["encoding"]``; single such lines are
    quarantined.
    """
    record = {"path": path}
    if target is not None and target not in schema.fieldNames():
        record["stage_failed"] = NO_TARGET
        return None, None, record
    stage = stage_path or shared_path(spark, "quarantine-stage")
    try:
        if is_splittable(encoding):
            files = CsvFiles(spark, path, encoding=encoding)
            if encoding.lower().replace("-", "") == "utf8" and sum(s["n_bad"] for s in files.splits):
                wrong = [r.asDict() for r in files.encoding_report().where("wrong_encoding").collect()]
                if wrong:
                    record["stage_failed"] = WRONG_ENCODING
                    record["encoding"] = wrong
                    record["error"] = f"{len(wrong)} file(s) are not {encoding}; try encoding='ISO-8859-1' or 'windows-1252'"
                    return None, None, record
            parsed = read_records(files, schema, header, corrupt=True)
        else:
            full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
            parsed = _one_task_csv(spark, path, full, header, {"encoding": encoding, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        parsed.write.mode("overwrite").parquet(stage)
    except Exception as exc:  # noqa: BLE001 -- recorded as a stage failure
        record["stage_failed"] = READ_FAILED
        record["error"] = f"{type(exc).__name__}: {exc}"
        return None, None, record
    df = spark.read.parquet(stage)
    record["staged"] = stage
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull())
    return good, bad, record


def encoding_report(spark: SparkSession, path: str, most_bad: float = 0.9) -> DataFrame:
    """A3: which files are not UTF-8, by their bytes: see ``CsvFiles.encoding_report``."""
    return CsvFiles(spark, path).encoding_report(most_bad)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A4: overwrite a table (CSV with header, or parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", "true").option("escape", '"')
    w.format(fmt).save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A5: one JSON record."""
    df.coalesce(1).write.mode("overwrite").json(path)   # a single-row frame


def read_baseline(spark: SparkSession, path: str, field: str = "baseline_f1_score") -> float:
    """A5: the baseline F1 written by ``write_metrics``; a missing file is a
    hard error that says what to run."""
    try:
        row = spark.read.json(path).select(field).first()
    except Exception as exc:  # noqa: BLE001
        raise FileNotFoundError(f"{path} not found: compute the baseline first "
                                f"(operators.model.baseline_metrics + sources.files.write_metrics)") from exc
    if row is None:
        raise FileNotFoundError(f"{path} holds no baseline record")
    return float(row[0])
