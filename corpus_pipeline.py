"""A training-data pipeline over ``documents``: five stages, each reading what the one
before wrote.

All stages share these results: an empty table gives an empty one; a null text counts as
empty and stays null; texts of any length are used whole; a null doc_id is kept like any
other; repeated rows are rows of their own unless a stage says otherwise; further columns,
whatever their names and types, are passed through up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import mixing, packing, pii, quality, simhash
from tablewright.llm.common import staged
from tablewright.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the threshold table rejects go, null and empty ones among them; equal
    rows are judged alike."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("text", row.alias("_row"))
    return quality.apply_rules(rows).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id, null last.
    Repeated rows are such a group; of rows with one doc_id and text the one with the least
    hash of all columns stays.  Texts without words form one group."""
    return simhash.deduplicated(docs, shingle=3, radius=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and n_chars counts the new text; equal texts are masked alike."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their weights; null is a
    source of its own, and rows without words stay once.  Rows that agree in source, doc_id
    and text share their copies evenly, ties by a hash of their other columns."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, max_repeat=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048; an empty text
    is the end id alone, each repeated row is packed, and other columns end here."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), limit=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("source mix", mix),
    ("best-fit packing", pack),
]

#: Tokenizing and the learned patterns are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's rows: one for each packed piece."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
