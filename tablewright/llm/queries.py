"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, interaction, licenses, mixing, mtree, packing, pii, quality, sharding, simhash, token_counts, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of an installed public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix_sources(spark, sf_dir):
    return mixing.taken(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeat=2)


def op2_shard_documents(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op3_license_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op5_personal_data(spark, sf_dir):
    return pii.pii_query(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark, sf_dir):
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048, end_id=0)


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model")))


def op9_warc_archive(spark, sf_dir):
    return warc.warc_query(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_query(_table(spark, sf_dir, "documents"))


def op11_filter_interaction(spark, sf_dir):
    return interaction.interaction_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark, sf_dir):
    return trie.trie_query(_table(spark, sf_dir, "conversations"))


def op13_decontamination(spark, sf_dir):
    return decontam.contamination_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_shard_documents, op3_license_scan, op4_simhash_near_dedup, op5_personal_data, op6_exact_top_k,
    op7_best_fit_packing, op8_token_counts, op9_warc_archive, op10_quality_rules,
    op11_filter_interaction, op12_conversation_trie, op13_decontamination,
)}

ORACLE = {
    "op6_exact_top_k": mtree.SQL,
    "op9_warc_archive": warc.SQL,
    "op10_quality_rules": quality.sql(),
    "op11_filter_interaction": interaction.SQL,
    "op12_conversation_trie": trie.SQL,
    "op13_decontamination": decontam.SQL,
}
