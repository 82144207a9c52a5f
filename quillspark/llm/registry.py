"""Queries and SQL of this folder, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_pages, langid, licences, mixing, ngram_join, ogg, packing, pivots, sharding, spelling, token_files, vectors
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.encode_column(table(spark, sf_dir, "documents")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents")))


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.main_text(table(spark, sf_dir, "pages"))


def op9_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


def op11_fingerprint_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id 7 divides are moved to the next; rows whose vec_id 100 divides are anchors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return pivots.hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_license_scan, op4_ogg_media, op5_ngram_jaccard, op6_token_files, op7_lexical_packing, op8_html_main_text, op9_embedding_near_dups, op10_balanced_shards, op11_fingerprint_exchange, op12_spelling_variants, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op3_license_scan": licences.oracle(), "op5_ngram_jaccard": ngram_join.ORACLE, "op9_embedding_near_dups": vectors.ORACLE, "op11_fingerprint_exchange": exact_dedup.ORACLE, "op12_spelling_variants": spelling.ORACLE, "op13_hard_negatives": pivots.ORACLE}
