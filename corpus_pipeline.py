"""The corpus pipeline: language ID, one document of each group of near copies, mixing by source, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. A stage
works on all that the one before it kept: documents without a language go; of each component of near copies (five-word
shingles, Jaccard 0.8) the smallest doc_id stays; each document comes as often as the mix takes it; what is left is
packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, langid, mixing, ngram_join, packing


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, size=5, percent=80)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", _language_id), ("near_copies", _near_copies), ("mix_sources", _mix), ("lexical_packing", _pack)]
#: SQL can express neither the language model nor the tokenizer: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.cut(docs)
    return docs
