"""A training corpus from ``documents``: filter, deduplicate, mask secrets, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next stage's docs. All but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from canopy.llm import packing, quality, secrets, simhash
from canopy.llm.common import read_table, written

TOKENIZER = "word_bpe_49k.json"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is masked; the documents stay."""
    return secrets.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", good_documents), ("simhash_dedup", one_of_each), ("secrets", without_secrets), ("packing", packed)]

#: SQL can express neither the trees, XXH64, nor the tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
