"""The registered queries of this subpackage: one per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, balltree, bpe, extract, itq, lexical, negatives, packing, quality, secrets, sharding, simhash, warc
from .common import read_table
from .oracle_sql import ORACLE  # noqa: F401


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's columns; the index's own (URL key, time, global order) depend on how the captures are dealt out
    return warc.archive_and_index(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(read_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers
    return bpe.digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label).drop("positive_rank")


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_sharding": op2_sharding,
    "op3_ann": op3_ann,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_html_extract": op8_html_extract,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_search": op13_exact_search,
}
