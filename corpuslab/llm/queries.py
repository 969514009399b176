"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import leaks
from .near_dedup import near_duplicates
from .nearest import nearest
from .piece_transducer import piece_report
from .secret_scan import secret_report
from .sharding import shard
from .substring_dedup import repeat_report
from .token_output import token_output
from .toxicity import toxicity_report
from .url_filter import url_report


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, read back through the last manifest."""
    dataset = shard(table(spark, sf_dir, "documents"), target_bytes=32 << 20)
    return dataset.read().select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_report(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_output, op2_near_dedup, op3_sentencepiece, op4_decontamination, op5_nearest, op6_sharding, op7_toxicity, op8_url_filter, op9_secret_scan, op10_substring_dedup)}

ORACLE: dict[str, str] = {
    "op6_sharding": "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents",
}
