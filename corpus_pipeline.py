"""The documents' pipeline: toxicity, near duplicates, benchmark leaks, secrets, pieces. Each stage takes all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Whoever
runs the stages writes what each returns and reads it again as the next one's ``docs``, which also bounds each plan.

Null ids and null texts stay (a null text is empty to the operators, has no words and no ids); of repeated ids in a class of near
duplicates one row stays; very long texts are worked on whole. Columns beyond those of ``documents`` are dropped by the first
stage, so their names can't clash. Empty tables give empty results; without labels no document is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.decontaminate import without_leaks
from corpuslab.llm.near_dedup import keep_one
from corpuslab.llm.piece_transducer import encoded
from corpuslab.llm.secret_scan import redact
from corpuslab.llm.shared import written
from corpuslab.llm.toxicity import THRESHOLD, fit, scored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from ``labels`` and the input's texts."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select(*COLUMNS), model, score="_toxicity").where(F.col("_toxicity") < THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id."""
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` counts what is left."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of the documents' texts."""
    out = encoded(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("pieces", pieces)]

#: SQL expresses neither the classifier nor the samples nor the pieces. Tests compare the operators with brute force, and the stages on edge tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
