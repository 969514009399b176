"""Queries that write or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import append_pending, cache_key
from ..sources.work import work_folder
from ..streaming.jobs import dedup_stream, new_members, stream_files, windowed_counts
from .registry import query, table


@query("SELECT min(event_type) AS event_type, user_id FROM events GROUP BY user_id, event_type")
def incremental_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (user, type) from a stream of the events' files."""
    path, schema = f"{d}/events.parquet", table(spark, d, "events").schema
    out = work_folder(spark)
    source = stream_files(spark, path + "*", schema).select("event_type", "user_id")
    dedup_stream(source, F.concat_ws("|", "user_id", "event_type"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("SELECT DISTINCT user_id FROM events")
def incremental_new_keys(spark: SparkSession, d: str) -> DataFrame:
    out = work_folder(spark)
    new_members(stream_files(spark, f"{d}/events.parquet*", table(spark, d, "events").schema), "user_id", f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type", "1 day", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT doc_id, lang FROM documents")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of a job that appends only what is pending."""
    docs, out = table(spark, d, "documents").select("doc_id", "lang"), work_folder(spark)
    append_pending(docs.where("doc_id % 2 = 0"), out, "doc_id")
    append_pending(docs, out, "doc_id")
    return spark.read.parquet(out)


@query("SELECT DISTINCT source, substr(sha256(source || '|' || lang || '|2048'), 1, 12) AS key FROM documents")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", cache_key(F.col("source"), F.col("lang"), F.lit("2048")).alias("key")).distinct()
