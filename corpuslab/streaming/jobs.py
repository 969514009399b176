"""Incremental jobs over a folder of files: what a checkpoint has seen isn't read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_files(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def dedup_stream(rows: DataFrame, key: Column, output: str, checkpoint: str, *, seen_for: str | None = None, at: str | None = None) -> StreamingQuery:
    """Appends rows whose key is new to ``output`` and stops when all files are read.

    State holds a hash for each key; with ``at`` and ``seen_for`` keys older than that are forgotten, which bounds it.
    """
    keyed = rows.withColumn("_key", F.md5(key))
    if seen_for and at:
        keyed = keyed.withWatermark(at, seen_for).dropDuplicatesWithinWatermark(["_key"])
    else:
        keyed = keyed.dropDuplicates(["_key"])
    return keyed.drop("_key").writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Rows by window of time and column; rows later than ``late`` are dropped. An extension: the reference has no event time."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def new_members(rows: DataFrame, key: str, output: str, checkpoint: str) -> StreamingQuery:
    """Appends each member's key the first time that it is seen."""
    return dedup_stream(rows.select(key), F.col(key).cast("string"), output, checkpoint)
